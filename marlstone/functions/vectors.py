"""Vector expressions over array<double>."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; the longer vector is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def l2_score(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance): higher is nearer."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return F.lit(1.0) / (F.lit(1.0) + gap)


def unit(a: Column) -> Column:
    """The vector over its length; zero stays zero."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))


def features(text: Column, trigrams: bool = True) -> Column:
    """Tokens of ASCII letters and digits and, with trigrams, the trigrams of each between marks of its start and end."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    if not trigrams:
        return tokens

    def grams(token: Column) -> Column:
        marked = F.concat(F.lit("^"), token, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substr(marked, i, F.lit(3)))

    return F.concat(tokens, F.flatten(F.transform(tokens, grams)))


def bucket(feature: Column, dimension: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("long"), F.lit(dimension)).cast("int")


def sign(feature: Column) -> Column:
    return F.when(F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("s|"), feature)), 1, 8), 16, 10).cast("long"), F.lit(2)) == 0, 1.0).otherwise(-1.0)


def model_version(dimension: int = 256, trigrams: bool = True) -> str:
    return f"md5-hashing-v1-d{dimension}-tri{int(trigrams)}"


def hashed_entries(texts: DataFrame, key: str, text: str, dimension: int = 256, trigrams: bool = True) -> DataFrame:
    """(key, bucket, value): the entries other than zero of the hashed and normalised vectors. Features of a text are counted before anything is shuffled."""
    if dimension < 8:
        raise ValueError("dimension must be at least 8")
    counted = texts.select(key, F.explode(features(F.col(text), trigrams)).alias("f")).groupBy(key, "f").count()
    summed = counted.groupBy(key, bucket(F.col("f"), dimension).alias("bucket")).agg(F.sum(sign(F.col("f")) * F.col("count")).alias("value")).filter("value != 0")
    size = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_size"))
    return summed.join(size, key).select(key, "bucket", (F.col("value") / F.col("_size")).alias("value"))


def hashed_vector(text: Column, dimension: int = 256, trigrams: bool = True) -> Column:
    """The hashed and normalised vector of each text: one pass without a shuffle. A feature is hashed once in a worker, then looked up; a text without features has zeros."""
    if dimension < 8:
        raise ValueError("dimension must be at least 8")
    pattern = re.compile("[a-z0-9]+")

    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[list[int], list[float]]] = {}

        def places(token: str) -> tuple[list[int], list[float]]:
            marked = f"^{token}$"
            feats = [token, *(marked[i : i + 3] for i in range(len(marked) - 2))] if trigrams else [token]
            at = [int(md5(f.encode()).hexdigest()[:8], 16) % dimension for f in feats]
            way = [1.0 if int(md5(b"s|" + f.encode()).hexdigest()[:8], 16) % 2 == 0 else -1.0 for f in feats]
            return at, way

        out = []
        for text in texts:
            buckets: list[int] = []
            values: list[float] = []
            for token, n in Counter(pattern.findall((text or "").lower())).items():
                if token not in known:
                    known[token] = places(token)
                at, way = known[token]
                buckets += at
                values += [w * n for w in way]
            v = np.bincount(buckets, values, dimension) if buckets else np.zeros(dimension)  # sums of whole numbers, so exact in any order
            size = np.sqrt(np.sum(v * v))
            out.append(v / size if size else v)
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(text)


def hashed_embed(texts: DataFrame, key: str, text: str, dimension: int = 256, trigrams: bool = True) -> DataFrame:
    """(key, model_version, vector)."""
    return texts.select(key, F.lit(model_version(dimension, trigrams)).alias("model_version"), hashed_vector(F.col(text), dimension, trigrams).alias("vector"))
