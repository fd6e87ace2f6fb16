"""A training corpus from documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import mixing, packing, rules, secrets, simhash
from marlstone.llm.common import join_stats, materialise, placed, scratch_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep; null and wordless texts go."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    learned = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.judge(docs, learned, prefix=prefix).filter(prefix + "kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the smallest id, of several such rows the least by the hashes of their texts and other columns; a null id comes last. Rows are told apart by their place in their file, so rows that share an id alone all stay."""
    docs, file, index = placed(docs)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.xxhash64("text").alias("t"), (F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)).cast("long").alias("o"), file.alias("f"), index.alias("i"))
    found = materialise(simhash.near_duplicates(docs, beside=row).select("component", "id", "beside.*"), "near")
    first = found.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t", "o", "f", "i")).alias("first")).filter("n > 1")
    gone = join_stats(found, first, "component", "n").filter("NOT (f = first.f AND i = first.i)").select(F.col("f").alias("_f"), F.col("i").alias("_i"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns], file.alias("_f"), index.alias("_i"))
    return rows.join(gone, ["_f", "_i"], "left_anti").select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets masked in its text and n_chars as the text is then."""
    return secrets.mask(docs, radius=None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target takes: none, one or two rows, more of those with diverse words."""
    return mixing.take(docs, worth=mixing.diversity(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return packing.pack(docs, prompt_end="\n").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality rules", quality), ("near-duplicates", near_dedup), ("secret scan", secret_scan), ("source mix", mix), ("packing", pack)]

#: Learned rules and tokenisation are beyond SQL: tests/llm hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
