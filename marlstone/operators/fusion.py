"""Rank fusion, reranking, diversification and near-duplicate cuts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.retrieve import few, top_k

METHODS = ("rrf", "relative_score", "distribution")


def fuse(hits: DataFrame, method: str = "rrf", k: int = 10, rrf_k: int = 60, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """(query, rank, item, score, contributions, ranks) from hits (query, source, rank, item, score, weight).

    rrf adds weight / (rrf_k + rank), relative_score weight times the score between a list's least and greatest (a flat list: 1),
    distribution weight times its distance from the list's mean in population deviations (no variance: 0). Lists of weight 0
    vanish. An item twice in a list counts once, at its best rank.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    once = Window.partitionBy(query, "source", item).orderBy("rank")
    live = hits.filter("weight > 0").withColumn("_first", F.row_number().over(once)).filter("_first = 1")
    each = Window.partitionBy(query, "source")
    low, high, mean, sd = F.min("score").over(each), F.max("score").over(each), F.avg("score").over(each), F.stddev_pop("score").over(each)
    base = {
        "rrf": F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank")),
        "relative_score": F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)),
        "distribution": F.when(sd == 0, F.lit(0.0)).otherwise((F.col("score") - mean) / sd),
    }[method]
    parts = live.withColumn("_part", F.col("weight") * base)
    fused = parts.groupBy(query, item).agg(F.round(F.sum("_part"), 12).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "_part")))).alias("contributions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank")))).alias("ranks"))
    return top_k(fused, k, query, item).select(query, "rank", item, "score", "contributions", "ranks")


def candidates_considered(hits: DataFrame, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    return hits.filter("weight > 0").groupBy(query).agg(F.count_distinct(item).alias("candidates"))


def lexical_scores(queries: DataFrame, candidates: DataFrame, query: str = "query_id", item: str = "chunk_id", query_text: str = "query", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, item, score): BM25 of stemmed terms over each question's own candidates; idf is ln(1 + (n - df + 0.5) / (df + 0.5)). A candidate without a term scores 0."""
    terms = candidates.select(query, item, F.transform(T.ascii_tokens(F.col(text)), T.stem).alias("_t"))
    sized = terms.withColumn("dl", F.size("_t").cast("double"))
    stats = sized.groupBy(query).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select(query, F.explode(F.array_distinct(F.transform(T.ascii_tokens(F.col(query_text)), T.stem))).alias("term"))
    tf = sized.select(query, item, "dl", F.explode("_t").alias("term")).join(asked, [query, "term"]).groupBy(query, item, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(query, "term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, [query, "term"]).join(stats, query).groupBy(query, item).agg(F.sum(gain).alias("score"))
    return candidates.select(query, item).join(scored, [query, item], "left").select(query, item, F.coalesce("score", F.lit(0.0)).alias("score"))


def rerank(ranked: DataFrame, scores: DataFrame, budget: int, weight: float = 1.0, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """ranked (query, rank, item, score) with its first `budget` items in the order of
    weight * minmax(new score) + (1 - weight) * minmax(old score); the others follow as they were."""
    head = ranked.filter(F.col("rank") <= budget).join(scores.select(query, item, F.col("score").alias("_new")), [query, item], "left").withColumn("_new", F.coalesce("_new", F.lit(0.0)))
    w = Window.partitionBy(query)

    def minmax(c: str):
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high == low, F.lit(1.0)).otherwise((F.col(c) - low) / (high - low))

    head = head.withColumn("score", F.round(weight * minmax("_new") + (1 - weight) * minmax("score"), 12))
    head = head.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), item))).select(query, "rank", item, "score")
    return head.unionByName(ranked.filter(F.col("rank") > budget).select(query, "rank", item, "score"))


def mmr(ranked: DataFrame, vectors: DataFrame, k: int, trade: float = 0.5, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """(query, rank, item, score) by maximal marginal relevance: relevance against likeness to what is chosen already.

    A greedy choice, so each question's pool (which ranked has cut to a fixed size) is one group. Items without a vector follow at the end; scores don't change.
    """
    pool = ranked.join(vectors.select(item, "vector"), item, "left").select(query, "rank", item, "score", "vector")
    kinds = {c: t for c, t in ranked.dtypes}

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
        has = rows["vector"].notna().to_numpy()
        with_vector = rows[has].reset_index(drop=True)
        picked: list[int] = []
        if len(with_vector):
            score = with_vector["score"].to_numpy(float)
            spread = score.max() - score.min()
            relevance = (score - score.min()) / spread if spread else np.ones(len(score))
            x = np.stack(with_vector["vector"].to_numpy())
            size = np.linalg.norm(x, axis=1)
            x = x / np.where(size == 0, 1, size)[:, None]
            like = np.full(len(x), -np.inf)
            left = list(range(len(x)))
            while left and len(picked) < k:
                value = [trade * relevance[i] - (1 - trade) * (like[i] if picked else 0.0) for i in left]
                best = left.pop(int(np.argmax(value)))
                picked.append(best)
                like = np.maximum(like, x @ x[best])
        out = pd.concat([with_vector.iloc[picked], with_vector.drop(index=picked), rows[~has]]).head(k)
        return out.assign(rank=range(1, len(out) + 1))[[query, "rank", item, "score"]]

    return pool.groupBy(query).applyInPandas(choose, f"{query} {kinds[query]}, rank int, {item} {kinds[item]}, score double")


def distinct_texts(ranked: DataFrame, texts: DataFrame, threshold: float = 0.9, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """ranked without items that nearly repeat a better one: shared words over the smaller set of words above the threshold.

    A fold over each question's ranked candidates, which are of a fixed number. Texts without words go; a threshold of 1 keeps all.
    """
    if threshold >= 1:
        return ranked
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: w != ""))
    held = few(ranked).join(texts.select(item, "text"), item).select(query, F.struct("rank", item, "score", words.alias("words")).alias("_x")).groupBy(query).agg(F.array_sort(F.collect_list("_x")).alias("_all"))
    empty = F.slice(F.col("_all"), 1, 0)

    def step(kept, x):
        alike = F.exists(kept, lambda y: F.size(F.array_intersect(x["words"], y["words"])) / F.least(F.size(x["words"]), F.size(y["words"])) > threshold)
        return F.when((F.size(x["words"]) == 0) | alike, kept).otherwise(F.concat(kept, F.array(x)))

    return held.select(query, F.posexplode(F.aggregate("_all", empty, step)).alias("_p", "_x")).select(query, (F.col("_p") + 1).alias("rank"), F.col(f"_x.{item}").alias(item), F.col("_x.score").alias("score"))
