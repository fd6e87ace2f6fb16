"""Retrieval evaluation over a table of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.retrieve import few
from marlstone.plans.scratch import fresh


def judge(hits: DataFrame, cases: DataFrame, texts: DataFrame, case: str = "case_id", item: str = "chunk_id") -> DataFrame:
    """(case, rank, item, rel): 1 where a hit is what the case expects.

    Snippets decide where a case has any (contained after lower case and one space for white space); else document ids,
    and pages too where pages are given; else pages alone. Cases are joined by their id, not with every text.
    """
    joined = few(hits).join(texts, item).join(cases, case)
    snippets = F.coalesce(F.col("expected_snippets"), F.array().cast("array<string>"))
    docs = F.coalesce(F.col("expected_doc_ids"), F.array().cast("array<string>"))
    pages = F.coalesce(F.col("expected_pages"), F.array().cast("array<int>"))
    return joined.select(case, "rank", item, relevant(T.squash(F.col("text")), F.col("doc_id").cast("string"), F.col("pages"), snippets, docs, pages).cast("int").alias("rel"))


def relevant(text: Column, doc_id: Column, on_pages: Column, snippets: Column, docs: Column, pages: Column) -> Column:
    on_page = F.arrays_overlap(F.coalesce(on_pages, F.array().cast("array<int>")), pages)
    return (
        F.when(F.size(snippets) > 0, F.exists(snippets, lambda s: F.contains(text, T.squash(s))))
        .when(F.size(docs) > 0, F.array_contains(docs, doc_id) & ((F.size(pages) == 0) | on_page))
        .when(F.size(pages) > 0, on_page)
        .otherwise(F.lit(False))
    )


def resolvable(cases: DataFrame, texts: DataFrame, case: str = "case_id") -> DataFrame:
    """Cases that some text satisfies, or all where there are no texts: a left semi join. Cases are a hand-made table and travel in blocks of a fixed size."""
    wants = cases.select(case, F.explode("expected_snippets").alias("s")).select(case, T.squash(F.col("s")).alias("s"))
    if not texts.limit(1).count():
        return cases.select(case)
    n = wants.count()
    blocks = max(1, -(-n // 4096))
    squashed = texts.select(T.squash(F.col("text")).alias("_t"))
    out = None
    for b in range(blocks):
        some = wants if blocks == 1 else wants.filter(F.pmod(F.xxhash64(case, "s"), F.lit(blocks)) == b)
        part = squashed.join(F.broadcast(some), F.contains(F.col("_t"), F.col("s"))).select(case).distinct()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def per_case(rels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), totals: DataFrame | None = None, case: str = "case_id") -> DataFrame:
    """hit_k, precision_k, ndcg_k and, with totals (case, total), recall_k; rr and ap. Precision divides by the hits that there are, not by k."""
    by_rank = Window.partitionBy(case).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rels.withColumn("_hits", F.sum("rel").over(by_rank)).withColumn("_gain", F.col("rel") / F.log2(F.col("rank") + F.lit(1.0)))
    top = F.max("rank")
    outs = [(F.lit(1.0) / F.min(F.when(F.col("rel") == 1, F.col("rank")))).alias("rr"), F.avg(F.when(F.col("rel") == 1, F.col("_hits") / F.col("rank"))).alias("ap"), F.sum("rel").alias("_rel"), top.alias("_n")]
    for k in ks:
        inside = F.col("rank") <= k
        outs += [F.max(F.when(inside, F.col("rel"))).alias(f"hit_{k}"), F.avg(F.when(inside, F.col("rel"))).alias(f"precision_{k}"), F.sum(F.when(inside, F.col("_gain"))).alias(f"_dcg_{k}"), F.sum(F.when(inside, F.col("rel"))).alias(f"_in_{k}")]
    found = rows.groupBy(case).agg(*outs)
    if totals is not None:
        found = found.join(totals, case, "left")
    want = F.col("total") if totals is not None else F.col("_rel")
    cols = [F.col(case), F.coalesce("rr", F.lit(0.0)).alias("rr"), F.coalesce("ap", F.lit(0.0)).alias("ap")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(want, F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
        cols += [F.coalesce(F.col(f"hit_{k}").cast("double"), F.lit(0.0)).alias(f"hit_{k}"), F.coalesce(f"precision_{k}", F.lit(0.0)).alias(f"precision_{k}"), F.when(want > 0, F.col(f"_dcg_{k}") / ideal).otherwise(F.lit(0.0)).alias(f"ndcg_{k}")]
        if totals is not None:
            cols.append(F.when(F.col("total").isNull(), F.col(f"hit_{k}").cast("double")).when(F.col("total") <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col(f"_in_{k}") / F.col("total"))).alias(f"recall_{k}"))
    return found.select(*cols)


def cited_relevant(rels: DataFrame, cited: DataFrame, case: str = "case_id", item: str = "chunk_id") -> DataFrame:
    """(case, cited_relevant): whether one of the items that an answer cites (case, item) is what the case expects; false where it cites none."""
    found = rels.join(fresh(cited.select(case, item).distinct()), [case, item], "left_semi").filter("rel = 1").select(case).distinct().withColumn("_yes", F.lit(True))
    return rels.select(case).distinct().join(found, case, "left").select(case, F.coalesce("_yes", F.lit(False)).alias("cited_relevant"))


def run(cases: DataFrame, hits: DataFrame, answers: DataFrame, texts: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row for each case, as aggregate() takes them: the metrics of its hits (case_id, rank, chunk_id), and of its answer (case_id, answer, grounded, chunk_ids) whether it refused, cites something relevant and holds what it should.

    A case without hits counts as one with no relevant ones; one that no text can satisfy is no fair case (resolvable is false).
    """
    rels = judge(hits, cases, texts)
    metrics = per_case(rels, ks)
    named = cited_relevant(rels, answers.select("case_id", F.explode("chunk_ids").alias("chunk_id")))
    good = resolvable(cases, texts).distinct().withColumn("_good", F.lit(True))
    wants = F.coalesce("expected_answer_contains", F.array().cast("array<string>"))
    misses = F.filter(wants, lambda w: ~F.contains(T.squash(F.coalesce("answer", F.lit(""))), T.squash(w)))
    met = cases.join(metrics, "case_id", "left").join(named, "case_id", "left").join(good, "case_id", "left").join(answers.select("case_id", "answer", "grounded"), "case_id", "left")
    names = [c for c in metrics.columns if c != "case_id"]
    pinned = F.size(F.coalesce("expected_snippets", F.array().cast("array<string>"))) > 0
    out = met.select(
        "case_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names], F.col("unanswerable"), (~pinned | F.coalesce("_good", F.lit(False))).alias("resolvable"), (~F.coalesce("grounded", F.lit(False))).alias("refused"),
        F.lit(0).alias("n_unverified"), F.coalesce("cited_relevant", F.lit(False)).alias("cited_relevant"), (F.size(wants) > 0).alias("answer_checked"), (F.size(misses) > 0).alias("answer_missed"), misses.alias("misses"),
    )
    return out.withColumn("correct", verdict(F.col("unanswerable"), F.col("refused"), F.col("misses"), F.col(f"hit_{max(ks)}") > 0))


def save_report(metrics: DataFrame, results: DataFrame, path: str) -> None:
    """Both tables of a report, as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/metrics")
    results.write.mode("overwrite").json(f"{path.rstrip('/')}/results")


def load_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, results) of a saved report; both can be compared with another's by diff_metrics and diff_cases."""
    root = path.rstrip("/")
    return spark.read.schema("metric string, value double").json(f"{root}/metrics"), spark.read.json(f"{root}/results")


def verdict(unanswerable: Column, refused: Column, misses: Column, any_relevant: Column) -> Column:
    """An unanswerable case is right if refused; another if it isn't, misses nothing and found something relevant."""
    return F.when(unanswerable, refused).otherwise(~refused & (F.coalesce(F.size(misses), F.lit(0)) <= 0) & any_relevant)


def aggregate(results: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, value): the mean of each metric over scored cases (answerable and resolvable; 0 over none), refusal rates and counts.

    results has unanswerable, resolvable, refused, correct, n_unverified, answer_checked, answer_missed and the metrics.
    """
    scored = ~F.col("unanswerable") & F.col("resolvable")
    mean = lambda c, where: F.coalesce(F.avg(F.when(where, c.cast("double"))), F.lit(0.0))
    flag = lambda name: F.col(name).cast("int")
    outs = [mean(F.col(m), scored).alias(m) for m in metrics] + [
        mean(flag("refused"), scored).alias("false_refusal"),
        mean(flag("refused"), F.col("unanswerable")).alias("refusal_accuracy"),
        mean((F.col("n_unverified") > 0).cast("int"), F.lit(True)).alias("hallucinated_citation"),
        F.avg(F.when(F.col("answer_checked"), (~F.col("answer_missed")).cast("double"))).alias("answer_match"),
        F.sum(flag("answer_checked")).cast("double").alias("answer_cases"),
        mean(flag("correct"), scored | F.col("unanswerable")).alias("overall_correct"),
        F.count("*").cast("double").alias("cases"),
        F.sum(flag("unanswerable")).cast("double").alias("unanswerable_cases"),
        F.sum(scored.cast("int")).cast("double").alias("scored_cases"),
        F.sum((~F.col("unanswerable") & ~F.col("resolvable")).cast("int")).cast("double").alias("dataset_errors"),
    ]
    wide = results.agg(*outs)
    return wide.unpivot([], wide.columns, "metric", "value").filter("value IS NOT NULL")


def diff_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, change) of metrics that both reports have."""
    return before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric").withColumn("change", F.col("after") - F.col("before"))


def diff_cases(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: fixed, broken, unchanged and net, over cases that both reports have."""
    met = before.select("case_id", F.col("correct").alias("b")).join(after.select("case_id", F.col("correct").alias("a")), "case_id")
    counts = met.agg(F.count_if(~F.col("b") & F.col("a")).alias("fixed"), F.count_if(F.col("b") & ~F.col("a")).alias("broken"), F.count_if(F.col("b") == F.col("a")).alias("unchanged"))
    return counts.withColumn("net", F.col("fixed") - F.col("broken"))


def render(metrics: DataFrame, most: int = 10) -> str:
    """A report's lines for people."""
    return "\n".join(f"{r['metric']}: {r['value']:.4f}" for r in metrics.orderBy("metric").limit(most * 5).collect())
