"""Command line: ingest a folder into an index, ask it, evaluate it over a golden set, inspect it. ask ends with 0 if it answered, 1 if it refused; bad usage ends with 2."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import vectors as V
from marlstone.operators import answer, chunk, evaluate, index, retrieve
from marlstone.plans.scratch import cut
from marlstone.session import session
from marlstone.sources import files


def ingest(spark: SparkSession, folder: str, out: str, max_tokens: int = 512, progress: Callable[[str, int], None] | None = None) -> dict:
    """Index the texts of a folder; of what is refused, all rows are written beside the index and the first hundred returned. progress is told each step's name and rows as it ends; an error of its own ends the run."""
    tell = progress or (lambda step, n: None)
    docs, bad = files.documents(spark, folder)
    docs = cut(docs, "documents")
    tell("documents", docs.count())
    once = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    chunks = cut(chunk.chunk(files.text_blocks(once), chunk.ChunkConfig(max_tokens=max_tokens)).withColumn("page", F.coalesce(F.col("provenances")[0]["page"], F.lit(1))), "chunks")
    tell("chunks", chunks.count())
    vectors = V.hashed_embed(chunks, "chunk_id", "text")
    manifest = index.save(spark, out, chunks, vectors, docs.select("path", "doc_id"), max_tokens)
    bad.write.mode("overwrite").json(f"{out.rstrip('/')}/{manifest['version']}/rejected")
    rejected = spark.read.schema("path string, length long, reason string").json(f"{out.rstrip('/')}/{manifest['version']}/rejected")
    tell("rejected", n := rejected.count())
    return {**manifest, "n_rejected": n, "rejected": [r.asDict() for r in rejected.orderBy("path").limit(100).collect()]}


def answers(spark: SparkSession, folder: str, queries: DataFrame, top_k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, passages, chunks) of queries (query_id, query) by a stored index: of its postings only those of the questions' terms are read."""
    manifest, chunks, vectors, _, _ = index.load(spark, folder, V.model_version())
    retrieve.require_one_model(vectors)
    asked = V.hashed_embed(queries, "query_id", "query").select("query_id", F.col("vector").alias("query_vector"))
    hits = cut(answer.retrieve_hits(queries, chunks, retrieve.dense_search(vectors, asked, 20), *index.load_lexical(spark, folder, manifest["version"])), "hits")
    passages = cut(answer.select_passages(queries, hits, chunks, top_k), "passages")
    return answer.extractive(queries, passages, chunks), passages, chunks


def ask(spark: SparkSession, folder: str, questions: Sequence[str], top_k: int = 5) -> list[dict]:
    queries = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "query_id string, query string")
    rows = answers(spark, folder, queries, top_k)[0].join(queries, "query_id").orderBy("query_id").collect()
    return [r.asDict() for r in rows]


def evaluation(spark: SparkSession, folder: str, cases_path: str, report: str | None = None, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(metrics, results) of a golden set (JSON lines) over an index; saved, if report names a folder."""
    cases = cut(files.eval_cases(spark, cases_path), "cases")
    said, passages, chunks = answers(spark, folder, cases.select(F.col("case_id").alias("query_id"), "query"), top_k)
    texts = chunks.select("chunk_id", "doc_id", "text", F.array("page").alias("pages"))
    results = cut(evaluate.run(cases, passages.withColumnRenamed("query_id", "case_id"), said.withColumnRenamed("query_id", "case_id"), texts), "results")
    metrics = cut(evaluate.aggregate(results, [c for c in results.columns if c in ("rr", "ap") or c.split("_")[0] in ("hit", "precision", "ndcg")]), "metrics")
    if report:
        evaluate.save_report(metrics, results, report)
    return metrics, results


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marlstone")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("folder")
    a.add_argument("--index", required=True)
    a.add_argument("--max-tokens", type=int, default=512)
    b = sub.add_parser("ask")
    b.add_argument("question")
    b.add_argument("--index", required=True)
    b.add_argument("--top-k", type=int, default=5)
    b.add_argument("--json", action="store_true")
    c = sub.add_parser("inspect")
    c.add_argument("--index", required=True)
    d = sub.add_parser("eval")
    d.add_argument("cases")
    d.add_argument("--index", required=True)
    d.add_argument("--report")
    d.add_argument("--compare", help="a saved report to compare with")
    d.add_argument("--top-k", type=int, default=5)
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "ingest":
        print(json.dumps(ingest(spark, args.folder, args.index, args.max_tokens, lambda step, n: print(f"{step}: {n}", file=sys.stderr)), default=str))
        return 0
    if args.command == "inspect":
        print(json.dumps(index.load(spark, args.index)[0]))
        return 0
    if args.command == "eval":
        metrics, results = evaluation(spark, args.index, args.cases, args.report, args.top_k)
        print(evaluate.render(metrics))
        if args.compare:
            old, old_results = evaluate.load_report(spark, args.compare)
            for r in evaluate.diff_metrics(old, metrics).orderBy("metric").collect():
                print(f"{r['metric']}: {r['before']:.4f} -> {r['after']:.4f} ({r['change']:+.4f})")
            print(json.dumps(evaluate.diff_cases(old_results, results).first().asDict()))
        return 0
    (row,) = ask(spark, args.index, [args.question], args.top_k)
    print(json.dumps(row, default=str) if args.json else row["answer"])
    return 0 if row["grounded"] else 1


if __name__ == "__main__":
    sys.exit(main())
