"""Retrieval, fusion, answers and evaluation. The benchmark's items are the questions, all of them, against all documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vectors as V
from marlstone.operators import answer, evaluate, fusion, retrieve
from marlstone.plans.scratch import cut
from marlstone.queries.base import Query, table, words

DIM = 64


def chunks(s, d):
    """Documents as chunks of one page each."""
    return table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("page"), F.array(F.lit(1)).alias("pages"))


def questions(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical(s, d, k=20, stop=False):
    c = chunks(s, d)
    if stop:
        return retrieve.bm25_texts(c, retrieve.query_terms(questions(s, d), stop=True), k, k1=1.5, b=0.75, idf="plus_one", drop_not_positive=True)
    return retrieve.bm25_texts(c, retrieve.query_terms(questions(s, d)), k)


def dense(s, d, k=20):
    vectors = V.hashed_embed(chunks(s, d), "chunk_id", "text", DIM, False)
    asked = V.hashed_embed(questions(s, d), "query_id", "query", DIM, False).select("query_id", F.col("vector").alias("query_vector"))
    return retrieve.dense_search(vectors, asked, k)


def hits(s, d):
    mark = lambda df, name, w: df.select("query_id", F.lit(name).alias("source"), "rank", "chunk_id", "score", F.lit(w).alias("weight"))
    return mark(dense(s, d), "dense", 1.0).unionByName(mark(lexical(s, d), "lexical", 1.0))


def hybrid(s, d, method="rrf", k=5):
    """The flagship: BM25 and hashed vectors over all documents for all questions, fused."""
    return fusion.fuse(hits(s, d), method, k).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def centroids(s, d):
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("query_vector"))


def nearest_to_centroids(s, d, measure):
    return retrieve.dense_search(table(s, d, "embeddings"), centroids(s, d), 20, "vec_id", "embedding", "label", "query_vector", measure).select("label", "rank", "vec_id", F.round("score", 6).alias("score"))


_PIECES = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
_BM25 = (
    "dt AS (SELECT doc_id, " + _PIECES.format("text") + " AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)::DOUBLE) AS avgdl FROM dt), "
    "po AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM po GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), "
    "qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(" + _PIECES.format("text") + ") AS term FROM benchmark) {stop} GROUP BY ALL), "
    "sc AS (SELECT query_id, doc_id, round(sum(times * {idf} * tf * {k1p} / (tf + {k1} * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL), "
    "lx AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id AS chunk_id, score FROM sc QUALIFY rank <= 20)"
)


def _fill(template: str, **values: str) -> str:
    """Values in the places of {name}; other braces stay."""
    for k, v in values.items():
        template = template.replace("{" + k + "}", v)
    return template


_LEX = _fill(_BM25, stop="", idf="greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)", k1p="2.2::DOUBLE", k1="1.2::DOUBLE", b="0.75")
_LEX_STOP = _fill(_BM25, stop=f"WHERE term NOT IN {words(T.STOPWORDS)}", idf="ln(1 + (n - df + 0.5) / (df + 0.5))", k1p="2.5::DOUBLE", k1="1.5::DOUBLE", b="0.75")
_HASH = (
    "(SELECT id, b, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM (SELECT id, ('0x' || substr(md5(f), 1, 8))::BIGINT % 64 AS b, sum(CASE WHEN ('0x' || substr(md5('s|' || f), 1, 8))::BIGINT % 2 = 0 THEN k ELSE -k END)::DOUBLE AS v "
    "FROM (SELECT {id} AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS f, 1 AS k FROM {t}) GROUP BY ALL) WHERE v <> 0)"
)
_DENSE = (
    "dv AS " + _HASH.format(id="doc_id", t="documents") + ", qv AS " + _HASH.format(id="item_id", t="benchmark") + ", "
    "ds AS (SELECT q.query_id, d.doc_id, round(coalesce(s.score, 0), 9) AS score FROM (SELECT DISTINCT item_id AS query_id FROM benchmark) q CROSS JOIN (SELECT doc_id FROM documents) d LEFT JOIN (SELECT qv.id AS query_id, dv.id AS doc_id, sum(qv.v * dv.v) AS score FROM qv JOIN dv USING (b) GROUP BY ALL) s USING (query_id, doc_id)), "
    "dn AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id AS chunk_id, score FROM ds QUALIFY rank <= 20)"
)
_HITS = _LEX + ", " + _DENSE + ", h AS (SELECT 'dense' AS source, * FROM dn UNION ALL SELECT 'lexical', * FROM lx)"


def _fused(part: str, k: int = 5) -> str:
    return f"WITH {_HITS}, f AS (SELECT query_id, chunk_id, round(sum(p), 12) AS s FROM (SELECT *, {part} AS p FROM h) GROUP BY ALL) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank, chunk_id, round(s, 6) AS score FROM f QUALIFY rank <= {k}"


_W = "OVER (PARTITION BY query_id, source)"
RRF_SQL = _fused("1.0::DOUBLE / (60 + rank)")
_CENTRES = "c AS (SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(generate_series(0, 63)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL) GROUP BY 1)"


def _near(score: str) -> str:
    return f"WITH {_CENTRES}, s AS (SELECT c.label, vec_id, round({score}, 9) AS sc FROM c, embeddings e) SELECT label, row_number() OVER (PARTITION BY label ORDER BY sc DESC, vec_id) AS rank, vec_id, round(sc, 6) AS score FROM s QUALIFY rank <= 20"


def cases(s, d):
    """The benchmark as a golden set: an item expects a text with its passage."""
    b = table(s, d, "benchmark")
    none = F.array().cast("array<string>")
    return b.select(F.col("item_id").alias("case_id"), F.array("text").alias("expected_snippets"), none.alias("expected_doc_ids"), F.array().cast("array<int>").alias("expected_pages"))


def judged(s, d):
    return evaluate.judge(lexical(s, d, 10).withColumnRenamed("query_id", "case_id"), cases(s, d), chunks(s, d))


_SQUASH = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_JUDGED = f"{_LEX}, j AS (SELECT lx.query_id AS case_id, rank, chunk_id, contains({_SQUASH.format('d.text')}, {_SQUASH.format('b.text')})::INT AS rel FROM lx JOIN documents d ON d.doc_id = lx.chunk_id JOIN benchmark b ON b.item_id = lx.query_id WHERE rank <= 10)"
_RUN = "OVER (PARTITION BY case_id ORDER BY rank)"
_CASES_SQL = f"""{_JUDGED}, r AS (SELECT *, sum(rel) {_RUN} AS hits FROM j),
 t AS (SELECT case_id, coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0) AS rr, coalesce(avg(CASE WHEN rel = 1 THEN hits::DOUBLE / rank END), 0) AS ap, max(CASE WHEN rank <= 5 THEN rel END)::DOUBLE AS hit_5, avg(CASE WHEN rank <= 5 THEN rel END) AS precision_5, sum(CASE WHEN rank <= 5 THEN rel / log2(rank + 1) END) AS dcg, sum(rel) AS total FROM r GROUP BY 1)"""
_IDEAL = "list_sum(list_transform(generate_series(1, least(total, 5)::BIGINT), lambda i: 1 / log2(i + 1)))"
_PER_CASE_SQL = f"WITH {_CASES_SQL} SELECT case_id, round(rr, 6) AS rr, round(ap, 6) AS ap, hit_5, round(precision_5, 6) AS precision_5, round(CASE WHEN total > 0 THEN dcg / {_IDEAL} ELSE 0 END, 6) AS ndcg_5 FROM t"


def per_case(s, d):
    return evaluate.per_case(judged(s, d), (5,))


def results(s, d):
    """Per-case results as the runner has them; a case counts as unanswerable where no document holds its passage, and as refused where nothing relevant is found."""
    good = evaluate.resolvable(cases(s, d), chunks(s, d)).withColumn("resolvable", F.lit(True))
    r = per_case(s, d).join(good, "case_id", "left")
    found = F.col("hit_5") > 0
    return r.select("case_id", "rr", "ap", "hit_5", "precision_5", "ndcg_5", F.col("resolvable").isNull().alias("unanswerable"), F.lit(True).alias("resolvable"), (~found).alias("refused"), F.lit(0).alias("n_unverified"), F.lit(True).alias("answer_checked"), (~found).alias("answer_missed")).withColumn("correct", evaluate.verdict(F.col("unanswerable"), F.col("refused"), F.array().cast("array<string>"), ~F.col("refused")))


_RESULTS = f"""{_CASES_SQL}, w AS (SELECT DISTINCT b.item_id AS case_id FROM benchmark b JOIN documents d ON contains({_SQUASH.format('d.text')}, {_SQUASH.format('b.text')})),
 e AS (SELECT t.*, CASE WHEN total > 0 THEN dcg / {_IDEAL} ELSE 0 END AS ndcg_5, w.case_id IS NULL AS un, hit_5 = 0 AS refused FROM t LEFT JOIN w USING (case_id))"""
_METRICS_SQL = f"""WITH {_RESULTS}, m AS (SELECT coalesce(avg(rr) FILTER (NOT un), 0) AS rr, coalesce(avg(ap) FILTER (NOT un), 0) AS ap, coalesce(avg(hit_5) FILTER (NOT un), 0) AS hit_5, coalesce(avg(precision_5) FILTER (NOT un), 0) AS precision_5, coalesce(avg(ndcg_5) FILTER (NOT un), 0) AS ndcg_5,
 coalesce(avg(refused::INT) FILTER (NOT un), 0) AS false_refusal, coalesce(avg(refused::INT) FILTER (un), 0) AS refusal_accuracy, 0.0::DOUBLE AS hallucinated_citation, avg((NOT refused)::INT) AS answer_match, count(*)::DOUBLE AS answer_cases, avg((un = refused)::INT) AS overall_correct, count(*)::DOUBLE AS cases, count(*) FILTER (un)::DOUBLE AS unanswerable_cases, count(*) FILTER (NOT un)::DOUBLE AS scored_cases, 0.0::DOUBLE AS dataset_errors FROM e)
 SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)"""


def _metric_report(s, d, stop):
    c, q = chunks(s, d), cases(s, d)
    r = evaluate.judge(lexical(s, d, 10, stop).withColumnRenamed("query_id", "case_id"), q, c)
    p = evaluate.per_case(r, (5,))
    return p.agg(F.avg("rr").alias("mrr"), F.avg("ap").alias("map"), F.avg("hit_5").alias("hit_5")).unpivot([], ["mrr", "map", "hit_5"], "metric", "value")


def _averages(lexical: str, lx: str, n: str) -> str:
    """CTEs of the three metrics over ranked lists of a lexical search."""
    return f"""{lexical}, j{n} AS (SELECT {lx}.query_id AS case_id, rank, contains({_SQUASH.format('d.text')}, {_SQUASH.format('b.text')})::INT AS rel FROM {lx} JOIN documents d ON d.doc_id = {lx}.chunk_id JOIN benchmark b ON b.item_id = {lx}.query_id WHERE rank <= 10),
    r{n} AS (SELECT *, sum(rel) {_RUN} AS hits FROM j{n}), t{n} AS (SELECT case_id, coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0) AS rr, coalesce(avg(CASE WHEN rel = 1 THEN hits::DOUBLE / rank END), 0) AS ap, max(CASE WHEN rank <= 5 THEN rel END)::DOUBLE AS h FROM r{n} GROUP BY 1),
    m{n} AS (SELECT unnest(['mrr', 'map', 'hit_5']) AS metric, unnest([avg(rr), avg(ap), avg(h)]) AS value FROM t{n})"""


_DIFF_SQL = f"WITH {_averages(_LEX, 'lx', 'a')}, {_averages(re.sub(r'\b(dt|st|po|tf|df|qt|sc|lx)\b', lambda m: m[1] + '2', _LEX_STOP), 'lx2', 'b')} SELECT metric, round(ma.value, 6) AS before, round(mb.value, 6) AS after, round(mb.value - ma.value, 6) AS change FROM ma JOIN mb USING (metric)"


def rerank_scores(s, d, found=None):
    """The reranker's BM25 over each question's own candidates."""
    c = retrieve.few(lexical(s, d) if found is None else found).join(chunks(s, d).select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "text")
    return fusion.lexical_scores(questions(s, d), c)


_STEM = "CASE WHEN {0} LIKE '%ies' AND length({0}) > 4 THEN left({0}, -3) || 'y' WHEN {0} LIKE '%ing' AND length({0}) > 5 THEN left({0}, -3) WHEN {0} LIKE '%ed' AND length({0}) > 4 THEN left({0}, -2) WHEN {0} LIKE '%s' AND {0} NOT LIKE '%ss' AND length({0}) > 3 THEN left({0}, -1) ELSE {0} END"
_RERANK_CTE = f"""{_LEX}, cd AS (SELECT query_id, chunk_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: {_STEM.format('w')}) AS t FROM lx JOIN documents ON doc_id = chunk_id),
 cs AS (SELECT query_id, count(*) AS n, avg(len(t)::DOUBLE) AS avgdl FROM cd GROUP BY 1), ct AS (SELECT query_id, chunk_id, len(t) AS dl, unnest(t) AS term FROM cd),
 qs AS (SELECT DISTINCT query_id, {_STEM.format('w')} AS term FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)),
 cf AS (SELECT query_id, chunk_id, dl, term, count(*) AS tf FROM ct JOIN qs USING (query_id, term) GROUP BY ALL), cdf AS (SELECT query_id, term, count(*) AS df FROM cf GROUP BY ALL),
 rs AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS sc FROM cf JOIN cdf USING (query_id, term) JOIN cs USING (query_id) GROUP BY ALL),
 ra AS (SELECT query_id, chunk_id, rank, score, coalesce(sc, 0) AS sc FROM lx LEFT JOIN rs USING (query_id, chunk_id))"""

QUERIES: dict[str, Query] = {
    "hybrid_search": Query(hybrid, RRF_SQL),
    "rrf_fuse": Query(lambda s, d: hybrid(s, d, "rrf", 10), _fused("1.0::DOUBLE / (60 + rank)", 10)),
    "relative_fuse": Query(lambda s, d: hybrid(s, d, "relative_score"), _fused(f"CASE WHEN max(score) {_W} = min(score) {_W} THEN 1 ELSE (score - min(score) {_W}) / (max(score) {_W} - min(score) {_W}) END")),
    "zscore_fuse": Query(lambda s, d: hybrid(s, d, "distribution"), _fused(f"CASE WHEN stddev_pop(score) {_W} = 0 THEN 0 ELSE (score - avg(score) {_W}) / stddev_pop(score) {_W} END")),
    "rank_lists": Query(lambda s, d: hits(s, d).select("query_id", "source", "rank", "chunk_id"), f"WITH {_HITS} SELECT query_id, source, rank, chunk_id FROM h"),
    "candidates_considered": Query(lambda s, d: fusion.candidates_considered(hits(s, d)), f"WITH {_HITS} SELECT query_id, count(DISTINCT chunk_id) AS candidates FROM h GROUP BY 1"),
    "bm25_search": Query(lambda s, d: lexical(s, d).withColumn("score", F.round("score", 6)), f"WITH {_LEX} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM lx"),
    "bm25_stopwords": Query(lambda s, d: lexical(s, d, 20, True).withColumn("score", F.round("score", 6)), f"WITH {_LEX_STOP} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM lx"),
    "dense_topk": Query(lambda s, d: nearest_to_centroids(s, d, "cosine"), _near("list_cosine_similarity(q, e.embedding::DOUBLE[])")),
    "l2_topk": Query(lambda s, d: nearest_to_centroids(s, d, "l2"), _near("1 / (1 + list_distance(q, e.embedding::DOUBLE[]) ** 2)")),
    "df_stats": Query(
        lambda s, d: retrieve.document_frequency(retrieve.postings(chunks(s, d))),
        "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(" + _PIECES.format("text") + ") AS term FROM documents) GROUP BY 1",
    ),
    "corpus_stats": Query(lambda s, d: retrieve.corpus_stats(chunks(s, d)).select("n", F.round("avgdl", 6).alias("avgdl")), "SELECT count(*) AS n, round(avg(len(" + _PIECES.format("text") + ")::DOUBLE), 6) AS avgdl FROM documents"),
    "relevance_gate": Query(
        lambda s, d: retrieve.gate(questions(s, d), hits(s, d), chunks(s, d)),
        f"WITH {_HITS}, q AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+'), lambda w: length(w) > 2 AND w NOT IN {words(T.STOPWORDS)}) AS terms FROM benchmark), b AS (SELECT q.query_id, max(len(list_filter(terms, lambda w: contains(lower(d.text), w))) / len(terms)::DOUBLE) AS best FROM h JOIN q USING (query_id) JOIN documents d ON d.doc_id = h.chunk_id WHERE rank <= 5 GROUP BY 1) SELECT q.query_id, len(terms) = 0 OR coalesce(best, 0) >= 0.5 AS passed FROM q LEFT JOIN b USING (query_id)",
    ),
    "lexical_rerank_scores": Query(lambda s, d: rerank_scores(s, d).withColumn("score", F.round("score", 6)), f"WITH {_RERANK_CTE} SELECT query_id, chunk_id, round(sc, 6) AS score FROM ra"),
    "rerank_head": Query(
        lambda s, d: fusion.rerank(found := lexical(s, d), rerank_scores(s, d, found).withColumn("score", F.round("score", 9)), 8, 0.75).withColumn("score", F.round("score", 6)),
        f"""WITH {_RERANK_CTE}, hd AS (SELECT query_id, chunk_id, round(0.75::DOUBLE * CASE WHEN max(round(sc, 9)) OVER w = min(round(sc, 9)) OVER w THEN 1 ELSE (round(sc, 9) - min(round(sc, 9)) OVER w) / (max(round(sc, 9)) OVER w - min(round(sc, 9)) OVER w) END + 0.25::DOUBLE * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 12) AS s FROM ra WHERE rank <= 8 WINDOW w AS (PARTITION BY query_id))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank, chunk_id, round(s, 6) AS score FROM hd UNION ALL SELECT query_id, rank, chunk_id, round(score, 6) FROM lx WHERE rank > 8""",
    ),
    "mmr_select": Query(lambda s, d: fusion.mmr(hybrid(s, d, "rrf", 20), V.hashed_embed(chunks(s, d), "chunk_id", "text", DIM, False), 5, 0.5)),
    "near_dup_cut": Query(lambda s, d: fusion.distinct_texts(lexical(s, d), chunks(s, d))),
    "ask_extractive": Query(lambda s, d: answer.extractive(questions(s, d), answer.select_passages(questions(s, d), hits(s, d), chunks(s, d)), chunks(s, d).withColumn("chunk_id", F.col("chunk_id"))).select("query_id", "answer", "grounded", "pages")),
    "judge_relevance": Query(judged, f"WITH {_JUDGED} SELECT case_id, rank, chunk_id, rel FROM j"),
    "resolvable_cases": Query(lambda s, d: evaluate.resolvable(cases(s, d), chunks(s, d)), f"SELECT DISTINCT item_id AS case_id FROM benchmark b JOIN documents d ON contains({_SQUASH.format('d.text')}, {_SQUASH.format('b.text')})"),
    "case_metrics": Query(lambda s, d: per_case(s, d).select("case_id", *[F.round(c, 6).alias(c) for c in ("rr", "ap", "hit_5", "precision_5", "ndcg_5")]), _PER_CASE_SQL),
    "eval_report": Query(lambda s, d: evaluate.aggregate(results(s, d), ["rr", "ap", "hit_5", "precision_5", "ndcg_5"]).select("metric", F.round("value", 6).alias("value")), _METRICS_SQL),
    "report_diff": Query(
        lambda s, d: evaluate.diff_metrics(_metric_report(s, d, False), _metric_report(s, d, True)).select("metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "change")]),
        _DIFF_SQL,
    ),
    "case_diff": Query(
        lambda s, d: evaluate.diff_cases(*[table(s, d, "labels").select(F.col("doc_id").alias("case_id"), c.alias("correct")) for c in (F.col("quality") == 1, F.col("toxic") == 0)]),
        "SELECT *, fixed - broken AS net FROM (SELECT count(*) FILTER (quality <> 1 AND toxic = 0) AS fixed, count(*) FILTER (quality = 1 AND toxic <> 0) AS broken, count(*) FILTER ((quality = 1) = (toxic = 0)) AS unchanged FROM labels)",
    ),
    "recall_at_5": Query(
        lambda s, d: evaluate.per_case(judged(s, d), (5,), judged(s, d).groupBy("case_id").agg(F.sum("rel").alias("total")).withColumn("total", F.when(F.pmod("case_id", F.lit(5)) != 0, F.col("total") + F.pmod("case_id", F.lit(3)))).filter("total IS NOT NULL")).select("case_id", F.round("recall_5", 6).alias("recall_5")),
        f"WITH {_JUDGED} SELECT case_id, round(CASE WHEN case_id % 5 = 0 THEN max(CASE WHEN rank <= 5 THEN rel END)::DOUBLE WHEN sum(rel) + case_id % 3 = 0 THEN 0 ELSE least(1, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END)::DOUBLE / (sum(rel) + case_id % 3)) END, 6) AS recall_5 FROM j GROUP BY case_id",
    ),
    "cited_relevant": Query(lambda s, d: evaluate.cited_relevant(j := cut(judged(s, d), "judged"), j.filter("rank <= 2").select("case_id", "chunk_id")), f"WITH {_JUDGED} SELECT case_id, coalesce(max(CASE WHEN rank <= 2 THEN rel END), 0) = 1 AS cited_relevant FROM j GROUP BY 1"),
    "zero_weight_lists": Query(
        lambda s, d: fusion.fuse(hits(s, d).withColumn("weight", F.when(F.col("source") == "dense", 0.0).otherwise(2.0)), "rrf", 5).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score")),
        f"WITH {_LEX} SELECT query_id, rank, chunk_id, round(2.0::DOUBLE / (60 + rank), 6) AS score FROM lx WHERE rank <= 5",
    ),
    "stored_index_search": Query(lambda s, d: retrieve.bm25(retrieve.with_frequency(retrieve.postings(chunks(s, d))), retrieve.corpus_stats(chunks(s, d)), retrieve.query_terms(questions(s, d)), 20).withColumn("score", F.round("score", 6)), f"WITH {_LEX} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM lx"),
}
