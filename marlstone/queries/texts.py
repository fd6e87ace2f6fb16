"""Scans, sinks and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import vectors as V
from marlstone.operators import answer, layout
from marlstone.queries.base import Query, literals, table, words
from marlstone.sources import files, html

_docs = lambda s, d: table(s, d, "documents")
_conv = lambda s, d: table(s, d, "conversations")

_MD = [(1, "# Manual\n\nFirst line\nsecond line\n\n## Parts\n- one\n* two\nafter\n\n\nend"), (2, "plain"), (3, ""), (4, "####### no\n#no\n###  deep  heading \n+ item")]
_md_df, _md_sql = literals("doc_id bigint, text string", _MD)
_CJK_ROWS = [(1, "漢字かな交じり文 with latin words 123"), (2, "한국어 문장"), (3, "none here, 4.5%"), (4, "  "), (5, "契約書")]
_cjk_df, _cjk_sql = literals("id bigint, text string", _CJK_ROWS)


def _blocks(spark, d):
    """Conversations as blocks: system turns are page headers, users' turns headings, the others paragraphs."""
    kind = F.when(F.col("role") == "system", "page_header").when(F.col("role") == "user", "heading").otherwise("paragraph")
    return _conv(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("reading_order"), kind.alias("type"), F.when(F.col("role") == "user", 2).alias("level"), "text")


_LATIN = "greatest(length(t) / 4.0::DOUBLE, w * 1.3::DOUBLE, w * 0.9::DOUBLE + len(regexp_extract_all(t, '[^\\p{L}\\p{N}\\p{Z}\\s]')) + len(regexp_extract_all(t, '\\p{Nd}')))"
_EAST = T._CJK
TOKENS_SQL = f"SELECT id, CASE WHEN s = '' THEN 0 ELSE greatest(1, floor(c + CASE WHEN trim(t) = '' THEN 0 ELSE {_LATIN} END)) END::BIGINT AS tokens FROM (SELECT id, s, c, t, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS w FROM (SELECT id, s, len(regexp_extract_all(s, '{_EAST}')) AS c, regexp_replace(s, '{_EAST}', '', 'g') AS t FROM (SELECT id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM (@))))"


def _prices(spark, d):
    """Order totals written as people write money; the way hangs on the key."""
    two = F.format_number("o_totalprice", 2)  # 1,234.50
    swap = F.translate(two, ",.", ".,")
    way = F.pmod("o_orderkey", F.lit(5))
    raw = F.when(way == 0, F.concat(F.lit("$"), two)).when(way == 1, F.concat(F.lit("EUR "), swap)).when(way == 2, F.concat(F.lit("("), two, F.lit(")"))).when(way == 3, F.concat(F.lit("-"), two, F.lit(" usd"))).otherwise(F.replace(two, F.lit(","), F.lit(" ")))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))


def _dates(spark, d):
    way = F.pmod("o_orderkey", F.lit(6))
    f = lambda p: F.date_format("o_orderdate", p)
    raw = F.when(way == 0, f("yyyy-MM-dd")).when(way == 1, f("yyyy/M/d")).when(way == 2, f("d MMMM yyyy")).when(way == 3, f("MMM d, yyyy")).when(way == 4, f("yyyy.MM.dd")).otherwise(f("dd/MM/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))


QUERIES: dict[str, Query] = {
    "doc_ids": Query(lambda s, d: _docs(s, d).select("doc_id", T.doc_id(F.col("text")).alias("content_id")), "SELECT doc_id, 'doc:' || substr(sha256(text), 1, 16) AS content_id FROM documents"),
    "screen_sizes": Query(
        lambda s, d: _docs(s, d).select(F.coalesce(files.screen(F.octet_length("text"), files.Limits(max_bytes=16384, min_bytes=64)), F.lit("ok")).alias("reason"), F.octet_length("text").cast("long").alias("n")).groupBy("reason").agg(F.count("*").alias("files"), F.sum("n").alias("bytes")),
        "SELECT CASE WHEN strlen(text) < 64 THEN 'empty' WHEN strlen(text) > 16384 THEN 'too_large' ELSE 'ok' END AS reason, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1",
    ),
    "source_dispatch": Query(
        lambda s, d: table(s, d, "pages").select("page_id", F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".MD", ".pdf", ".html", ".bin", ".txt", "")]), (F.pmod("page_id", F.lit(6)) + 1).cast("int"))).alias("path")).select("page_id", F.coalesce(files.source_of(F.col("path")), F.lit("none")).alias("source")),
        "SELECT page_id, ['text', 'pdf', 'rich', 'none', 'text', 'none'][page_id % 6 + 1] AS source FROM pages",
    ),
    "markdown_blocks": Query(
        lambda s, d: files.text_blocks(_docs(s, d).select("doc_id", "text").unionByName(_md_df(s).withColumn("doc_id", -F.col("doc_id")))).select("doc_id", "block_index", "type", "level", F.md5("text").alias("digest")),
        f"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM ({_md_sql})),
        l AS (SELECT doc_id, unnest(generate_series(1, len(parts))) AS n, trim(regexp_replace(unnest(parts), '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS parts FROM t)),
        k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN 'heading' WHEN regexp_matches(line, '^[-*+]\\s+\\S') THEN 'list_item' ELSE 'paragraph' END AS type FROM l),
        g AS (SELECT *, sum(CASE WHEN type <> 'paragraph' OR lag(type) OVER w IS NULL OR lag(type) OVER w <> 'paragraph' THEN 1 ELSE 0 END) OVER w AS b FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM k) WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        j AS (SELECT doc_id, b, type, CASE WHEN type = 'heading' THEN length(regexp_extract(min(line), '^(#{{1,6}})\\s', 1)) END AS level, string_agg(CASE WHEN type = 'heading' THEN regexp_replace(line, '^#{{1,6}}\\s+', '') WHEN type = 'list_item' THEN regexp_replace(line, '^[-*+]\\s+', '') ELSE line END, ' ' ORDER BY n) AS text FROM g WHERE type <> 'blank' GROUP BY doc_id, b, type)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS block_index, type, level, md5(text) AS digest FROM j""".replace("lag(type) OVER w", "before"),
    ),
    "heading_paths": Query(
        lambda s, d: files.heading_paths(files.text_blocks(_md_df(s))).select("doc_id", "block_index", F.array_join("heading_path", " > ").alias("path")),
        "SELECT * FROM (VALUES (1, 0, 'Manual'), (1, 1, 'Manual'), (1, 2, 'Manual > Parts'), (1, 3, 'Manual > Parts'), (1, 4, 'Manual > Parts'), (1, 5, 'Manual > Parts'), (1, 6, 'Manual > Parts'), (2, 0, ''), (4, 0, ''), (4, 1, 'deep heading'), (4, 2, 'deep heading')) v(doc_id, block_index, path)",
    ),
    "html_block_counts": Query(
        lambda s, d: html.html_blocks(table(s, d, "pages")).groupBy("page_id", "type").agg(F.count("*").alias("blocks")),
        None,
    ),
    "document_text": Query(lambda s, d: layout.to_text(_blocks(s, d)).select("doc_id", F.md5("text").alias("digest")), "SELECT conv_id AS doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS digest FROM conversations WHERE role <> 'system' GROUP BY 1"),
    "markdown_sink": Query(lambda s, d: layout.to_markdown(_blocks(s, d)).select("doc_id", F.md5("markdown").alias("digest")), "SELECT conv_id AS doc_id, md5(string_agg(CASE WHEN role = 'user' THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn, text)) AS digest FROM conversations WHERE role <> 'system' GROUP BY 1"),
    "token_estimate": Query(lambda s, d: _docs(s, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens")), TOKENS_SQL.replace("@", "SELECT doc_id AS id, text FROM documents").replace("SELECT id, CASE", "SELECT id AS doc_id, CASE", 1)),
    "cjk_tokens": Query(lambda s, d: _cjk_df(s).select("id", T.estimate_tokens(F.col("text")).alias("tokens")), TOKENS_SQL.replace("@", _cjk_sql)),
    "stem_tokens": Query(
        lambda s, d: _docs(s, d).select(F.explode(F.transform(T.ascii_tokens(F.col("text")), T.stem)).alias("stem")).groupBy("stem").agg(F.count("*").alias("n")),
        """WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
        SELECT CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, -3) || 'y' WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, -3) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, -1) ELSE w END AS stem, count(*) AS n FROM t GROUP BY 1""",
    ),
    "dehyphenate": Query(
        lambda s, d: _docs(s, d).select("doc_id", F.md5(T.dehyphenate(F.regexp_replace("text", " (?=[a-z])", "-\n"))).alias("digest")),
        "SELECT doc_id, md5(regexp_replace(regexp_replace(text, ' ([a-z])', '-' || chr(10) || '\\1', 'g'), '(\\p{L})-\\n(\\p{Ll})', '\\1\\2', 'g')) AS digest FROM documents",
    ),
    "mask_digits": Query(lambda s, d: _docs(s, d).select("doc_id", F.md5(T.mask_digits(F.col("text"))).alias("digest")), "SELECT doc_id, md5(regexp_replace(text, '\\p{Nd}+', '#', 'g')) AS digest FROM documents"),
    "number_parse": Query(lambda s, d: _prices(s, d).select("o_orderkey", F.round(T.parse_number(F.col("raw")), 2).alias("value")), "SELECT o_orderkey, round(CASE WHEN o_orderkey % 5 IN (2, 3) THEN -o_totalprice ELSE o_totalprice END, 2) AS value FROM orders"),
    "date_coerce": Query(lambda s, d: _dates(s, d).select("o_orderkey", T.coerce_date(F.col("raw")).alias("day")), "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"),
    "iso_check": Query(lambda s, d: _dates(s, d).select("o_orderkey", T.is_iso_date(F.col("raw")).alias("iso")), "SELECT o_orderkey, o_orderkey % 6 = 0 AS iso FROM orders"),
    "trigrams": Query(
        lambda s, d: _docs(s, d).select(F.explode(V.features(F.col("text"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).select("feature", V.bucket(F.col("feature"), 256).alias("bucket"), V.sign(F.col("feature")).alias("sign"), "n"),
        """WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT w, count(*) AS k FROM t GROUP BY 1),
        f AS (SELECT w AS feature, k FROM c UNION ALL SELECT unnest(list_transform(generate_series(1, length(w)), lambda i: substr('^' || w || '$', i::BIGINT, 3))), k FROM c)
        SELECT feature, (('0x' || substr(md5(feature), 1, 8))::BIGINT % 256)::BIGINT AS bucket, CASE WHEN ('0x' || substr(md5('s|' || feature), 1, 8))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign, sum(k)::BIGINT AS n FROM f GROUP BY 1""",
    ),
    "url_extract": Query(
        lambda s, d: table(s, d, "pages").select("page_id", F.array_join(T.urls(F.concat(F.lit("see ("), F.col("url"), F.lit("), or "), F.col("url"), F.lit("."))), " ").alias("found")),
        "SELECT page_id, url || ' ' || url AS found FROM pages",
    ),
    "content_terms": Query(
        lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(T.content_terms(F.col("text")), " ").alias("terms")),
        f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+'), lambda w: length(w) > 2 AND w NOT IN {words(T.STOPWORDS)}), ' ') AS terms FROM benchmark",
    ),
    "quote_project": Query(lambda s, d: _docs(s, d).select("doc_id", F.md5(answer.quote(F.col("text"))).alias("digest")), "SELECT doc_id, md5(left(text, 400)) AS digest FROM documents"),
    "citation_markers": Query(
        lambda s, d: _conv(s, d).select("conv_id", "turn", F.concat(F.lit("as ["), F.col("turn").cast("string"), F.lit("] and ["), (F.col("turn") + 3).cast("string"), F.lit("], but ["), F.col("turn").cast("string"), F.lit("][100]")).alias("a")).select("conv_id", "turn", *[F.array_join(m.cast("array<string>"), ",").alias(n) for m, n in zip(answer.citation_markers(F.col("a"), F.lit(5)), ("valid", "unverified"), strict=True)]),
        "SELECT conv_id, turn, array_to_string(list_filter([turn, turn + 3], lambda x: x BETWEEN 1 AND 5), ',') AS valid, array_to_string(list_filter([turn, turn + 3], lambda x: x NOT BETWEEN 1 AND 5), ',') AS unverified FROM conversations",
    ),
    "page_lists": Query(
        lambda s, d: _conv(s, d).groupBy("conv_id").agg(F.collect_list(F.struct((F.floor(F.col("turn") / 3) + 1).alias("page"))).alias("p")).select("conv_id", F.array_join(answer.pages(F.col("p")).cast("array<string>"), ",").alias("pages"), answer.first_page(F.array_sort("p")).alias("first")),
        "SELECT conv_id, string_agg(DISTINCT (turn // 3 + 1)::VARCHAR, ',' ORDER BY (turn // 3 + 1)::VARCHAR) AS pages, min(turn // 3 + 1) AS first FROM conversations GROUP BY 1",
    ),
    "cache_keys": Query(
        lambda s, d: _docs(s, d).select("doc_id", T.cache_key(F.lit("embed"), F.col("lang"), F.col("source")).alias("key")),
        "SELECT doc_id, 'embed:' || sha256('[\"' || lang || '\",\"' || source || '\"]') AS key FROM documents",
    ),
    "normalised_text": Query(lambda s, d: _docs(s, d).select("doc_id", F.md5(T.normalise_text()(F.col("text"))).alias("digest"))),
    "sentence_split": Query(lambda s, d: _docs(s, d).select("doc_id", F.size(T.split_sentences()(F.col("text"))).alias("sentences"))),
}
