"""Reading order and block types of positioned text spans.

The recursive cut of a page into columns is sequential, so a page is one group; what goes across pages (body size, repeated
headers and footers, heading levels) is native aggregation and windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BULLET = r"^\s*(?:[-*\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}]|\(?\d{1,2}[.)]|[a-z][.)])\s+"
_BULLET = re.compile(r"\s*(?:[-*•‣◦⁃∙]|\(?\d{1,2}[.)]|[a-z][.)])\s+")
CAPTION = r"(?i)^\s*(?:appendix|chart|exhibit|fig(?:ure)?|listing|table|tbl)\s*\.?\s*(?:[A-Z]|[clxvi]+|\d+)\b"
ENDED = r"[.!?:;\"')\x{201D}\x{2019}]\s*$"
_ENDED = re.compile("[.!?:;\"')”’]\\s*$")


@dataclass(frozen=True)
class LayoutConfig:
    line_overlap: float = 0.5
    paragraph_gap: float = 1.6
    column_gap: float = 1.2
    column_width: float = 0.25
    gutter: float = 0.02
    heading_ratio: float = 1.12
    heading_words: int = 25
    band: float = 0.08
    band_pages: int = 3
    duplicate_iou: float = 0.85
    caption_words: int = 30


class Box:
    """Items on a page and the box around them."""

    __slots__ = ("items", "x0", "x1", "y0", "y1")

    def __init__(self, item) -> None:
        self.items = [item]
        self.x0, self.y0, self.x1, self.y1 = item.x0, item.y0, item.x1, item.y1

    def add(self, item) -> None:
        self.items.append(item)
        self.x0, self.y0, self.x1, self.y1 = min(self.x0, item.x0), min(self.y0, item.y0), max(self.x1, item.x1), max(self.y1, item.y1)

    @property
    def size(self) -> float:
        n = sum(len(s.text) for s in self.items)
        return sum(s.font_size * len(s.text) for s in self.items) / n if n else self.items[0].font_size


def _overlap(a, b) -> float:
    common, least = min(a.y1, b.y1) - max(a.y0, b.y0), min(a.y1 - a.y0, b.y1 - b.y0)
    return (1.0 if common >= 0 else 0.0) if least <= 0 else max(0.0, common) / least


def _stack(items: list, cfg: LayoutConfig, back: int, centred: bool) -> list[Box]:
    """Rows or lines: an item joins one of the last few that it overlaps enough."""
    out: list[Box] = []
    for s in sorted(items, key=lambda s: (s.y0, s.x0)):
        for row in out[: -back - 1 : -1]:
            if _overlap(s, row) >= cfg.line_overlap and (not centred or abs(s.y0 + s.y1 - row.y0 - row.y1) / 2 <= 0.6 * max(s.y1 - s.y0, 1.0)):
                row.add(s)
                break
        else:
            out.append(Box(s))
    return sorted(out, key=lambda r: (r.y0, r.x0))


def _least_gap(rows: list[Box], width: float, cfg: LayoutConfig) -> float:
    return max(cfg.column_gap * max(0.5 * sum(r.size for r in rows) / len(rows), 1.0), cfg.gutter * width)


def _gutter(rows: list[Box], width: float, cfg: LayoutConfig) -> float | None:
    """The middle of the widest band that few rows reach into, with room for a column on either side."""
    step, bins = 4.0, max(1, int(width / 4.0))
    ink = [0] * bins
    for row in rows:
        for k in {k for s in row.items for k in range(max(0, int(s.x0 / step)), min(bins - 1, int(s.x1 / step)) + 1)}:
            ink[k] += 1
    few, left, right = max(2, int(0.15 * len(rows))), min(r.x0 for r in rows), max(r.x1 for r in rows)
    best, k = None, 0
    while k < bins:
        start = k
        while k < bins and ink[k] <= few:
            k += 1
        low, high, middle = start * step, k * step, (start + k) * step / 2
        if k > start and low > left and high < right and high - low >= _least_gap(rows, width, cfg) and min(middle - left, right - middle) >= cfg.column_width * width and (best is None or high - low > best[1]):
            best = (middle, high - low)
        k = max(k, start + 1)
    return best[0] if best else None


def _crosses(row: Box, at: float, gap: float) -> bool:
    """Whether a row runs over the gutter as one line of words, rather than being two columns on one base line."""
    first, *rest = sorted(row.items, key=lambda s: s.x0)
    end = first.x1
    for s in rest:
        if end <= at <= s.x0:
            return s.x0 - end < gap
        end = max(end, s.x1)
    return True


def _ink(items: list, cfg: LayoutConfig) -> float:
    shares = [min(1.0, sum(s.x1 - s.x0 for s in r.items) / (r.x1 - r.x0)) for r in _stack(items, cfg, 3, False) if r.x1 > r.x0]
    return sum(shares) / len(shares) if shares else 0.0


def regions(items: list, width: float | None, cfg: LayoutConfig, depth: int = 0) -> list[list]:
    """Items in regions, in the order of reading."""
    whole = [items]
    if len(items) < 4 or depth > 6:
        return whole
    width = width or max(s.x1 for s in items)
    rows = _stack(items, cfg, 3, False)
    at = _gutter(rows, width, cfg) if width > 0 and len(rows) > 1 else None
    if at is None:
        return whole
    gap, across, left, right = _least_gap(rows, width, cfg), [], [], []
    for row in rows:
        if row.x1 <= at:
            left += row.items
        elif row.x0 >= at:
            right += row.items
        elif _crosses(row, at, gap):
            across.append(row)
        else:
            for s in row.items:
                (left if (s.x0 + s.x1) / 2 <= at else right).append(s)
    if not left or not right or len(across) > len(rows) // 2:
        return whole
    if not across:
        if min(_ink(left, cfg), _ink(right, cfg)) < 0.6:  # a table
            return whole
        return [r for side in (left, right) for r in regions(side, max(1.0, max(s.x1 for s in side) - min(s.x0 for s in side)), cfg, depth + 1)]
    rest, out, above = [r for r in rows if r not in across], [], float("-inf")
    middle = lambda r: (r.y0 + r.y1) / 2
    across.sort(key=lambda r: r.y0)
    while across:
        run = [across.pop(0)]
        while across and across[0].y0 - run[-1].y1 < 1.5 * max(run[-1].y1 - run[-1].y0, 1.0):
            run.append(across.pop(0))
        band = [s for r in rest if above <= middle(r) < run[0].y0 for s in r.items]
        out += regions(band, width, cfg, depth + 1) if band else []
        out.append([s for r in run for s in r.items])
        above = run[-1].y1
    tail = [s for r in rest if middle(r) >= above for s in r.items]
    return out + (regions(tail, width, cfg, depth + 1) if tail else [])


def _line_text(items: list) -> str:
    out, before = "", None
    for s in items:
        if before is not None and s.x0 - before.x1 > 0.15 * max(before.font_size, 1.0) and not out.endswith(" ") and not s.text.startswith(" "):
            out += " "
        out, before = out + s.text, s
    return " ".join(out.split())


LINES = "region int, line int, text string, font_size double, bold double, x0 double, y0 double, x1 double, y1 double, paragraph int, spans array<int>"


def page_lines(spans: DataFrame, sizes: DataFrame | None = None, cfg: LayoutConfig = LayoutConfig()) -> DataFrame:  # noqa: B008
    """(doc_id, page, region, line, text, font_size, bold, box, paragraph, spans): lines in reading order and the paragraphs that they form. A page is one group."""
    rows = spans if sizes is None else spans.join(sizes.select("doc_id", "page", F.col("width").alias("page_width")), ["doc_id", "page"], "left")
    if sizes is None:
        rows = rows.withColumn("page_width", F.lit(None).cast("double"))
    kind = dict(spans.dtypes)["doc_id"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        items = list(pdf.sort_values("span_index", kind="stable").itertuples(index=False))
        width = None if pdf["page_width"].isna().all() else float(pdf["page_width"].iloc[0])
        out, number, paragraph = [], 0, -1
        for r, region in enumerate(regions(items, width, cfg)):
            lines = []
            for line in _stack(region, cfg, 4, True):
                line.items.sort(key=lambda s: s.x0)
                lines.append((line, _line_text(line.items)))
            heights = sorted(b.y1 - b.y0 for b, _ in lines)
            median, widest = heights[len(heights) // 2] or 1.0, max(b.x1 - b.x0 for b, _ in lines) or 1.0
            before = None
            for b, text in lines:
                if before is not None:
                    prev, prev_text = before
                    gap, bullet = b.y0 - prev.y1, bool(_BULLET.match(text))
                    parts = gap > cfg.paragraph_gap * median or abs(b.size - prev.size) > 0.6 or bullet or (bool(_BULLET.match(prev_text)) and gap > 0.3 * median) or (prev.x1 - prev.x0 < 0.75 * widest and bool(_ENDED.search(prev_text)))
                if before is None or parts:
                    paragraph += 1
                n = sum(len(s.text) for s in b.items)
                out.append((*key, r, number, text, b.size, sum(len(s.text) for s in b.items if s.bold) / n if n else 0.0, b.x0, b.y0, b.x1, b.y1, paragraph, [s.span_index for s in b.items]))
                before, number = (b, text), number + 1
        return pd.DataFrame(out, columns=["doc_id", "page", "region", "line", "text", "font_size", "bold", "x0", "y0", "x1", "y1", "paragraph", "spans"])

    return rows.groupBy("doc_id", "page").applyInPandas(run, f"doc_id {kind}, page int, {LINES}")


def live_spans(spans: DataFrame) -> DataFrame:
    return spans.filter((F.trim("text") != "") & (F.col("x1") >= F.col("x0")))


def dedupe_spans(spans: DataFrame, cfg: LayoutConfig = LayoutConfig()) -> DataFrame:  # noqa: B008
    """spans without those that repeat an earlier kept one at the same place. Greedy within one page's spans of one text."""
    keyed = spans.withColumn("_k", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    alone = Window.partitionBy("doc_id", "page", "_k")
    counted = keyed.withColumn("_n", F.count("*").over(alone))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for s in pdf.sort_values("span_index", kind="stable").itertuples():
            for o in kept:
                both = max(0.0, min(s.x1, o.x1) - max(s.x0, o.x0)) * max(0.0, min(s.y1, o.y1) - max(s.y0, o.y0))
                own, other = (s.x1 - s.x0) * (s.y1 - s.y0), (o.x1 - o.x0) * (o.y1 - o.y0)
                if (own + other - both > 0 and both / (own + other - both) >= cfg.duplicate_iou) or (own > 0 and both / own >= 0.95):
                    break
            else:
                kept.append(s)
        return pdf.loc[[s.Index for s in kept]]

    several = counted.filter("_n > 1").groupBy("doc_id", "page", "_k").applyInPandas(run, counted.schema)
    return counted.filter("_n = 1").unionByName(several).drop("_k", "_n")


def body_size(spans: DataFrame) -> DataFrame:
    """(doc_id, body): the font size, to half a point, of most characters; of equal ones that met first."""
    sized = spans.groupBy("doc_id", (F.bround(F.col("font_size") * 2) / 2).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min("span_index").alias("first"))
    return sized.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))


def boilerplate(lines: DataFrame, sizes: DataFrame | None = None, cfg: LayoutConfig = LayoutConfig()) -> DataFrame:  # noqa: B008
    """(doc_id, masked, type): lines, digits masked, that recur in the top or bottom band of three pages, or of all where there are fewer; none in a document of one page."""
    heights = sizes.select("doc_id", "page", F.col("height").cast("double").alias("h")) if sizes is not None else lines.groupBy("doc_id", "page").agg(F.max("y1").alias("h"))
    met = lines.join(heights, ["doc_id", "page"]).filter("h > 0").withColumn("masked", F.regexp_replace(F.lower(F.trim("text")), r"\p{Nd}+", "#")).filter("masked != ''")
    place = F.when(F.col("y1") <= cfg.band * F.col("h"), "page_header").when(F.col("y0") >= (1 - cfg.band) * F.col("h"), "page_footer")
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages")).filter("pages > 1")
    counted = met.withColumn("type", place).filter("type IS NOT NULL").groupBy("doc_id", "masked", "type").agg(F.count_distinct("page").alias("on")).join(pages, "doc_id")
    kept = counted.filter(F.col("on") >= F.least(F.lit(cfg.band_pages), F.col("pages")))
    return kept.groupBy("doc_id", "masked").agg(F.max("type").alias("type"))  # a header where it is both


def heading_levels(headings: DataFrame, key: str = "doc_id", size: str = "_size") -> DataFrame:
    """(key, size, _level, _deepest): each size of a document's headings, the largest first, and how many there are."""
    sizes = headings.select(key, size).distinct()
    return sizes.withColumn("_level", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc(size)))).withColumn("_deepest", F.count("*").over(Window.partitionBy(key)))


def layout(spans: DataFrame, sizes: DataFrame | None = None, cfg: LayoutConfig = LayoutConfig()) -> DataFrame:  # noqa: B008
    """(doc_id, reading_order, page, type, level, text, font_size, x0, y0, x1, y1): blocks of documents."""
    kept = dedupe_spans(live_spans(spans), cfg)
    lines = page_lines(kept, sizes, cfg)
    repeated = boilerplate(lines, sizes, cfg)
    chars = F.length("text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    joined = F.aggregate(ordered, F.lit(""), lambda out, x: F.when(out == "", x).when(out.rlike(r"\p{L}-$") & x.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(out, "-$", ""), x)).otherwise(F.concat(out, F.lit(" "), x)))
    groups = lines.groupBy("doc_id", "page", "paragraph").agg(joined.alias("text"), F.min_by("text", "line").alias("first"), F.count("*").alias("n"), (F.sum(F.col("font_size") * chars) / F.greatest(F.sum(chars), F.lit(1))).alias("font_size"), (F.sum(F.col("bold") * chars) / F.greatest(F.sum(chars), F.lit(1))).alias("bold"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]).filter("text != ''")
    known = groups.join(body_size(kept), "doc_id").withColumn("masked", F.regexp_replace(F.lower("text"), r"\p{Nd}+", "#")).join(repeated.withColumnRenamed("type", "furniture"), ["doc_id", "masked"], "left")
    words = F.size(F.split(F.trim("text"), r"\s+"))
    heading = (words <= cfg.heading_words) & ((F.col("font_size") >= cfg.heading_ratio * F.col("body")) | ((F.col("bold") >= 0.6) & (F.col("font_size") >= F.col("body")))) & ~F.when(F.length("text") > 1, F.expr("substr(text, 1, length(text) - 1)")).otherwise(F.col("text")).rlike(ENDED)
    kind = F.when((F.col("n") == 1) & F.col("furniture").isNotNull(), F.col("furniture")).when(F.col("first").rlike(BULLET) & ~heading, "list_item").when(F.col("text").rlike(CAPTION) & (words <= cfg.caption_words), "caption").when(heading, "heading").otherwise("paragraph")
    typed = known.withColumn("type", kind).withColumn("_size", F.bround(F.col("font_size") * 2) / 2)
    ranks = heading_levels(typed.filter("type = 'heading'"))
    levelled = typed.join(ranks, ["doc_id", "_size"], "left")
    level = F.when(F.col("type") == "heading", F.least(F.lit(6), F.when(F.col("_size") <= F.col("body"), F.col("_deepest")).otherwise(F.col("_level"))).cast("int"))
    order = Window.partitionBy("doc_id").orderBy("page", "paragraph")
    return levelled.select("doc_id", (F.row_number().over(order) - 1).alias("reading_order"), "page", "type", level.alias("level"), "text", "font_size", "x0", "y0", "x1", "y1")


def to_markdown(blocks: DataFrame, order: str = "reading_order") -> DataFrame:
    """(doc_id, markdown): furniture goes, bullets are set anew."""
    line = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.coalesce("level", F.lit(1)), F.lit(6))), F.lit(" "), F.col("text"))).when(F.col("type") == "list_item", F.concat(F.lit("- "), F.trim(F.regexp_replace("text", BULLET, "")))).when(F.col("type") == "caption", F.concat(F.lit("*"), F.col("text"), F.lit("*"))).when(F.col("type") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    rows = blocks.filter(~F.col("type").isin("page_header", "page_footer")).select("doc_id", F.struct(F.col(order).alias("o"), line.alias("l")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n\n").alias("markdown"))


def to_text(blocks: DataFrame, order: str = "reading_order") -> DataFrame:
    rows = blocks.filter(~F.col("type").isin("page_header", "page_footer")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("x"))
    return rows.select("doc_id", F.array_join(F.transform("x", lambda x: x["text"]), "\n\n").alias("text"))
