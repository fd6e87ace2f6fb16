"""Blocks of web pages, natively: headings, paragraphs, list items and navigation by their elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ELEMENT = r"(?is)<(h[1-6]|p|li|nav|header|footer|figcaption|pre|td)\b[^>]*>(.*?)(?=</?(?:h[1-6]|p|li|ul|ol|nav|header|footer|figcaption|pre|td|tr|table|div|article|section|main|body|html)\b|$)"


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block_index, type, level, text). Scripts, styles and comments go; elements without text of their own are no blocks."""
    clean = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1>", "")
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(clean, F.lit(_ELEMENT), F.lit(0))).alias("n", "m"))
    tag = F.lower(F.regexp_extract("m", r"^<([A-Za-z0-9]+)", 1))
    text = F.regexp_replace("m", r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    kind = F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list_item").when(tag == "nav", "page_header").when(tag == "header", "page_header").when(tag == "footer", "page_footer").when(tag == "figcaption", "caption").when(tag == "pre", "code").when(tag == "td", "table").otherwise("paragraph")
    typed = rows.select(key, "n", kind.alias("type"), F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).alias("level"), F.trim(F.regexp_replace(text, r"(?U)\s+", " ")).alias("text")).filter("text != ''")
    return typed.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("n")) - 1).alias("block_index"), "type", "level", "text")


LABELS = {"title": "heading", "section_header": "heading", "page_header": "page_header", "page_footer": "page_footer", "header": "heading", "list_item": "list_item", "list": "list_item", "table": "table", "caption": "caption", "code": "code", "formula": "paragraph", "footnote": "paragraph", "paragraph": "paragraph", "text": "paragraph"}


def block_type(label: str) -> str:
    """The type for a parser's label: exact labels first, then the first that it contains."""
    low = label.lower().replace("-", "_").replace(" ", "_")
    return LABELS.get(low) or next((t for k, t in LABELS.items() if k in low), "paragraph")
