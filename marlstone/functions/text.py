"""Text expressions. All are column expressions but those that say so, whose rules built-in functions can't state."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple(sorted(set("a about all and any are been boy but can could day did do does doing done for from get had has have her him his how into its long man many may men more most much new not now old one only our out own put same say see she should some such take taken takes taking than that the them then there these they this those too two use very was were what when where which who why will with would you your yours".split()) - {"a", "were"}))
#: Texts of a batch that are Python objects at once.
SLICE = 64
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"


def normalise_text(keep_lines: bool = False):
    """An Arrow UDF: NFKC, then invisible characters go, then white space runs become one space (within each line, with keep_lines). Of a batch, SLICE texts at a time are Python's."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        drop = dict.fromkeys(map(ord, _INVISIBLE))

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            text = unicodedata.normalize("NFKC", text).translate(drop)
            return "\n".join(" ".join(x.split()) for x in text.splitlines()) if keep_lines else " ".join(text.split())

        return pa.concat_arrays([pa.array([one(t) for t in texts.slice(at, SLICE).to_pylist()], pa.string()) for at in range(0, max(1, len(texts)), SLICE)])

    return run


def squash(text: Column) -> Column:
    """Lower case, white space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def dehyphenate(text: Column) -> Column:
    """Join words that a hyphen breaks across lines, where a letter precedes and a lower-case letter follows."""
    return F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")


def _latin(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"(?U)\s+"))).cast("double")
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\p{Z}\s]")).cast("double")
    digits = F.regexp_count(text, F.lit(r"\p{Nd}")).cast("double")
    return F.greatest(F.length(text).cast("double") / F.lit(4.0).cast("double"), words * F.lit(1.3).cast("double"), words * F.lit(0.9).cast("double") + marks + digits)


def estimate_tokens(text: Column) -> Column:
    """Tokens without a tokenizer: 0 for blank; the largest of three rules, truncated, at least 1. Each CJK character counts one and is taken out first."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    cjk = F.regexp_count(trimmed, F.lit(_CJK)).cast("double")
    rest = F.regexp_replace(trimmed, _CJK, "")
    blank = F.regexp_replace(rest, r"(?U)\s+", "") == ""
    total = cjk + F.when(blank, F.lit(0.0)).otherwise(_latin(rest))
    return F.when(trimmed == "", 0).otherwise(F.greatest(F.lit(1), F.floor(total).cast("int")))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_pieces(text: Column) -> Column:
    """Non-empty pieces between characters that are neither letters, digits nor underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def stem(token: Column) -> Column:
    """The first rule that fits: ies to y, ing and ed go, a single final s goes."""
    n = F.length(token)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(token.substr(F.lit(1), n - 3), F.lit("y")))
        .when(token.endswith("ing") & (n > 5), token.substr(F.lit(1), n - 3))
        .when(token.endswith("ed") & (n > 4), token.substr(F.lit(1), n - 2))
        .when(token.endswith("s") & ~token.endswith("ss") & (n > 3), token.substr(F.lit(1), n - 1))
        .otherwise(token)
    )


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}+", "#")


def urls(text: Column) -> Column:
    """Web addresses without the punctuation that ends a sentence around them."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"'\]]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,);]+$", ""))


def content_terms(query: Column) -> Column:
    """Words of a question that carry meaning: over two characters and no stop word; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def parse_number(raw: Column, safe: bool = False) -> Column:
    """A double from money as people write it, or null. The right-most of two kinds of separators is the decimal point;
    exactly three digits after a lone one are thousands (with safe, not after a leading zero)."""
    text = F.trim(raw)
    bracket = text.rlike(r"^\(.*\)$")
    text = F.when(bracket, F.trim(F.substring(text, 2, F.length(text) - 2))).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"(?i)[$£€¥₹]|\b(?:aud|cad|chf|cny|eur|gbp|inr|jpy|myr|sgd|usd)\b", ""))
    minus = text.startswith("-")
    text = F.regexp_replace(F.when(minus, F.trim(F.substring(text, 2, 1_000_000))).otherwise(text), "[  ]", "")
    dots, commas = F.regexp_count(text, F.lit(r"\.")), F.regexp_count(text, F.lit(","))
    right_dot, right_comma = F.length(text) - F.locate(".", F.reverse(text)), F.length(text) - F.locate(",", F.reverse(text))
    groups = text.rlike(r",\d{3}$")
    thousands = text.rlike(r"\.\d{3}$") & (F.length(text) > 4) & (~text.rlike(r"^0\.") if safe else F.lit(True))
    plain = (
        F.when((dots > 0) & (commas > 0) & (right_comma > right_dot), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((dots > 0) & (commas > 0), F.replace(text, F.lit(","), F.lit("")))
        .when((commas > 0) & groups, F.replace(text, F.lit(","), F.lit("")))
        .when(commas > 0, F.replace(text, F.lit(","), F.lit(".")))
        .when((dots > 0) & thousands, F.replace(text, F.lit("."), F.lit("")))
        .otherwise(text)
    )
    value = F.when(plain.rlike(r"^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    return F.when(bracket != minus, -value).otherwise(value)


def coerce_date(text: Column) -> Column:
    """YYYY-MM-DD from ISO, from year-first dates and from dates that name the month; null for 01/02/2024, which is two days. No calendar check."""
    text = F.trim(text)
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    number = F.create_map(*[F.lit(v) for k, m in enumerate(months, 1) for v in (m, f"{k:02d}")])
    by_day, by_month = r"^(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})$", r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    first = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})$"

    def dated(pattern: str, day: int, month: int) -> Column:
        m = F.element_at(number, F.substring(F.lower(F.regexp_extract(text, pattern, month)), 1, 3))
        return F.when(m.isNotNull(), F.concat_ws("-", F.regexp_extract(text, pattern, 3), m, F.lpad(F.regexp_extract(text, pattern, day), 2, "0")))

    return (
        F.when(is_iso_date(text), text)
        .when(text.rlike(first), F.concat_ws("-", F.regexp_extract(text, first, 1), F.lpad(F.regexp_extract(text, first, 2), 2, "0"), F.lpad(F.regexp_extract(text, first, 3), 2, "0")))
        .when(text.rlike(by_day), dated(by_day, 1, 2))
        .when(text.rlike(by_month), dated(by_month, 2, 1))
    )


def is_iso_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def doc_id(content: Column) -> Column:
    """Identity of a document's version: a hash of its content."""
    return F.concat(F.lit("doc:"), F.substring(F.sha2(content, 256), 1, 16))


def cache_key(namespace: Column, *parts: Column) -> Column:
    return F.concat(namespace, F.lit(":"), F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256))


_BOUNDARY = re.compile(r"[.!?](?P<close>[\"')\]]*)(\s+)(?=[A-Z0-9\"'(\[])")
_SHORT = frozenset("al approx art cf ch corp dr e.g eq etc fig i.e inc jr ltd mr mrs ms no prof sec sr st vs".split())


def sentences(text: str, keep_closers: bool = True) -> list[str]:
    """Sentences of one text. An abbreviation, or a single letter with a full stop, ends none. keep_closers: closing quotes and brackets stay with their sentence."""
    text = " ".join(text.split())
    out, start = [], 0
    for m in _BOUNDARY.finditer(text):
        stop = m.start() + 1
        before = text[start:stop]
        last = re.search(r"([A-Za-z](?:\.[A-Za-z]+)?|[A-Za-z]+)\.$", before)
        if last:
            word = re.search(r"(?:^|[^A-Za-z0-9_])((?:e\.g|i\.e|[A-Za-z]+))\.$", before, re.I)
            if word and (len(word[1]) == 1 or word[1].lower() in _SHORT):
                continue
        out.append((text[start : m.start("close") + len(m["close"])] if keep_closers else before).strip())
        start = m.end()
    if tail := text[start:].strip():
        out.append(tail)
    return out or ([text] if text else [])


def split_sentences(keep_closers: bool = True):
    """A pandas UDF, as a boundary may be refused after it is found, which no regular expression alone states."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sentences(t, keep_closers))

    return run


def json_object(text: str) -> str | None:
    """The first balanced JSON object in a reply: inside a fence, or anywhere; braces in strings don't count. None if there is none."""
    fenced = re.search(r"`{3}(?:json)?\s*(.*?)`{3}", text, re.S | re.I)
    for part in ([fenced[1]] if fenced else []) + [text]:
        start = part.find("{")
        while start >= 0:
            depth, quoted, escaped = 0, False, False
            for k in range(start, len(part)):
                c = part[k]
                if quoted:
                    escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
                elif c == '"':
                    quoted = True
                elif c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if not depth:
                        return part[start : k + 1]
            start = part.find("{", start + 1)
    return None
