"""Secret scans with multipart linking.

Strong finds stand alone: assigned values, access identifiers and long hexadecimal strings. Weak candidates (values that
look like secret keys, endpoints and account names) are too common to report alone. They are linked by an interval join
inside a scope (a stretch between blank lines): a secret needs an identifier, an endpoint or an account name needs both
complementary parts. A radius can narrow the scope; the registered queries set none. Parts and neighbours are sorted by
start, so the join is a binary search for each candidate and never lists the pairs of a scope.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import map_rows

_I = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run under 20 characters fails wherever it is entered
HEX = re.compile(r"[0-9a-f]{24,}")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])")  # with or without a key and '=' before it; never the key itself
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9.@-])(?:[a-z0-9-]+\.)+(?:amazonaws\.com|windows\.net|googleapis\.com|internal)(?![A-Za-z0-9-])""", re.ASCII)
IDENTITY = re.compile(r"""(?:user(?:name)?|login|account(?:_?name)?|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", _I)

KINDS = ("assign", "access", "hex", "secret", "endpoint", "identity")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX = bytes(120 if chr(k) in "0123456789abcdef" else 32 for k in range(256))
_RUN = b"x" * 24
RADIUS = 400

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS) or not low.isascii() and ("ſ" in text or "K" in text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if _RUN in text.encode("utf-8", "surrogatepass").translate(_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _mixed(value: str) -> bool:
    """Upper and lower case and digits: not a word, a number or a hexadecimal string."""
    return any(c.isupper() for c in value) and any(c.islower() for c in value) and any(c.isdigit() for c in value)


def _near(span: Span, sorted_starts: list[int], parts: list[Span], radius: int | None, low: int, high: int) -> bool:
    """Whether one of the parts (sorted by start) lies inside the scope, beside the span; with a radius, begins or ends within it."""
    if radius is None:  # ends at the first part that doesn't overlap the span
        for i in range(bisect_left(sorted_starts, low), len(parts)):
            start, _, end = parts[i]
            if start >= high:
                break
            if end <= high and not (start < span[2] and span[0] < end):
                return True
        return False
    k = bisect_left(sorted_starts, span[0] - radius)
    for i in range(max(0, k - 1), len(parts)):
        start, _, end = parts[i]
        if start > span[2] + radius:
            break
        if end >= span[0] - radius and low <= start and end <= high and not (start < span[2] and span[0] < end):
            return True
    return False


def linked_spans(text: str, base: list[Span], radius: int | None = RADIUS) -> list[Span]:
    """Weak candidates whose complementary parts occur beside them in their scope, at any distance if radius is None."""
    access = [s for s in base if s[1] == 1]
    low = text.lower()
    names = [(m.start(), 5, m.end()) for m in IDENTITY.finditer(text)] if any(k in low for k in ("user", "login", "account", "client")) else []
    if not access and not names:
        return []
    starts, ends = [s[0] for s in base], list(accumulate((s[2] for s in base), max))

    def free(a: int, b: int) -> bool:
        """Whether no base span, which are in order of their starts, overlaps these characters."""
        k = bisect_left(starts, b)
        return not k or ends[k - 1] <= a

    names = [s for s in names if free(s[0], s[2])]
    secrets = [(m.start(), 3, m.end()) for m in SECRET.finditer(text) if _mixed(m[0]) and free(m.start(), m.end())]
    points = [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text) if free(m.start(), m.end())]
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]

    def scope(s: Span) -> tuple[int, int]:
        k = bisect_left(breaks, s[0])
        return (breaks[k - 1] if k else 0), (breaks[k] if k < len(breaks) else len(text))

    def beside(parts: list[Span]) -> Callable[[Span], bool]:
        at = [p[0] for p in parts]
        return lambda s: _near(s, at, parts, radius, *scope(s))

    by_who = beside(sorted(access + names))
    found = [s for s in secrets if by_who(s)]
    by_value = beside(sorted(found + [s for s in base if s[1] in (0, 2)]))
    by_point = beside(points)
    found += [s for s in points if by_who(s) and by_value(s)]
    found += [s for s in names if by_value(s) and by_point(s)]
    return found


def scan(text: str | None, radius: int | None = RADIUS) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each sorted by start and then by kind; none in a null text."""
    base = base_spans(text or "")
    return base, sorted(base + linked_spans(text or "", base, radius))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, radius: int | None = RADIUS) -> str | None:
    """The text with each run of found spans replaced by a mark; the same object where nothing is found."""
    spans = scan(text, radius)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = RADIUS) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Null and empty texts have no spans (and the hash of nothing). Repeated rows and null ids keep their rows. Other
    columns are not read. One pass without a shuffle; memory is one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for x in batch.column(1):
                base, every = scan(x.as_py(), radius)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                counts[3].append(len(every) - len(base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", radius: int | None = RADIUS) -> DataFrame:
    """docs, row by row, with found secrets masked in the text; length_col, if docs has it, follows a changed text."""
    names = docs.columns
    at, size = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = [redact(t, radius) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, columns[at].type)
            if size is not None:
                columns[size] = pa.array([old if c is t else len(c) for old, c, t in zip(columns[size].to_pylist(), clean, texts, strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_rows(docs, run)


def op5_secret_scan(docs: DataFrame) -> DataFrame:
    return find(docs, radius=None)
