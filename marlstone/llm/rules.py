"""Quality rules: base statistics of whole texts, and a decision list learned from labelled ones.

Sequential covering: a rule is a conjunction of thresholds, grown one condition at a time by FOIL's gain on two thirds of
the rows still uncovered, then pruned from its end by (p - n) / (p + n) on the other third. A rule is taken only if its
precision there reaches a floor, and its rows leave the training set. The list becomes one Spark conditional expression,
tried in order. The rules learn what low quality looks like among texts that the base rules pass, so what no rule covers is
kept. How many rows a rule must cover is a share of the bad rows to learn from, so that small tables are learned from too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import map_rows

#: Labelled rows that the list is fitted on: the ids with the least hashes, so the choice doesn't hang on row order.
MAX_LABELLED = 20_000
#: A rule covers at least this share of the bad rows that there were to learn from, and at least so many.
SHARE, LEAST = 0.02, 5
WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_chars_all", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words", "n_repeat_next")
_LAYOUT = ", ".join(f"{c} long" for c in BASE + EXTRA)


def _repeats(ids: np.ndarray, window: int) -> int:
    """Words in windows that are found twice or more. Windows of equal hash are told apart by their words."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    hashes = np.zeros(n, np.uint64)
    for k in range(window):
        hashes = hashes * np.uint64(0x94D049BB133111EB) + mixed[k : k + n]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(same):
        return 0
    twice = np.zeros(n, bool)
    twice[order[same]] = twice[order[same + 1]] = True
    at = np.flatnonzero(twice)
    words = np.lib.stride_tricks.sliding_window_view(ids, window)[at]
    _, inverse, counts = np.unique(np.ascontiguousarray(words.astype(np.int32)).view(f"V{4 * window}").ravel(), return_inverse=True, return_counts=True)
    at = at[counts[inverse] > 1]
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[at] += 1
    edges[at + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str | None, window: int = WINDOW) -> tuple[int, ...]:
    """BASE and EXTRA of one whole text; a null text has no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at \x20 and \x09-\x0D alone
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spaces = int(codes[9:14].sum() + codes[32])
    return (
        len(words),
        len(text) - spaces,
        int(codes[[ord(c) for c in "#*$%&|<>"]].sum()),
        len(lines) - len(set(lines)),
        _repeats(ids, window),
        len(text),
        len(lines),
        int(codes[65:91].sum()),
        int(codes[48:58].sum()),
        int(codes[[ord(c) for c in "!?.,;:"]].sum()),
        len(known),
        int((ids[1:] == ids[:-1]).sum()),
    )


def statistics(docs: DataFrame, text_col: str = "text", window: int = WINDOW, prefix: str = "") -> DataFrame:
    """docs with the statistics of each whole text as further columns, named with prefix. One pass, no shuffle."""
    names = [prefix + c for c in BASE + EXTRA]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py(), window) for x in batch.column(at)]
            table = np.array(rows, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(names)))], names=[*batch.schema.names, *names])

    return map_rows(docs, run, names)


#: What rules may test: shares of the statistics, each with a numerator and a denominator.
FEATURES: dict[str, tuple[str, str]] = {
    "words": ("n_words", ""),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "repeat_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "repeat_next": ("n_repeat_next", "n_words"),
    "distinct": ("n_distinct_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def feature(name: str, prefix: str = "") -> Column:
    over, under = FEATURES[name]
    top = F.col(prefix + over).cast("double")
    return top / F.greatest(F.col(prefix + under), F.lit(1)).cast("double") if under else top


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.threshold:.6g}" for c in self.conditions) + f" -> drop ({self.covered} rows, precision {self.precision:.3f})"


def _holds(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= (x[c.feature] >= c.threshold) == c.above
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, share: float = SHARE, least: int = LEAST, most_conditions: int = 4, most_rules: int = 16, cuts: int = 64, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that cover bad rows. Rows of one class, or none, give an empty list."""
    least = max(least, math.ceil(share * bad.sum()))
    left = np.arange(len(bad))
    out: list[Rule] = []
    while len(out) < most_rules and bad[left].sum() >= least:
        shuffled = np.random.default_rng(seed + len(out)).permutation(left)
        grow, prune = shuffled[: 2 * len(left) // 3], shuffled[2 * len(left) // 3 :]
        rule: list[Condition] = []
        inside = grow
        while len(rule) < most_conditions and not bad[inside].all():
            p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
            best, gain = None, 1e-9
            for name in x:
                values = x[name][inside]
                order = np.argsort(values, kind="stable")
                ranked, hits = values[order], np.cumsum(bad[inside][order])
                edges = np.flatnonzero(np.diff(ranked)) + 1
                if len(edges) > cuts:
                    edges = edges[np.unique(np.concatenate([np.linspace(0, len(edges) - 1, cuts), np.arange(min(8, len(edges))), len(edges) - 1 - np.arange(min(8, len(edges)))]).astype(int))]
                if not len(edges):
                    continue
                below = hits[edges - 1]
                for above in (False, True):
                    p = p0 - below if above else below
                    n = (len(inside) - edges if above else edges) - p
                    ok = p >= max(1, least // 2)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        foil = np.where(ok, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                    k = int(np.argmax(foil))
                    if foil[k] > gain:
                        best, gain = Condition(name, above, float((ranked[edges[k] - 1] + ranked[edges[k]]) / 2)), foil[k]
            if best is None:
                break
            rule.append(best)
            inside = inside[_holds([best], {k: v[inside] for k, v in x.items()}, len(inside))]
        if not rule:
            break

        def worth(r: list[Condition], rows: np.ndarray = prune) -> float:
            m = _holds(r, {k: v[rows] for k, v in x.items()}, len(rows))
            p, n = (bad[rows] & m).sum(), (~bad[rows] & m).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        m = _holds(rule, {k: v[left] for k, v in x.items()}, len(left))
        hits, exact = int((bad[left] & m).sum()), (worth(rule) + 1) / 2
        right = hits / max(1, int(m.sum()))
        if hits < least or min(right, exact) < precision:
            break
        out.append(Rule(tuple(rule), int(m.sum()), right))
        left = left[~m]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", bad_value: int = 0, most: int = MAX_LABELLED, **options: float) -> list[Rule]:
    """The list for labelled rows of docs that the base rules pass; at most `most` of them reach the driver, as numbers. Null labels and ids don't count; an id labelled twice has its lower label."""
    marked = labels.select(F.col(label_id).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna().groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    some = texts.join(F.broadcast(chosen), "_id")  # the bound is `most` rows
    rows = statistics(some, "_text").filter(~base_failed()).select("_id", "_label", *(feature(c).alias(c) for c in FEATURES)).toPandas().sort_values(["_id", *FEATURES], ignore_index=True)
    if rows.empty:
        return []
    return learn({c: rows[c].to_numpy(float) for c in FEATURES}, (rows["_label"] == bad_value).to_numpy(), **options)


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one ordered conditional expression: true where a text is kept."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule.conditions:
            test = test & ((feature(c.feature, prefix) >= c.threshold) if c.above else (feature(c.feature, prefix) < c.threshold))
        out = (F if out is None else out).when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(prefix: str = "") -> Column:
    return (F.col(prefix + "n_words") < 20) | (100 * F.col(prefix + "n_repeat_words") > 30 * F.col(prefix + "n_words"))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with BASE, base_failed and kept as further columns. Null and empty texts have no words and fail."""
    stats = statistics(docs, text_col, prefix=prefix)
    return stats.withColumn(prefix + "base_failed", base_failed(prefix)).withColumn(prefix + "kept", ~base_failed(prefix) & verdict(rules, prefix)).drop(*(prefix + c for c in EXTRA))


def op4_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs, repeated rows and null ids included. Without labels the list is empty and the base rules alone decide."""
    rules = fit(docs, labels)
    return judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rules).drop("text")
