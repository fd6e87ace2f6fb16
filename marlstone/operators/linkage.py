"""Record linkage: blocking, comparison levels, a model fitted by expectation maximisation, and clusters."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.graph import connected_components
from marlstone.operators.keyed import HOT_ROWS
from marlstone.operators.rows import numbered
from marlstone.plans.scratch import cut

PREDICATES = ("first4", "first6", "last4", "token", "gram3", "gram4", "acronym", "digits", "alpha")


def _grams(s: Column, n: int) -> Column:
    return F.when(F.length(s) < n, F.array(s)).otherwise(F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - n + 1)), lambda i: F.substr(s, i, F.lit(n))))))


def _words(s: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(s, r"[^\p{L}\p{N}]+"), lambda t: t != "")))


def predicate_keys(value: Column, predicate: str) -> Column:
    """The blocking keys of a value under a predicate; short values stand for themselves."""
    s = F.trim(F.lower(value.cast("string")))
    one = lambda x: F.filter(F.array(x), lambda k: k != "")
    return {
        "first4": one(F.substring(s, 1, 4)),
        "first6": one(F.substring(s, 1, 6)),
        "last4": one(F.right(s, F.lit(4))),
        "token": _words(s),
        "gram3": F.filter(_grams(s, 3), lambda k: k != ""),
        "gram4": F.filter(_grams(s, 4), lambda k: k != ""),
        "acronym": one(F.array_join(F.array_sort(F.transform(_words(s), lambda t: F.substring(t, 1, 1))), "")),
        "digits": one(F.regexp_replace(s, r"[^\p{Nd}]", "")),
        "alpha": one(F.regexp_replace(s, r"[^\p{L}]", "")),
    }[predicate]


def block_keys(records: DataFrame, predicates: Sequence[tuple[str, str]], id_col: str = "id") -> DataFrame:
    """(id, predicate, key) for (name, field) pairs; a null or blank field has no keys."""
    each = [F.struct(F.lit(f"{name}:{f}").alias("predicate"), F.coalesce(predicate_keys(F.col(f), name), F.array().cast("array<string>")).alias("keys")) for name, f in predicates]
    return records.select(F.col(id_col).alias("id"), F.explode(F.array(*each)).alias("p")).select("id", "p.predicate", F.explode("p.keys").alias("key")).distinct()


def _kept_blocks(keys: DataFrame, max_block: int) -> tuple[DataFrame, DataFrame]:
    """(predicate, key) of the blocks of 2 to max_block records, and the keys without those of very many rows, which need not meet in one task to be dropped."""
    counts = keys.groupBy("predicate", "key").agg(F.count("*").alias("n"))
    hot = counts.filter(F.col("n") >= max(HOT_ROWS, max_block + 1)).select("predicate", "key")
    return counts.filter(F.col("n").between(2, max_block)).select("predicate", "key"), keys.join(F.broadcast(hot), ["predicate", "key"], "left_anti")


def candidate_pairs(keys: DataFrame, max_block: int = 200) -> DataFrame:
    """(left, right, shared_keys): pairs in a block of 2 to max_block records; shared_keys counts the predicates that agree.

    The cap is the operator's own rule, and it bounds what a block can emit. Records are shuffled to their blocks, each with the
    list of its blocks; a pair is given by the first block that both are in, so the pairs themselves are never shuffled.
    """
    return _pairs(keys, None, (), max_block)


def compared_pairs(keys: DataFrame, records: DataFrame, comparisons: Sequence[Comparison], max_block: int = 200, id_col: str = "id") -> DataFrame:
    """patterns(candidate_pairs(keys, max_block), records, comparisons) in one step: the fields travel with the records to their blocks, where equal pairs of values are compared once."""
    return _pairs(keys, records.select(F.col(id_col).alias("id"), *[F.col(c.field).cast("string").alias(f"_f{k}") for k, c in enumerate(comparisons)]), comparisons, max_block)


def _pairs(keys: DataFrame, values: DataFrame | None, comparisons: Sequence[Comparison], max_block: int) -> DataFrame:
    blocks, rest = _kept_blocks(keys, max_block)
    blocks = cut(blocks.withColumn("b", F.monotonically_increasing_id()), "blocks")
    # blocks has a row for each block, so the arrays are as long as a record has keys
    member = rest.join(blocks, ["predicate", "key"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("b", F.col("predicate").alias("p")))).alias("_in"))
    member = member if values is None else member.join(values, "id")
    fields = [f"_f{k}" for k in range(len(comparisons))]
    rows = member.select(F.explode("_in.b").alias("b"), "id", F.col("_in.b").alias("_b"), F.col("_in.p").alias("_p"), *fields)
    kind = dict(keys.dtypes)["id"]
    schema = ", ".join([f"left {kind}", f"right {kind}", "shared_keys long", *[f"`level_{c.field}` string" for c in comparisons]])
    return rows.repartition("b").sortWithinPartitions("b", "id").mapInArrow(_block_pairs(comparisons), schema)


#: Pairs that are compared at once in a task.
PAIRS_AT_ONCE = 100_000


def _block_pairs(comparisons: Sequence[Comparison]):
    """A function over rows (block, id, its blocks, their predicates, fields), sorted by block and id: the pairs of each block that share no earlier one. Only the last block of a batch waits for the next."""

    def pairs_of(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        block = rows.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        left, right, held = [], [], 0
        for at, n in zip(starts, np.diff(np.r_[starts, len(block)]), strict=True):
            i, j = np.triu_indices(n, 1)
            for k in range(0, len(i), PAIRS_AT_ONCE):
                left.append(i[k : k + PAIRS_AT_ONCE] + at)
                right.append(j[k : k + PAIRS_AT_ONCE] + at)
                held += len(left[-1])
                if held >= PAIRS_AT_ONCE:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
        if held:
            yield np.concatenate(left), np.concatenate(right)

    def padded(lists: pa.ListArray, flat: np.ndarray, fill: int) -> np.ndarray:
        sizes = pc.list_value_length(lists).to_numpy()
        out = np.full((len(sizes), max(1, sizes.max())), fill, flat.dtype)
        out[np.arange(out.shape[1]) < sizes[:, None]] = flat
        return out

    def compare(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, ids = rows.column(0).to_numpy(), rows.column(1)
        same = ids.dictionary_encode().indices.to_numpy()
        of = padded(rows.column(2), rows.column(2).flatten().to_numpy(), -1)
        predicates = rows.column(3).flatten().dictionary_encode()
        by = padded(rows.column(3), predicates.indices.to_numpy(), -1)
        coded = [rows.column(4 + k).dictionary_encode() for k in range(len(comparisons))]
        texts = [c.dictionary.to_pylist() for c in coded]
        codes = [c.indices.fill_null(-1).to_numpy() for c in coded]
        levels = [np.array(c.names, object) for c in comparisons]
        step = max(1, 8_000_000 // of.shape[1] ** 2)
        for left, right in pairs_of(rows):
            for at in range(0, len(left), step):
                i, j = left[at : at + step], right[at : at + step]
                shared = (of[i][:, :, None] == np.where(of[j] == -1, -2, of[j])[:, None, :]).any(axis=2)
                first = (of[i, shared.argmax(axis=1)] == block[i]) & (same[i] != same[j])
                i, j, shared = i[first], j[first], shared[first]
                if not len(i):
                    continue
                held = by[i]
                agree = sum((shared & (held == p)).any(axis=1).astype(np.int64) for p in range(len(predicates.dictionary)))
                out = [ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(agree)]
                for c, code, text, names in zip(comparisons, codes, texts, levels, strict=True):
                    each, where = np.unique((code[i] + 1).astype(np.int64) * (len(text) + 1) + code[j] + 1, return_inverse=True)
                    a, b = each // (len(text) + 1) - 1, each % (len(text) + 1) - 1
                    known = np.full(len(each), -1.0)
                    both = (a >= 0) & (b >= 0)
                    known[both] = similarities([text[x] for x in a[both]], [text[x] for x in b[both]])
                    level = np.select([known >= least for _, least in c.levels], range(len(c.levels)), len(c.levels))
                    out.append(pa.array(names, pa.string()).take(pa.array(level[where])))
                yield pa.RecordBatch.from_arrays(out, names=["left", "right", "shared_keys", *[f"level_{c.field}" for c in comparisons]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            block = batch.column(0).to_numpy()
            last = int(np.searchsorted(block, block[-1]))
            waiting = batch.slice(last)
            if last:
                yield from compare(pa.Table.from_batches([batch.slice(0, last)]).combine_chunks().to_batches()[0])
        if waiting is not None:
            yield from compare(pa.Table.from_batches([waiting]).combine_chunks().to_batches()[0])

    return run


def predicate_costs(keys: DataFrame, max_block: int = 200) -> DataFrame:
    """(predicate, pairs): distinct pairs that each predicate would compare."""
    blocks, rest = _kept_blocks(keys, max_block)
    kept = rest.join(blocks, ["predicate", "key"], "left_semi")
    a, b = kept.select("predicate", "key", F.col("id").alias("left")), kept.select("predicate", "key", F.col("id").alias("right"))
    return a.join(b, ["predicate", "key"]).filter("left < right").groupBy("predicate").agg(F.count_distinct("left", "right").alias("pairs"))


def cover(costs: Mapping[str, int], covers: Mapping[str, set], positives: set, most: int = 6) -> list[str]:
    """Predicates by greedy weighted set cover of labelled duplicates: the best gain / (cost + 1), the first of equal ones. Without labels the cheapest; if none is of use, the first."""
    if not positives:
        return [p for p, _ in sorted(costs.items(), key=lambda x: x[1])[:most]]
    left, out = set(positives), []
    while left and len(out) < most:
        best, ratio = None, 0.0
        for p in costs:
            gain = len(covers.get(p, set()) & left)
            if p not in out and gain and gain / (costs[p] + 1) > ratio:
                best, ratio = p, gain / (costs[p] + 1)
        if best is None:
            break
        out.append(best)
        left -= covers[best]
    return out or list(costs)[:most]


def affine_gap(a: str, b: str, match: float = -5.0, differ: float = 5.0, begin: float = 4.0, extend: float = 1.0) -> float:
    """Least cost of an alignment whose gaps cost `begin` and then `extend` a character. Each row is computed as arrays; a
    gap that runs along the row is a running minimum, as the cheapest opening stays the cheapest."""
    if a == b:
        return match * len(a)
    if not a or not b:
        return begin + extend * (len(a) + len(b) - 1)
    other = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(b) + 1) * extend
    best = np.concatenate(([0.0], begin + steps[:-1]))
    down = np.full(len(b) + 1, np.inf)
    for i, c in enumerate(a):
        down[1:] = np.minimum(down[1:] + extend, best[1:] + begin)
        met = best[:-1] + np.where(other == ord(c), match, differ)
        now = np.empty(len(b) + 1)
        now[0] = begin + extend * i
        now[1:] = np.minimum(down[1:], met)
        along = np.minimum.accumulate(now[:-1] - steps[:-1]) + steps[:-1] + begin
        now[1:] = np.minimum(now[1:], along)
        best = now
    return float(best[-1])


def similarity(a: str | None, b: str | None) -> float:
    """Affine-gap likeness between 0 and 1 of trimmed lower-case values."""
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    low, high = -5.0 * min(len(a), len(b)), 4.0 + len(a) + len(b) - 1
    return max(0.0, min(1.0, 1 - (affine_gap(a, b) - low) / (high - low)))


def affine_gaps(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """affine_gap() of each pair of texts that aren't empty, with its default costs: pairs of equal lengths are aligned together, row by row as there."""
    out = np.zeros(len(a))
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    cuts = np.flatnonzero((np.diff(sizes[order], axis=0) != 0).any(axis=1)) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        n, m = (int(x) for x in sizes[group[0]])
        together = max(1, min(4096, 100_000 // (m + 1)))
        for at in range(0, len(group), together):
            some = group[at : at + together]
            x, y = (np.frombuffer("".join(s[k] for k in some).encode("utf-32-le"), np.uint32).reshape(len(some), -1).T for s in (a, b))
            out[some] = _aligned(np.ascontiguousarray(x), np.ascontiguousarray(y), np.int16 if 5 * (n + m) + 8 < 30_000 else np.int64)
    return out


def _aligned(x: np.ndarray, y: np.ndarray, kind: type) -> np.ndarray:
    """The costs of affine_gap() for a column of characters for each pair; all are whole numbers."""
    steps = np.arange(len(y) + 1, dtype=kind)[:, None]
    best = np.empty((len(y) + 1, x.shape[1]), kind)
    best[0], best[1:] = 0, steps[:-1] + 4
    down = np.full((len(y), x.shape[1]), np.iinfo(kind).max // 2, kind)
    for i in range(len(x)):
        down = np.minimum(down + kind(1), best[1:] + kind(4))
        now = np.empty_like(best)
        now[0] = 4 + i
        np.minimum(down, best[:-1] + np.where(y == x[i], kind(-5), kind(5)), out=now[1:])
        along = np.minimum.accumulate(now[:-1] - steps[:-1], axis=0) + steps[:-1] + kind(4)
        np.minimum(now[1:], along, out=now[1:])
        best = now
    same = (x == y).all(axis=0) if len(x) == len(y) else np.zeros(x.shape[1], bool)
    return np.where(same, -5.0 * len(x), best[-1])


def similarities(a: Sequence[str | None], b: Sequence[str | None]) -> np.ndarray:
    """similarity() of each pair of values."""
    a, b = ([(x or "").strip().lower() for x in s] for s in (a, b))
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(a, b, strict=True)])
    rest = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and x != y]
    if rest:
        n, m = (np.array([len(s[k]) for k in rest]) for s in (a, b))
        low, high = -5.0 * np.minimum(n, m), 4.0 + n + m - 1
        out[rest] = np.maximum(0.0, np.minimum(1.0, 1 - (affine_gaps([a[k] for k in rest], [b[k] for k in rest]) - low) / (high - low)))
    return out


def affine_gap_similarity(a: Column, b: Column) -> Column:
    """similarity() of each pair of values: a pandas UDF, as the engine has no alignment with affine gaps. Equal pairs of a batch are aligned once."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = list(zip(left, right, strict=True))
        each = list(dict.fromkeys(pairs))
        known = dict(zip(each, similarities([x for x, _ in each], [y for _, y in each]), strict=True))
        return pd.Series([known[k] for k in pairs], dtype=float)

    return F.pandas_udf(run, "double")(a, b)


@dataclass(frozen=True)
class Comparison:
    """How a field is compared: levels from the best, each with the least likeness that reaches it."""

    field: str
    levels: tuple[tuple[str, float], ...] = (("exact", 1.0), ("close", 0.88), ("partial", 0.70))

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.levels] + ["none"]


def patterns(pairs: DataFrame, records: DataFrame, comparisons: Sequence[Comparison], id_col: str = "id") -> DataFrame:
    """pairs with a column level_<field> for each comparison; a null on either side is none."""
    fields = [c.field for c in comparisons]
    l = records.select(F.col(id_col).alias("left"), *[F.col(f).cast("string").alias(f"_l_{f}") for f in fields])
    r = records.select(F.col(id_col).alias("right"), *[F.col(f).cast("string").alias(f"_r_{f}") for f in fields])
    met = pairs.join(l, "left").join(r, "right")
    for c in comparisons:
        a, b = F.col(f"_l_{c.field}"), F.col(f"_r_{c.field}")
        met = met.withColumn(f"_s_{c.field}", F.when(a.isNull() | b.isNull(), F.lit(-1.0)).otherwise(affine_gap_similarity(a, b)))
    levels = []
    for c in comparisons:
        out = F.when(F.col(f"_s_{c.field}") >= c.levels[0][1], F.lit(c.levels[0][0]))
        for name, least in c.levels[1:]:
            out = out.when(F.col(f"_s_{c.field}") >= least, F.lit(name))
        levels.append(out.otherwise(F.lit("none")).alias(f"level_{c.field}"))
    return met.select(*pairs.columns, *levels)


@dataclass
class Model:
    prior: float = 0.5
    m: dict[str, dict[str, float]] = field(default_factory=dict)
    u: dict[str, dict[str, float]] = field(default_factory=dict)
    rounds: int = 0


def fit(compared: DataFrame, comparisons: Sequence[Comparison], most_rounds: int = 30, tolerance: float = 1e-5) -> Model:
    """Expectation maximisation over the distinct patterns and their counts, which number at most the product of levels: one aggregation, then the driver."""
    names = {c.field: c.names for c in comparisons}

    def seed(levels: list[str], strong: int) -> dict[str, float]:
        rest = 0.15 / (len(levels) - 1)
        return {x: 0.85 if k == strong else rest for k, x in enumerate(levels)}

    model = Model(0.1, {f: seed(n, 0) for f, n in names.items()}, {f: seed(n, len(n) - 1) for f, n in names.items()})
    fields = list(names)
    rows = compared.groupBy(*[f"level_{f}" for f in fields]).count().collect()
    rows = sorted(((tuple(r[f"level_{f}"] for f in fields), r["count"]) for r in rows))
    if not rows:
        flat = {f: {x: 1 / len(n) for x in n} for f, n in names.items()}
        return Model(0.5, flat, {f: dict(v) for f, v in flat.items()})
    total = sum(n for _, n in rows)
    eps = 1e-9
    for model.rounds in range(1, most_rounds + 1):
        share = []
        for pattern, _ in rows:
            a = model.prior * math.prod(model.m[f][x] for f, x in zip(fields, pattern, strict=True))
            b = (1 - model.prior) * math.prod(model.u[f][x] for f, x in zip(fields, pattern, strict=True))
            share.append(a / (a + b) if a + b else 0.0)
        prior = min(1 - 1e-6, max(1e-6, sum(g * n for g, (_, n) in zip(share, rows, strict=True)) / total))
        moved = abs(prior - model.prior)
        new_m, new_u = {}, {}
        for k, f in enumerate(fields):
            for old, new, weight in ((model.m, new_m, lambda g: g), (model.u, new_u, lambda g: 1 - g)):
                sums = {x: eps for x in names[f]}
                for g, (pattern, n) in zip(share, rows, strict=True):
                    sums[pattern[k]] += weight(g) * n
                whole = sum(sums.values())
                new[f] = {x: v / whole for x, v in sums.items()}
                moved += sum(abs(new[f][x] - old[f][x]) for x in names[f])
        model.prior, model.m, model.u = prior, new_m, new_u
        if moved < tolerance:
            break
    return model


def score(compared: DataFrame, comparisons: Sequence[Comparison], model: Model) -> DataFrame:
    """compared with weight (log2 of the odds, between -500 and 500) and probability."""
    weight = F.lit(math.log2(model.prior / (1 - model.prior)))
    for c in comparisons:
        table = F.create_map(*[F.lit(v) for x in c.names for v in (x, math.log2(model.m[c.field][x] / model.u[c.field][x]))])
        weight = weight + F.element_at(table, F.col(f"level_{c.field}"))
    clamped = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), weight))
    return compared.withColumn("weight", clamped).withColumn("probability", F.pow(F.lit(2.0), F.col("weight")) / (1 + F.pow(F.lit(2.0), F.col("weight"))))


def average_linkage(ids: list, links: dict[tuple, float], threshold: float) -> list[list]:
    """Clusters of one component: the two with the highest mean score merge while it reaches the threshold; absent pairs count 0, the last of equal ones goes first.

    Only linked pairs are held, in a heap of their means; a pair whose clusters have changed since is passed over.
    """
    groups: list[list | None] = [[i] for i in sorted(ids)]
    if threshold <= 0 and groups:
        return [[g[0] for g in groups]]
    at = {g[0]: k for k, g in enumerate(groups)}
    total: list[dict[int, float]] = [{} for _ in groups]
    for (a, b), p in links.items():
        if a != b:
            total[at[a]][at[b]] = total[at[b]][at[a]] = p
    age = [0] * len(groups)
    heap = [(-p, -i, -j, 0, 0) for i, near in enumerate(total) for j, p in near.items() if i < j and p >= threshold]
    heapq.heapify(heap)
    while heap:
        _, i, j, old_i, old_j = heapq.heappop(heap)
        a, b = -i, -j
        if groups[a] is None or groups[b] is None or age[a] != old_i or age[b] != old_j:
            continue
        groups[a] += groups[b]
        groups[b] = None
        age[a] += 1
        del total[a][b]
        for c, p in total[b].items():
            if c != a:
                del total[c][b]
                total[a][c] = total[c][a] = total[a].get(c, 0.0) + p
        total[b] = {}
        for c, p in total[a].items():
            mean = p / (float(len(groups[a])) * len(groups[c]))
            if mean >= threshold:
                heapq.heappush(heap, (-mean, -min(a, c), -max(a, c), age[min(a, c)], age[max(a, c)]))
    return [sorted(g) for g in groups if g is not None]


def spanning_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges that connect what edges (src, dst) connect: of each Arrow batch a star for each of its components, so pairs of blocks shrink to about their records before any are shuffled."""
    s, d = dict(edges.dtypes)[src], dict(edges.dtypes)[dst]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = pa.chunked_array([batch.column(0), batch.column(1)]).combine_chunks().dictionary_encode()
            code = met.indices.to_numpy()
            up = list(range(len(met.dictionary)))

            def top(k: int, up: list[int] = up) -> int:
                while up[k] != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            for a, b in np.unique(np.stack([code[: batch.num_rows], code[batch.num_rows :]], axis=1), axis=0).tolist():
                up[top(a)] = top(b)
            roots = np.array([top(k) for k in range(len(up))], np.int64)
            far = np.flatnonzero(roots != np.arange(len(up)))
            yield pa.RecordBatch.from_arrays([met.dictionary.take(pa.array(far)), met.dictionary.take(pa.array(roots[far]))], names=[src, dst])

    return edges.select(src, dst).filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).mapInArrow(run, f"`{src}` {s}, `{dst}` {d}")


def clusters(records: DataFrame, scored: DataFrame, threshold: float = 0.9, linkage: str = "average", id_col: str = "id") -> DataFrame:
    """(cluster_id, record_ids, size, cohesion), the largest first, then by first id; records alone have cohesion 1.

    Pairs under the threshold are dropped, so clusters never leave a connected component, and average linkage runs in each
    component by itself. Cohesion is the mean probability of the pairs that cleared the threshold within the cluster.
    """
    good = scored.filter(F.col("probability") >= threshold).select("left", "right", "probability")
    comp = connected_components(spanning_edges(good, "left", "right"), "left", "right")
    kind = dict(records.dtypes)[id_col]
    inside = good.join(comp.select(F.col("node").alias("left"), "component"), "left")
    if linkage == "average":

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            links = {(a, b): p for a, b, p in zip(rows["left"], rows["right"], rows["probability"], strict=True)}
            out, cluster = [], {}
            for g in average_linkage(sorted({x for pair in links for x in pair}), links, threshold):
                cluster |= dict.fromkeys(g, g[0])
            within: dict = {}
            for a, b, p in zip(rows["left"], rows["right"], rows["probability"], strict=True):
                if cluster[a] == cluster[b]:
                    within.setdefault(cluster[a], []).append(p)
            mean = {g: math.fsum(ps) / len(ps) for g, ps in within.items()}
            out = [(i, g, mean.get(g)) for i, g in cluster.items()]
            return pd.DataFrame(out, columns=["node", "component", "cohesion"])

        comp = inside.groupBy("component").applyInPandas(run, f"node {kind}, component {kind}, cohesion double")
    else:
        comp = comp.join(inside.groupBy("component").agg(F.avg("probability").alias("cohesion")), "component").select("node", "component", "cohesion")
    member = records.select(F.col(id_col).alias("node")).distinct().join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "cohesion")
    grouped = member.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("record_ids"), F.count("*").alias("size"), F.max("cohesion").alias("cohesion"))
    ordered = numbered(grouped.select("record_ids", "size", "cohesion", (-F.col("size")).alias("_less"), F.col("record_ids")[0].alias("_first")), "_less", "_first", name="cluster_id")
    return ordered.select(F.col("cluster_id"), "record_ids", "size", F.coalesce("cohesion", F.lit(1.0)).alias("cohesion"))


def pairs_avoided(n_records: Column, compared: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(n_records * (n_records - 1) / 2) - compared)


def resolve(records: DataFrame, comparisons: Sequence[Comparison], predicates: Sequence[tuple[str, str]] | None = None, id_col: str = "id", threshold: float = 0.9, linkage: str = "average", max_block: int = 200) -> tuple[DataFrame, DataFrame, Model]:
    """Clusters, scored pairs and the model."""
    if not comparisons:
        raise ValueError("nothing to compare")
    keys = block_keys(records, predicates or [("first4", comparisons[0].field), ("token", comparisons[0].field), ("alpha", comparisons[0].field)], id_col)
    compared = cut(compared_pairs(keys, records, comparisons, max_block, id_col), "compared")
    model = fit(compared, comparisons)
    scored = score(compared, comparisons, model)
    return clusters(records, scored, threshold, linkage, id_col), scored, model
