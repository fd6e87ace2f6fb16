"""Exact substring deduplication: bytes covered by a string of a given length that also starts anywhere else.

A suffix array of a whole corpus has no place in a cluster's tasks, so only suffixes at anchors are sorted. The anchor of
a string of `length` bytes is its least GRAM-byte window (the leftmost of equal ones), a function of the string alone:
equal strings have equal anchors at the same offset, and each start of a string belongs to exactly one anchor. An anchor
thus owns a run of starts, and with their strings a stretch of text. Anchors that occur once are done. Equal stretches
need no look inside. Of the different stretches around one anchor, the suffixes to its right and the reversed prefixes
to its left are sorted (see suffixes.py); walking from an item to its neighbours in order, common extensions fall, so
the first neighbour whose left and right extensions add up to the length gives the furthest covered byte.

All shuffles move anchors (about one for each 170 bytes, most of which go after the count), and the text of documents
that hold a repeated anchor, once. Anchors with more different stretches than a task should hold are resolved start by
start, as rows, so no cap drops any case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import HOT_ROWS, join_stats, materialise
from marlstone.llm.suffixes import Hashed, Strings, sort

#: Bytes of a document that are hashed at once.
BUFFER = 1 << 19
#: Low bits of an ordering key that hold the position in the buffer.
_AT = np.uint64((1 << 21) - 1)
#: Different stretches around one anchor that one task compares.
GROUP = 16_384


def _anchors_of(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For documents that lie one after another: document, ordering hash, first and last start owned, and anchor, all in the buffer's positions."""
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    if len(data) < length:
        return none
    span = length - gram + 1  # windows in a string
    keys = Hashed(data).windows(gram)
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(32)
    keys *= np.uint64(0x94D049BB133111EB)
    ordered = (keys & ~_AT) | np.arange(len(keys), dtype=np.uint64)
    n = len(data) - length + 1
    blocks = -(-len(ordered) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ordered)] = ordered
    table = padded.reshape(blocks, span)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(after[:n], before[span - 1 : span - 1 + n]) & _AT).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:n]
    ok = np.arange(n) + length <= ends[doc]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1]) | (doc[1:] != doc[:-1])
    low = np.flatnonzero(change)
    high = np.append(low[1:], n) - 1
    low, high = low[ok[low]], high[ok[low]]
    return doc[low], keys[anchor[low]].view(np.int64), low, high, anchor[low]


def _pieces(texts: list[bytes], length: int, most: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Documents in buffers of about `most` bytes; a longer one in pieces that overlap by length - 1 bytes, so every start is in one piece."""
    which, offsets, parts, total = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), most):
            part = text[at : at + most + length - 1]
            if len(part) < length:
                continue
            if parts and total + len(part) > most + length:
                yield which, offsets, parts
                which, offsets, parts, total = [], [], [], 0
            which.append(k)
            offsets.append(at)
            parts.append(part)
            total += len(part)
    if parts:
        yield which, offsets, parts


_ANCHOR = "doc_id long, th long, h long, e binary, p long, lo long, hi long"


def anchors(docs: DataFrame, length: int, gram: int, buffer: int = BUFFER) -> DataFrame:
    """One row for each anchor of docs (doc_id, th, text): h hashes the anchor, e the stretch; p, lo and hi are the anchor and the first and last start that it owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("h", pa.int64()), ("e", pa.binary()), ("p", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
        for batch in batches:
            texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            for which, offsets, parts in _pieces(texts, length, buffer):
                joined = b"".join(parts)
                doc, h, low, high, at = _anchors_of(np.frombuffer(joined, np.uint8), np.array([len(p) for p in parts]), length, gram)
                if not len(doc):
                    continue
                digest = xxhash.xxh3_128_digest
                e = [digest(joined[a:b]) for a, b in zip(low.tolist(), (high + length).tolist(), strict=True)]
                sizes = np.array([len(p) for p in parts])
                shift = np.array(offsets)[doc] - (np.cumsum(sizes) - sizes)[doc]
                row = pa.array(np.array(which)[doc])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(h), pa.array(e, pa.binary()), pa.array(at + shift), pa.array(low + shift), pa.array(high + shift)], schema=schema)

    return docs.select("doc_id", "th", "text").mapInArrow(run, _ANCHOR)


def _reach(mine: Strings, order: np.ndarray, group: np.ndarray, own: int, other: int, text: tuple[Hashed, Hashed], length: int, other_most: np.ndarray) -> np.ndarray:
    """For each item the longest extension on the `own` side, over all items of its group whose two extensions add up to length; 0 if none."""
    n = len(order)
    best = np.zeros(n, np.int64)
    for way in (-1, 1):
        here = np.arange(n)
        run = np.full(n, np.iinfo(np.int64).max)
        step = 0
        while len(here):
            step += 1
            there = here + way * step
            inside = (there >= 0) & (there < n)
            here, run, there = here[inside], run[inside], there[inside]
            inside = group[there] == group[here]
            here, run, there = here[inside], run[inside], there[inside]
            if not len(here):
                break
            i, j = order[here], order[there]
            near = order[there - way]
            run = np.minimum(run, mine.common(own, near, j))
            alive = (run + other_most[i] >= length) & (run > best[i])  # extensions only fall from here on
            here, run, i, j = here[alive], run[alive], i[alive], j[alive]
            if not len(here):
                break
            rest = mine.common(other, i, j)
            found = run + rest >= length
            if found.any():
                a, b, size, more = i[found], j[found], run[found], rest[found]
                (x, x_at, _), (y, y_at, _) = mine.parts[own], mine.parts[other]
                if not (x.equal(x_at[a], x_at[b], size).all() and y.equal(y_at[a], y_at[b], more).all()):
                    raise ValueError("collision")
                np.maximum.at(best, a, size)
            here, run = here[~found], run[~found]
    return best


def _brute(left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as cover() for one group by comparing all bytes: only for a group in which a hash collided."""

    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        return next((k for k in range(n) if a[k] != b[k]), n)

    out = np.zeros((2, len(left)), np.int64)
    for i in range(len(left)):
        for j in range(len(left)):
            if i != j and (x := common(left[i], left[j])) + (y := common(right[i], right[j])) >= length:
                out[:, i] = np.maximum(out[:, i], (x, y))
    return out[0], out[1]


def cover(group: np.ndarray, stretches: list[bytes], before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after each item's anchor that are covered (0 and 0: none). group is in order; before: where the anchor is in its stretch."""
    n = len(group)
    sizes = np.array([len(s) for s in stretches])
    starts = np.cumsum(sizes) - sizes
    forward = np.frombuffer(b"".join(stretches), np.uint8)
    right, left = Hashed(forward), Hashed(forward[::-1].copy())
    right_at, right_len = starts + before, sizes - before
    left_at, left_len = len(forward) - right_at, before
    try:
        by_right = Strings(right, right_at, right_len, left, left_at, left_len)
        order_r = sort(by_right, group)
        by_left = Strings(left, left_at, left_len, right, right_at, right_len)
        order_l = sort(by_left, group)

        def most(strings: Strings, order: np.ndarray) -> np.ndarray:
            out = np.zeros(n, np.int64)
            beside = np.flatnonzero(group[1:] == group[:-1])
            near = strings.common(0, order[beside], order[beside + 1])
            np.maximum.at(out, order[beside], near)
            np.maximum.at(out, order[beside + 1], near)
            return out

        most_r, most_l = most(by_right, order_r), most(by_left, order_l)
        got_l = _reach(by_left, order_l, group, 0, 1, (left, right), length, most_r)
        got_r = _reach(by_right, order_r, group, 0, 1, (right, left), length, most_l)
        return got_l, got_r
    except ValueError:
        outs = [_brute([stretches[k][: before[k]][::-1] for k in w], [stretches[k][before[k] :] for k in w], length) for w in np.split(np.arange(n), np.flatnonzero(np.diff(group)) + 1)]
        return np.concatenate([x for x, _ in outs]), np.concatenate([y for _, y in outs])


_SPANS = "doc_id long, th long, a long, b long"


def _partial(stretches: DataFrame, length: int) -> DataFrame:
    """Covered bytes around anchors that have several different stretches: rows (h, doc_id, th, p, lo, hi, part) in, spans out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "th", "a", "b")])

        def done(t: pa.Table) -> pa.RecordBatch:
            h, p, lo = (t.column(c).to_numpy() for c in ("h", "p", "lo"))
            group = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]).astype(np.int64))))
            left, right = cover(group, t.column("part").to_pylist(), p - lo, length)
            keep = np.flatnonzero(right)
            rows = pa.array(keep)
            return pa.RecordBatch.from_arrays([t.column(c).take(rows).combine_chunks() if t.num_rows else pa.array([], pa.int64()) for c in ("doc_id", "th")] + [pa.array((p - left)[keep]), pa.array((p + right)[keep])], schema=schema)

        kept: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if size < 4 << 20:
                continue
            t = pa.Table.from_batches(kept)
            h = t.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))
            if whole:
                yield done(t.slice(0, whole).combine_chunks())
                kept = t.slice(whole).combine_chunks().to_batches()
                size = sum(b.nbytes for b in kept)
        if kept:
            yield done(pa.Table.from_batches(kept).combine_chunks())

    return stretches.repartition("h").sortWithinPartitions("h").select("h", "doc_id", "th", "p", "lo", "part").mapInArrow(run, _SPANS)


def _startwise(stretches: DataFrame, length: int, hot_rows: int) -> DataFrame:
    """The same for anchors with very many stretches: a row for each start, joined on the hash of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, strings = [], []
            for k, (lo, part) in enumerate(zip(batch.column("lo").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                for s in range(len(part) - length + 1):
                    at.append((k, lo + s))
                    strings.append(xxhash.xxh3_128_digest(part[s : s + length]))
            which = pa.array([k for k, _ in at], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), batch.column("th").take(which), pa.array([s for _, s in at], pa.int64()), pa.array(strings, pa.binary())], names=["doc_id", "th", "a", "w"])

    starts = materialise(stretches.select("doc_id", "th", "lo", "part").mapInArrow(run, "doc_id long, th long, a long, w binary"), "suffix-starts")
    twice = starts.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1")
    return join_stats(starts, twice, "w", "n", "inner", hot_rows).select("doc_id", "th", "a", (F.col("a") + length).alias("b"))


_REMOVED = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _keep(text: bytes, spans: list[dict] | None) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal runs that spans cover, in order, and the bytes outside of them."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or []):
        if runs and a <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], b)
        else:
            runs.append((a, b))
    cuts = [0, *(x for run in runs for x in run), len(text)]
    return runs, b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64, group: int = GROUP, hot_rows: int = HOT_ROWS, buffer: int = BUFFER, columns: Sequence[str | Column] = ("n_bytes", "spans", "kept")) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (of the text), spans (the removed runs, start and end in bytes) and kept (the bytes that are left).

    Null texts are empty; texts under `length` bytes lose nothing. Rows that repeat cover each other. Ids may be null or
    repeat: a document is told by its id and its text. Other columns of docs are not read. What is kept is binary, as a
    run may start or end inside a character. With columns, these are made of the three and returned in their place; a
    document that loses nothing is then joined without its text.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    every = materialise(anchors(source, length, gram, buffer), "suffix-anchors")
    counts = every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialise(join_stats(every, counts, "h", "n", "inner", hot_rows), "suffix-shared")
    by_stretch = materialise(shared.groupBy("e").agg(F.count("*").alias("n"), F.first("h").alias("h"), F.min(F.struct("doc_id", "th", "p", "lo", "hi")).alias("one")), "suffix-stretches")
    whole = join_stats(shared, by_stretch.filter("n > 1").select("e", "n"), "e", "n", "inner", hot_rows).select("doc_id", "th", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    variants = by_stretch.groupBy("h").agg(F.count("*").alias("variants"), F.min("n").alias("least")).filter("variants > 1 AND least = 1")
    partial = materialise(join_stats(by_stretch.select("h", "one.*"), variants.select("h", "variants", F.col("variants").alias("size")), "h", "variants", "inner", hot_rows), "suffix-partial")
    held = shared.groupBy("doc_id", "th").agg(F.count("*").alias("anchors"))
    texts = materialise(source.alias("s").join(held.alias("k"), F.col("s.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("s.th") == F.col("k.th")), "left_semi"), "suffix-texts")
    wanted = partial.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "p", "lo", "hi", "size")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("h", "size", "doc_id", "th", "p", "lo", "part")}
            for doc_id, th, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for x in parts:
                    for c, v in (("h", x["h"]), ("size", x["size"]), ("doc_id", doc_id), ("th", th), ("p", x["p"]), ("lo", x["lo"]), ("part", text[x["lo"] : x["hi"] + length])):
                        rows[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "part" else pa.int64()) for c, v in rows.items()], names=list(rows))

    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))
    stretches = texts.alias("t").join(wanted.alias("w"), same("t", "w")).select("t.doc_id", "t.th", "t.text", "w.parts").mapInArrow(cut, "h long, size long, doc_id long, th long, p long, lo long, part binary")
    stretches = materialise(stretches, "suffix-parts")
    spans = whole.unionByName(_partial(stretches.filter(F.col("size") <= group), length))
    if stretches.filter(F.col("size") > group).limit(1).count():
        spans = spans.unionByName(_startwise(stretches.filter(F.col("size") > group), length, hot_rows))
    merged = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_keep(t, s) for t, s in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            runs = [[{"start": a, "end": b} for a, b in r] for r, _ in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(runs, _RUNS), pa.array([k for _, k in out], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    touched = texts.alias("t").join(merged.alias("m"), same("t", "m"), "left").select("t.doc_id", "t.text", "m.spans").mapInArrow(keep, _REMOVED).select("doc_id", *columns)
    plain = source.select("doc_id", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"), F.col("text").cast("binary").alias("kept")).select("doc_id", "th", *columns)
    rest = plain.alias("s").join(held.alias("k"), same("s", "k"), "left_anti").drop("th")
    return rest.unionByName(touched)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64, group: int = GROUP, hot_rows: int = HOT_ROWS, buffer: int = BUFFER) -> DataFrame:
    """What remove() does with each row of docs, in figures: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    figures = ["n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    return remove(docs, id_col, text_col, length, gram, group, hot_rows, buffer, figures)


def op6_suffix_dedup(docs: DataFrame) -> DataFrame:
    return dedup(docs)
