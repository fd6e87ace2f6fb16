"""SimHash near-duplicates: pigeonhole blocks, verified by Hamming distance.

A fingerprint is cut into blocks of bits. Two fingerprints that differ in at most d bits agree on all bits of at least
(blocks - d) blocks, so they share the bucket of one choice of (blocks - d) blocks. Buckets are compared without
writing out pairs: a search through the bucket emits a spanning forest of its links, which has the same components.
Buckets above a size are cut into a grid of cells, each a task of its own, so that no bucket is one task's whole work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from marlstone.llm.common import join_stats, materialise, signed
from marlstone.llm.components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Members of a bucket that one task compares.
CELL = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a whole text; zero without words (null, empty, white space alone)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split() parts at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    cuts = [joined[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(42)), np.uint64, len(cuts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_535):
        part = hashes[k : k + 65_535]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, beside: Column | None = None) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long; with beside, that as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["id", "fp", "beside"][: batch.num_columns])

    more = [] if beside is None else [beside.alias("beside")]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more)
    return source.mapInArrow(run, S.StructType([S.StructField("id", S.LongType()), S.StructField("fp", S.LongType()), *source.schema.fields[2:]]))


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask of bits for each choice of (blocks - distance) blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(choice) for choice in combinations(parts, blocks - distance)]


def _blocks_for(n: int, distance: int) -> int:
    """Blocks enough that a bucket's key has some bits more than the logarithm of the rows; any choice gives the same links."""
    blocks = distance + 1
    while blocks < distance + 6 and 64 * (blocks - distance) // blocks < max(1, n).bit_length() + 4:
        blocks += 1
    return blocks


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the components of one cell: each fingerprint is compared once with all that are not reached yet."""
    out, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = np.bitwise_count(left ^ one) <= distance
            if near.any():
                found = left[near]
                out += [(int(one), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def links(fps: DataFrame, distance: int = 3, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within distance."""
    blocks = blocks or _blocks_for(fps.count(), distance)
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, distance)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("k", "part")).select("fp", F.xxhash64("k", "part").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = join_stats(keyed, sizes.withColumn("size", F.col("n")), "bucket", "n")
    parts = F.ceil(F.col("size") / F.lit(cell)).cast("int")
    cells = (
        met.withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
        .select("fp", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_cell, kept = np.empty(0, np.int64), np.empty(0, np.uint64)

        def done(cells_: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(cells_)) + 1
            found = [e for group in np.split(values, cut) for e in _forest(np.unique(group), distance)]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept_cell = np.concatenate([kept_cell, batch.column(0).to_numpy()])
            kept = np.concatenate([kept, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(kept_cell, kept_cell[-1]))  # the last cell may go on in the next batch
            if whole:
                yield done(kept_cell[:whole], kept[:whole])
                kept_cell, kept = kept_cell[whole:], kept[whole:]
        if len(kept):
            yield done(kept_cell, kept)

    return cells.select("cell", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, blocks: int | None = None, cell: int = CELL, hot_rows: int = 200_000, beside: Column | None = None) -> DataFrame:
    """One row for each row of docs: id, fp (signed long), component_id (the smallest id that links reach), component (the
    same for the rows of a component, and for no others, even where ids repeat); with beside, that as a further column.

    Null or wordless texts have fingerprint zero and are linked like any other. A null id keeps its row; it counts as no
    id, so a component of null ids has a null component_id. Repeated rows stay repeated. Other columns of docs are not read.
    """
    own = materialise(fingerprints(docs, id_col, text_col, shingle, beside), "simhash")
    each = materialise(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-each")
    joined = connected_components(links(each.select("fp"), distance, blocks, cell), "a", "b", hot_rows)
    linked = each.join(joined, each["fp"] == joined["node"], "inner").select("fp", "least", "n", "component")
    of = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    settled = join_stats(linked, of, "component", "members", "inner", hot_rows).select("fp", "component_id", "component", "n")
    alone = each.join(settled.select("fp"), "fp", "left_anti").filter("n > 1").select("fp", F.col("least").alias("component_id"), F.col("fp").alias("component"), "n")
    labels = materialise(settled.unionByName(alone), "simhash-labels")
    return join_stats(own, labels, "fp", "n", "left", hot_rows).select("id", "fp", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("component", "fp").alias("component"), *own.columns[2:])


def op8_simhash(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), signed(F.col("fp")).alias("fingerprint"), "component_id")
