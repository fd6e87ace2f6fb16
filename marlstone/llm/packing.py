"""Vector bin packing of tokenised documents into fixed-length training sequences.

A piece takes room in three dimensions: tokens, segments and loss-bearing tokens. Pieces that fill a sequence by
themselves are cut off first. The rest are packed lot by lot: for the open sequence, of all pieces that fit, the one whose
demand has the largest dot product with the room left (both as shares of the limits) goes in, until none fits. Sequences
with almost no padding are given out; the pieces of the others join the next lot. At the end of a task, and when too many
are left, they are laid end to end and cut into full sequences, and the last into lengths that are powers of two, which need
no padding.

Each task packs what it reads: nothing is shuffled, and memory is one lot. A lost task runs again with the same numbers.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder:
    """Ids of a byte-level BPE, as the tokenizers library gives them without added special tokens; texts that hold a special token's name by that library itself. Ids must be below 65,536."""

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        self.path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(table.values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary don't fit in 16 bits")
        self.bpe = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.whole = None

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text and "<|endoftext|>" in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16)
        return np.frombuffer(array("H", self.bpe.encode_ordinary(text)), np.uint16)


@lru_cache(1)
def encoder(tokenizer: str | None, ranks: str | None, pattern: str | None) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(tokenizer, ranks, pattern)


class Piece:
    __slots__ = ("doc", "ids", "loss_from", "start", "total")

    def __init__(self, doc: int | None, start: int, ids: np.ndarray, total: int, loss_from: int):
        self.doc, self.start, self.ids, self.total, self.loss_from = doc, start, ids, total, loss_from

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.loss_from))

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:at], self.total, self.loss_from), Piece(self.doc, self.start + at, self.ids[at:], self.total, self.loss_from)

    def room(self, tokens: int, loss: int) -> int:
        """How many of its leading tokens fit."""
        return min(len(self.ids), tokens, max(0, self.loss_from - self.start) + loss)


class Packer:
    def __init__(self, tokens: int = 1024, segments: int = 256, loss: int = 1024, lot: int = 4096, slack: int = 4):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss, self.lot, self.slack = tokens, segments, loss, lot, slack
        self.waiting: list[Piece] = []

    def add(self, doc: int | None, ids: np.ndarray, loss_from: int = 0) -> Iterator[list[Piece]]:
        """Sequences that are ready after one more document."""
        rest = Piece(doc, 0, ids, len(ids), loss_from)
        while len(rest.ids) and (n := rest.room(self.tokens, self.loss)) < len(rest.ids) or n == self.tokens:
            one, rest = rest.cut(n)
            if n == self.tokens:
                yield [one]
            else:
                self.waiting.append(one)
            if not len(rest.ids):
                break
        if len(rest.ids):
            self.waiting.append(rest)
        if len(self.waiting) >= self.lot:
            yield from self._pack()

    def _pack(self) -> Iterator[list[Piece]]:
        pieces = self.waiting
        need = np.array([(len(p.ids), 1, p.loss) for p in pieces], float)
        order = np.lexsort((need[:, 2], -need[:, 0]))  # largest first; of equal products the first counts
        pieces, need = [pieces[k] for k in order], need[order]
        share = need / self.limits
        free = np.ones(len(pieces), bool)
        kept: list[Piece] = []
        begin = 0
        while begin < len(pieces):
            if not free[begin]:
                begin += 1
                continue
            left, chosen = self.limits - need[begin], [begin]
            free[begin] = False
            while left.min() > 0 or (left[0] > 0 and left[1] > 0):
                fits = free[begin:] & (need[begin:] <= left).all(axis=1)
                if not fits.any():
                    break
                best = begin + int(np.argmax(np.where(fits, share[begin:] @ (left / self.limits), -1)))
                free[best] = False
                left = left - need[best]
                chosen.append(best)
            group = [pieces[k] for k in chosen]
            if left[0] <= self.slack:
                yield group
            else:
                kept += group
        self.waiting = kept
        if len(kept) > self.lot // 2:
            yield from self._end_to_end()

    def _end_to_end(self) -> Iterator[list[Piece]]:
        pieces, self.waiting = self.waiting[::-1], []
        while pieces:
            now, tokens, loss = [], self.tokens, self.loss
            while pieces and len(now) < self.segments and tokens:
                n = pieces[-1].room(tokens, loss)
                if not n:
                    break
                one = pieces.pop()
                if n < len(one.ids):
                    one, rest = one.cut(n)
                    pieces.append(rest)
                now.append(one)
                tokens, loss = tokens - n, loss - one.loss
            yield from self._powers(now) if tokens else [now]

    @staticmethod
    def _powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
        """The same tokens in sequences whose lengths are powers of two."""
        pieces = pieces[::-1]
        left = sum(len(p.ids) for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            now = []
            while size:
                one = pieces.pop()
                if len(one.ids) > size:
                    one, rest = one.cut(size)
                    pieces.append(rest)
                now.append(one)
                size -= len(one.ids)
            yield now

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._pack() if self.waiting else ()
        yield from self._end_to_end()


_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, prompt_end: str | None = None, tokens: int = 1024, segments: int = 256, loss: int = 1024, lot: int = 4096, end_id: int = 0, tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    Every document ends with end_id; a null or empty text is that id alone. prompt_col: how many leading tokens bear no
    loss (null or none: 0); prompt_end: the tokens of the text before the first place where this is bear none, as an
    instruction before its answer (nowhere: all bear loss). Repeated rows and null ids are packed like any other; an empty table gives no rows. Other columns
    are not read. tokenizer, ranks and pattern: the vocabulary's files and its pattern.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = encoder(tokenizer, ranks, pattern), Packer(tokens, segments, loss, lot)
        end = np.array([end_id], np.uint16)
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def note(sequences: Iterator[list[Piece]]) -> None:
            nonlocal number
            for sequence in sequences:
                at = 0
                for p in sequence:
                    rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, number, at, p.loss))
                    at += len(p.ids)
                number += 1

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_SCHEMA)
            rows.clear()
            return batch

        for batch in batches:
            for doc, text, prompt in zip(*(batch.column(k) for k in range(3)), strict=True):
                whole = text.as_py() or ""
                free = prompt.as_py() or 0
                if prompt_end and (k := whole.find(prompt_end)) > 0:
                    free = max(free, len(words.ids(whole[:k])))
                note(packer.add(doc.as_py(), np.concatenate([words.ids(whole), end]), free))
                if len(rows) > 20_000:
                    yield out()
        note(packer.finish())
        if rows:
            yield out()

    prompt = F.col(prompt_col).cast("long") if prompt_col else F.lit(0).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), prompt.alias("prompt"))
    return source.mapInArrow(run, ", ".join(f"{c} long" for c in _SCHEMA.names))


def op9_packing(docs: DataFrame) -> DataFrame:
    """The query's columns. A document's first line counts as its prompt, which bears no loss."""
    return pack(docs, prompt_end="\n").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
