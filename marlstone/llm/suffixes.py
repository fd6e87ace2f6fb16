"""Hash-compared suffix sort: prefix polynomial hashes and binary search give common extensions in logarithmic time.

Strings lie one after another in a byte buffer. A prefix sum of hashed bytes times powers of an odd base (modulo 2**64)
gives the hash of any stretch with one subtraction and one product, whatever its length, so that the common extension of
two suffixes is found by binary search. A stable bottom-up mergesort compares suffixes that way, all groups and all
merges of a level at once. Since a chain of neighbours in order is in order throughout, it is enough to verify the bytes
of neighbours after the sort; a group in which that fails (a collision) is sorted again by its bytes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(2**62, 2**63, dtype=np.uint64)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


class Hashed:
    """Prefix hashes of a byte buffer."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.up, down = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * down[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.up[start]

    def windows(self, length: int) -> np.ndarray:
        """The hash of every stretch of one length."""
        n = len(self.data) - length + 1
        return (self.prefix[length:] - self.prefix[:n]) * self.up[:n] if n > 0 else np.empty(0, np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The longest common extension of the suffixes at a and b, at most so long, by binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.of(a, middle) == self.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes of stretches are the same: verification without hashes."""
        total = int(length.sum())
        if not total:
            return np.ones(len(a), bool)
        first = np.cumsum(length) - length
        step = np.arange(total) - np.repeat(first, length)
        differ = self.data[np.repeat(a, length) + step] != self.data[np.repeat(b, length) + step]
        return np.bincount(np.repeat(np.arange(len(a)), length), differ, len(a)) == 0


class Strings:
    """Items that each have a first and a second string; they are ordered by the first, and by the second where those are equal."""

    def __init__(self, first: Hashed, first_at: np.ndarray, first_len: np.ndarray, second: Hashed, second_at: np.ndarray, second_len: np.ndarray):
        self.parts = ((first, first_at, first_len), (second, second_at, second_len))

    def common(self, part: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        text, at, length = self.parts[part]
        return text.common(at[a], at[b], np.minimum(length[a], length[b]))

    def less(self, a: np.ndarray, b: np.ndarray, verify: bool = False) -> np.ndarray:
        """-1, 0 or 1 for each pair; with verify, 2 where a hash lied."""
        out = np.zeros(len(a), np.int64)
        todo = np.arange(len(a))
        for part, (text, at, length) in enumerate(self.parts):
            i, j = a[todo], b[todo]
            same = self.common(part, i, j)
            bad = ~text.equal(at[i], at[j], same) if verify else np.zeros(len(i), bool)
            ended_i, ended_j = same == length[i], same == length[j]
            x = np.where(ended_i, -1, text.data[np.minimum(at[i] + same, len(text.data) - 1)].astype(np.int64)) if len(text.data) else np.full(len(i), -1)
            y = np.where(ended_j, -1, text.data[np.minimum(at[j] + same, len(text.data) - 1)].astype(np.int64)) if len(text.data) else np.full(len(i), -1)
            out[todo] = np.where(bad, 2, np.sign(x - y))
            todo = todo[out[todo] == 0]
            if not len(todo):
                break
        return out

    def bytes_of(self, item: int) -> tuple[bytes, bytes]:
        return tuple(text.data[at[item] : at[item] + length[item]].tobytes() for text, at, length in self.parts)


def sort(strings: Strings, group: np.ndarray) -> np.ndarray:
    """The items' order: groups (a non-decreasing array) stay apart, and within each the strings are in order; a stable mergesort."""
    n = len(group)
    order = np.arange(n)
    if not n:
        return order
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(starts[1:], n)
    first, last = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
    place = np.arange(n) - first
    width, longest = 1, int((ends - starts).max())
    while width < longest:
        run = place // width
        left = run % 2 == 0
        own = first + run * width
        other = np.where(left, own + width, own - width)
        stop = np.minimum(other + width, last)
        low, high = np.minimum(other, last).copy(), stop.copy()
        base = low.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            sign = strings.less(order[middle], order[todo])
            # items of the left run go before equal ones of the right
            after = np.where(left[todo], sign < 0, sign <= 0)
            low[todo] = np.where(after, middle + 1, low[todo])
            high[todo] = np.where(after, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        at = np.where(left, own, other) + (np.arange(n) - own) + (low - base)
        merged = np.empty(n, np.int64)
        merged[at] = order
        order = merged
        width *= 2
    beside = np.flatnonzero(group[1:] == group[:-1])
    sign = strings.less(order[beside], order[beside + 1], verify=True)
    for g in np.unique(group[beside[sign > 0]]):  # a collision: sort this group by its bytes
        i, j = np.searchsorted(group, g), np.searchsorted(group, g, "right")
        order[i:j] = sorted(range(i, j), key=strings.bytes_of)
    return order
