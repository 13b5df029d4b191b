"""What encoders remember of the texts that they have seen: ids by run of bytes, in arrays instead of objects."""

from __future__ import annotations

import numpy as np


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a longer copy, of ``size`` places at least."""
    return array if len(array) >= size else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


#: Masks of the first bytes of a word of 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def ends_of(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last 8 bytes of runs in ``raw``, as numbers; 8 bytes more than the runs on either side of them."""
    size, eight = end - start, np.ndarray(len(raw) - 7, "<u8", raw, 0, 1)
    return eight[start] & _FIRST[np.minimum(size, 8)], np.where(size > 8, eight[end - 8], np.uint64(0))


class Runs:
    """Numbers for runs of bytes, and the ids of each.

    Runs of up to 16 bytes stand in an open hash table in arrays, by their first and last 8 bytes and their size, which
    are all there is to them (and a mark of 32 or more, added to the size, where the same bytes can have other ids).
    Longer ones stand in a dictionary. A table takes some tens of bytes for each run.
    """

    def __init__(self, dtype: np.dtype):
        self.n = self.used = 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.first, self.last, self.bytes = (np.zeros(1 << 15, t) for t in (np.uint64, np.uint64, np.uint8))
        self.start, self.size, self.asked = (np.zeros(1 << 15, t) for t in (np.int64, np.int32, np.int64))
        self.flat, self.long = np.zeros(1 << 16, dtype), {}

    def _slot(self, first, last, size) -> np.ndarray:
        mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (last * np.uint64(0xC2B2AE3D27D4EB4F)) + size.astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def find(self, first, last, size) -> np.ndarray:
        """The number of each run of up to 16 bytes, -1 where it is unknown."""
        out, slot, left = np.full(len(first), -1, np.int64), self._slot(first, last, size), np.arange(len(first))
        while len(left):
            got = self.slots[slot[left]]
            left, got = left[got >= 0], got[got >= 0]
            same = (self.first[got] == first[left]) & (self.last[got] == last[left]) & (self.bytes[got] == size[left])
            out[left[same]] = got[same]
            left = left[~same]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
        return out

    def add(self, first, last, size) -> np.ndarray:
        """Numbers for new runs, which must differ; of runs over 16 bytes, size is 0 and they aren't put into the table."""
        new = np.arange(self.n, self.n + len(first))
        self.n += len(new)
        for name in ("first", "last", "bytes", "start", "size", "asked"):
            setattr(self, name, room(getattr(self, name), self.n))
        self.first[new], self.last[new], self.bytes[new] = first, last, size
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << (4 * self.n).bit_length(), -1, np.int32)
            self._put(np.arange(self.n))
        else:
            self._put(new)
        return new

    def _put(self, numbers: np.ndarray) -> None:
        left = numbers[self.bytes[numbers] > 0]
        slot = self._slot(self.first[left], self.last[left], self.bytes[left])
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def numbers(self, raw: bytes, start: np.ndarray, end: np.ndarray, learn, mark: np.ndarray | int = 0) -> np.ndarray:
        """The number of each run. ``learn(numbers, names, marks)`` is called for new ones, and must ``give`` them ids."""
        size = end - start
        mark = np.broadcast_to(mark, size.shape)
        first, last = ends_of(raw, start, end)
        key = np.where(size > 16, 0, size + mark)
        out, long, held = self.find(first, last, key), np.flatnonzero(size > 16), self.long
        names = list(zip([raw[a:b] for a, b in zip(start[long].tolist(), end[long].tolist())], mark[long].tolist()))
        new = np.flatnonzero((out < 0) & (key > 0))
        if len(new):
            order = new[np.lexsort((key[new], last[new], first[new]))]
            a, b = order[1:], order[:-1]
            differ = np.r_[True, (first[a] != first[b]) | (last[a] != last[b]) | (key[a] != key[b])]
            head = order[differ]
            fresh = self.add(first[head], last[head], key[head])
            out[order] = fresh[np.cumsum(differ) - 1]
            learn(fresh, [raw[a:b] for a, b in zip(start[head].tolist(), end[head].tolist())], mark[head])
        if unknown := dict.fromkeys(x for x in names if x not in held):
            zero = np.zeros(len(unknown), np.uint64)
            fresh = self.add(zero, zero, zero)
            held.update(zip(unknown, fresh.tolist()))
            learn(fresh, [x for x, _ in unknown], np.array([m for _, m in unknown]))
        out[long] = [held[x] for x in names]
        return out

    def give(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[numbers], self.size[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        return gathered(self.flat, self.start[numbers], size), size

    def frequent(self, most: int) -> Runs:
        """A table of the runs of up to 16 bytes that were asked for most."""
        out = Runs(self.flat.dtype)
        short = np.flatnonzero(self.bytes[: self.n])
        kept = short[np.argsort(self.asked[short], kind="stable")[::-1][:most]]
        out.give(out.add(self.first[kept], self.last[kept], self.bytes[kept]), *self.ids(kept))
        return out
