"""A cuckoo filter over 16-byte digests: insertion, deletion, vectorised lookup.

Each key has a 16-bit tag (never 0) and two buckets of four tags; the second
bucket follows from the first and the tag, so a tag can be moved without its
key. A filter never says no to a key that it holds. Deleting a key that was
inserted is exact as far as tags go: equal tags in equal buckets are counted
one by one.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    halves = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


class CuckooFilter:
    def __init__(self, buckets: int = 16, cells: np.ndarray | None = None) -> None:
        """``buckets`` is a power of two."""
        self.cells = np.zeros((buckets, SLOTS), dtype=np.uint16) if cells is None else cells

    def _places(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = _words(digests)
        mask = np.uint64(len(self.cells) - 1)
        tags = (high & np.uint64(0xFFFF)).astype(np.uint16)
        tags[tags == 0] = 1
        first = low & mask
        return tags, first.astype(np.int64), (first ^ self._jump(tags)).astype(np.int64)

    def _jump(self, tags: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (tags.astype(np.uint64) * _MIX) >> np.uint64(17)
        return mixed & np.uint64(len(self.cells) - 1)

    def contains(self, digests: list[bytes]) -> np.ndarray:
        if not digests:
            return np.zeros(0, dtype=bool)
        tags, first, second = self._places(digests)
        return (self.cells[first] == tags[:, None]).any(1) | (self.cells[second] == tags[:, None]).any(1)

    def insert(self, digests: list[bytes]) -> bool:
        """False if the filter is too full; it must then be built anew, larger."""
        if not digests:
            return True
        for tag, first, second in zip(*(a.tolist() for a in self._places(digests)), strict=True):
            if not (self._put(first, tag) or self._put(second, tag) or self._kick(second, tag)):
                return False
        return True

    def _put(self, bucket: int, tag: int) -> bool:
        free = np.flatnonzero(self.cells[bucket] == 0)
        if len(free):
            self.cells[bucket, free[0]] = tag
        return bool(len(free))

    def _kick(self, bucket: int, tag: int) -> bool:
        for turn in range(KICKS):
            slot = turn % SLOTS
            tag, self.cells[bucket, slot] = int(self.cells[bucket, slot]), tag
            bucket ^= int(self._jump(np.array([tag], dtype=np.uint16))[0])
            if self._put(bucket, tag):
                return True
        return False

    def delete(self, digests: list[bytes]) -> None:
        if not digests:
            return
        for tag, first, second in zip(*(a.tolist() for a in self._places(digests)), strict=True):
            for bucket in (first, second):
                held = np.flatnonzero(self.cells[bucket] == tag)
                if len(held):
                    self.cells[bucket, held[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.cells.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(cells=np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).astype(np.uint16))

    @classmethod
    def build(cls, digests: list[bytes]) -> CuckooFilter:
        """A filter of the given keys, at most 80 % full."""
        buckets = 16
        while buckets * SLOTS * 8 < len(digests) * 10:
            buckets *= 2
        while True:
            made = cls(buckets)
            if made.insert(digests):
                return made
            buckets *= 2
