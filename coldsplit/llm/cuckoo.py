"""A cuckoo filter (Fan et al. 2014) over 64-bit key hashes: four 16-bit
fingerprints a bucket, partial-key hashing, insertion, deletion and a
vectorised membership test. It answers for one shard; a full filter doubles."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h):
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class CuckooFilter:
    def __init__(self, buckets: int = 1, data: np.ndarray | None = None):
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if data is None else data

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter that holds all of ``hashes`` (int64 or uint64, distinct)."""
        need = max(1, int(np.ceil(len(hashes) / (SLOTS * 0.85))))
        buckets = 1 << (need - 1).bit_length()
        while True:
            f = cls(buckets)
            if all(f.insert(int(h)) for h in np.asarray(hashes).astype(np.int64)):
                return f
            buckets *= 2

    def _parts(self, hashes):
        h = np.asarray(hashes).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            m = _mix(h)
            f = (m >> np.uint64(48)).astype(np.uint16)
            f = np.where(f == 0, np.uint16(1), f)  # 0 marks an empty cell
            mask = np.uint64(len(self.cells) - 1)
            i = m & mask
            j = i ^ (_mix(f.astype(np.uint64)) & mask)
        return f, i.astype(np.int64), j.astype(np.int64)

    def _other(self, i: int, f: int) -> int:
        with np.errstate(over="ignore"):
            return int(np.uint64(i) ^ (_mix(np.array([f], np.uint64))[0] & np.uint64(len(self.cells) - 1)))

    def insert(self, h: int) -> bool:
        """False if no place is found; the filter then has to be built anew."""
        f, i, j = (x[0] for x in self._parts([h]))
        for k in (i, j):
            free = np.flatnonzero(self.cells[k] == 0)
            if len(free):
                self.cells[k, free[0]] = f
                return True
        k, f = int(i), int(f)
        for n in range(KICKS):
            slot = (f + n) % SLOTS
            f, self.cells[k, slot] = int(self.cells[k, slot]), f
            k = self._other(k, f)
            free = np.flatnonzero(self.cells[k] == 0)
            if len(free):
                self.cells[k, free[0]] = f
                return True
        return False

    def delete(self, h: int) -> bool:
        """Removes one copy of a key that was inserted before."""
        f, i, j = (x[0] for x in self._parts([h]))
        for k in (i, j):
            own = np.flatnonzero(self.cells[k] == f)
            if len(own):
                self.cells[k, own[0]] = 0
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        f, i, j = self._parts(hashes)
        return (self.cells[i] == f[:, None]).any(1) | (self.cells[j] == f[:, None]).any(1)

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> CuckooFilter:
        return cls(data=np.frombuffer(b, np.uint16).reshape(-1, SLOTS).copy())
