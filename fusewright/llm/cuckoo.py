"""A cuckoo filter over 128-bit keys in numpy: 16-bit fingerprints, four to a bucket, two buckets a key; whole arrays at a time."""
from __future__ import annotations

import numpy as np

from fusewright.llm._text import U64, mix

SLOTS = 4
#: Cells that a new layer has for each key.
ROOM = 1.6
#: Rounds of evictions after which a layer counts as full.
ROUNDS = 400


def _places(keys: np.ndarray, buckets: int):
    """(bucket, fingerprint) of 64-bit keys."""
    mixed = mix(keys.astype(U64))
    prints = (mixed >> U64(48)).astype(np.uint16)
    prints[prints == 0] = 1
    return (mixed & U64(buckets - 1)).astype(np.int64), prints


def _other(bucket: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
    return bucket ^ (mix(prints.astype(U64)) & U64(buckets - 1)).astype(np.int64)


def _rank(sorted_values: np.ndarray) -> np.ndarray:
    """Each value's number among the equal ones before it."""
    if not len(sorted_values):
        return np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return np.arange(len(sorted_values)) - np.repeat(first, np.diff(np.r_[first, len(sorted_values)]))


class Cuckoo:
    """Layers of cells, each about twice as large as the one before, so that a shard may grow without its keys being read again.

    A key that was added is always found. One that was not is found with a chance of about 2 * 4 / 65,536 for each layer. ``remove`` may
    only be called for keys that were added and not removed since: the caller's exact counts see to that.
    """

    def __init__(self, layers: list[bytes] = ()):
        self.layers = [np.frombuffer(x, dtype=np.uint16).reshape(-1, SLOTS).copy() for x in layers]

    def dump(self) -> list[bytes]:
        return [x.tobytes() for x in self.layers]

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=bool)
        for cells in self.layers:
            at, prints = _places(keys, len(cells))
            for b in (at, _other(at, prints, len(cells))):
                found |= (cells[b] == prints[:, None]).any(axis=1)
        return found

    def add(self, keys: np.ndarray) -> None:
        """Adds each key once; the keys are different and not in the filter yet."""
        if len(keys) and self.layers:
            free = int((self.layers[-1] == 0).sum()) - int(self.layers[-1].size * (1 - 1 / ROOM))
            if free >= len(keys):
                before = self.layers[-1].copy()
                if self._put(keys, self.layers[-1]):
                    return
                self.layers[-1] = before
        while len(keys):
            wanted = max(len(keys) * ROOM / SLOTS, 2 * len(self.layers[-1]) if self.layers else 1)
            self.layers.append(np.zeros((1 << int(np.ceil(np.log2(max(1, wanted)))), SLOTS), dtype=np.uint16))
            if self._put(keys, self.layers[-1]):
                return
            self.layers[-1] = np.zeros((2 * len(self.layers.pop()), SLOTS), dtype=np.uint16)

    @staticmethod
    def _put(keys: np.ndarray, cells: np.ndarray) -> bool:
        """Into free cells first, then by evictions, one to a bucket a round; False if the layer proves full."""
        at, prints = _places(keys, len(cells))
        for turn in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            at, prints = at[order], prints[order]
            place = _rank(at)
            free = np.argsort(cells[at] != 0, axis=1, kind="stable")
            room = (cells[at] == 0).sum(axis=1)
            fits = place < room
            cells[at[fits], free[fits, place[fits]]] = prints[fits]
            at, prints, place = at[~fits], prints[~fits], place[~fits] - room[~fits]
            if not len(at):
                return True
            if turn:
                evicts = place == 0
                slot = (mix(at[evicts].astype(U64) + U64(turn)) % U64(SLOTS)).astype(np.int64)
                victims = cells[at[evicts], slot].copy()
                cells[at[evicts], slot] = prints[evicts]
                prints[evicts] = victims
            at = _other(at, prints, len(cells))
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Takes one fingerprint of each key away."""
        for cells in reversed(self.layers):
            at, prints = _places(keys, len(cells))
            gone = np.zeros(len(keys), dtype=bool)
            for second in (False, True):
                left = np.flatnonzero(~gone)
                b = _other(at[left], prints[left], len(cells)) if second else at[left]
                order = np.lexsort((prints[left], b))
                left, b = left[order], b[order]
                place = _rank(b * 65536 + prints[left])
                same = cells[b] == prints[left][:, None]
                fits = place < same.sum(axis=1)
                cell = np.argsort(~same, axis=1, kind="stable")[fits, place[fits]]
                cells[b[fits], cell] = 0
                gone[left[fits]] = True
            keys = keys[~gone]


__all__ = ["Cuckoo"]
