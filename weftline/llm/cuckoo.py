"""Cuckoo filters over 16-byte digests: whole batches of keys at a time, with deletion.

A filter is a chain of slots of one size, ``BUCKETS`` buckets of four 16-bit fingerprints each; 0 is a
free place. A key's fingerprint lies in one of two buckets, each found from the other and the
fingerprint. As slots have one size, two keys that agree in fingerprint and buckets agree in every slot,
so it does not matter whose copy a deletion takes away. No key that was put in and not taken out is
ever denied; other keys are affirmed with a chance of about one in ten thousand for each slot.
"""

from __future__ import annotations

import numpy as np

BUCKETS, PLACES = 1 << 13, 4
#: Keys a slot takes, nine tenths of its places, and moves tried for a key before a new slot is begun.
SLOT_KEYS, MOVES = BUCKETS * PLACES * 9 // 10, 400
_SPREAD = 0x9E3779B1


def other(bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
    """The second bucket of a fingerprint, and the first again when asked of the second."""
    return bucket ^ (print_.astype(np.int64) * _SPREAD >> 9) % BUCKETS


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and first buckets of keys, an array of n x 16 bytes."""
    halves = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
    prints = (halves[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
    prints[prints == 0] = 1
    return prints, (halves[:, 1] % np.uint64(BUCKETS)).astype(np.int64)


class CuckooFilter:
    def __init__(self, slots: list[bytes] | None = None):
        self.slots = [np.frombuffer(s, np.uint16).reshape(BUCKETS, PLACES).copy() for s in slots or []]

    def held(self) -> int:
        return sum(int(np.count_nonzero(s)) for s in self.slots)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first = places(keys)
        second, found = other(first, prints), np.zeros(len(prints), bool)
        for slot in self.slots:
            for bucket in (first, second):
                found |= (slot[bucket] == prints[:, None]).any(1)
        return found

    def insert(self, keys: np.ndarray) -> None:
        """One copy of each key more; the caller knows that it is not in already."""
        prints, buckets = places(keys)
        while len(prints):
            room = SLOT_KEYS - int(np.count_nonzero(self.slots[-1])) if self.slots else 0
            if room <= 0:
                self.slots.append(np.zeros((BUCKETS, PLACES), np.uint16))
                continue
            homeless = self._fill(self.slots[-1], prints[:room], buckets[:room])
            prints, buckets = (np.concatenate([np.array(h, x.dtype), x[room:]]) for h, x in zip(homeless, (prints, buckets), strict=True))
            if homeless[0]:  # the last slot is too crowded for these
                self.slots.append(np.zeros((BUCKETS, PLACES), np.uint16))

    def _fill(self, slot: np.ndarray, prints: np.ndarray, buckets: np.ndarray) -> tuple[list, list]:
        """Where a bucket has room for all that come, they are put in at once; the rest move others."""
        for at in (buckets, None):
            at = other(buckets, prints) if at is None else at
            order = np.argsort(at, kind="stable")
            rank = np.empty(len(at), np.int64)
            rank[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order])
            taken = slot[at] != 0
            fits = rank < PLACES - taken.sum(1)
            free = np.argsort(taken, axis=1, kind="stable")
            slot[at[fits], free[fits, rank[fits]]] = prints[fits]
            prints, buckets = prints[~fits], buckets[~fits]
        left: tuple[list, list] = ([], [])
        for print_, bucket in zip(prints, buckets, strict=True):
            for move in range(MOVES):
                empty = np.flatnonzero(slot[bucket] == 0)
                if len(empty):
                    slot[bucket, empty[0]] = print_
                    break
                victim = (move + int(print_)) % PLACES
                print_, slot[bucket, victim] = slot[bucket, victim], print_
                bucket = other(bucket, print_)
            else:
                left[0].append(print_)
                left[1].append(bucket)
        return left

    def delete(self, keys: np.ndarray) -> None:
        """One copy of each key less. A key that is not in is an error: it would take another's copy."""
        for print_, first in zip(*places(keys), strict=True):
            for slot, bucket in ((s, b) for s in self.slots for b in (first, other(first, print_))):
                if len(at := np.flatnonzero(slot[bucket] == print_)):
                    slot[bucket, at[0]] = 0
                    break
            else:
                raise ValueError("a key to delete is not in the filter")
