"""A cuckoo filter in numpy: a set of 64-bit hashes in two bytes each, with deletion.

A hash has a 16-bit fingerprint and two buckets of four slots; either bucket follows from the
other and the fingerprint. Members are always found; a hash that was never put in is found with
a probability of some 8 / 65,535, so what a filter finds is confirmed by an exact table.
Batches of hashes are looked up, put in and taken out together.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Part of the slots that a filter of a given size is planned for, and evictions before it grows.
LOAD, KICKS = 0.8, 400


def _places(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first and second bucket of each hash."""
    h = hashes.view(np.uint64)
    mark = np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)
    one = (h & np.uint64(buckets - 1)).astype(np.int64)
    return mark, one, _other(one, mark, buckets)


def _other(bucket: np.ndarray, mark: np.ndarray, buckets: int) -> np.ndarray:
    return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995 >> 7) & (buckets - 1))


def empty(members: int) -> np.ndarray:
    """A filter for so many members."""
    buckets = 1
    while buckets * SLOTS * LOAD < members:
        buckets *= 2
    return np.zeros((buckets, SLOTS), dtype=np.uint16)


def contains(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mark, one, two = _places(hashes, len(table))
    return (table[one] == mark[:, None]).any(1) | (table[two] == mark[:, None]).any(1)


def _put_free(table: np.ndarray, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Put marks into free slots of their buckets, one a bucket and turn; whether each is in."""
    done = np.zeros(len(mark), dtype=bool)
    left = np.arange(len(mark))
    while len(left):
        left = left[(table[bucket[left]] == 0).any(1)]
        _, first = np.unique(bucket[left], return_index=True)
        now = left[first]
        table[bucket[now], (table[bucket[now]] == 0).argmax(1)] = mark[now]
        done[now] = True
        left = left[~done[left]]
    return done


def insert(table: np.ndarray, hashes: np.ndarray) -> bool:
    """Put distinct hashes in; False if there is no room (the filter is then to be made anew)."""
    mark, one, two = _places(hashes, len(table))
    left = np.flatnonzero(~_put_free(table, one, mark))
    mark, bucket = mark[left], two[left]
    turn = np.random.default_rng(1)
    for _ in range(KICKS):
        full = ~_put_free(table, bucket, mark)
        mark, bucket = mark[full], bucket[full]
        if not len(mark):
            return True
        _, now = np.unique(bucket, return_index=True)
        slot = turn.integers(SLOTS, size=len(now))
        out = table[bucket[now], slot]
        table[bucket[now], slot] = mark[now]
        mark[now], bucket[now] = out, _other(bucket[now], out, len(table))
    return False


def delete(table: np.ndarray, hashes: np.ndarray) -> None:
    """Take out distinct hashes that are in, one slot each."""
    mark, one, two = _places(hashes, len(table))
    left = np.arange(len(mark))
    for bucket in (one, two):
        while len(left):
            has = (table[bucket[left]] == mark[left, None]).any(1)
            held = left[has]
            _, first = np.unique(bucket[held], return_index=True)  # one of a bucket at a time
            now = held[first]
            if not len(now):
                break
            table[bucket[now], (table[bucket[now]] == mark[now, None]).argmax(1)] = 0
            left = np.setdiff1d(left, now, assume_unique=True)
    if len(left):
        raise ValueError(f"{len(left)} hashes were not in the filter")


def of(hashes: np.ndarray) -> np.ndarray:
    """A filter of distinct hashes."""
    table = empty(len(hashes))
    while not insert(table, hashes):
        table = np.zeros((2 * len(table), SLOTS), dtype=np.uint16)
    return table
