"""Sums of large key sets over blocks of documents.

A block holds the keys of some thousand documents, each key once, so a key that
occurs in a third of all documents weighs one entry for each block.  Blocks send
their keys, sorted, in slices to buckets (ranges of the 64-bit key); a bucket adds
up equal keys and answers every slice in its own order.  Arrays travel as bytes,
keys as differences, with equal-ranking bytes side by side so that they compress.
"""

from __future__ import annotations

import numpy as np


def to_planes(a: np.ndarray) -> bytes:
    """The array's bytes by rank: all lowest bytes, then the next ones."""
    a = np.ascontiguousarray(a)
    by_rank = np.empty((a.itemsize, len(a)), np.uint8)
    for rank, plane in enumerate(by_rank):  # much faster than one transposed copy
        plane[:] = a.view(np.uint8)[rank :: a.itemsize]
    return by_rank.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    out = np.empty(len(data) // width, dtype)
    for rank, plane in enumerate(np.frombuffer(data, np.uint8).reshape(width, -1)):
        out.view(np.uint8)[rank::width] = plane
    return out


def to_counts(counts: np.ndarray) -> bytes:
    """Whole numbers from 0, in as few bytes as the largest takes."""
    width = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([width.itemsize]) + to_planes(counts.astype(width))


def from_counts(data: bytes) -> np.ndarray:
    return from_planes(data[1:], f"u{data[0]}").astype(np.float64)


def to_coded(values: np.ndarray) -> bytes:
    """Doubles of which many are equal: the distinct ones and the place of each among
    them, or as they are if that is no gain."""
    distinct, place = np.unique(values, return_inverse=True)
    if 2 * len(distinct) > len(values) or len(distinct) > 1 << 16:
        return to_plain(values)
    return np.uint32(len(distinct)).tobytes() + to_planes(distinct.astype(np.float64)) + to_planes(place.astype(np.uint16))


def to_plain(values: np.ndarray) -> bytes:
    """Doubles as ``from_coded`` reads them too, for rows that aren't kept."""
    return np.uint32(0).tobytes() + to_planes(values.astype(np.float64))


def from_coded(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    if not n:
        return from_planes(data[4:], np.float64)
    return from_planes(data[4 : 4 + 8 * n], np.float64)[from_planes(data[4 + 8 * n :], np.uint16)]


def keys_to_bytes(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys."""
    return to_planes(np.diff(keys, prepend=np.uint64(0)))


def keys_from_bytes(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def slices(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of the non-empty slices of sorted keys."""
    at = buckets_of(keys, buckets)
    cuts = np.flatnonzero(np.diff(at)) + 1
    starts = np.concatenate(([0], cuts)).astype(int) if len(keys) else np.empty(0, int)
    stops = np.append(starts[1:], len(keys)).astype(int)
    return [(int(at[s]), int(s), int(e)) for s, e in zip(starts, stops)]


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of whole numbers from 0, and the numbers in that order.  A sort of
    values is several times as fast as one of positions, so position and as much of
    the key as fits make one value."""
    keys = keys.astype(np.uint64, copy=False)
    if len(keys) < 2 or (spread := int(keys.max() - keys.min()).bit_length()) == 0:
        return np.arange(len(keys)), keys
    bits = np.uint64((len(keys) - 1).bit_length())
    both = keys - keys.min()
    both <<= np.uint64(64 - spread)
    both >>= bits
    both <<= bits
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    out = keys[order]
    wrong = out[1:] < out[:-1]
    if wrong.any():  # keys that differ only in what didn't fit: the runs that hold some are sorted again
        both >>= bits
        run = np.append(0, np.cumsum(both[1:] != both[:-1]))
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[1:][wrong]] = True
        at = np.flatnonzero(mixed[run])
        again = at[np.argsort(out[at], kind="stable")]
        order[at], out[at] = order[again], out[again]
    return order, out


def order_of(keys: np.ndarray) -> np.ndarray:
    return ranked(keys)[0]


class Merged:
    """Equal keys of several sorted arrays brought together."""

    def __init__(self, arrays: list[np.ndarray]):
        self.sizes = [len(a) for a in arrays]
        keys = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
        order, by_key = ranked(keys)
        new = np.ones(len(keys), bool)
        np.not_equal(by_key[1:], by_key[:-1], out=new[1:])
        self.keys = by_key[new]
        self.group = np.empty(len(keys), np.int64)  # of each entry, in input order
        self.group[order] = np.cumsum(new) - 1
        self.first = np.zeros(len(keys), bool)  # the entry of the first array that has the key
        self.first[order[new]] = True

    def sums(self, values: list[np.ndarray]) -> np.ndarray:
        """Sum for each distinct key."""
        return np.bincount(self.group, np.concatenate(values) if values else None, minlength=len(self.keys))

    def split(self, per_entry: np.ndarray) -> list[np.ndarray]:
        """Per-entry values back in one array for each input."""
        return np.split(per_entry, np.cumsum(self.sizes)[:-1])
