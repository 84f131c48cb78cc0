"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

Round j inserts the suffix of length j of every string that has one: its
symbol and place follow from the transform of the shorter suffixes (the rank of
the symbol before the place of the suffix without it), and its common prefixes
with its neighbours from those of the neighbours' own tails. Transform and
common prefixes are two files that each round reads and writes once, in order;
a last walk over the transform says where in the input each suffix stands.
Suffixes that end are ordered by string.
"""

from __future__ import annotations

import os
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _merged(at: np.ndarray, *pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Of each pair (old, new): old with new at the places `at`, which ascend."""
    keep = np.ones(len(pairs[0][0]) + len(at), dtype=bool)
    keep[at] = False
    out = []
    for old, new in pairs:
        x = np.empty(len(keep), dtype=old.dtype)
        x[keep] = old
        x[at] = new
        out.append(x)
    return out


def _by_symbol(bwt: np.ndarray) -> np.ndarray:
    """Places by symbol, then place. Arrow sorts bytes by counting, about five times as fast as a stable sort here."""
    return pc.array_sort_indices(pa.array(bwt)).to_numpy().view(np.int64)


def collection(text: np.ndarray, start: np.ndarray, size: np.ndarray, most: int, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefix with the suffix before, place in text of the suffix) of the strings text[start : start + size].

    text: uint8, with at most 255 distinct values, as UTF-8 has. In the
    transform 0 stands for a string's start, r + 1 for the r-th of the values.
    Common prefixes are counted up to `most`, which is below 255. The suffix of
    length 0 of a string has the place of its end.
    """
    with open(os.path.join(folder, "bwt"), "w+b", buffering=0) as a, open(os.path.join(folder, "lcp"), "w+b", buffering=0) as b:
        return _built(text, start, size, most, (a, b))


def _built(text: np.ndarray, start: np.ndarray, size: np.ndarray, most: int, files: tuple[BinaryIO, BinaryIO]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def put(arrays: list[np.ndarray]) -> None:
        for f, x in zip(files, arrays, strict=True):
            f.seek(0)  # files only grow, so they are written over
            x.tofile(f)

    def get() -> list[np.ndarray]:
        out = []
        for f in files:
            f.seek(0)
            out.append(np.fromfile(f, dtype=np.uint8))
        return out

    m = len(start)
    end = start + size
    values, text = np.unique(text if len(text) else np.zeros(1, dtype=np.uint8), return_inverse=True)
    if len(values) > 255:
        raise ValueError("more than 255 distinct bytes")
    text = (text + 1).astype(np.uint8)
    symbol = lambda ids, j: np.where(size[ids] > j, text[np.maximum(end[ids] - j - 1, 0)], 0).astype(np.uint8)
    ids = np.arange(m)
    put([symbol(ids, 0), np.zeros(m, dtype=np.uint8)])
    count = np.bincount(symbol(ids, 0), minlength=256)
    at = np.arange(m)  # of the newest suffix of each string that goes on
    for j in range(1, int(size.max(initial=0)) + 1):
        on = size[ids] >= j
        ids, at = ids[on], at[on]
        bwt, lcp = get()
        order = _by_symbol(bwt)
        bounds = np.concatenate([[0], np.cumsum(count)])
        c = bwt[at]
        rank = np.argsort(c, kind="stable")  # by symbol, then place: the order of the new suffixes too
        c = c.astype(np.int64)
        newest = np.zeros(len(bwt), dtype=bool)
        newest[at] = True
        k = np.empty(len(at), dtype=np.int64)  # at ascends, so that those of one symbol stand in `order` as here
        k[rank] = np.flatnonzero(newest[order])
        new_at = k - bounds[1] + m
        # the neighbours in the new order begin with the same symbol if they are next to it in `order`
        has_before, has_after = k > bounds[c], k + 1 < bounds[c + 1]
        before, after = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, len(order) - 1)]
        padded = np.append(lcp, np.uint8(0))

        def least(lo: np.ndarray, hi: np.ndarray, padded=padded) -> np.ndarray:
            """Minimum of lcp over [lo, hi) for each pair, lo < hi."""
            if not len(lo):
                return np.zeros(0, dtype=np.uint8)
            return np.minimum.reduceat(padded, np.stack([lo, hi], axis=1).ravel())[::2]

        mine = np.zeros(len(at), dtype=np.uint8)
        mine[has_before] = np.minimum(least(before[has_before] + 1, at[has_before] + 1).astype(np.int64) + 1, most)
        ids, new_at = ids[rank], new_at[rank]
        symbols = symbol(ids, j)
        bwt, lcp = _merged(new_at, (bwt, symbols), (lcp, mine[rank]))
        # what comes after a new suffix may share more with it than with what stood before
        after_at = new_at[has_after[rank]] + 1
        use = rank[has_after[rank]]
        lcp[after_at] = np.minimum(least(at[use] + 1, after[use] + 1).astype(np.int64) + 1, most)
        count += np.bincount(symbols, minlength=256)
        put([bwt, lcp])
        at = new_at
    bwt, lcp = get()
    before = np.empty(len(bwt), dtype=np.int64)  # where the suffix one symbol longer stands
    before[_by_symbol(bwt)] = np.arange(len(bwt)) - np.count_nonzero(bwt == 0) + m
    place, ids, at = np.empty(len(bwt), dtype=np.int64), np.arange(m), np.arange(m)
    place[at] = end
    for j in range(1, int(size.max(initial=0)) + 1):
        on = size[ids] >= j
        ids, at = ids[on], before[at[on]]
        place[at] = end[ids] - j
    return bwt, lcp, place

