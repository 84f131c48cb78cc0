"""Word shingle sets of Arrow string batches, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SLICE = 4 << 20
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """batch in parts of about SLICE bytes of text, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, "right"))
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, code of each word, words by code): lower case A-Z, split at white space of ASCII; null has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    row = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    empty = np.flatnonzero(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False))
    if len(empty):
        keep = code != empty[0]
        row, code = row[keep], code[keep]
    return row, code, coded.dictionary


def sets(texts: pa.Array, k: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of its whole sequence if it has fewer words; empty without words."""
    import xxhash

    row, code, vocabulary = words(texts)
    by_code = np.fromiter((xxhash.xxh3_64_intdigest(w or "") for w in vocabulary.to_pylist()), dtype=np.uint64, count=len(vocabulary))
    h = by_code[code] if len(code) else np.zeros(0, dtype=np.uint64)
    count = np.bincount(row, minlength=len(texts))
    start = np.concatenate([[0], np.cumsum(count)])
    g = h * M1
    for j in range(1, k):
        g = finish(g)[: len(h) - j] + h[j:] * M1 if len(h) > j else g[:0]
    g = finish(g)
    out = []
    for i in range(len(texts)):
        n, a = int(count[i]), int(start[i])
        if n >= k:
            out.append(np.unique(g[a : a + n - k + 1]))
        elif n:
            x = np.uint64(n)
            for w in h[a : a + n]:
                x = finish(np.array([x]) * M2 + w)[0]
            out.append(np.array([x], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def as_lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<int64> column."""
    sizes = np.array([len(x) for x in arrays], dtype=np.int64)
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))
