"""Words and shingles of whole Arrow text columns as 64-bit hashes, in numpy: no Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(p: int, n: int) -> np.ndarray:
    have = _powers.get(p)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 21), p, np.uint64)
        steps[0] = 1
        have = _powers[p] = np.cumprod(steps)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins (one more entry than texts). Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and where each text's words begin."""
    data, at = raw_bytes(texts)
    n = len(data)
    word = ~_GAP[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = at[:-1][at[1:] > at[:-1]]
    first[full] = word[full]
    full = at[1:][at[1:] > at[:-1]] - 1
    last[full] = word[full]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, n), out=sums[1:])
    back = _power(pow(_P, -1, 2**64), n)
    return mix64((sums[ends] - sums[starts]) * back[starts]), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; of fewer words, the whole sequence as one."""
    n = max(0, len(hashes) - k + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(k):
        runs += hashes[j : j + n] * _PLACE[j]
    runs = mix64(runs)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield mix64((hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a) * _PLACE[15])
        else:
            yield runs[:0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``limit`` bytes together; one longer text makes a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit, prepend=0)) + 1
    edges = [0, *cuts[cuts < len(sizes)].tolist(), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
