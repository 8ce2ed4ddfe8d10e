"""Words and shingle sets of whole texts, many texts at a time, on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are worked on together; a longer text is taken alone.
CHUNK = 1 << 20

_ONE = np.uint64(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; another salt gives an independent function."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: A random value for each byte after lower-casing A-Z; those of upper and lower case are the same.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_VALUE = mix(np.arange(256, dtype=np.uint64), 7)[_LOWER]
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)

_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse. Tables for more than a chunk (a word may be longer) are not kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    tables = []
    for b in (_BASE, _INVERSE):
        p = np.full(max(n, 2 * CHUNK), b, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            tables.append(np.cumprod(p))
    if n <= 2 * CHUNK:
        _powers[:] = tables
    return tables


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of each word, and where each text's words begin.

    data holds the texts in UTF-8, text k from bounds[k] to bounds[k + 1]. A
    word is a run of anything but ASCII white space.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    return starts, np.flatnonzero(solid & (~after | edge[1:])), np.searchsorted(starts, bounds)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, A-Z lower-cased. Of a long text, words that begin in one chunk are hashed together."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + CHUNK, CHUNK)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        first = starts[a]
        part = data[first : ends[b - 1] + 1]
        power, inverse = _power(len(part))
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUE[part] * power[: len(part)], out=total[1:])
            h = (total[ends[a:b] - first + 1] - total[starts[a:b] - first]) * inverse[starts[a:b] - first]
            out[a:b] = mix(h + (ends[a:b] - starts[a:b]).astype(np.uint64))
    return out


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of each text, A-Z lower-cased, and where each text's words begin."""
    starts, ends, at = spans(data, bounds)
    return hashed(data, starts, ends), at


def sets(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, sorted, and where each text's begin.

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    n, texts = len(hashes), len(at) - 1
    count = np.diff(at)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(_BASE) + hashes[j : j + len(rolled)]
    rolled = mix(rolled, 1)
    parts = []
    for t in range(texts):
        c, a = count[t], at[t]
        if c >= k:
            s = np.sort(rolled[a : a + c - k + 1])
            parts.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif c:
            with np.errstate(over="ignore"):
                v = np.uint64(c)
                for x in hashes[a : a + c]:
                    v = v * np.uint64(_BASE) + x
            parts.append(mix(np.array([v]), 2))
        else:
            parts.append(rolled[:0])
    return (np.concatenate(parts) if parts else rolled[:0]), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


def chunks(batch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a record batch into runs of rows: first row, rows, text bytes, bounds. Null text is empty."""
    import pyarrow as pa

    text = batch.column(column).cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        end = int(np.searchsorted(bounds, bounds[row] + CHUNK, "right")) - 1
        end = min(max(end, row + 1), len(text))
        yield row, end - row, raw[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def shingle_sets(batch, column: int, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each run of rows: first row, rows, all shingles, where each row's begin."""
    for first, rows, data, bounds in chunks(batch, column):
        yield first, rows, *sets(*words(data, bounds), k)
