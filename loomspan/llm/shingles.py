"""Word shingles of UTF-8 texts as 64-bit hashes, computed on the bytes of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on together up to so many bytes; a longer one alone.
CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240607))
_SIGN = _rng.integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = _SIGN[_LOWER]  # A-Z count as a-z
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, CHUNK_BYTES + 1)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for name, x in (("up", _BASE), ("down", inverse)):
            steps = np.full(m, x, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text) for texts ``data[offsets[i]:offsets[i+1]]``, A-Z lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _IS_WORD[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])) | inside & first[:n])
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | first[1:]))
    up, down = _power(n)
    total = np.cumsum(_SIGN[data] * up, dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], _U(0))
    hashes = mix((total[ends] - before) * down[starts])
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, bounds): text i has ``shingles[bounds[i]:bounds[i+1]]``, ascending.

    A text of fewer than ``width`` words has its whole sequence as one shingle, one without words none.
    """
    counts = np.bincount(text, minlength=n_texts)
    begins = np.cumsum(counts) - counts
    if not len(hashes):
        return hashes, np.zeros(n_texts + 1, np.int64)
    rolled = hashes.copy()
    short = counts < width
    for k in range(1, width):
        follows = np.zeros(len(hashes), bool)
        follows[:-k] = text[k:] == text[:-k] if k < len(hashes) else False
        at = np.flatnonzero(follows)
        rolled[at] = mix(rolled[at] * _U(3) ^ hashes[at + k] + _U(k))
    # a full shingle has width - 1 followers; of a short text the first position spans it whole
    whole = np.zeros(len(hashes), bool)
    if width > 1:
        whole[: len(hashes) - width + 1] = text[width - 1 :] == text[: len(hashes) - width + 1] if len(hashes) >= width else False
    else:
        whole[:] = True
    lone = begins[short & (counts > 0)]
    whole[lone] = True
    rolled[lone] = mix(rolled[lone] ^ _U(0x5555))
    sets, bounds = [], np.zeros(n_texts + 1, np.int64)
    kept, owner = rolled[whole], text[whole]
    cuts = np.searchsorted(owner, np.arange(n_texts + 1))
    for i in range(n_texts):
        s = kept[cuts[i] : cuts[i + 1]]
        if len(s) > 1:
            s = np.unique(s)
        sets.append(s)
        bounds[i + 1] = bounds[i] + len(s)
    return np.concatenate(sets) if sets else kept[:0], bounds


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column in chunks of bounded bytes; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles, bounds) for the texts of a column."""
    for at, end, data, offsets in text_chunks(column):
        hashes, text = word_hashes(data, offsets)
        yield at, end, *shingles(hashes, text, end - at, width)
