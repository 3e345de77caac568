"""Words and word shingles of many texts at once, on UTF-8 bytes with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which are never part of a longer UTF-8 character.
Texts come as Arrow columns; every helper works on pieces of a few megabytes, so that memory does not follow the size
of an Arrow batch. A single text longer than the piece size is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: bytes of text handled at once, and rows of an Arrow batch
PIECE_BYTES = 1 << 19
BATCH_ROWS = 1_000

#: bytes that stand in no word: white space, or all ASCII but letters and digits
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
MARKS = np.ones(256, dtype=bool)
MARKS[0x80:] = False
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

_rng = np.random.Generator(np.random.PCG64(20240607))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(int(_rng.integers(1, 1 << 62)) * 2 + 1)
#: multipliers of the words of a shingle
_PLACE = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_small_batches(texts: DataFrame) -> DataFrame:
    """``texts`` after its session has been told to hand long rows to Python in batches of ``BATCH_ROWS``."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return texts


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, byte offsets of the rows) of consecutive rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; words end at the end of their row."""
    inside = ~outside[data]
    if len(inside) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = inner[inner > 0] - 1
    after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def since_start(n: int, starts: np.ndarray) -> np.ndarray:
    """For each of ``n`` bytes its distance from the last of ``starts``, 0 before the first."""
    edges = np.concatenate([[0], starts, [n]])
    return np.arange(n, dtype=np.int32) - np.repeat(edges[:-1].astype(np.int32), np.diff(edges))


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, outside: np.ndarray = WHITE) -> np.ndarray:
    """64-bit code of each word in lower case (A-Z), the same for the same bytes wherever it stands."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    codes = np.where(outside, np.uint64(0), _BYTE_CODE[_LOWER])[data]
    lengths = ends - starts
    place = since_start(len(data), starts)
    longest = int(lengths.max())
    powers = np.ones(longest, dtype=np.uint64)
    if longest > 1:
        powers[1:] = _BASE
        powers = np.cumprod(powers, dtype=np.uint64)
    np.minimum(place, longest - 1, out=place)
    codes *= powers[place]
    return mix(np.add.reduceat(codes, starts) + lengths.astype(np.uint64))


def shingle_sets(codes: np.ndarray, rows: np.ndarray, n_rows: int, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of each row, ascending, and the borders of the rows among them.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    out, borders = [], np.zeros(n_rows + 1, dtype=np.int64)
    m = len(codes) - words + 1
    if m > 0:
        full = np.zeros(m, dtype=np.uint64)
        for j in range(words):
            full += codes[j:j + m] * _PLACE[j]
        full = mix(full)
    for r in range(n_rows):
        n, a = int(counts[r]), int(first[r])
        if n >= words:
            s = np.sort(full[a:a + n - words + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif n:
            s = mix((codes[a:a + n] * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + _PLACE[32:33] * np.uint64(n))
        else:
            s = np.zeros(0, dtype=np.uint64)
        out.append(s)
        borders[r + 1] = borders[r] + len(s)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), borders
