"""Words of Arrow text columns as numpy arrays, straight from their UTF-8 bytes.

Every separator used here is an ASCII byte, so words can be cut in UTF-8 without
decoding. Texts are handled in blocks of about ``BLOCK`` bytes: memory follows the
block (or the one longer text), never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
MAX_ROWS = 1 << 16

_RATIO = 0x9E3779B97F4A7C13
_INVERSE = pow(_RATIO, -1, 1 << 64)


def _table(member) -> np.ndarray:
    return np.array([member(b) for b in range(256)], dtype=bool)


#: Words between blanks: anything but space and the bytes 09-0D.
BLANK_WORD = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of ASCII digits, letters and all bytes beyond ASCII.
ALNUM_WORD = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=None)
def constants(n: int, salt: int = 0) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt * 1_000_003)) | np.uint64(1)


_BYTE_VALUE = constants(256, 7)[LOWER]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        tables = []
        for ratio in (_RATIO, _INVERSE):
            steps = np.full(size, ratio, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        if n > BLOCK * 8:  # a single huge text: do not keep its tables
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1
        end = min(n, row + MAX_ROWS, max(end, row + 1))
        yield row, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """Starts, ends and row of each word, in order; and words per row."""
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = np.flatnonzero(np.diff(offsets))
        head, tail = offsets[full], offsets[full + 1] - 1
        first[head] = inside[head]
        last[tail] = inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), counts), counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z folded to a-z."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def hash_words(text: str, member: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends, _, _ = word_spans(raw, np.array([0, len(raw)]), member)
    return word_hashes(raw, starts, ends)


def window_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and where each begins."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for j, c in enumerate(constants(size, 100 + size)):
        total += words[j: j + n] * c
    at = np.flatnonzero(rows[:n] == rows[size - 1:]) if size > 1 else np.arange(n)
    return mix(total[at] + np.uint64(size)), at
