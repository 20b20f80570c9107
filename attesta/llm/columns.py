"""Arrow columns as numpy arrays: text bytes, words as 64-bit hashes, windows, minimizers.

Everything here works on one bounded slice of rows at a time (``slices``), so a task's memory follows the longest
single text, not its partition. Words are maximal runs of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are no part of a letter or digit; bytes beyond ASCII count as letters.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def release() -> None:
    """Give back to the system what numpy and Arrow hold unused: a worker process outlives its stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same work over batches, with unused memory given back before and after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from work(batches)
        release()
    return run


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as binary with 64-bit offsets (nulls stay null)."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary()) if column.type != pa.large_binary() else column


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in the bytes and their end) of slices of about ``limit`` bytes;
    a longer text is a slice of its own. A null reads as empty."""
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    if column.null_count:  # a null may cover bytes: give it none
        length = np.where(np.asarray(pc.is_valid(column)), np.diff(offsets), 0)
        if int(length.sum()) != int(offsets[-1] - offsets[0]):
            column = pc.fill_null(column, b"")
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
            data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        end = min(end, n)
        yield start, end, data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def powers(n: int) -> np.ndarray:
    """1, B, B^2 .. modulo 2^64."""
    out = np.full(n, _U(_BASE))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _inverse() -> int:
    inv = 1
    for _ in range(6):
        inv = inv * (2 - _BASE * inv) % (1 << 64)
    return inv


_INVERSE = _inverse()


def inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, _U(_INVERSE))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of one slice: ``start``/``end`` byte places, ``key`` 64-bit hashes, ``doc`` row of each word and
    ``first`` the number of the first word of each row (one more entry at the end). ``alnum``: ASCII other than letters
    and digits separates words too."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold_case: bool = False, alnum: bool = False):
        if fold_case:  # A-Z only
            data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
        word = ~(IS_MARK if alnum else IS_SPACE)[data]
        before = np.empty(len(word), dtype=bool)
        before[:1] = False
        before[1:] = word[:-1]
        before[offsets[:-1][offsets[:-1] < len(word)]] = False  # a text starts a new word
        self.start = np.flatnonzero(word & ~before)
        after = np.empty(len(word), dtype=bool)
        after[-1:] = False
        after[:-1] = word[1:] & before[1:]
        self.end = np.flatnonzero(word & ~after) + 1
        self.data = data
        codes = BYTE_CODES[data] * _powers_cached(len(data))
        total = np.empty(len(data) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(codes, out=total[1:])
        key = (total[self.end] - total[self.start]) * _inverse_cached(len(data) + 1)[self.start]
        self.key = mix64(key ^ (self.end - self.start).astype(np.uint64) * _U(0x2545F4914F6CDD1D))
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


_CACHE: dict[str, np.ndarray] = {"p": powers(1), "i": inverse_powers(1)}


def _powers_cached(n: int) -> np.ndarray:
    if n > 2 * SLICE_BYTES:
        return powers(n)
    if len(_CACHE["p"]) < n:
        _CACHE["p"] = powers(max(n, SLICE_BYTES + 1))
    return _CACHE["p"][:n]


def _inverse_cached(n: int) -> np.ndarray:
    if n > 2 * SLICE_BYTES:
        return inverse_powers(n)
    if len(_CACHE["i"]) < n:
        _CACHE["i"] = inverse_powers(max(n, SLICE_BYTES + 1))
    return _CACHE["i"][:n]


def gram_hashes(key: np.ndarray, k: int) -> np.ndarray:
    """The 64-bit hash of the k symbols from each place on (places whose k symbols run past the end are left out)."""
    n = len(key) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(key) + 1, dtype=np.uint64)
    np.cumsum(key * _powers_cached(len(key)), out=total[1:])
    return mix64((total[k:] - total[:n]) * _inverse_cached(n))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value (by its upper 32 bits) of each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    if len(values) >= 1 << 32:
        raise ValueError("a single text of 4 GiB or more")
    least, step = (values & _U(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64), 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[:-(width - step)], least[width - step:])
    return (least[:n] & _U(0xFFFFFFFF)).astype(np.int64)
