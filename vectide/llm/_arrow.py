"""Arrow buffers seen as numpy arrays, and vectorised text primitives.

Everything here works on a slice of documents at once: the UTF-8 bytes of all
texts lie in one array, ``offs`` says where each text begins. No Python object
is made per word or per character.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 2 << 20
#: Bytes that are hashed at a time.
HASH_BYTES = 1 << 18
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[raw[0] : raw[-1]], raw - raw[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``most`` bytes a slice (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def release() -> None:
    """Give freed memory back: workers live on from operator to operator, beside an executor that needs its own."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """The same table; where the session doesn't say otherwise, Arrow batches are kept to 4 MB instead of 64, which executor and worker would each hold for every task."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, "4m")
    return df


def filtered(df: DataFrame, text: str, mask: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows that ``mask`` keeps by their text; columns, and their order, stay as they are."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(mask(batch.column(at))))

    return small_batches(df).mapInArrow(run, df.schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        inv = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _P, np.uint64))])
            _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inv, np.uint64))])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span ``data[start:end]``; equal bytes hash alike wherever they lie. Spans are in order and don't overlap."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):  # some bytes at a time: every byte takes five numbers
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, lo + HASH_BYTES, "right")))
        hi = int(end[to - 1])
        _grow(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers[: hi - lo], out=total[1:])
        a, b = start[at:to] - lo, end[at:to] - lo
        out[at:to] = (total[b] - total[a]) * _inverse[a] + (b - a).astype(np.uint64)
        at = to
    return mix(out)


def flag_spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a text's border: (starts, ends)."""
    n = len(inside)
    begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    if n:
        begins[0] = inside[0]
        begins[1:n] = inside[1:] & ~inside[:-1]
        ends[1:n] = inside[:-1] & ~inside[1:]
        ends[n] = inside[-1]
        cut = np.unique(offs)
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] |= inside[cut]
        ends[cut] |= inside[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of ASCII letters, digits and all non-ASCII bytes): starts, ends, and where each text's words begin."""
    start, end = flag_spans(_WORD[data], offs)
    return start, end, np.searchsorted(start, offs)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, repeats kept: (hashes, where each text's begin).

    A text of fewer than ``n`` words, but at least one, has all of its words as its only n-gram.
    """
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(size)), count)
    at = first[doc] + (np.arange(begin[-1]) - begin[doc])
    out = np.full(len(at), n, np.uint64)
    stop = first[doc + 1]
    for k in range(n):
        live = at + k < stop
        out[live] = mix(out[live] * np.uint64(0xD6E8FEB86659FD93) + hashes[at[live] + k])
    return out, begin
