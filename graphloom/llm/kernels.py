"""Vectorised text kernels over Arrow string buffers: words, 64-bit word and n-gram hashes.

A word is a maximal run of bytes other than space, tab, newline, carriage return, vertical tab and form feed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: The same word separators for SQL and JVM regular expressions.
SPACES = r"[ \t\n\r\x0B\f]+"
WORD = r"[^ \t\n\r\x0B\f]+"
WS = np.zeros(256, bool)
WS[[32, 9, 10, 13, 11, 12]] = True
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
#: Text handled at once; a longer document is handled alone.
CHUNK_BYTES = 2 << 20
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches for Python of at most ``BATCH_BYTES``: a task holds one in the executor and one in its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark.conf.get(key).rstrip("bB")
    if not most.isdigit() or not 0 < int(most) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (with 8 bytes of padding) and n + 1 offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([data, np.zeros(8, np.uint8)]), offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a string column; at least a row each."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every word."""
    size = int(offsets[-1])
    solid = ~WS[data[:size]]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < size]
    begin[inner] |= solid[inner]
    stop = np.zeros(size + 1, bool)
    stop[:-1] = begin
    stop[1:-1] |= solid[:-1] & ~solid[1:]
    stop[0] = False
    if size and solid[-1]:
        stop[size] = True
    starts = np.flatnonzero(begin)
    stop[1:] &= np.concatenate([solid, [False]])[:-1] if size else stop[1:]
    ends = np.flatnonzero(stop)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a step."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    length = ends - starts
    out = mix((wide[starts] & MASK[np.minimum(length, 8)]) * _K1 + length.astype(np.uint64))
    left, at = np.flatnonzero(length > 8), 8
    while len(left):
        rest = length[left] - at
        out[left] = mix((out[left] ^ (wide[starts[left] + at] & MASK[np.minimum(rest, 8)])) * _K1 + np.uint64(at))
        left, at = left[rest > 8], at + 8
    return out


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _K1 + (b ^ _K2))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n successive values, by doubling; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, size, done, out = h, 1, 0, None
    while True:
        if n & size:
            piece = power[done:]
            out = piece if out is None else join_hashes(out[: len(piece)], piece)
            done += size
            if done == n:
                return out[: len(h) - n + 1]
        if size * 2 > n:
            raise AssertionError("unreachable")
        power = join_hashes(power[:-size], power[size:])
        size *= 2


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index, start and end (bytes within the batch) of every word."""
    data, offsets = flat(texts)
    starts, ends, doc = words(data, offsets)
    return span_hashes(data, starts, ends), doc, starts, ends
