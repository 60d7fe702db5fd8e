"""Token ids as directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id and a bitmap that says which ids go
on; level 1 holds the next chunk of those, and so on. The place of an id's next chunk is the number of set bits before
it, which a directory of counts every 512 bits gives with a look at no more than one block of the bitmap. So any token
is read from a blob in as many steps as it has chunks, and nothing else is decoded.

Blob (little endian): b"DAC1", u32 ids, u8 levels; then of each level u32 chunks, the chunks, and but for the last
level the bitmap (least bit first) and the directory (u32 set bits before each block of 512).

Defined cases: null ids give a null blob, no ids a blob of none; a null id within a list counts as 0; ids of up to 63 bits
are kept whole; negative ids raise ValueError; reading outside a blob raises IndexError (null in DataFrames); repeated rows give equal blobs; an empty
table gives an empty table; other columns pass through and a column that has the name of the result raises ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from . import kernels as K
from .lineage import positional

_BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_EMPTY = b"DAC1" + bytes(5)


def encode_many(ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A blob for each list ids[offsets[i]:offsets[i + 1]]; all lists advance level by level together."""
    if len(ids) and ids.min() < 0:
        raise ValueError("negative id")
    n = len(offsets) - 1
    parts: list[list[bytes]] = [[] for _ in range(n)]
    levels = np.zeros(n, np.int64)
    value, at, live = ids.astype(np.uint32 if not len(ids) or ids.max() < 1 << 32 else np.uint64), offsets.astype(np.int64), np.arange(n)
    while len(live):
        levels[live] += 1
        more = value > 255
        count = np.diff(at)
        ones = np.concatenate([[0], np.cumsum(more)])
        going = ones[at[1:]] > ones[at[:-1]]
        chunks = (value & 255).astype(np.uint8).tobytes()
        # bitmaps: every list starts at a byte
        width = (count + 7) // 8
        base = np.concatenate([[0], np.cumsum(width)])
        owner = np.repeat(np.arange(len(live)), count)
        bits = np.zeros(int(base[-1]) * 8, bool)
        bits[base[owner] * 8 + np.arange(len(value)) - at[owner]] = more
        bitmap = np.packbits(bits, bitorder="little").tobytes()
        blocks = (count + _BLOCK - 1) // _BLOCK
        edge = np.concatenate([[0], np.cumsum(blocks)])
        block_of = np.repeat(np.arange(len(live)), blocks)
        start = at[block_of] + (np.arange(int(edge[-1])) - edge[block_of]) * _BLOCK
        ranks = (ones[start] - ones[at[block_of]]).astype(np.uint32).tobytes()
        for k, (i, go) in enumerate(zip(live.tolist(), going.tolist())):
            a, b = int(at[k]), int(at[k + 1])
            parts[i] += [struct.pack("<I", b - a), chunks[a:b]]
            if go:
                parts[i] += [bitmap[base[k] : base[k + 1]], ranks[4 * edge[k] : 4 * edge[k + 1]]]
        kept = np.concatenate([[0], np.cumsum((ones[at[1:]] - ones[at[:-1]])[going])])
        value, at, live = value[more] >> 8, kept, live[going]
    sizes = np.diff(offsets)
    return [b"".join([b"DAC1", struct.pack("<IB", int(sizes[i]), int(levels[i])), *parts[i]]) for i in range(n)]


class Reader:
    """Random access to a blob; only its header is read up front."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != b"DAC1":
            raise ValueError("no DAC1 blob")
        self.blob = blob
        self.n, levels = struct.unpack_from("<IB", blob, 4)
        self.levels, at = [], 9
        for level in range(levels):
            (m,) = struct.unpack_from("<I", blob, at)
            chunks = at + 4
            bitmap = chunks + m
            ranks = bitmap + (m + 7) // 8
            last = level == levels - 1
            self.levels.append((chunks, None if last else bitmap, ranks))
            at = bitmap if last else ranks + 4 * ((m + _BLOCK - 1) // _BLOCK)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out, blob = 0, self.blob
        for shift, (chunks, bitmap, ranks) in enumerate(self.levels):
            out |= blob[chunks + i] << 8 * shift
            if bitmap is None or not blob[bitmap + i // 8] >> i % 8 & 1:
                break
            block = i // _BLOCK
            (rank,) = struct.unpack_from("<I", blob, ranks + 4 * block)
            first = bitmap + block * (_BLOCK // 8)
            between = int.from_bytes(blob[first : bitmap + i // 8], "little") | (blob[bitmap + i // 8] & ((1 << i % 8) - 1)) << 8 * (bitmap + i // 8 - first)
            i = rank + between.bit_count()
        return out

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for shift, (chunks, bitmap, _) in enumerate(self.levels):
            m = len(place)
            out[place] |= np.frombuffer(self.blob, np.uint8, m, chunks).astype(np.int64) << 8 * shift
            if bitmap is None:
                break
            more = np.unpackbits(np.frombuffer(self.blob, np.uint8, (m + 7) // 8, bitmap), count=m, bitorder="little").astype(bool)
            place = place[more]
        return out


def read_many(blobs: list[bytes], places: np.ndarray) -> np.ndarray:
    """The id at one place of each blob, all advancing level by level; -1 outside a blob."""
    size = np.array([len(b) for b in blobs], np.int64)
    data = np.frombuffer(b"".join(blobs) + bytes(64 + 8), np.uint8)
    wide = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    base = np.cumsum(size) - size
    if len(base) and (wide[base] != 0x31434144).any():
        raise ValueError("no DAC1 blob")
    n, levels = wide[base + 4].astype(np.int64), data[base + 8]
    live = np.flatnonzero((places >= 0) & (places < n))
    out = np.full(len(blobs), -1, np.int64)
    out[live] = 0
    at, i, level = base[live] + 9, places[live].astype(np.int64), 0
    while len(live):
        m = wide[at].astype(np.int64)
        chunks = at + 4
        bitmap, width = chunks + m, (m + 7) // 8
        out[live] |= data[chunks + i].astype(np.int64) << 8 * level
        goes = level < levels[live] - 1
        byte = bitmap + np.where(goes, i // 8, 0)
        goes &= (data[byte] >> (i % 8).astype(np.uint8) & 1).astype(bool)
        live, i, m, bitmap, width, byte = (x[goes] for x in (live, i, m, bitmap, width, byte))
        block = i // _BLOCK
        first = bitmap + block * (_BLOCK // 8)
        near = first[:, None] + np.arange(_BLOCK // 8)
        between = np.where(near < byte[:, None], _ONES[data[np.minimum(near, len(data) - 1)]], 0).sum(1)
        partial = _ONES[data[byte] & ((1 << (i % 8)) - 1).astype(np.uint8)]
        ranks = bitmap + width
        at = ranks + 4 * ((m + _BLOCK - 1) // _BLOCK)
        i = wide[ranks + 4 * block].astype(np.int64) + between.astype(np.int64) + partial
        level += 1
    return out


def encode(df: DataFrame, ids_col: str, out: str = "dac") -> DataFrame:
    """``df`` with the blob of an array of ids in ``out``; a narrow map."""
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    at, names, df = df.columns.index(ids_col), df.columns, positional(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                lists = part.column(at)
                offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
                blobs = encode_many(lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), offsets)
                blobs = [None if null else b for b, null in zip(blobs, lists.is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blobs, pa.binary())], names=[*part.schema.names, "out"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("out", T.BinaryType())])).toDF(*names, out)


def token_at(df: DataFrame, blob_col: str, place_col: str, out: str = "token_id") -> DataFrame:
    """``df`` with the id at a place of each blob; null outside it."""
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    at, place_at, names, df = df.columns.index(blob_col), df.columns.index(place_col), df.columns, positional(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                blobs = [b if b is not None else _EMPTY for b in part.column(at).to_pylist()]
                found = read_many(blobs, part.column(place_at).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64(), mask=found < 0)], names=[*part.schema.names, "out"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("out", T.LongType())])).toDF(*names, out)


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = bpe.VOCABULARY) -> DataFrame:
    """Rows (doc_id, n_tokens, dac): texts straight to blobs of their byte-pair ids, in one narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, "text", K.CHUNK_BYTES // 2):
                texts = part.column(1)
                ids, offsets = bpe.codec(path).encode(texts)
                blobs, null = encode_many(ids, offsets), texts.is_null()
                if texts.null_count:
                    blobs = [None if x else b for b, x in zip(blobs, null.to_pylist())]
                count = pa.array(np.diff(offsets), pa.int64(), mask=null.to_numpy(zero_copy_only=False) if texts.null_count else None)
                yield pa.RecordBatch.from_arrays([part.column(0), count, pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "dac"])

    schema = T.StructType([T.StructField("doc_id", docs.schema.fields[docs.columns.index(id_col)].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("dac", T.BinaryType())])
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def random_access(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, exact): whether the first, middle and last id of each text's blob, read by ``token_at``, are those of the
    encoder, and the places before and after it have none."""
    ids = bpe.encode(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")).drop("text")
    coded = encode(ids, "token_ids").withColumn("n", F.size("token_ids"))
    places = {"a": F.lit(0), "b": F.expr("n div 2"), "c": F.col("n") - 1, "d": F.lit(-1), "e": F.col("n")}
    exact = F.lit(True)
    for name, place in places.items():
        coded = token_at(coded.withColumn(f"p{name}", place.cast("bigint")), "dac", f"p{name}", f"t{name}")
        want = F.when(F.col(f"p{name}").between(0, F.col("n") - 1), F.try_element_at("token_ids", (F.col(f"p{name}") + 1).cast("int")))
        exact &= F.col(f"t{name}").eqNullSafe(want)
    return coded.select("doc_id", exact.alias("exact"))
