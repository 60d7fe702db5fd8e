"""Exact Jaccard self-join of documents on their sets of word n-grams.

A document is a distinct (id, text). Documents with the same set form a class and only one of a class, its head, takes
part in the search. Grams are put in one global order, rarest first, by a count sketch over the whole table, and those
whose counts are such as chance gives by how frequent their words are. A set of
size s that reaches the threshold T with another shares at least ceil(T * s) grams with it, so any two such sets share
k of the first s - ceil(T * s) + k grams of either (k = 1, 2).

The join is size-aware. Sets of at most ``boundary`` grams are small: they list all 2-subsets of their 2-prefix, and
two small sets are candidates if they list a subset in common. Larger sets scan inverted lists: the 1-prefix grams of
all sets that are large, or near enough in size to match a large one, are posted, and pairs with a large member are
read off the lists. The boundary is the one of least cost, from the size histogram and the skew of the sketch.
Candidates carry how many keys they share, which bounds their overlap from above; those that can still reach the
threshold are checked on their full texts. No list, set or pair is capped.

Groups of near copies grow with the table, and pairs with the square of a group. So sets are first put into blocks by
links between sets that share a minimum hash and look alike in a 16-slot sketch: to the first set under the hash, else
to one just before. Pairs within a block are found
by tasks for pairs of its pieces (of at most ``BLOCK`` sets and ``PIECE_GRAMS`` grams), as products of 0/1 matrices;
the search above skips them. Any blocks give the same pairs, so the sketch decides only where a pair is found.

``links``, the registered form, returns a row a document: its group and with how many others it reaches the threshold.
A task counts and joins the pairs it finds and hands on a row a set, so no group is written out as pairs.
``jaccard_join`` lists the pairs of heads, for callers that need the values.

Postings travel as packed arrays of a bucket of the key space, so the shuffle holds about 12 bytes a posting.

Defined cases: null and blank texts have no set and no row; a text of fewer words than n has one gram, all its words;
ties at the threshold count; rows with a null id are left out; rows that repeat id and text are one document; rows of
one id with different texts are documents of their own, each judged by its own text; an empty table gives no rows; only
id and text are read, so other columns can't clash, and names may hold dots.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .lineage import positional, settle

GRAM = 3
THRESHOLD = 0.55
#: Least and greatest number of counters of the sketch (as powers of two, four a document in between). It orders grams
#: and estimates cost, so its size bounds no result.
SKETCH_BITS, _MOST_SKETCH_BITS = 20, 22
WORD_BITS = 20  # of the counters of words
_BLOCK_BITS = 14
_ZSTD = pa.Codec("zstd", compression_level=1)
_SIZES = 4096  # sets of this size or more share the last entry of the histogram
_PER_BUCKET = 500_000
#: Above this many ids or edges the work is shuffled instead of broadcast or done on the driver.
SMALL_SIDE = 500_000
#: Postings that a task holds before it sends them.
_HELD = 300_000
#: Pairs that a task holds at once, at some 150 bytes each.
_MAX_PAIRS = 250_000
#: Sets and grams of a piece of a block, of which a task gets two, and labels sent to every executor (16 bytes each). A
#: task holds about 150 bytes a gram of its pieces, so its memory doesn't grow with the block.
BLOCK = 2048
PIECE_GRAMS = 500_000
_LABELS_SENT = 2_000_000
_SLOTS, _LINKS, _ALIKE = 16, 8, 8
#: Places before it under a key at which a set that doesn't look like the first one is compared.
_BACK = (1, 2, 3, 5, 8)
_STRIPE = 512
#: Postings carry 48 bits of a signature; candidates that share them are told apart when texts are compared.
_SHORT = np.uint64(16)


def _runs(h: np.ndarray, doc: np.ndarray, texts: int, n: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """``grams`` of hashed words; with the ranks of words by hash also half the mean rank in every gram."""
    run = K.run_hashes(h, n)
    inside = doc[: len(run)] == doc[n - 1 :] if len(run) else np.zeros(0, bool)
    of, value = doc[: len(run)][inside], run[inside]
    count = np.bincount(doc, minlength=texts)
    at = np.concatenate([[0], np.cumsum(count)])
    mean = None
    if words is not None:
        total = np.concatenate([[0], np.cumsum(words[(h >> np.uint64(64 - WORD_BITS)).astype(np.int64)], dtype=np.int64)])
        mean = (total[n:] - total[: max(0, len(total) - n)])[inside] // (2 * n)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            part = K.run_hashes(h, k)[at[short]] ^ np.uint64(k)
            of, value = np.concatenate([of, short]), np.concatenate([value, K.mix(part)])
            if words is not None:
                mean = np.concatenate([mean, (total[at[short] + k] - total[at[short]]) // (2 * k)])
    return of, value, mean


def grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and 64-bit hash of every n-gram occurrence, in order; a shorter text has one of all its words."""
    h, doc, _, _ = K.word_hashes(texts)
    return _runs(h, doc, len(texts), n)[:2]


def _distinct_grams(texts: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every distinct n-gram of each text, in order; texts are cut into grams a few at a time."""
    rows, values, base = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for chunk in texts.chunks:
        for part in K.chunks(pa.RecordBatch.from_arrays([chunk], names=["text"]), "text"):
            of, value = grams(part.column("text"), n)
            by = np.lexsort((value, of))
            of, value = of[by], value[by]
            fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])]) if len(of) else np.zeros(0, bool)
            rows.append(of[fresh] + base)
            values.append(value[fresh])
            base += part.num_rows
    return np.concatenate(rows), np.concatenate(values)


def _sets(h: np.ndarray, doc: np.ndarray, texts: int, n: int, order: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, 44-bit gram) of hashed words by text and rank in the order; at most 4096 texts."""
    of, value, mean = _runs(h, doc, texts, n, None if order is None else order[1])
    short, of = value >> np.uint64(20), of.astype(np.uint64) << np.uint64(52)
    if order is None:
        both = np.unique(of | short)
    else:
        rank = order[0][(short >> np.uint64(44 - (len(order[0]) - 1).bit_length())).astype(np.int64)].astype(np.uint64)
        rank = np.where(rank == 0, mean.astype(np.uint64), rank)
        # grams that share their 44 bits are one, whatever their words
        both = np.sort(of | short << np.uint64(8) | rank)
        both = both[np.concatenate([[True], both[1:] >> np.uint64(8) != both[:-1] >> np.uint64(8)])] if len(both) else both
        both = np.sort(both >> np.uint64(52) << np.uint64(52) | (both & np.uint64(255)) << np.uint64(44) | both >> np.uint64(8) & np.uint64((1 << 44) - 1))
    return (both >> np.uint64(52)).astype(np.int64), both & np.uint64((1 << 44) - 1)


def _packed(counts: np.ndarray) -> bytes:
    """32-bit counts as compressed planes of bytes: most are small, and a task has as many of them as there are counters."""
    return _ZSTD.compress(counts.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(data, 4 << _BLOCK_BITS, asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32)[:, 0]


def _rarity(logs: np.ndarray) -> np.ndarray:
    """Ranks of the counters, of their logarithms: 0 where chance may have filled one (its grams go by their words), else
    128 and more by count."""
    usual = 2.0 ** (np.median(logs) / 8) - 1
    chance = 8 * np.log2(1 + usual + 2 * np.sqrt(usual))
    return np.where(logs <= chance, 0, 128 + np.minimum(127, np.maximum(0, logs - chance))).astype(np.uint8)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for part in K.chunks(batch, column):
        for at in range(0, part.num_rows, 4096):
            yield part.slice(at, 4096)


def _needed(size: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(size * t - 1e-9).astype(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text) of the rows with an id; th is a hash of the text that tells texts of one id apart."""
    text = F.col(f"`{text_col}`")
    return docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def profile(texts: DataFrame, n: int, bits: int) -> DataFrame:
    """Settled rows: of each document its set's signature (two 64-bit sums) and size; of each task blocks of the sketch
    and sizes."""
    shift = np.uint64(44 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, words, sizes = np.zeros(1 << bits, np.int32), np.zeros(1 << WORD_BITS, np.int32), np.zeros(_SIZES, np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in _slices(batch, "text"):
                h, doc, _, _ = K.word_hashes(part.column("text"))
                of, gram = _sets(h, doc, part.num_rows, n, None)
                if not len(of):
                    continue
                words += np.bincount((h >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=len(words)).astype(np.int32)
                sketch += np.bincount((gram >> shift).astype(np.int64), minlength=len(sketch)).astype(np.int32)
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                size = np.diff(np.concatenate([first, [len(of)]]))
                sizes += np.bincount(np.minimum(size, _SIZES - 1), minlength=_SIZES)
                sig = K.mix(np.add.reduceat(K.mix(gram + np.uint64(0x1234567)), first) + size.astype(np.uint64))
                value = K.mix(gram + np.uint64(0x7654321))
                check = K.mix(np.add.reduceat(value, first))
                slot = value & np.uint64(_SLOTS - 1)
                least = np.stack([np.minimum.reduceat(np.where(slot == np.uint64(i), value, np.uint64(2**64 - 1)), first) for i in range(_SLOTS)], 1)
                short = (least >> np.uint64(8)).astype(np.uint16)
                links = pa.FixedSizeListArray.from_arrays(pa.array((least[:, :_LINKS] >> np.uint64(8)).astype(np.uint32).view(np.int32).ravel()), _LINKS).cast(pa.list_(pa.int32()))
                rows = pa.array(of[first])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(sig.view(np.int64)), pa.array(check.view(np.int64)), pa.array(size), pa.nulls(len(first), pa.int32()), pa.array([r.tobytes() for r in short], pa.binary()), links], names=names)
        if sizes.any():
            blocks = np.concatenate([sketch, words]).reshape(-1, 1 << _BLOCK_BITS)
            data = [sizes.tobytes(), *map(_packed, blocks)]
            k = len(data)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), *[pa.nulls(k, pa.int64())] * 4, pa.array(np.arange(-1, k - 1), pa.int32()), pa.array(data, pa.binary()), pa.nulls(k, pa.list_(pa.int32()))], names=names)

    long = T.LongType()
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), *(T.StructField(c, long) for c in ("th", "sig", "check", "size")), T.StructField("block", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("links", T.ArrayType(T.IntegerType()))])
    names = schema.names
    return settle(texts.mapInArrow(run, schema))


def _merged_sketch(rows: DataFrame, bits: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, float, float]:
    """Ranks of the counters of grams and of words (a byte each), the size histogram, the sum and the sum of squares of
    the counts of grams."""

    def add(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        total = sum((np.frombuffer(b, np.int64) if block < 0 else _unpacked(b)).astype(np.int64) for b in table.column("data").to_pylist())
        out = total.tobytes() if block < 0 else np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8).tobytes()
        return pa.table({"block": pa.array([block], pa.int32()), "data": pa.array([out], pa.binary()), "n": [float(total.sum())], "squares": [float((total.astype(float) ** 2).sum())]})

    merged = rows.where("block IS NOT NULL").select("block", "data").groupBy("block").applyInArrow(add, "block int, data binary, n double, squares double").collect()
    by = {r["block"]: r for r in merged}
    logs = np.zeros((1 << bits) + (1 << WORD_BITS), np.uint8)
    sizes = np.zeros(_SIZES, np.int64)
    for block, r in by.items():
        if block < 0:
            sizes = np.frombuffer(bytes(r["data"]), np.int64)
        else:
            logs[block << _BLOCK_BITS : (block + 1) << _BLOCK_BITS] = np.frombuffer(bytes(r["data"]), np.uint8)
    of_grams = [r for b, r in by.items() if 0 <= b < 1 << bits - _BLOCK_BITS]
    return (_rarity(logs[: 1 << bits]), logs[1 << bits :]), sizes, sum(r["n"] for r in of_grams), sum(r["squares"] for r in of_grams)


def choose_boundary(sizes: np.ndarray, partners: float, t: float) -> tuple[int, float]:
    """The boundary of least cost, and how many postings it makes.

    A posting costs 1; a posting in an inverted list also costs a tenth for each set it is expected to meet there.
    """
    size = np.arange(len(sizes))
    need = _needed(size, t)
    two, one = np.maximum(size - need + 2, 0), np.maximum(size - need + 1, 0)
    light = np.cumsum(sizes * (two * (two - 1) / 2))
    heavy = np.concatenate([np.cumsum((sizes * one)[::-1])[::-1], [0.0]])
    light[:2] = 0
    after = np.minimum(np.floor(size * t).astype(int) + 1, len(sizes))
    cost = light + heavy[after] * (1 + partners / 10)
    cost[-1] = np.inf  # the last entry holds sets of all greater sizes
    at = int(np.argmin(cost))
    return at, float(light[at] + heavy[after[at]])


def _subsets(value: np.ndarray, first: np.ndarray, size: np.ndarray, boundary: int, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all 2-subsets of the 2-prefix of sets of at most ``boundary`` grams, a row a set, and the sets' first
    places; about ``_HELD`` keys at once, or those of one set."""
    for s in np.unique(size[(size <= boundary) & (size > 1)]):
        rows = first[size == s]
        p = int(s - _needed(np.array([s]), t)[0] + 2)
        i, j = np.triu_indices(min(p, int(s)), 1)
        step = max(1, _HELD // len(i))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield K.join_hashes(value[part[:, None] + i], value[part[:, None] + j]), part


def _postings(texts: DataFrame, n: int, t: float, order: tuple[np.ndarray, np.ndarray], boundary: int, buckets: int, labels: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Packed (key, set, size, block) by bucket; a task sends a set once however many copies of it it meets.
    labels: sorted signatures and their blocks, or None where the texts carry their block in ``label``."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((order, labels))

    def pack(key: np.ndarray, sig: np.ndarray, size: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        """A blob a bucket, by key: steps of the key and the other columns as planes of bytes, which compress alike
        whatever the number of buckets."""
        bucket = (key >> np.uint64(32)) % np.uint64(buckets)
        by = np.argsort(bucket << np.uint64(32) | key & np.uint64(0xFFFFFFFF), kind="stable")
        bucket, key, sig, size, label = bucket[by].astype(np.int32), key[by].astype(np.uint32), sig[by] >> _SHORT, size[by].astype(np.uint32), label[by]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.concatenate([first[1:], [len(bucket)]])
        step = np.diff(key, prepend=np.uint32(0))
        step[first] = key[first]
        planes = np.concatenate([step.view(np.uint8).reshape(-1, 4), sig.view(np.uint8).reshape(-1, 8)[:, :6], size.view(np.uint8).reshape(-1, 4), label.view(np.uint8).reshape(-1, 8)], 1)
        data = [planes[a:b].T.tobytes() for a, b in zip(first, ends)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(data, pa.binary())], names=["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ranks, known), held, count, sent = shared.value, [], 0, np.zeros(0, np.uint64)
        for batch in batches:
            for part in _slices(batch, "text"):
                h, doc, _, _ = K.word_hashes(part.column("text"))
                of, gram = _sets(h, doc, part.num_rows, n, ranks)
                if not len(of):
                    continue
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                size = np.diff(np.concatenate([first, [len(of)]]))
                value = K.mix(gram + np.uint64(0x1234567))
                sig = K.mix(np.add.reduceat(value, first) + size.astype(np.uint64))
                fresh = np.zeros(len(sig), bool)
                fresh[np.unique(sig, return_index=True)[1]] = True
                fresh &= ~np.isin(sig, sent)
                if not fresh.all():
                    use = np.repeat(fresh, size)
                    of, gram, value, sig, size = of[use], gram[use], value[use], sig[fresh], size[fresh]
                    if not len(of):
                        continue
                    first = np.cumsum(size) - size
                sent = np.concatenate([sent, sig])
                if known is None:
                    label = part.column("label").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)[of[first]]
                else:
                    at = np.minimum(np.searchsorted(known[0], sig), max(len(known[0]) - 1, 0))  # blocks are numbered from 1
                    label = np.where(known[0][at] == sig, known[1][at], np.uint64(0)) if len(known[0]) else np.zeros(len(sig), np.uint64)
                lane = np.repeat(np.arange(len(first)), size)
                rank = np.arange(len(of)) - first[lane]
                free = size - _needed(size, t)
                # the inverted lists of large sets and of those that may match one
                take = (rank < (free + 1)[lane]) & (size[lane] > boundary * t)
                made = [(value[take] & ~np.uint64(1), sig[lane[take]], size[lane[take]].astype(np.int64), label[lane[take]])]
                # the 2-subsets of small sets, of so many sets at once as have a bounded number of them
                for keys, rows in itertools.chain([(None, None)], _subsets(value, first, size, boundary, t)):
                    if keys is not None:
                        each = np.repeat(lane[rows], keys.shape[1])
                        made = [(keys.ravel() | np.uint64(1), sig[each], size[each].astype(np.int64), label[each])]
                    held += made
                    count += len(made[0][0])
                    if count > _HELD:
                        yield pack(*(np.concatenate(x) for x in zip(*held)))
                        held, count = [], 0
        if count:
            yield pack(*(np.concatenate(x) for x in zip(*held)))

    return texts.select("text", *(["label"] if labels is None else [])).mapInArrow(run, "bucket int, data binary")


def _meet(key: np.ndarray, sig: np.ndarray, size: np.ndarray, label: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of sets under one key, of different blocks, that sizes allow: whether the key is a subset, signatures and
    sizes, the smaller set first."""
    by = np.argsort(key, kind="stable")
    key = key[by]
    same = key[1:] == key[:-1]
    met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    if not met.any():
        return
    key, by = key[met], by[met]
    sig, size, label = sig[by], size[by], label[by]
    label = np.where(label == 0, sig | np.uint64(1 << 63), label)  # a set without a block is its own
    by = np.lexsort((sig, label, key))
    key, sig, size, label = key[by], sig[by], size[by], label[by]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])])
    key, sig, size, label = key[fresh], sig[fresh], size[fresh], label[fresh]
    # partners of a set are those of the later blocks under its key
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    end = np.repeat(ends, np.diff(ends, prepend=0))
    blocks = np.append(np.flatnonzero((key[1:] != key[:-1]) | (label[1:] != label[:-1])) + 1, len(key))
    start = np.repeat(blocks, np.diff(blocks, prepend=0))
    many, at = end - start, 0
    total = np.cumsum(many)
    while at < len(key):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + _MAX_PAIRS, "right")))
        a = np.repeat(np.arange(at, to), many[at:to])
        if len(a):
            b = start[a] + np.arange(len(a)) - np.repeat(total[at:to] - many[at:to] - base, many[at:to])
            x, y = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            near = x >= y * t - 1e-9
            a, b = a[near], b[near]
            swap = (size[a] > size[b]) | ((size[a] == size[b]) & (sig[a] > sig[b]))
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield (key[a] & 1).astype(bool), sig[a], sig[b], size[a], size[b]
        at = to


def _candidates(postings: DataFrame, t: float, boundary: int, buckets: int, parts: int) -> DataFrame:
    def count(held: list) -> list:
        a, b, x, y, n = (np.concatenate(v) for v in zip(*held))
        if not len(a):
            return [(a, b, x, y, n)]
        by = np.lexsort((b, a))
        a, b, x, y, n = a[by], b[by], x[by], y[by], n[by]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return [(a[first], b[first], x[first], y[first], np.add.reduceat(n, first))]

    def batch_of(held: list) -> pa.RecordBatch:
        a, b, x, y, n = held[0]
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(x), pa.array(y), pa.array(n)], names=["sig_a", "sig_b", "size_a", "size_b", "n"])

    def bucket_of(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
        out = ([], [], [], [])
        for data in blobs:
            planes = np.frombuffer(data, np.uint8).reshape(22, -1)
            for held, (lo, hi), kind in zip(out, ((0, 4), (4, 10), (10, 14), (14, 22)), (np.uint32, np.uint64, np.uint32, np.uint64)):
                wide = np.zeros((planes.shape[1], kind().nbytes), np.uint8)
                wide[:, : hi - lo] = planes[lo:hi].T
                held.append(wide.view(kind)[:, 0])
            out[0][-1] = np.cumsum(out[0][-1], dtype=np.uint32)
            out[2][-1] = out[2][-1].astype(np.int64)
        return tuple(np.concatenate(x) for x in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n = [], 0
        for blobs in _groups(batches):
            key, sig, size, label = bucket_of(blobs)
            for subset, a, b, x, y in _meet(key, sig, size, label, t):
                # two small sets on an inverted list are met by their subsets
                own = subset | (y > boundary)
                held.append((a[own], b[own], x[own], y[own], np.ones(int(own.sum()), np.int64)))
                held_n += len(held[-1][0])
                if held_n > _MAX_PAIRS:
                    held = count(held)
                    held_n = len(held[0][0])
                    if held_n > _MAX_PAIRS // 2:
                        yield batch_of(held)
                        held, held_n = [], 0
        if held:
            yield batch_of(count(held))

    met = postings.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "sig_a long, sig_b long, size_a long, size_b long, n long")
    pairs = met.groupBy("sig_a", "sig_b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.sum("n").alias("n"))
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    # size_a <= size_b, so the greater rest after a prefix is that of b
    rest = F.ceil(F.lit(t) * F.col("size_b") - 1e-9)
    shared = F.greatest(F.lit(2), need - rest + 2)
    return pairs.where(F.when(F.col("size_b") <= boundary, F.col("n") >= shared * (shared - 1) / 2).otherwise(F.col("n") >= need - rest + 1)).select("sig_a", "sig_b")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of one bucket after another, of rows sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != at and held:
                yield held
                held = []
            at = bucket
            held.append(data)
    if held:
        yield held


_KEYS = ["id_a", "th_a", "id_b", "th_b"]


def _pairs_of(id_type: T.DataType) -> T.StructType:
    """Two documents and a value: their Jaccard, or what a task counted for the first of them."""
    kinds = [id_type, T.LongType(), id_type, T.LongType(), T.DoubleType()]
    return T.StructType([T.StructField(c, k) for c, k in zip([*_KEYS, "value"], kinds)])


def _jaccard(pairs: DataFrame, n: int, t: float, id_type: T.DataType) -> DataFrame:
    """The rows of pairs (with text_a and text_b) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in K.chunks(batch, "text_a"):
                for part in K.chunks(half, "text_b"):
                    sets = []
                    for side in ("text_a", "text_b"):
                        of, value = grams(part.column(side), n)
                        by = np.lexsort((value, of))
                        of, value = of[by], value[by]
                        fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])]) if len(of) else np.zeros(0, bool)
                        sets.append((of[fresh], value[fresh]))
                    (oa, va), (ob, vb) = sets
                    of, value = np.concatenate([oa, ob]), np.concatenate([va, vb])
                    by = np.lexsort((value, of))
                    of, value = of[by], value[by]
                    both = np.bincount(of[1:][(of[1:] == of[:-1]) & (value[1:] == value[:-1])], minlength=part.num_rows)
                    union = np.bincount(of, minlength=part.num_rows) - both
                    score = both / np.maximum(union, 1)
                    keep = np.flatnonzero(score >= t - 1e-12)
                    rows = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in _KEYS), pa.array(np.floor(score[keep] * 1e6 + 0.5) / 1e6)], names=[*_KEYS, "value"])

    return pairs.select(*_KEYS, "text_a", "text_b").mapInArrow(run, _pairs_of(id_type))


def _blocks(heads: DataFrame, parts: int) -> DataFrame:
    """(sig, label) of the sets that look like another: connected by star links under shared minimum hashes, and where
    the star's centre differs by links to sets just before."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = vector = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sigs = batch.column("key").to_numpy(), batch.column("sig").to_numpy()
            vectors = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.uint16).reshape(-1, _SLOTS)
            first = np.flatnonzero(np.concatenate([[keys[0] != key], keys[1:] != keys[:-1]]))
            lead = np.searchsorted(first, np.arange(len(keys)), "right") - 1
            leads, lead_vectors = sigs[first[np.maximum(lead, 0)]] if len(first) else np.full(len(keys), head), vectors[first[np.maximum(lead, 0)]] if len(first) else np.repeat(vector[None], len(keys), 0)
            if head is not None and (lead < 0).any():
                leads, lead_vectors = np.where(lead < 0, head, leads), np.where((lead < 0)[:, None], vector, lead_vectors)
            key, head, vector = keys[-1], leads[-1], lead_vectors[-1]
            alike = ((vectors == lead_vectors).sum(1) >= _ALIKE) & (sigs != leads)
            ends = [(leads[alike], sigs[alike])]
            for back in _BACK:
                at = np.flatnonzero(~alike[back:]) + back
                at = at[keys[at] == keys[at - back]]
                at = at[(vectors[at] == vectors[at - back]).sum(1) >= _ALIKE]
                alike[at] = True
                ends.append((sigs[at - back], sigs[at]))
            a, b = (np.concatenate(x) for x in zip(*ends))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["doc_id_a", "doc_id_b"])

    keyed = heads.select("sig", "data", F.posexplode("links").alias("slot", "least")).where("least <> -1").select(F.xxhash64("slot", "least").alias("key"), "sig", "data")
    links = keyed.repartition(parts, "key").sortWithinPartitions("key", "sig").mapInArrow(link, "doc_id_a long, doc_id_b long").distinct()
    return components(links).select(F.col("id").alias("sig"), F.col("head").alias("label"))


def _stars(keep: np.ndarray, same: bool) -> np.ndarray:
    """Of rows and columns of a 0/1 matrix, one after the other (or of the rows alone where both are the ``same``), the
    first member of the connected component, as its place among them."""
    m, k = keep.shape
    head = np.arange(m if same else m + k)
    base = 0 if same else m
    while True:
        new = head.copy()
        for at in range(0, m, _STRIPE):
            to = min(m, at + _STRIPE)
            part = keep[at:to]
            new[at:to] = np.minimum(new[at:to], np.where(part, head[None, base : base + k], len(head)).min(1, initial=len(head)))
            if not same:
                new[m:] = np.minimum(new[m:], np.where(part, head[at:to, None], len(head)).min(0, initial=len(head)))
        new = new[new]
        if (new == head).all():
            return head
        head = new


def _overlaps(parts: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Numbers of shared grams between the sets of one piece, or of two; a piece is (row of each gram, gram, rows)."""
    left, right, wide = parts[0], parts[-1], sum(p[2] for p in parts)
    _, code, count = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    both = np.zeros((left[2], right[2]), np.float32)
    sides, lo = [], 0
    for row, gram, _ in parts:
        col = place[code[lo : lo + len(gram)]]
        lo += len(gram)
        row, col = row[col >= 0], col[col >= 0]
        by = np.argsort(col, kind="stable")
        sides.append((row[by], col[by]))
    step = max(256, (8 << 20) // max(1, wide))
    for c in range(0, len(shared), step):
        made = []
        for (row, col), (_, _, rows) in zip(sides, parts):
            a, b = np.searchsorted(col, [c, c + step])
            x = np.zeros((rows, min(step, len(shared) - c)), np.float32)
            x[row[a:b], col[a:b] - c] = 1
            made.append(x)
        both += made[0] @ made[-1].T
    return both


def _within_blocks(blocked: DataFrame, texts: DataFrame, few: bool, parts: int, n: int, t: float, id_type: T.DataType, block: int, count: bool) -> DataFrame:
    """Rows of ``_pairs_of`` for the sets of blocked (id, th, label, weight, size): pairs of one block that reach the
    threshold, or with ``count`` of each set of a task that has such pairs the first of its component in the task and
    the weight of its partners."""
    need_pieces = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / PIECE_GRAMS))
    sizes = blocked.groupBy("label").agg(need_pieces.alias("pieces"))
    cut = blocked.join(sizes, "label").withColumn("piece", F.pmod(F.xxhash64("id", "th"), F.col("pieces")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))
    tasks = cut.withColumn("other", other).select("label", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "id", "th", "piece", "weight")
    tasks = texts.join(F.broadcast(tasks) if few else tasks, ["id", "th"]).select("label", "i", "j", "piece", "id", "th", "weight", "text")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, th, piece = rows.column("id"), rows.column("th"), rows.column("piece").to_numpy()
        weight = rows.column("weight").to_numpy().astype(float)
        of, value = _distinct_grams(rows.column("text"), n)
        at = np.searchsorted(of, np.arange(rows.num_rows + 1))
        size = np.diff(at).astype(float)
        split = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        m = int(np.searchsorted(piece, piece[0], "right"))
        if split and m == rows.num_rows:
            return
        bounds = [(0, m), (m, rows.num_rows)] if split else [(0, rows.num_rows)]
        both = _overlaps([(of[at[a] : at[b]] - a, value[at[a] : at[b]], b - a) for a, b in bounds])
        (a, b), (c, d) = bounds[0], bounds[-1]
        keep = np.zeros(both.shape, bool)
        for k in range(0, b - a, _STRIPE):
            total = size[a + k : min(b, a + k + _STRIPE), None] + size[None, c:d]
            # overlap / (total - overlap) >= t
            keep[k : k + _STRIPE] = both[k : k + _STRIPE] >= t / (1 + t) * total - 1e-9
        if not split:
            np.fill_diagonal(keep, False)
        if count:
            stripes = range(0, len(keep), _STRIPE)  # a product with the whole of keep would make floats of it
            sums = np.concatenate([np.zeros(0), *(keep[k : k + _STRIPE] @ weight[c:d] for k in stripes)])
            if split:
                sums = np.concatenate([sums, sum(weight[a + k : min(b, a + k + _STRIPE)] @ keep[k : k + _STRIPE] for k in stripes)])
            x = np.flatnonzero(sums > 0)
            y, score = _stars(keep, not split)[x], sums[x]
        else:
            x, y = np.nonzero(keep)
            if not split:
                x, y = x[x < y], y[x < y]
            total = size[x + a] + size[y + c]
            score = both[x, y] / (total - both[x, y])
            score = np.floor(score * 1e6 + 0.5) / 1e6
            y = y + c
        x, y = pa.array(x), pa.array(y)
        out = pa.table([ids.take(x), th.take(x), ids.take(y), th.take(y), pa.array(score, pa.float64())], names=[*_KEYS, "value"])
        yield from out.combine_chunks().to_batches(max_chunksize=200_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, []

        def close() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(open_).combine_chunks()
            if group.num_rows > 1:  # repeated rows lie side by side
                again = pc.and_(*(pc.equal(group.column(c).slice(1), group.column(c).slice(0, group.num_rows - 1)) for c in ("id", "th")))
                if pc.any(again).as_py():
                    group = group.filter(pa.chunked_array([pa.array([True]), *pc.invert(again).chunks])).combine_chunks()
            if group.num_rows > 1:
                yield from compare(group)

        for batch in batches:
            label, i, j = (batch.column(c).to_numpy() for c in ("label", "i", "j"))
            if not len(label):
                continue
            new = np.concatenate([[(label[0], i[0], j[0]) != key], (label[1:] != label[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            key = (label[-1], i[-1], j[-1])
            edges = [0, *[e for e in np.flatnonzero(new).tolist() if e], len(label)]
            for a, b in zip(edges, edges[1:]):
                if new[a] and open_:
                    yield from close()
                    open_ = []
                open_.append(batch.slice(a, b - a))
        if open_:
            yield from close()

    return tasks.repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j", "piece", "id", "th").mapInArrow(run, _pairs_of(id_type))


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int, t: float, block: int, labels_sent: int, count: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members (sig, check, id, th), heads (sig, check, id, th, weight: documents of the class), the rows of
    ``_within_blocks``, and the other pairs of heads that reach the threshold, once each."""
    spark = docs.sparkSession
    K.small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema.fields[docs.columns.index(id_col)].dataType
    texts = _keyed(docs, id_col, text_col)
    many = max(1, docs.select(F.col(f"`{id_col}`")).count())
    bits = int(min(_MOST_SKETCH_BITS, max(SKETCH_BITS, 2 + np.ceil(np.log2(many)))))
    rows = profile(texts, n, bits)
    order, sizes, total, squares = _merged_sketch(rows, bits)
    # mean number of sets that a gram occurrence meets, free of the sketch's collisions
    partners = max(0.0, squares - total * total / (1 << bits)) / max(total, 1.0)
    boundary, postings = choose_boundary(sizes, partners, t)
    buckets = max(8, int(postings / _PER_BUCKET))
    # repeated rows go first and by all keys, so that a large class is counted before it is moved
    each = rows.where("block IS NULL").groupBy("sig", "check", "id", "th").agg(F.first("size").alias("size"), F.first("data").alias("data"), F.first("links").alias("links"))
    heads = each.groupBy("sig", "check").agg(F.min(F.struct("id", "th")).alias("own"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("data").alias("data"), F.first("links").alias("links"))
    heads = settle(heads.select("sig", "check", F.col("own.id").alias("id"), F.col("own.th").alias("th"), "weight", "size", "data", "links"))
    labels = settle(_blocks(heads, parts))
    small = heads.select("sig", "check", "id", "th", "weight")
    few = labels.count() <= SMALL_SIDE
    blocked = settle(heads.join(labels, "sig").select("id", "th", "label", "weight", "size"))
    within = _within_blocks(blocked, texts, few, parts, n, t, id_type, block, count)
    if labels.count() <= labels_sent:
        known = labels.toPandas()
        sig, label = known["sig"].to_numpy(np.int64).view(np.uint64), known["label"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(sig)
        posted = _postings(texts, n, t, order, boundary, buckets, (sig[by], np.unique(label, return_inverse=True)[1][by].astype(np.uint64) + np.uint64(1)))
    else:
        by_text = rows.where("block IS NULL").join(labels, "sig").groupBy("id", "th").agg(F.min("label").alias("label"))
        posted = _postings(texts.join(by_text, ["id", "th"], "left"), n, t, order, boundary, buckets, None)
    met = settle(_candidates(posted, t, boundary, buckets, min(buckets, max(parts, buckets // 4))))
    left, right = (small.select(F.shiftrightunsigned("sig", int(_SHORT)).alias(f"sig_{c}"), F.struct("id", "th").alias(f"own_{c}")) for c in "ab")
    named = met.join(left, "sig_a").join(right, "sig_b").where("own_a <> own_b").select(F.least("own_a", "own_b").alias("a"), F.greatest("own_a", "own_b").alias("b")).distinct()
    named = settle(named.select(*(F.col(f"{c}.{k}").alias(f"{k}_{c}") for c in "ab" for k in ("id", "th"))))
    ends = settle(named.select(F.col("id_a").alias("id"), F.col("th_a").alias("th")).union(named.select("id_b", "th_b")).distinct())
    near = texts.join(F.broadcast(ends) if ends.count() <= SMALL_SIDE else ends, ["id", "th"]).dropDuplicates(["id", "th"])
    a, b = (near.select(F.col("id").alias(f"id_{c}"), F.col("th").alias(f"th_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab")
    across = _jaccard(named.join(a, ["id_a", "th_a"]).join(b, ["id_b", "th_b"]), n, t, id_type)
    return each.select("sig", "check", "id", "th"), small, within, across


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, t: float = THRESHOLD, block: int = BLOCK, labels_sent: int = _LABELS_SENT) -> DataFrame:
    """Rows (doc_id_a, doc_id_b, jaccard): every pair of different sets with Jaccard at least t, by the least id of
    each set's class (doc_id_a < doc_id_b), and for each class its least id with each other member at 1.0.

    An id with several texts has with another id the best of their pairs. Rows grow with the square of a group of near
    copies; ``links`` doesn't."""
    members, heads, within, across = _joined(docs, id_col, text_col, n, t, block, labels_sent, False)
    equal = members.join(heads.select("sig", "check", F.col("id").alias("head")), ["sig", "check"]).select(F.col("head").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("value"))
    rows = within.union(across).select("id_a", "id_b", "value").union(equal).where("id_a <> id_b")
    return rows.groupBy(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).agg(F.max("value").alias("jaccard"))


def _linked(docs: DataFrame, id_col: str, text_col: str, n: int, t: float, block: int, labels_sent: int) -> DataFrame:
    """(id, th, head: least (id, th) of the group, links) of every document that has a link."""
    members, heads, within, across = _joined(docs, id_col, text_col, n, t, block, labels_sent, True)
    within, across = settle(within), settle(across)
    weights = heads.select(F.col("id").alias("id_b"), F.col("th").alias("th_b"), F.col("weight").alias("w_b"))
    both = across.select(*_KEYS).union(across.select("id_b", "th_b", "id_a", "th_a"))
    met = both.join(weights, ["id_b", "th_b"]).select("id_a", "th_a", F.col("w_b").cast("double").alias("value"))
    counts = within.select("id_a", "th_a", "value").union(met).groupBy(F.col("id_a").alias("id"), F.col("th_a").alias("th")).agg(F.sum("value").cast("bigint").alias("partners"))
    edges = within.union(across).select(F.struct(F.col("id_a").alias("id"), F.col("th_a").alias("th")).alias("doc_id_a"), F.struct(F.col("id_b").alias("id"), F.col("th_b").alias("th")).alias("doc_id_b"))
    groups = components(edges).select(F.col("id.id").alias("id"), F.col("id.th").alias("th"), "head")
    found = heads.join(counts, ["id", "th"], "left").join(groups, ["id", "th"], "left").where("weight > 1 OR partners > 0")
    found = found.select("sig", "check", F.coalesce("head", F.struct("id", "th")).alias("head"), (F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).alias("links"))
    return members.join(found, ["sig", "check"]).select("id", "th", "head", "links")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, t: float = THRESHOLD, block: int = BLOCK, labels_sent: int = _LABELS_SENT) -> DataFrame:
    """Rows (doc_id, class_id, links), one for every document that has a link: with how many other documents its
    Jaccard is at least t (copies among them), and the least id of its group, closed under such links."""
    out = _linked(docs, id_col, text_col, n, t, block, labels_sent)
    return out.select(F.col("id").alias("doc_id"), F.col("head.id").alias("class_id"), "links")


def oracle(table: str = "documents", n: int = GRAM, t: float = THRESHOLD) -> str:
    """The rows of ``links``."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return rf"""
WITH RECURSIVE split AS (SELECT DISTINCT doc_id, text, list_filter(string_split_regex(text, '[ \t\n\r\v\f]+'), lambda x: x <> '') AS w FROM {table} WHERE doc_id IS NOT NULL),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: {gram}) END)) AS g FROM split WHERE len(w) > 0),
classes AS (SELECT doc_id, g, min(doc_id) OVER (PARTITION BY g) AS head, count(*) OVER (PARTITION BY g) AS weight FROM sets),
flat AS (SELECT doc_id, weight, len(g) AS n, unnest(g) AS gram FROM classes WHERE doc_id = head),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(b.weight) AS weight, count(*) AS both_n, any_value(a.n) + any_value(b.n) AS sum_n
        FROM flat a JOIN flat b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND a.n >= {t} * b.n AND b.n >= {t} * a.n GROUP BY 1, 2),
near AS (SELECT a, b, weight FROM met WHERE both_n / (sum_n - both_n)::DOUBLE >= {t} - 1e-12),
reach AS (SELECT a, a AS b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
least AS (SELECT a, min(b) AS class_id FROM reach GROUP BY 1),
partners AS (SELECT a, sum(weight) AS n FROM near GROUP BY 1)
SELECT c.doc_id, coalesce(l.class_id, c.head) AS class_id, (c.weight - 1 + coalesce(p.n, 0))::BIGINT AS links
FROM classes c LEFT JOIN least l ON c.head = l.a LEFT JOIN partners p ON c.head = p.a WHERE c.weight > 1 OR p.n > 0"""


def components(edges: DataFrame, most_on_driver: int = SMALL_SIDE) -> DataFrame:
    """(id, head) of every id in the edges (doc_id_a, doc_id_b): the least id of its connected component.

    Few edges are merged on the driver; more by rounds of large and small stars, each settled, until they are stable.
    """
    spark = edges.sparkSession
    pairs = settle(edges.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")))
    kind = pairs.schema["a"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("head", kind)])
    if pairs.count() <= most_on_driver:
        parent: dict = {}

        def find(x):  # noqa: ANN001, ANN202
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs.collect():
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        return spark.createDataFrame([(x, find(x)) for x in list(parent)], out)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    links, mark = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settle(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        links = settle(small.distinct())
        # stars don't change any more
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            heads = links.groupBy("a").agg(F.min("b").alias("head"))
            return ids.join(heads, F.col("id") == F.col("a"), "left").select("id", F.coalesce("head", "id").alias("head"))
        mark = now


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, t: float = THRESHOLD) -> DataFrame:
    """(id, th, head) of every document that has a near copy, th a hash of its text: the least (id, th) of its group,
    closed under the join's pairs."""
    return _linked(docs, id_col, text_col, n, t, BLOCK, _LABELS_SENT).select("id", "th", "head")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, t: float = THRESHOLD) -> DataFrame:
    """``docs`` with only the document of least (id, hash of text) of each group, and one row of rows that repeat in all
    columns. A text that isn't like any other stays, whatever else its id holds.

    Documents with a null id, or without words, are kept.
    """
    plain, names = positional(docs), docs.columns
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    gone = settle(groups(plain, key, text, n, t).where("id <> head.id OR th <> head.th").select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")))
    few = gone.count() <= SMALL_SIDE
    left = plain.join(F.broadcast(gone) if few else gone, (F.col(key) == F.col("gone_id")) & (F.xxhash64(text) == F.col("gone_th")), "left_anti")
    again = settle(plain.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("again")).count().where("count > 1").select("again"))
    if not again.isEmpty():
        once = left.join(again, F.col(key) == F.col("again"), "left_anti")
        left = once.unionByName(left.join(again, F.col(key) == F.col("again"), "left_semi").dropDuplicates())
    return left.toDF(*names)
