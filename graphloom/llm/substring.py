"""Passages of at least ``length`` words that occur more than once in a table of texts, by seed and extend.

Seeds: every window of ``length`` words picks its winnowed anchor, the least hash among its runs of ``seed`` words
(the rightmost on ties), so equal windows pick equal anchors at equal places. Documents are joined on anchors; around
every shared anchor the windows that picked it are joined in their turn, and each window that occurs again gets the
first of its occurrences, by (document, place). Extension: each pair of a window and its first occurrence is extended
both ways, word by word, as far as the two documents agree, which gives a maximal repeat of the pair. What a document
shares with another is known by the names of its windows (their first occurrences), so no text is sent for it.

A document's spans are the maximal repeats it has a part in, as the first or as the later side, without those that lie
within another of its spans; spans may overlap. The words of a window that isn't a first occurrence are redundant.

Joins combine on the map side: a task sends a key once and answers its own repeats itself by the first of them, whose
own answer is put in later, so a passage that millions of documents share costs the receiving task one entry a sending
task. Windows travel back as runs. No list is capped. Anchors are compared by 64-bit hashes, windows by 96 bits.

Defined cases: null and blank texts, and texts under ``length`` words, have no spans; repeats within one document
count; rows with a null id are left out (deduplication keeps them as they are); rows that repeat id and text are one
document; texts of one id that differ are documents of their own, in the order of a hash of the text, and each is cut
by its own repeats only; ties cannot occur, as places differ; an empty table gives no rows; other columns are neither
read nor changed, whatever their names. Ids are of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .lineage import positional, settle

LENGTH = 50
SEED = 16
_PLACE = np.uint64((1 << 26) - 1)
_BUCKETS_A_PARTITION = 4
#: Rows that a task combines before it sends them.
_HELD = 4_000_000
#: Windows whose names are compared at once; a pair of documents with more is compared alone.
_NAMES = 500_000
_OTHER = np.uint64(0xA0761D6478BD642F)


def anchors(texts: pa.Array, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of every window of ``length`` words: text index, first word (in its text), index of its anchor; of all runs of
    ``seed`` words the hash; the first word index of each text; and the hashes of all words. Windows index the chunk."""
    h, doc, _, _ = K.word_hashes(texts)
    base = np.searchsorted(doc, np.arange(len(texts)))
    if len(h) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), base, h
    run = K.run_hashes(h, seed)
    least = (run & ~_PLACE) | (_PLACE - np.arange(len(run), dtype=np.uint64))
    span, size = length - seed + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    start = np.flatnonzero(doc[: len(h) - length + 1] == doc[length - 1 :])
    return doc[start], start, (_PLACE - (least[start] & _PLACE)).astype(np.int64), run, base, h


_PLANES = ("<u8", "<u4", "<u4", "<u4", "<u2", "<u2", "u1")
_WIDTH = 25


def _split(key: np.ndarray, check: np.ndarray, doc: np.ndarray, place: np.ndarray, extra: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Entries by bucket of their key, packed by columns."""
    bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    bucket, key, check, doc, place, extra = bucket[by], key[by], check[by], doc[by].view(np.uint64), place[by].astype(np.uint64), extra[by]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.concatenate([first[1:], [len(bucket)]])
    planes = [key, check, doc.astype(np.uint32), (doc >> np.uint64(32)).astype(np.uint32), place.astype(np.uint16), (place >> np.uint64(16)).astype(np.uint16), extra.astype(np.uint8)]
    return bucket[first], [b"".join(p[a:b].tobytes() for p in planes) for a, b in zip(first, ends)]


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    out = [[] for _ in range(5)]
    for data in blobs:
        n, at, planes = len(data) // _WIDTH, 0, []
        for kind in _PLANES:
            planes.append(np.frombuffer(data, kind, n, at))
            at += planes[-1].nbytes
        out[0].append(planes[0])
        out[1].append(planes[1])
        out[2].append((planes[2].astype(np.uint64) | planes[3].astype(np.uint64) << np.uint64(32)).view(np.int64))
        out[3].append(planes[4].astype(np.int64) | planes[5].astype(np.int64) << 16)
        out[4].append(planes[6])
    return tuple(np.concatenate(x) for x in out)


def _resolve(key: np.ndarray, check: np.ndarray, doc: np.ndarray, place: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, ...]:
    """By key, then (document, place): the entries without doubles, whether the key occurs more than once, and the
    index of the first entry of the key. again: that the key is known to occur elsewhere too."""
    by = np.lexsort((place, doc, check, key))
    key, check, doc, place, again = key[by], check[by], doc[by], place[by], again[by].astype(bool)
    if not len(key):
        return key, check, doc, place, again, np.zeros(0, np.int64)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
    fresh = new | np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])
    again = np.logical_or.reduceat(again, np.flatnonzero(fresh))
    key, check, doc, place, new = key[fresh], check[fresh], doc[fresh], place[fresh], new[fresh]
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate([head, [len(key)]]))
    many = (size > 1) | np.logical_or.reduceat(again, head)
    return key, check, doc, place, np.repeat(many, size), np.repeat(head, size)


def _groups(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and end of each run of equal values."""
    if not len(by[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in by])]))
    return first, np.concatenate([first[1:], [len(by[0])]])


def _runs(doc: np.ndarray, place: np.ndarray, to: np.ndarray, there: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(doc, place, to, there, size) of runs in which place and there go up together, by (doc, to, place)."""
    by = np.lexsort((place, to, doc))
    doc, place, to, there = doc[by], place[by], to[by], there[by]
    size = np.ones(len(doc), np.int64) if size is None else size[by]
    if not len(doc):
        return doc, place, to, there, size
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (to[1:] != to[:-1]) | (place[1:] != place[:-1] + size[:-1]) | (there[1:] != there[:-1] + size[:-1])])
    first = np.flatnonzero(new)
    return doc[first], place[first], to[first], there[first], np.add.reduceat(size, first)


_RUN = np.dtype([("place", "<u4"), ("size", "<u4"), ("to", "<i8"), ("there", "<u4")])


def _packed(place: np.ndarray, size: np.ndarray, to: np.ndarray, there: np.ndarray) -> np.ndarray:
    out = np.zeros(len(place), _RUN)
    out["place"], out["size"], out["to"], out["there"] = place, size, to, there
    return out


def _runs_by_doc(doc: np.ndarray, place: np.ndarray, to: np.ndarray, there: np.ndarray, size: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows (doc_id, leader, data) of the runs, one for each document and leader."""
    doc, place, to, there, size = _runs(doc, place, to, there, size)
    data = _packed(place, size, to, there)
    first, end = _groups(doc, to)
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(to[first]), pa.array([data[a:b].tobytes() for a, b in zip(first, end)], pa.binary())], names=["doc_id", "leader", "data"])


def _places_by_doc(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    by = np.argsort(doc, kind="stable")
    doc, place = doc[by], place[by].astype(np.uint32)
    first, end = _groups(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.nulls(len(first), pa.int64()), pa.array([place[a:b].tobytes() for a, b in zip(first, end)], pa.binary())], names=["doc_id", "leader", "data"])


class _Sender:
    """Combines a task's entries: answers repeats within the task, sends each key once."""

    def __init__(self, buckets: int, leaders: bool) -> None:
        self.buckets, self.leaders, self.held, self.n = buckets, leaders, [], 0

    def add(self, key: np.ndarray, check: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((key, check, doc, place))
        self.n += len(key)
        if self.n > _HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        key, check, doc, place = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        key, check, doc, place, many, head = _resolve(key, check, doc, place, np.zeros(len(key), np.uint8))
        first = head == np.arange(len(head))
        known = many & ~first
        at = head[known]
        own = _runs_by_doc(doc[known], place[known], doc[at], place[at]) if self.leaders else _places_by_doc(doc[known], place[known])
        yield pa.RecordBatch.from_arrays([pa.nulls(own.num_rows, pa.int32()), *own.columns], names=["bucket", *own.schema.names])
        bucket, data = _split(key[first], check[first], doc[first], place[first], many[first], self.buckets)
        none = pa.nulls(len(bucket), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bucket), none, none, pa.array(data, pa.binary())], names=["bucket", "doc_id", "leader", "data"])


_ROWS = "bucket int, doc_id long, leader long, data binary"
_BY_DOC = "doc_id long, leader long, data binary"


def _answers(sent: DataFrame, parts: int, leaders: bool) -> DataFrame:
    """Of the sent entries whose key occurs more than once: their places, or runs with the first occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs, out, n = None, [], [], 0

        def settle_bucket() -> None:
            _, _, doc, place, many, head = _resolve(*_joined(blobs))
            out.append((doc[many], place[many], doc[head[many]], place[head[many]]))

        def rows() -> pa.RecordBatch:
            doc, place, to, there = (np.concatenate(x) for x in zip(*out))
            return _runs_by_doc(doc, place, to, there) if leaders else _places_by_doc(doc, place)

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and blobs:
                    settle_bucket()
                    blobs, n = [], n + len(out[-1][0])
                    if n > _HELD:
                        yield rows()
                        out, n = [], 0
                at = bucket
                blobs.append(data)
        if blobs:
            settle_bucket()
        if out:
            yield rows()

    return sent.where("bucket IS NOT NULL").select("bucket", "data").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _BY_DOC)


def _of_lists(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The runs in all lists of blobs in a row, and the list of each."""
    joined = [b"".join(x) for x in lists]
    return np.frombuffer(b"".join(joined), _RUN), np.repeat(np.arange(len(lists)), [len(x) // _RUN.itemsize for x in joined])


def _together(rows: DataFrame) -> DataFrame:
    """(doc_id, runs) of rows (doc_id, data): a document's runs as one, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, of = _of_lists(batch.column("lists").to_pylist())
            by = np.lexsort((r["place"], of))
            r, of = r[by], of[by]
            # runs of one leader that meet are one
            place, size, there = (r[c].astype(np.int64) for c in ("place", "size", "there"))
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (r["to"][1:] != r["to"][:-1]) | (place[1:] != place[:-1] + size[:-1]) | (there[1:] != there[:-1] + size[:-1])])
            first = np.flatnonzero(new)
            r = _packed(place[first], np.add.reduceat(size, first), r["to"][first], there[first])
            edge = np.searchsorted(of[first], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], names=["doc_id", "runs"])

    return rows.groupBy("doc_id").agg(F.collect_list("data").alias("lists")).mapInArrow(run, "doc_id long, runs binary")


def _composed(local: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, data): runs that lead to a task's own first occurrence, led on to where that one's runs lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, of = _of_lists([[x] for x in batch.column("data").to_pylist()])
            theirs, at = _of_lists([[x] for x in batch.column("runs").to_pylist()])
            size = mine["size"].astype(np.int64)
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            place, there = np.repeat(mine["place"].astype(np.int64), size) + step, np.repeat(mine["there"].astype(np.int64), size) + step
            row = np.repeat(of, size)
            where = np.searchsorted(at << 32 | theirs["place"].astype(np.int64), row << 32 | there, "right") - 1
            led = theirs[where]
            doc, place, to, there, size = _runs(row, place, led["to"].astype(np.int64), led["there"].astype(np.int64) + there - led["place"].astype(np.int64))
            data = _packed(place, size, to, there)
            first, end = _groups(doc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[first])), pa.array([data[a:b].tobytes() for a, b in zip(first, end)], pa.binary())], names=["doc_id", "data"])

    return local.join(known.select(F.col("doc_id").alias("leader"), "runs"), "leader").select("doc_id", "data", "runs").mapInArrow(run, "doc_id long, data binary")


def repeated_windows(texts: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, runs) of every document (doc_id, text) with a window of ``length`` words that occurs more than once:
    runs of such windows with their first occurrences (its own, where it is the first)."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * _BUCKETS_A_PARTITION

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, False)
        for batch in batches:
            for part in K.chunks(batch, "text"):
                of, _, anchor, run, base, _ = anchors(part.column("text"), length, seed)
                if not len(of):
                    continue
                fresh = np.concatenate([[True], anchor[1:] != anchor[:-1]])
                of, anchor = of[fresh], anchor[fresh]
                ids = part.column("doc_id").to_numpy()
                yield from sender.add(run[anchor], np.zeros(len(of), np.uint32), ids[of], anchor - base[of])
        yield from sender.flush()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, True)
        for batch in batches:
            for part in K.chunks(batch, "text"):
                of, start, anchor, _, base, h = anchors(part.column("text"), length, seed)
                if not len(of):
                    continue
                shared = np.zeros(len(h) + 1, bool)
                for i, lists in enumerate(part.column("lists").to_pylist()):
                    shared[np.minimum(base[i] + np.frombuffer(b"".join(lists), np.uint32).astype(np.int64), len(h))] = True
                take = shared[anchor]
                of, start = of[take], start[take]
                if not len(of):
                    continue
                ids = part.column("doc_id").to_numpy()
                check = (K.run_hashes(K.mix(h ^ _OTHER), length)[start] >> np.uint64(32)).astype(np.uint32)
                yield from sender.add(K.run_hashes(h, length)[start], check, ids[of], start - base[of])
        yield from sender.flush()

    seeded = settle(texts.mapInArrow(seeds, _ROWS))
    shared = _answers(seeded, parts, False).union(seeded.where("bucket IS NULL").drop("bucket")).groupBy("doc_id").agg(F.collect_list("data").alias("lists"))
    windows = settle(texts.join(shared, "doc_id").select("doc_id", "text", "lists").mapInArrow(extend, _ROWS))
    led = settle(_together(_answers(windows, parts, True).select("doc_id", "data")))
    local = _composed(windows.where("bucket IS NULL").select("doc_id", "leader", "data"), led)
    return settle(_together(led.select("doc_id", F.col("runs").alias("data")).union(local)))


class _Names:
    """The names (first occurrences) of the repeated windows of many documents, and of doubling stretches of them."""

    def __init__(self, runs: np.ndarray, row: np.ndarray) -> None:
        place, size = runs["place"].astype(np.int64), runs["size"].astype(np.int64)
        self.key, self.place, self.size = row << 32 | place, place, size
        # a gap between runs that don't meet is a name of its own
        gap = np.ones(len(runs), bool)
        gap[:-1] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + size[:-1])
        self.at = np.cumsum(size + gap) - size - gap
        n = int(self.at[-1] + size[-1] + 1) if len(runs) else 1
        owner = np.repeat(np.arange(len(runs)), size)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        there = runs["there"].astype(np.int64)[owner] + step
        self.level = [K.mix(np.arange(n, dtype=np.uint64) ^ _OTHER)]
        self.level[0][self.at[owner] + step] = K.join_hashes(K.mix(runs["to"].astype(np.int64).view(np.uint64)[owner]), there.astype(np.uint64))
        longest = int(np.diff(np.flatnonzero(np.concatenate([[True], gap])), prepend=0).max(initial=1)) * int(size.max(initial=1))
        while 2 ** len(self.level) <= min(longest, n):
            half = 2 ** (len(self.level) - 1)
            self.level.append(K.join_hashes(self.level[-1][:-half], self.level[-1][half:]))

    def find(self, row: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Index of the name of the window at x of a row."""
        k = np.searchsorted(self.key, row << 32 | x, "right") - 1
        return self.at[k] + x - self.place[k]

    def common(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many names from x and y on are equal, and how many before them."""
        ahead, behind = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            h, size = self.level[k], 1 << k
            a, b = x + ahead, y + ahead
            ok = np.maximum(a, b) < len(h)
            ok[ok] = h[a[ok]] == h[b[ok]]
            ahead += size * ok
            a, b = x - behind - size, y - behind - size
            ok = np.minimum(a, b) >= 0
            ok[ok] = h[a[ok]] == h[b[ok]]
            behind += size * ok
        return ahead, behind


def _widest(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (group, a, b), once each, that don't lie within another of their group."""
    x = np.unique(np.stack([group, a, -b], 1), axis=0)
    group, a, b = x[:, 0], x[:, 1], -x[:, 2]
    _, rank = np.unique(group, return_inverse=True)
    reach = np.maximum.accumulate((rank << 40) + b)
    keep = np.ones(len(x), bool)
    keep[1:] = (rank[1:] << 40) + b[1:] > reach[:-1]
    return np.stack([group, a, b], 1)[keep]


def _extended(doc: np.ndarray, leader: np.ndarray, mine: list[bytes], theirs: list[bytes], length: int) -> np.ndarray:
    """Rows (document, start, end): both sides of the maximal repeats of documents with their leaders, but for those
    within another of the same pair."""
    n = len(doc)
    runs, row = _of_lists([[x] for x in [*mine, *theirs]])
    names = _Names(runs, row)
    seed = np.flatnonzero((row < n) & (runs["to"] == leader[np.minimum(row, n - 1)]))
    place, there, row = names.place[seed], runs["there"][seed].astype(np.int64), row[seed]
    apart = (doc[row] != leader[row]) | (place != there)
    place, there, row = place[apart], there[apart], row[apart]
    ahead, behind = names.common(names.find(row, place), names.find(row + n, there))
    a, b, off = place - behind, place + ahead - 1 + length, there - place
    own, other = _widest(row, a, b), _widest(row, a + off, b + off)
    out = np.concatenate([own, other])
    out[:, 0] = np.concatenate([doc[own[:, 0]], leader[other[:, 0]]])
    return out


def _spans(windows: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, end): both sides of every maximal repeat, once each."""

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row, to = batch.column("doc_id").to_pylist(), [], []
            for i, data in enumerate(batch.column("runs").to_pylist()):
                r = np.frombuffer(data, _RUN)
                found = np.unique(r["to"][(r["to"] != ids[i]) | (r["there"] != r["place"])]).tolist()
                row += [i] * len(found)
                to += found
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in batch.columns), pa.array(to, pa.int64())], names=["doc_id", "runs", "leader"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, leader = (batch.column(c).to_numpy() for c in ("doc_id", "leader"))
            mine, theirs = (batch.column(c).to_pylist() for c in ("runs", "theirs"))
            weight = np.cumsum([int(np.frombuffer(x, _RUN)["size"].sum()) + int(np.frombuffer(y, _RUN)["size"].sum()) for x, y in zip(mine, theirs)])
            at = 0
            while at < len(doc):
                to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + _NAMES, "right")))
                x = _extended(doc[at:to], leader[at:to], mine[at:to], theirs[at:to], length)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(3)], names=["doc_id", "start", "end"])
                at = to

    pairs = windows.mapInArrow(leaders, "doc_id long, runs binary, leader long")
    both = pairs.join(windows.select(F.col("doc_id").alias("leader"), F.col("runs").alias("theirs")), "leader")
    return both.mapInArrow(extend, "doc_id long, start long, end long").distinct()


def _later(runs: np.ndarray, doc: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the redundant stretches of words: windows that aren't first occurrences, put together."""
    r = runs[(runs["to"] != doc) | (runs["there"] != runs["place"])]
    begin = r["place"].astype(np.int64)
    end = begin + r["size"].astype(np.int64) - 1 + length
    if not len(begin):
        return begin, end
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > np.maximum.accumulate(end)[:-1]]))
    return begin[first], np.maximum.reduceat(end, first)


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with a whole number for each document, in their order; and the table (doc_id, id, th) of what they
    stand for, or None where ids are whole numbers of one text each, which then stand for themselves."""
    id_type = docs.schema.fields[docs.columns.index(id_col)].dataType
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL")
    hashed = texts.select("id", F.xxhash64("text").alias("th"))
    if isinstance(id_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        if hashed.groupBy("id").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo <> hi").isEmpty():
            return texts.select(F.col("id").cast("bigint").alias("doc_id"), "text"), None
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of a sorted table are numbered in order
    names = settle(hashed.distinct().repartitionByRange(parts, "id", "th").sortWithinPartitions("id", "th").select(F.monotonically_increasing_id().alias("doc_id"), "id", "th"))
    return texts.withColumn("th", F.xxhash64("text")).join(names, ["id", "th"]).select("doc_id", "text"), names


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, start_word, end_word, n_words, redundant_words): the spans of every document."""
    texts, names = _named(docs, id_col, text_col)
    windows = repeated_windows(texts, length, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((0, 5), np.int64)]
            for doc, data, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "runs", "spans"))):
                x = np.array([(doc, s["start"], s["end"]) for s in spans], np.int64)
                x = _widest(*x.T)[:, 1:]
                begin, end = _later(np.frombuffer(data, _RUN), doc, length)
                total = np.concatenate([[0], np.cumsum(end - begin)])

                def words(at: np.ndarray) -> np.ndarray:
                    """Redundant words before a place."""
                    k = np.searchsorted(begin, at, "right")
                    return total[k] - np.where(k > 0, np.maximum(end[np.maximum(k, 1) - 1] - at, 0), 0) if len(begin) else np.zeros(len(at), np.int64)

                out.append(np.stack([np.full(len(x), doc), x[:, 0], x[:, 1], x[:, 1] - x[:, 0], words(x[:, 1]) - words(x[:, 0])], 1))
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(5)], names=["doc_id", "start_word", "end_word", "n_words", "redundant_words"])

    spans = _spans(windows, length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = windows.join(spans, "doc_id").mapInArrow(run, "doc_id long, start_word long, end_word long, n_words long, redundant_words long")
    if names is None:
        return found
    return found.join(names, "doc_id").select(F.col("id").alias("doc_id"), "start_word", "end_word", "n_words", "redundant_words")


def cut(text: str | None, begin: np.ndarray, end: np.ndarray) -> str | None:
    """A text without the stretches of words [begin, end), each cut up to the next word left."""
    if text is None or not len(begin):
        return text
    data = text.encode()
    starts, _, _ = K.words(np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]), np.array([0, len(data)]))
    out, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist()):
        if a >= len(starts):
            break
        out.append(data[at : starts[a]])
        at = starts[b] if b < len(starts) else len(data)
    out.append(data[at:])
    return b"".join(out).decode()


def _without_repeats(batch: pa.RecordBatch, at: int, length: int) -> Iterator[pa.RecordBatch]:
    """Rows whose last columns are ``doc`` and ``runs``, without these two and with the texts in column ``at`` cut, a
    chunk of texts at a time."""
    for part in K.chunks(batch, batch.schema.names[at]):
        texts, keep = part.column(at).to_pylist(), []
        for i, (doc, data) in enumerate(zip(part.column("doc").to_pylist(), part.column("runs").to_pylist())):
            if data is not None:
                begin, end = _later(np.frombuffer(data, _RUN), doc, length)
                if len(begin):
                    texts[i] = cut(texts[i], begin, end)
                    if not (texts[i] or "").strip(" \t\n\r\x0b\x0c"):
                        continue
            keep.append(i)
        columns = list(part.columns[:-2])
        columns[at] = pa.array(texts, columns[at].type)
        yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-2]).take(pa.array(keep, pa.int64()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with the redundant words of every text cut out; a text of which nothing is left goes.

    Other columns are kept as they are. Rows with a null id, and texts without repeats, are untouched.
    """
    plain = positional(docs)
    key, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    texts, names = _named(plain, key, text)
    later = repeated_windows(texts, length, seed).select(F.col("doc_id").alias("doc"), "runs")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _without_repeats(batch, at, length)

    if names is None:
        joined = plain.join(later, F.col(key).cast("bigint") == F.col("doc"), "left")
    else:
        later = later.join(names, F.col("doc") == F.col("doc_id")).select("doc", "runs", "id", "th")
        joined = plain.join(later, (F.col(key) == F.col("id")) & (F.xxhash64(text) == F.col("th")), "left")
    return joined.select(*plain.columns, "doc", "runs").mapInArrow(run, plain.schema).toDF(*docs.columns)


def oracle(table: str = "documents", length: int = LENGTH) -> str:
    """The rows of ``repeats``, where ids are whole numbers of one text each."""
    return rf"""
WITH split AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\v\f]+'), lambda x: x <> '') AS w FROM {table} WHERE doc_id IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(0, len(w) - {length - 1})) AS s FROM split WHERE len(w) >= {length}),
win AS (SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + {length}], ' ')) AS h FROM places),
led AS (SELECT doc_id, s, h, count(*) OVER (PARTITION BY h) AS n, first_value(doc_id) OVER o AS to_doc, first_value(s) OVER o AS to_s FROM win WINDOW o AS (PARTITION BY h ORDER BY doc_id, s)),
rep AS (SELECT doc_id, s, h, to_doc, to_s, to_doc <> doc_id OR to_s <> s AS later FROM led WHERE n > 1),
pairs AS (SELECT DISTINCT doc_id, to_doc, to_s - s AS off FROM rep WHERE later),
met AS (SELECT p.doc_id, p.to_doc, p.off, a.s, a.to_doc = p.to_doc AND a.to_s - a.s = p.off AS seed FROM pairs p JOIN rep a ON a.doc_id = p.doc_id JOIN rep b ON b.doc_id = p.to_doc AND b.s = a.s + p.off AND b.h = a.h),
island AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, to_doc, off ORDER BY s) AS g FROM met),
repeat AS (SELECT doc_id, to_doc, off, min(s) AS a, max(s) + {length} AS b FROM island GROUP BY doc_id, to_doc, off, g HAVING bool_or(seed)),
span AS (SELECT doc_id, a, b FROM repeat UNION SELECT to_doc, a + off, b + off FROM repeat),
widest AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM span),
maximal AS (SELECT doc_id, a, b FROM widest WHERE before IS NULL OR before < b),
steps AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {length} THEN 0 ELSE 1 END AS new FROM rep WHERE later),
stretch AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM steps),
gone AS (SELECT doc_id, min(s) AS x, max(s) + {length} AS y FROM stretch GROUP BY doc_id, g)
SELECT m.doc_id, a AS start_word, b AS end_word, b - a AS n_words, sum(CASE WHEN y IS NULL THEN 0 ELSE greatest(0, least(y, b) - greatest(x, a)) END)::BIGINT AS redundant_words
FROM maximal m LEFT JOIN gone g ON g.doc_id = m.doc_id GROUP BY m.doc_id, a, b"""
