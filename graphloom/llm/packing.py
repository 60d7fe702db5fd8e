"""Best-fit-decreasing packing of documents into windows of a fixed number of tokens.

A document longer than a window is first cut into full windows and a rest. All rests and shorter documents are then
placed longest first, each in the open window with the least room that still holds it, else in a new one.

Best fit looks only at lengths, and there are at most ``window`` of those. So the placement is computed once for the
histogram of lengths: windows that are alike form a run, a segment tree over remaining capacity finds the tightest
run that holds a length, and a whole group of equal pieces goes into it at once. What comes out is a table of at most
a few times ``window`` runs, whatever the number of documents; each piece finds its place in it by its rank among the
pieces of its length. The placement equals that of the item-by-item algorithm over the whole corpus, with ties in a fixed order.

Defined cases: null and blank texts have no tokens and no window, so no row; ties in length go by a hash of
the document id, the id, then the piece; repeated rows are pieces of their own, packed one by one; an empty table gives no rows; only the id and the
token count are read, so other columns can't clash. A null id is kept and sorts first.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .lineage import settle

WINDOW = 2048
#: Pieces of one length that one task puts in order.
_IN_ORDER = 1 << 20


class CapacityTree:
    """A segment tree over remaining capacities 0..n: the least capacity of at least x that has an open window."""

    def __init__(self, n: int) -> None:
        self.size = 1 << max(1, n).bit_length()
        self.used = [False] * (2 * self.size)

    def set(self, at: int, used: bool) -> None:
        at += self.size
        self.used[at] = used
        while at > 1:
            at >>= 1
            self.used[at] = self.used[2 * at] or self.used[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.used[at]:
            return least
        while at > 1:
            if not at & 1 and self.used[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first window, pieces a window, tokens before in that window), and how many windows.

    The pieces of a length with rank r in a run go to window ``first + (r - first rank) // pieces a window``.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    tree, open_at = CapacityTree(window), defaultdict(list)  # remaining capacity -> sorted runs [first window, count]
    windows = 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            bisect.insort(open_at[room], (first, count))
            tree.set(room, True)

    for length in sorted((x for x, n in histogram.items() if x > 0 and n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, fits = window, window // length
                first, count = windows, -(-left // fits)
                windows += count
            else:
                first, count = open_at[room].pop(0)
                if not open_at[room]:
                    tree.set(room, False)
                fits = room // length
            full = min(count, left // fits)
            if full:
                runs.append((length, rank, first, fits, window - room))
                put(room - fits * length, first, full)
                rank, left = rank + full * fits, left - full * fits
            if full < count and left:
                runs.append((length, rank, first + full, left, window - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, count - full)
    return runs, windows


def pack(docs: DataFrame, id_col: str, tokens: Column, window: int = WINDOW, in_order: int = _IN_ORDER) -> DataFrame:
    """Rows (doc_id, piece, token_start, n_tokens, window_id, window_offset): where each piece of a document lies.

    Shuffles rows of (id, length) once. To the driver come a row a length, and one for each ``in_order`` pieces.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), tokens.cast("bigint").alias("n")).where("n > 0")
    sized = settle(sized)  # read several times; the texts are not
    pieces = sized.select(
        "doc_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {window}")),
                lambda i: F.struct((i * window).alias("start"), F.least(F.lit(window).cast("bigint"), F.col("n") - i * window).alias("length")),
            )
        ).alias("piece", "p"),
    ).select("doc_id", F.col("piece").cast("bigint").alias("piece"), F.col("p.start").alias("token_start"), F.col("p.length").alias("n_tokens"))
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    lengths = spark.createDataFrame([(x, -(-n // in_order)) for x, n in sorted(histogram.items())] or [(0, 1)], "n_tokens bigint, buckets bigint")
    pieces = pieces.join(F.broadcast(lengths), "n_tokens").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    order = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece", "token_start")
    ranked = pieces.withColumn("at", F.row_number().over(order).cast("bigint") - 1)
    before, seen = [], defaultdict(int)
    for length, bucket, n in sorted(map(tuple, pieces.groupBy("n_tokens", "bucket").count().collect())):
        before.append((length, bucket, seen[length]))
        seen[length] += n
    runs, _ = plan(histogram, window)
    by_length: dict[int, list] = defaultdict(list)
    for length, rank, first, fits, used in runs:
        by_length[length].append((rank, first, fits, used))
    base = spark.createDataFrame(before or [(0, 0, 0)], "n_tokens bigint, bucket bigint, base bigint")
    places = spark.createDataFrame(sorted(by_length.items()) or [(0, [])], "n_tokens bigint, runs array<struct<rank:bigint,first:bigint,fits:bigint,used:bigint>>")
    placed = ranked.join(F.broadcast(base), ["n_tokens", "bucket"]).join(F.broadcast(places), "n_tokens").withColumn("rank", F.col("at") + F.col("base"))
    run = F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("rank")), -1)
    placed = placed.withColumn("run", run).withColumn("in_run", F.col("rank") - F.col("run.rank"))
    return placed.select(
        "doc_id", "piece", "token_start", "n_tokens",
        (F.col("run.first") + F.expr("in_run div run.fits")).alias("window_id"),
        (F.col("run.used") + F.col("in_run") % F.col("run.fits") * F.col("n_tokens")).alias("window_offset"),
    )


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str = bpe.VOCABULARY) -> DataFrame:
    """``pack`` by the number of byte-pair ids of each text."""
    return pack(bpe.count(docs, id_col, text_col, path), "doc_id", F.col("n_tokens"), window)
