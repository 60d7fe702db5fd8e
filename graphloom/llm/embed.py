"""Near duplicates among embeddings by product quantisation.

Vectors are scaled to length 1; equal ones form a class, and one vector of each class is searched. A coarse quantiser
puts each in the inverted list of its nearest centroid; what is left of it is cut into subspaces and stored as one code
for each, with the length of the error. Both codebooks are fitted by Lloyd rounds on a sample, chosen by a hash, of about
``FIT_ROWS`` vectors for each list; there are about as many lists as the square root of the number of classes.

Each vector is also a query. It visits its own list and those after it that are close enough for a vector within the
threshold to lie there: for the nearest centroid n and another c, the vector's distances to them differ, squared, by no
more than ``PROBE_Z`` standard deviations of what an offset of threshold length can change along n - c, given the
effective dimension of the data. In a list, a query's tables of the distances to all codewords are summed over the codes
(asymmetric distances); entries within the threshold plus their own error, so all true ones, are compared by exact
cosine. Only the choice of lists is approximate. A list of more than ``PIECE`` entries is cut into pieces, each searched
by a task of its own; a query goes to all of them.

A task counts the pairs it finds and joins them, and hands on a row a vector; no group is written out as pairs.

Defined cases: null vectors, vectors with nulls, NaN or infinities, of no length, or of a dimension other than the most
common one (the greater on a tie) are nobody's duplicates; rows with a null id are left out; rows that repeat id and
vector are one vector, and vectors of one id that differ are each their own; ties at the threshold count; fewer than two
vectors give no rows; only id and vector are read, so other columns can't clash, and names may hold dots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import settle
from .ngram_join import components

THRESHOLD = 0.9
PROBE_Z = 2.0
SUBSPACES = 16
#: Vectors a list that the codebooks are fitted on, entries of a piece, codes of a subspace, Lloyd rounds.
FIT_ROWS, PIECE, _CODES, _ROUNDS = 64, 16384, 64, 5
_AT_ONCE = 2 << 20


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as float32, and the rows they are of."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim), np.arange(len(column))
    length = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dim)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((flat * flat).sum(1))
        ok = np.isfinite(norm) & (norm > 0)
        return (flat[ok] / norm[ok, None]).astype(np.float32), rows[ok]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of c."""
    d = x @ c.T
    d *= -2
    d += (c * c).sum(1)
    d += (x * x).sum(1)[:, None]
    return np.maximum(d, 0, out=d)


def _coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the rows of x in each subspace (books: subspaces, codes, width), and the squared distance to them."""
    m, _, width = books.shape
    code, error = np.zeros((len(x), m), np.uint8), np.zeros(len(x), np.float32)
    for i in range(m):
        d = _distances(x[:, i * width : (i + 1) * width], books[i])
        code[:, i] = d.argmin(1)
        error += d[np.arange(len(x)), code[:, i]]
    return code, error


def _lloyd(df: DataFrame, books: np.ndarray, coarse: np.ndarray | None, dim: int) -> np.ndarray:
    """One round over all rows for each codebook books[s] (codes by width) of its slice of the vectors."""
    shared = df.sparkSession.sparkContext.broadcast((books, coarse))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, coarse = shared.value
        s, k, width = books.shape
        total, count = np.zeros((s, k, width)), np.zeros((s, k))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x, _ = _matrix(batch.column("v").slice(at, 4096), dim)
                if coarse is not None:
                    x = x - coarse[_distances(x, coarse).argmin(1)]
                for i in range(s):
                    part = x[:, i * width : (i + 1) * width]
                    code = _distances(part, books[i]).argmin(1)
                    by = np.argsort(code, kind="stable")
                    first = np.flatnonzero(np.diff(code[by], prepend=-1))
                    used = code[by][first]
                    count[i] += np.bincount(code, minlength=k)
                    total[i, used] += np.add.reduceat(part[by].astype(float), first)
        if count.any():
            yield pa.RecordBatch.from_pydict({"s": pa.array(range(s), pa.int32()), "data": pa.array([np.concatenate([total[i].ravel(), count[i]]).tobytes() for i in range(s)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        data = sum(np.frombuffer(b) for b in table.column("data").to_pylist())
        return pa.table({"s": table.column("s").slice(0, 1), "data": pa.array([data.tobytes()], pa.binary())})

    out = books.copy()
    for r in df.select("v").mapInArrow(run, "s int, data binary").groupBy("s").applyInArrow(add, "s int, data binary").collect():
        data = np.frombuffer(bytes(r["data"]))
        k, width = books.shape[1:]
        total, count = data[: k * width].reshape(k, width), data[k * width :]
        used = count > 0
        out[r["s"]][used] = (total[used] / count[used, None]).astype(np.float32)
        # a code without vectors starts anew beside the fullest ones
        empty, full = np.flatnonzero(~used), np.argsort(-count)
        for e, f in zip(empty, np.resize(full[: max(1, used.sum() // 2)], len(empty))):
            out[r["s"]][e] = out[r["s"]][f] * np.float32(1 + 1e-3) + np.float32(1e-4)
    return out


class _Piece:
    """The entries of a piece of a list: what they have been found to match, and their components."""

    def __init__(self, centroid: np.ndarray, books: np.ndarray, reach: float, t: float, parts: list[tuple]) -> None:
        self.centroid, self.books, self.t = centroid, books, t
        self.keys = pa.concat_arrays([p[0] for p in parts])
        self.x, self.weight, self.code, error = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
        self.code = np.ascontiguousarray(self.code.T)
        self.most = (reach + error + np.float32(1e-3)) ** 2
        self.count, self.head = np.zeros(len(self.x)), np.arange(len(self.x))

    def matches(self, q: np.ndarray, first: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Entries and rows of q whose cosine reaches the threshold; with ``first``, q are the entries from there on and
        only pairs with an earlier entry count."""
        m, _, width = self.books.shape
        rest = q - self.centroid
        tables = np.matmul(self.books, rest.reshape(len(q), m, width).transpose(1, 2, 0))
        tables *= -2
        tables += (self.books * self.books).sum(2)[:, :, None]
        near = self.most[:, None] - (rest * rest).sum(1)[None, :]
        for i in range(m):
            near -= tables[i].take(self.code[i], axis=0)
        a, b = np.nonzero(near >= 0)
        if first is not None:
            a, b = a[a < b + first], b[a < b + first]
        if len(a) * 16 > near.size:
            hit = (self.x.astype(float) @ q.astype(float).T)[a, b] >= self.t - 1e-7
        else:
            hit = np.zeros(len(a), bool)
            for k in range(0, len(a), 1 << 16):
                hit[k : k + (1 << 16)] = np.einsum("ij,ij->i", self.x[a[k : k + (1 << 16)]].astype(float), q[b[k : k + (1 << 16)]].astype(float)) >= self.t - 1e-7
        return a[hit], b[hit]

    def step(self) -> int:
        return max(1, _AT_ONCE // max(1, len(self.x)))

    def own(self) -> None:
        """Pairs among the entries."""
        for k in range(0, len(self.x), self.step()):
            a, b = self.matches(self.x[k : k + self.step()], k)
            b = b + k
            self.count += np.bincount(a, self.weight[b], len(self.x)) + np.bincount(b, self.weight[a], len(self.x))
            while True:
                x, y = self.head[a], self.head[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(self.head, np.maximum(x, y), np.minimum(x, y))
                while (self.head[self.head] != self.head).any():
                    self.head = self.head[self.head]

    def asked(self, keys: pa.Array, q: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, n) of queries: for each component that a query meets one, the first with its matches' weight."""
        for k in range(0, len(q), self.step()):
            a, b = self.matches(q[k : k + self.step()], None)
            if not len(a):
                continue
            self.count += np.bincount(a, weight[k : k + self.step()][b], len(self.x))
            total = np.bincount(b, self.weight[a], len(q[k : k + self.step()]))
            met = np.unique(np.stack([b, self.head[a]], 1), axis=0)
            once = np.diff(met[:, 0], prepend=-1) > 0
            yield _row(keys.take(pa.array(met[:, 0] + k)), self.keys.take(pa.array(met[:, 1])), np.where(once, total[met[:, 0]], 0.0))

    def rows(self) -> pa.RecordBatch:
        """Rows (a, b, n) of the entries that matched."""
        at = np.flatnonzero(self.count > 0)
        return _row(self.keys.take(pa.array(at)), self.keys.take(pa.array(self.head[at])), self.count[at])


def _row(a: pa.Array, b: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a, b, pa.array(n, pa.float64())], names=["a", "b", "n"])


def near_links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", t: float = THRESHOLD, z: float = PROBE_Z, piece: int = PIECE) -> DataFrame:
    """Rows (id_col, class_id, links), one for every vector that has a link: with how many others its cosine reaches t
    (equal ones among them), and the least id of its group, closed under such links."""
    spark = df.sparkSession
    id_type = df.schema.fields[df.columns.index(id_col)].dataType
    out_schema = T.StructType([T.StructField("id", id_type), T.StructField("class_id", id_type), T.StructField("links", T.LongType())])
    nothing = lambda: spark.createDataFrame([], out_schema).withColumnRenamed("id", id_col)
    raw = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    dims = raw.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).take(1)
    if not dims or dims[0]["d"] < 1:
        return nothing()
    dim = dims[0]["d"]

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch.column("v"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"])

    units = settle(raw.mapInArrow(unit, T.StructType([T.StructField("id", id_type), T.StructField("v", T.BinaryType())])).select("id", F.md5("v").alias("key"), "v"))
    members = units.select("key", "id").distinct()
    classes = settle(members.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    nodes = settle(units.groupBy("key").agg(F.first("v").alias("v")).join(classes, "key").select("key", "v", "weight"))
    n = classes.count()
    if not n:
        return nothing()
    lists = int(max(1, 2 ** round(np.log2(np.sqrt(n)))))
    codes = int(min(_CODES, max(1, n // 8)))
    m = next(s for s in range(min(SUBSPACES, dim), 0, -1) if dim % s == 0)
    every = max(1, n // max(FIT_ROWS * lists, 4 * codes))
    sample = settle(nodes.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key", "v"))
    sample = nodes if sample.isEmpty() else sample
    # the codebooks start from as many rows in the order of a hash
    seeds = np.stack([np.frombuffer(bytes(r["v"]), np.float32) for r in sample.orderBy(F.xxhash64("key"), "key").limit(max(lists, codes)).select("v").collect()])
    coarse = np.resize(seeds[:lists], (lists, dim))[None].copy()
    for _ in range(_ROUNDS):
        coarse = _lloyd(sample, coarse, None, dim)
    coarse = coarse[0]
    start = seeds[:codes] - coarse[_distances(seeds[:codes], coarse).argmin(1)]
    books = np.stack([np.resize(start[:, i * (dim // m) : (i + 1) * (dim // m)], (codes, dim // m)) for i in range(m)]).astype(np.float32)
    for _ in range(_ROUNDS):
        books = _lloyd(sample, books, coarse, dim)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, rows = np.zeros((dim, dim)), 0
        for batch in batches:
            x, _ = _matrix(batch.column("v"), dim)
            second, rows = second + x.T.astype(float) @ x, rows + len(x)
        yield pa.RecordBatch.from_pydict({"s": pa.array([0], pa.int32()), "data": pa.array([np.append(second, rows).tobytes()], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        return pa.table({"s": table.column("s").slice(0, 1), "data": pa.array([sum(np.frombuffer(b) for b in table.column("data").to_pylist()).tobytes()], pa.binary())})

    second = np.frombuffer(bytes(sample.select("v").mapInArrow(spread, "s int, data binary").groupBy("s").applyInArrow(total, "s int, data binary").first()["data"]))
    second = second[:-1].reshape(dim, dim) / max(second[-1], 1)
    effective = float(np.trace(second) ** 2 / (second * second).sum())
    reach = float(np.sqrt(max(0.0, 2 - 2 * t)))
    shared = spark.sparkContext.broadcast((coarse, books, z * 2 * reach / np.sqrt(effective)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books, margin = shared.value
        for batch in batches:
            step = max(16, min(4096, (1 << 22) // len(coarse)))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                x, _ = _matrix(part.column("v"), dim)
                d = _distances(x, coarse)
                own = d.argmin(1)
                code, error = _coded(x - coarse[own], books)
                d -= d[np.arange(len(x)), own][:, None]
                visits = (d <= margin * np.sqrt(_distances(coarse[own], coarse))) & (np.arange(len(coarse)) > own[:, None])
                q, at = np.nonzero(visits)
                offsets = pa.array(np.searchsorted(q, np.arange(len(x) + 1)), pa.int32())
                blob = np.concatenate([code, np.sqrt(error).astype(np.float32)[:, None].view(np.uint8)], 1)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("v"), part.column("weight"), pa.array(own, pa.int32()), pa.array([r.tobytes() for r in blob], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32()))], names=["key", "v", "weight", "list", "code", "visits"])

    placed = settle(nodes.mapInArrow(route, "key string, v binary, weight long, list int, code binary, visits array<int>"))
    # as many rows as there are lists
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    pieces = F.broadcast(spark.createDataFrame([(i, -(-c // piece)) for i, c in sorted(counts.items())], "list int, pieces long"))
    own = placed.join(pieces, "list").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")))
    entries = own.select("list", "piece", F.lit(0).alias("kind"), "key", "v", "weight", "code")
    none = F.lit(None).cast("binary").alias("code")
    later = own.where("piece + 1 < pieces").select("list", F.explode(F.sequence(F.col("piece") + 1, F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("kind"), "key", "v", "weight", none)
    away = placed.select(F.explode("visits").alias("list"), "key", "v", "weight").join(pieces, "list")
    away = away.select("list", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("kind"), "key", "v", "weight", none)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books, _ = shared.value
        now, held, open_ = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in ("list", "piece", "kind")], 1)
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:]):
                part, key = batch.slice(a, b - a), (int(at[a, 0]), int(at[a, 1]))
                if key != now:
                    if held:
                        open_ = _Piece(coarse[now[0]], books, reach, t, held)
                        open_.own()
                    if open_:
                        yield open_.rows()
                    now, held, open_ = key, [], None
                x, _ = _matrix(part.column("v"), dim)
                weight = part.column("weight").to_numpy().astype(float)
                if at[a, 2] == 0:
                    blob = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
                    held.append((part.column("key"), x, weight, blob[:, :-4], blob[:, -4:].copy().view(np.float32)[:, 0]))
                    continue
                if held:
                    open_, held = _Piece(coarse[now[0]], books, reach, t, held), []
                    open_.own()
                if open_:  # else a query of a piece without entries
                    yield from open_.asked(part.column("key"), x, weight)
        if held:
            open_ = _Piece(coarse[now[0]], books, reach, t, held)
            open_.own()
        if open_:
            yield open_.rows()

    parts = int(min(sum(-(-c // piece) for c in counts.values()), max(int(spark.conf.get("spark.sql.shuffle.partitions")), lists // 64)))
    found = entries.union(later).union(away).repartition(parts, "list", "piece").sortWithinPartitions("list", "piece", "kind").mapInArrow(search, "a string, b string, n double")
    found = settle(found)
    partners = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").cast("bigint").alias("partners"))
    heads = components(found.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))).select(F.col("id").alias("key"), "head")
    grouped = classes.join(partners, "key", "left").join(heads, "key", "left").where("weight > 1 OR partners > 0").withColumn("head", F.coalesce("head", "key"))
    least = grouped.groupBy("head").agg(F.min("id").alias("class_id"))
    info = grouped.join(least, "head").select("key", "class_id", (F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).alias("links"))
    return members.join(info, "key").select(F.col("id").alias(id_col), "class_id", "links")


def with_copies(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the rows, and for each two more: one stretched and changed a little, one changed by more."""
    row = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    turned = lambda by, k: row.select((F.col("vec_id") + F.lit(k * 10**9)).alias("vec_id"), F.transform("embedding", lambda x, i: x * 2 + (F.pmod(i + F.col("vec_id"), F.lit(3)) - 1) * F.lit(by)).alias("embedding"))
    return row.union(turned(0.01, 1)).union(turned(0.06, 2))


def oracle(table: str = "embeddings", t: float = THRESHOLD) -> str:
    """The rows of ``near_links``."""
    return f"""
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM {table} WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {t} - 1e-7),
reach AS (SELECT a, a AS b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
least AS (SELECT a, min(b) AS class_id FROM reach GROUP BY 1)
SELECT a AS vec_id, any_value(class_id) AS class_id, count(*)::BIGINT AS links FROM near JOIN least USING (a) GROUP BY 1"""


#: ``with_copies`` over embeddings.
COPIES = "(" + " UNION ALL ".join(
    ["SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings"]
    + [f"SELECT vec_id + {k * 10**9}, list_transform(embedding::DOUBLE[], lambda x, i: x * 2 + ((i - 1 + vec_id) % 3 - 1) * {by}) FROM embeddings" for k, by in ((1, 0.01), (2, 0.06))]
) + ")"
