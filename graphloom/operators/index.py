"""An inverted index of texts, built once and read by many rankings.

Postings (term, document, frequency, length) lie in folders by a hash of the term, sorted by term within files, so a
query reads a few folders and, in them, the row groups that hold its terms. A frequent term's postings are spread over
several files by a hash of the document. The vocabulary has a row a term, the documents a row each with length and norm.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from graphloom.functions import text as X
from graphloom.functions.rows import small_batches
from graphloom.operators.lineage import written
from graphloom.operators.terms import BROADCAST_ROWS, _by_score, counted, idf, saturated, small, terms_of, tokenised, within_edits

BUCKETS = 32
_SPREAD = 4
#: Entries of the matrix of a batch of queries, beyond which postings are joined instead, and of a block of documents.
_MATRIX, _BLOCK = 8_000_000, 2_000_000


@dataclass
class TermIndex:
    """``postings`` (bucket, term, doc_id, tf, len), ``vocabulary`` (term, df, frequency), ``counts`` (doc_id, len, terms,
    ns), and ``documents`` (doc_id, len, norm), which are made when they are first asked for."""

    postings: DataFrame
    vocabulary: DataFrame
    counts: DataFrame
    n: int
    average: float

    @cached_property
    def documents(self) -> DataFrame:
        weight = F.col("tf") * (F.log((F.lit(self.n) + 1) / (F.col("df") + 1)) + 1)
        squares = self.postings.join(self.vocabulary.select("term", "df"), "term").groupBy("doc_id").agg(F.first("len").alias("len"), F.sqrt(F.sum(weight * weight)).alias("norm"))
        blank = self.counts.where("len = 0").select("doc_id", "len", F.lit(0.0).alias("norm"))
        return written(squares.unionByName(blank))

    def _of(self, terms: list[str]) -> DataFrame:
        """Postings of some terms."""
        asked = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        return self.postings.where(F.col("bucket").isin(asked) & F.col("term").isin(terms))

    def _df(self, terms: list[str]) -> dict[str, int]:
        return {r["term"]: r["df"] for r in self.vocabulary.where(F.col("term").isin(terms)).collect()}

    def bm25(self, query: str, k: int | None = 10, fuzzy: int = 0, min_length: int = 4) -> DataFrame:
        """(doc_id, score) of the k best documents, as ``terms.bm25`` without candidates gives."""
        if k is not None and k <= 0:
            raise ValueError("k must be positive")
        asked = terms_of(query)
        none = self.counts.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        if not asked:
            return none
        n, average = F.lit(float(self.n)), F.lit(self.average)
        if not fuzzy:
            df = self._df(asked)
            if not df:
                return none
            weight = reduce(lambda c, t: c.when(F.col("term") == t, idf(n, F.lit(float(df[t])))), list(df)[1:], F.when(F.col("term") == next(iter(df)), idf(n, F.lit(float(next(iter(df.values())))))))
            hits = self._of(list(df)).select("doc_id", (weight * saturated(F.col("tf").cast("double"), F.col("len"), average)).alias("s"))
            return _by_score(hits.groupBy("doc_id").agg(F.sum("s").alias("score")), k, "doc_id")
        near = within_edits(self.vocabulary.select("term"), [t for t in asked if len(t) >= min_length], fuzzy, min_length).select("query_term", "term", "distance")
        short = [(t, t, 0) for t in asked if len(t) < min_length]
        if short:
            near = near.unionByName(self.vocabulary.sparkSession.createDataFrame(short, "query_term string, term string, distance bigint"))
        near = written(near)  # the vocabulary is compared once
        if near.count() <= BROADCAST_ROWS:
            names = [r["term"] for r in near.select("term").distinct().collect()]
            hits = self._of(names).join(F.broadcast(near), "term") if names else self.postings.limit(0).join(near, "term")
        else:
            hits = self.postings.join(near, "term")
        share = F.greatest(F.lit(0.0), 1 - F.col("distance") / F.length("query_term"))
        # of the terms of a document those at the least distance count
        levels = [F.sum(F.when(F.col("distance") == d, F.col("tf") * (F.lit(1.0) if d == 0 else share))) for d in range(fuzzy + 1)]
        found = written(hits.groupBy("doc_id", "query_term").agg(F.coalesce(*levels).alias("tf"), F.first("len").alias("len")).where("tf > 0"))
        df = found.groupBy("query_term").agg(F.count("*").cast("double").alias("df"))
        scored = found.join(F.broadcast(df), "query_term").select("doc_id", (idf(n, F.col("df")) * saturated(F.col("tf"), F.col("len"), average)).alias("s"))  # a row a query term
        return _by_score(scored.groupBy("doc_id").agg(F.sum("s").alias("score")), k, "doc_id")

    def bm25_batch(self, queries: DataFrame, k: int = 10, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
        """(query_id, doc_id, score, rank) of the k best documents for every row of ``queries``."""
        wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col(query_text)))).alias("term"))
        weighed = wanted.join(self.vocabulary.select("term", "df"), "term").select("query_id", "term", idf(F.lit(float(self.n)), F.col("df").cast("double")).alias("w"))
        weighed = written(weighed)
        shape = weighed.agg(F.count("*"), F.count_distinct("query_id") * F.count_distinct("term")).first()
        if shape[0] and shape[0] <= BROADCAST_ROWS and shape[1] <= _MATRIX:
            scored = self._products(weighed.toArrow(), k)
        else:
            score = F.col("w") * saturated(F.col("tf").cast("double"), F.col("len"), F.lit(self.average))
            scored = self.postings.join(small(weighed), "term").groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))
        scored = scored.withColumn("score", F.round("score", 6)).where("score > 0")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)

    def _products(self, weighed: pa.Table, k: int) -> DataFrame:
        """(query_id, doc_id, score): of every query the documents that may be among its k best, by products of blocks of
        documents' frequencies with the queries' weights. A task hands on what reaches its own k best so far."""
        queries = weighed.column("query_id").combine_chunks().dictionary_encode()
        terms = weighed.column("term").combine_chunks().dictionary_encode()
        weight = np.zeros((len(terms.dictionary), len(queries.dictionary)))
        weight[terms.indices.to_numpy(), queries.indices.to_numpy()] = weighed.column("w").to_numpy()
        spark, average = self.counts.sparkSession, self.average
        small_batches(spark)
        shared = spark.sparkContext.broadcast((weight, terms.dictionary, queries.dictionary))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, known, names = shared.value
            best = np.zeros((k, weight.shape[1]))
            step = max(16, _BLOCK // max(weight.shape))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    size = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False)
                    place = pc.index_in(part.column("terms").flatten(), value_set=known)
                    hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(part.num_rows), size)[hit]
                    tf, length = part.column("ns").flatten().to_numpy()[hit].astype(float), part.column("len").to_numpy()[row]
                    block = np.zeros((part.num_rows, len(known)))
                    block[row, place.to_numpy(zero_copy_only=False)[hit].astype(np.int64)] = saturated(tf, length, average)
                    score = block @ weight
                    best = np.partition(np.concatenate([best, score]), -k, axis=0)[-k:]
                    doc, query = np.nonzero((score > 0) & (score >= best.min(0) - 2e-6))  # scores tie when they are rounded
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), part.column("doc_id").take(pa.array(doc)), pa.array(score[doc, query])], names=["query_id", "doc_id", "score"])

        kinds = [T.StructField("query_id", from_arrow_type(queries.dictionary.type)), self.counts.schema["doc_id"], T.StructField("score", T.DoubleType())]
        return self.counts.mapInArrow(run, T.StructType(kinds))

    def corrections(self, query: str, edits: int = 1, best: int = 1, min_length: int = 4) -> DataFrame:
        """(query_term, term, similarity, frequency, rank) for query terms that the corpus lacks."""
        near = within_edits(self.vocabulary.select("term", "frequency"), terms_of(query), edits, min_length)
        known = near.where("distance = 0").select("query_term")
        similarity = F.round(1 - F.col("distance") / F.greatest(F.length("term"), F.length("query_term")), 6)
        rank = F.row_number().over(Window.partitionBy("query_term").orderBy(F.desc("similarity"), F.desc("frequency"), "term"))
        out = near.join(known, "query_term", "left_anti").withColumn("similarity", similarity).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= best)
        return out.select("query_term", "term", "similarity", "frequency", "rank")

    def token_distance(self, query: str, k: int = 3) -> DataFrame:
        """(doc_id, distance) of the k documents nearest to the query by distance of scaled tf-idf vectors.

        Documents without a common term are at the square root of 2, empty ones at 1 (at 0 from an empty query)."""
        counts: dict[str, int] = {}
        for t in X.search_tokens(query):
            counts[t] = counts.get(t, 0) + 1
        df = self._df(list(counts)) if counts else {}
        scale = lambda f, d: f * (F.log((F.lit(self.n) + 1) / (d + 1)) + 1)
        weights = {t: c * (math.log((self.n + 1) / (df.get(t, 0) + 1)) + 1) for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        known = [t for t in counts if t in df]
        empty = self.documents.where("len = 0").select("doc_id", F.lit(1.0 if norm else 0.0).alias("distance"))
        if not norm:
            full = self.documents.where("len > 0").select("doc_id", F.lit(1.0).alias("distance"))
            return self._nearest([empty, full], k)
        far = self.documents.where("len > 0").select("doc_id", F.lit(round(2**0.5, 6)).alias("distance"))
        if not known:
            return self._nearest([empty, far], k)
        part = reduce(lambda c, t: c.when(F.col("term") == t, scale(F.col("tf"), F.lit(df[t])) * weights[t]), known[1:], F.when(F.col("term") == known[0], scale(F.col("tf"), F.lit(df[known[0]])) * weights[known[0]]))
        dots = self._of(known).groupBy("doc_id").agg(F.sum(part).alias("dot"))
        near = dots.join(self.documents, "doc_id").select("doc_id", F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("dot") / F.col("norm") / F.lit(norm))), 6).alias("distance"))
        near = written(near.orderBy("distance", "doc_id").limit(k))
        if near.count() >= k and near.agg(F.max("distance")).first()[0] < 1:
            return near.orderBy("distance", "doc_id")
        # a document that matches is in the list before, at less than those without a common term
        hit = self._of(known).select("doc_id").distinct()
        return self._nearest([near, empty, far.join(hit, "doc_id", "left_anti")], k)

    @staticmethod
    def _nearest(parts: list[DataFrame], k: int) -> DataFrame:
        cut = [p.orderBy("distance", "doc_id").limit(k) for p in parts]
        return reduce(DataFrame.unionByName, cut).orderBy("distance", "doc_id").limit(k)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TermIndex:
    """Tokenises and counts every text once, where it lies; one shuffle by bucket and one of the vocabulary."""
    toks = tokenised(docs, id_col, text_col)
    rows = written(counted(toks))
    tf = rows.select("doc_id", "len", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("ns").alias("tf"))))
    bucket: Column = (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(_SPREAD))
    parts = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = tf.withColumn("bucket", bucket).repartition(parts, "bucket", spread).sortWithinPartitions("bucket", "term")
    postings = written(laid.select("term", "doc_id", "tf", "len", "bucket"), "bucket")
    vocabulary = written(postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("frequency")))
    # rows that repeat an id count apart
    stats = (rows if rows.count() == docs.count() else toks.select(F.size("tokens").alias("len"))).agg(F.count("*").alias("n"), F.avg("len").alias("average")).first()
    return TermIndex(postings, vocabulary, rows, stats["n"], float(stats["average"] or 0.0))
