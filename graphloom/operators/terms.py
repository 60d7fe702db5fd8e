"""Term statistics and rankings over a table of (id, text) rows.

Rankings for one query never explode the texts: a document's frequencies of the few query terms are counted inside one
projection, and the corpus statistics come from one global aggregate of a single row. What needs the whole vocabulary
(weights, corrections, phrases) groups exploded tokens, combined on the map side. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text as X
from graphloom.functions.rows import slices, small_batches
from graphloom.operators.lineage import written

K1, B = 1.2, 0.75
#: A table of query terms is broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: What splits a text column into an array of tokens: search tokens, or e.g. ``subwords`` of a tokenizer.
Split = Callable[[Column], Column]


def subwords(encode: Callable[[list[str]], list[list[int]]]) -> Split:
    """Tokens by a tokenizer: ``encode`` gives the ids of each text of a batch; ids become their decimal names."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[str(i) for i in ids] for ids in encode([t or "" for t in batch])])

    return lambda text: F.pandas_udf(run, "array<string>")(text)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: Split | None = None) -> DataFrame:
    if split is not None:
        return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(split(F.col(text_col)), F.array().cast("array<string>")).alias("tokens"))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(X.tokens(F.col(text_col)), F.array().cast("array<string>")).alias("tokens"))


def counted(toks: DataFrame) -> DataFrame:
    """(doc_id, len, terms, ns) of (doc_id, tokens): a row a document with its distinct terms and how often it has each.

    A document is counted where its row lies, so no token is shuffled; only rows that repeat an id are brought together
    before."""
    small_batches(toks.sparkSession)
    if not toks.groupBy("doc_id").count().where("count > 1").isEmpty():  # reads the ids alone
        toks = toks.groupBy("doc_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4 << 20):
                tokens = part.column(1)
                size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = tokens.flatten().dictionary_encode()
                key = np.repeat(np.arange(len(size), dtype=np.int64) << 32, size) | coded.indices.to_numpy(zero_copy_only=False)
                key, n = np.unique(key, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(size) + 1, dtype=np.int64) << 32).astype(np.int32))
                terms = coded.dictionary.take(pa.array(key & 0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], names=["doc_id", "len", "terms", "ns"])

    schema = T.StructType([toks.schema["doc_id"], *T.StructType.fromDDL("len int, terms array<string>, ns array<int>").fields])
    return toks.select("doc_id", "tokens").mapInArrow(run, schema)


def _each(rows: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, term, n, ...) of counted rows."""
    return rows.select("doc_id", *more, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("ns").alias("n")))).withColumn("n", F.col("n").cast("bigint"))


def term_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: Split | None = None) -> DataFrame:
    """(doc_id, term, n)."""
    return _each(counted(tokenised(docs, id_col, text_col, split))).select("doc_id", "term", "n")


def document_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n_docs); a document's terms are made distinct before the one shuffle."""
    once = tokenised(docs, id_col, text_col).select(F.explode(F.array_distinct("tokens")).alias("term"))
    return once.groupBy("term").agg(F.count("*").alias("n_docs"))


def length_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (n_docs, n_tokens, avg_tokens)."""
    n = tokenised(docs, id_col, text_col).select(F.size("tokens").alias("n"))
    return n.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.avg("n").alias("avg_tokens"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturated(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def terms_of(query: str) -> list[str]:
    """Distinct search tokens in order, as the expression makes them."""
    return list(dict.fromkeys(X.search_tokens(query)))


def _by_score(df: DataFrame, k: int | None, *ties: str) -> DataFrame:
    """Ordered by score rounded to six places, so that equal scores tie; the first k."""
    ranked = df.withColumn("score", F.round("score", 6)).where("score > 0").orderBy(F.desc("score"), *ties)
    return ranked if k is None else ranked.limit(k)


def bm25(docs: DataFrame, query: str, k: int | None = 10, id_col: str = "doc_id", text_col: str = "text", candidates: DataFrame | None = None, fuzzy: int = 0, min_length: int = 4) -> DataFrame:
    """(doc_id, score) of the k best documents.

    ``candidates`` (a table with ``id_col``) narrows the documents before N, df and the average length are taken.
    ``fuzzy`` > 0 lets a term that a document lacks match its nearest terms within so many edits, when both have at
    least ``min_length`` characters; each counts 1 - edits / length of the query term.
    """
    if k is not None and k <= 0:
        raise ValueError("k must be positive")
    terms = terms_of(query)
    if candidates is not None:
        docs = docs.join(candidates.select(id_col).distinct(), id_col, "left_semi")
    if not terms:
        return tokenised(docs, id_col, text_col).select("doc_id", F.lit(0.0).alias("score")).limit(0)

    def frequency(t: str) -> Column:
        exact = F.size(F.filter("tokens", lambda x: x == t)).cast("double")
        if not fuzzy or len(t) < min_length:
            return exact
        near = F.filter(
            F.transform(
                F.filter("tokens", lambda x: (F.length(x) >= min_length) & F.length(x).between(len(t) - fuzzy, len(t) + fuzzy)),
                lambda x: F.levenshtein(x, F.lit(t), fuzzy),
            ),
            lambda d: d >= 0,
        )
        best = F.array_min(near)
        weight = F.aggregate(near, F.lit(0.0), lambda a, d: a + F.when(d == best, F.greatest(F.lit(0.0), 1 - d / F.lit(float(len(t))))).otherwise(0.0))
        return F.when(exact > 0, exact).otherwise(F.coalesce(weight, F.lit(0.0)))

    counted = tokenised(docs, id_col, text_col).select("doc_id", F.size("tokens").alias("len"), *[frequency(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = reduce(lambda a, b: a + b, [F.when(F.col(f"tf{i}") > 0, idf(F.col("n"), F.col(f"df{i}")) * saturated(F.col(f"tf{i}"), F.col("len"), F.col("avgdl"))).otherwise(0.0) for i in range(len(terms))])
    hit = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])
    return _by_score(counted.where(hit).crossJoin(F.broadcast(stats)).select("doc_id", score.alias("score")), k, "doc_id")  # stats is one row


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents for every row of ``queries``."""
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col(query_text)))).alias("term"))
    vocabulary = small(wanted.select("term").distinct())
    toks = tokenised(docs, id_col, text_col)
    stats = toks.agg(F.count("*").alias("n_all"), F.avg(F.size("tokens")).alias("avgdl"))
    tf = toks.select("doc_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).join(vocabulary, "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = tf.join(small(df), "term").crossJoin(F.broadcast(stats)).select("doc_id", "term", (idf(F.col("n_all"), F.col("df")) * saturated(F.col("tf"), F.col("len"), F.col("avgdl"))).alias("w"))
    scored = weighed.join(small(wanted), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def within_edits(vocabulary: DataFrame, terms: Sequence[str], edits: int, min_length: int = 4) -> DataFrame:
    """(query_term, term, distance, ...) of vocabulary rows within so many edits of a term, both long enough.

    The terms are a literal array, so this is one narrow pass over the vocabulary with a length band before the distance.
    """
    t = [x for x in dict.fromkeys(terms) if len(x) >= min_length]
    near = vocabulary.where(F.length("term") >= min_length).withColumn("query_term", F.explode(F.array([F.lit(x) for x in t]).cast("array<string>")))
    return near.where(F.abs(F.length("term") - F.length("query_term")) <= edits).withColumn("distance", F.levenshtein("term", "query_term", edits).cast("bigint")).where("distance >= 0")


def corrections(docs: DataFrame, query: str, edits: int = 1, best: int = 1, min_length: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_term, term, similarity, frequency, rank) for query terms that the corpus lacks."""
    tf = tokenised(docs, id_col, text_col).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("frequency"))
    near = within_edits(tf, terms_of(query), edits, min_length)
    known = near.where("distance = 0").select("query_term")
    similarity = F.round(1 - F.col("distance") / F.greatest(F.length("term"), F.length("query_term")), 6)
    rank = F.row_number().over(Window.partitionBy("query_term").orderBy(F.desc("similarity"), F.desc("frequency"), "term"))
    out = near.join(known, "query_term", "left_anti").withColumn("similarity", similarity).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= best)
    return out.select("query_term", "term", "similarity", "frequency", "rank")


def corrected(docs: DataFrame, query: str, **options: int) -> str:
    """The query with the best corrections of its unknown terms appended (at most ``best`` a query term reach the driver)."""
    rows = corrections(docs, query, **options).orderBy("query_term", "rank").collect()
    return " ".join([query, *[r["term"] for r in rows]])


def own_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: Split | None = None) -> DataFrame:
    """(doc_id, term, tf, binary): both weights that a document's own counts give, without a shuffle."""
    norm = F.sqrt(F.aggregate("ns", F.lit(0.0), lambda a, n: a + n.cast("double") * n.cast("double")))
    each = _each(counted(tokenised(docs, id_col, text_col, split)), norm.alias("norm"), F.sqrt(F.size("ns").cast("double")).alias("width"))
    return each.select("doc_id", "term", (F.col("n") / F.col("norm")).alias("tf"), (1 / F.col("width")).alias("binary"))


def weights(docs: DataFrame, kind: str = "tfidf", id_col: str = "doc_id", text_col: str = "text", split: Split | None = None) -> DataFrame:
    """(doc_id, term, weight), scaled to length 1: ``tf``, ``binary`` or ``tfidf``."""
    if kind not in ("tf", "binary", "tfidf"):
        raise ValueError("kind must be tf, binary or tfidf")
    if kind != "tfidf":
        return own_weights(docs, id_col, text_col, split).select("doc_id", "term", F.col(kind).alias("weight"))
    tf = term_frequency(docs, id_col, text_col, split)
    n = docs.agg(F.count("*").alias("n_all"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    tf = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("n") * (F.log((F.col("n_all") + 1) / (F.col("df") + 1)) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return tf.select("doc_id", "term", (F.col("w") / norm).alias("weight"))


def subword_distance(docs: DataFrame, query: str, split: Split, k: int = 3, kind: str = "tfidf", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, distance) as ``token_distance``, of the tokens that ``split`` gives and of any weights."""
    spark = docs.sparkSession
    asked = spark.createDataFrame([(0, query)], "doc_id int, text string")
    tf = term_frequency(docs, id_col, text_col, split)
    own = term_frequency(asked, split=split).select("term", F.col("n").alias("qn"))
    scale = lambda n: F.lit(1.0) if kind == "binary" else n.cast("double") if kind == "tf" else n * (F.log((F.col("n_all") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    if kind not in ("tf", "binary", "tfidf"):
        raise ValueError("kind must be tf, binary or tfidf")
    total, df = docs.agg(F.count("*").alias("n_all")), tf.groupBy("term").agg(F.count("*").alias("df"))
    q = F.broadcast(own).join(df, "term", "left").crossJoin(F.broadcast(total)).select("term", scale(F.col("qn")).alias("qw"))  # a query's terms
    qnorm = q.agg(F.coalesce(F.sqrt(F.sum(F.col("qw") * F.col("qw"))), F.lit(0.0)).alias("qnorm"))
    w = tf.join(df, "term").crossJoin(F.broadcast(total)).withColumn("w", scale(F.col("n"))).join(F.broadcast(q), "term", "left")
    sums = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.coalesce("qw", F.lit(0.0))).alias("dot"))
    every = docs.select(F.col(id_col).alias("doc_id")).join(sums, "doc_id", "left").crossJoin(F.broadcast(qnorm))
    both, either = (F.col("qnorm") == 0) & F.col("norm").isNull(), (F.col("qnorm") == 0) | F.col("norm").isNull()
    distance = F.when(both, 0.0).when(either, 1.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("dot") / F.col("norm") / F.col("qnorm"))))
    return every.select("doc_id", F.round(distance, 6).alias("distance")).orderBy("distance", "doc_id").limit(k)


def token_distance(docs: DataFrame, query: str, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, distance) of the k documents nearest to the query by Euclidean distance of scaled tf-idf vectors.

    Documents without a common term are at the square root of 2; an empty query and document at 0, one empty at 1.
    """
    terms = terms_of(query)
    counts = {t: 0.0 for t in terms}
    word: list[str] = []
    for c in query.lower() + " ":
        if c.isalpha() or c.isnumeric():
            word.append(c)
        elif word:
            counts["".join(word)] += 1
            word = []
    tf = term_frequency(docs, id_col, text_col)
    n = docs.agg(F.count("*").alias("n_all"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    asked = docs.sparkSession.createDataFrame(list(counts.items()) or [("", 0.0)], "term string, qtf double")  # a query's terms
    scale = lambda f: f * (F.log((F.col("n_all") + 1) / (F.coalesce(F.col("df"), F.lit(0)) + 1)) + 1)
    q = asked.join(df.join(F.broadcast(asked.select("term")), "term", "left_semi"), "term", "left")
    q = q.crossJoin(F.broadcast(n)).select("term", scale(F.col("qtf")).alias("qw"))
    qnorm = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dw = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", scale(F.col("n")))
    sums = dw.join(F.broadcast(q), "term", "left").groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.coalesce("qw", F.lit(0.0))).alias("dot"))
    every = docs.select(F.col(id_col).alias("doc_id")).join(sums, "doc_id", "left").crossJoin(F.broadcast(qnorm))
    no_query, no_doc = F.coalesce(F.col("qnorm"), F.lit(0.0)) == 0, F.col("norm").isNull()
    distance = F.when(no_query & no_doc, 0.0).when(no_query | no_doc, 1.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("dot") / F.col("norm") / F.col("qnorm"))))
    return every.select("doc_id", F.round(distance, 6).alias("distance")).orderBy("distance", "doc_id").limit(k)


def related(docs: DataFrame, k: int = 3, most: float | None = None, id_col: str = "doc_id", text_col: str = "text", asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, related_id, distance, confidence, rank): the k nearest other texts of each, by tf-idf distance; of those in
    ``asked`` (a table with ``id_col``) only, where it is given. The join on terms costs the asked texts' terms times the
    texts that hold them, so with all texts asked it grows with the square of frequent terms.

    Pairs with a common term come from a join on terms; where a text has fewer than k such neighbours, those of least
    id without a common term follow at the square root of 2 (unless ``most`` is less).
    """
    w = written(weights(docs, "tfidf", id_col, text_col))  # read several times
    mine = w if asked is None else w.join(asked.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")
    a, b = mine.select(F.col("doc_id").alias("a"), "term", F.col("weight").alias("wa")), w.select(F.col("doc_id").alias("b"), "term", F.col("weight").alias("wb"))
    dots = a.join(b, "term").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    near = dots.select("a", "b", F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("dot"))), 6).alias("distance"))
    order = Window.partitionBy("a").orderBy("distance", "b")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # a text lacks a term with all but its own partners, so the k + (its partners) + 1 least ids hold enough to fill up
    have = near.groupBy("a").agg(F.collect_list("b").alias("has"))
    ids = w.select("doc_id").distinct()
    first = ids.orderBy("doc_id").limit(2 * k + 1).agg(F.array_sort(F.collect_list("doc_id")).alias("first"))
    short = mine.select(F.col("doc_id").alias("a")).distinct().join(have, "a", "left").where(F.coalesce(F.size("has"), F.lit(0)) < k).crossJoin(F.broadcast(first))
    fill = short.select("a", F.explode(F.array_except(F.array_remove(F.col("first"), F.col("a")), F.coalesce("has", F.array().cast(ids.select(F.array("doc_id").alias("x")).schema["x"].dataType)))).alias("b"), F.lit(round(2**0.5, 6)).alias("distance"))
    both = near.select("a", "b", "distance").unionByName(fill).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    if most is not None:
        both = both.where(F.col("distance") <= most)
    return both.select(F.col("a").alias("doc_id"), F.col("b").alias("related_id"), "distance", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance") / F.lit(2**0.5)), 6).alias("confidence"), "rank")


def keyphrases(docs: DataFrame, k: int = 8, longest: int = 3, id_col: str = "doc_id", text_col: str = "text", normal: bool = True) -> DataFrame:
    """(doc_id, phrase, n, score, rank): the k best runs of one to ``longest`` words with a word of three characters.

    score = n * (ln((N + 1) / (df + 1)) + 1) * sqrt(words) * ln(characters + 1). ``normal``: keys are NFC.
    """
    low = X.nfc_lower(F.col(text_col)) if normal else F.lower(F.col(text_col))
    split = docs.select(F.col(id_col).alias("doc_id"), X.words(F.coalesce(low, F.lit(""))).alias("w"))
    def of_length(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))
        return F.when(F.size("w") >= n, runs).otherwise(F.array().cast("array<array<string>>"))

    runs = F.flatten(F.array(*[of_length(n) for n in range(1, longest + 1)]))
    fit = F.filter(runs, lambda r: F.exists(r, lambda x: F.length(x) >= 3))
    counted = split.select("doc_id", F.explode(fit).alias("r")).groupBy("doc_id", F.array_join("r", " ").alias("phrase"), F.size("r").alias("words")).agg(F.count("*").alias("n"))
    df = counted.groupBy("phrase").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n_all"))
    score = F.col("n") * (F.log((F.col("n_all") + 1) / (F.col("df") + 1)) + 1) * F.sqrt(F.col("words").cast("double")) * F.log(F.length("phrase") + 1.0)
    scored = counted.join(df, "phrase").crossJoin(F.broadcast(total)).withColumn("score", F.round(score, 6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("words"), "phrase"))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("doc_id", "phrase", "n", "score", "rank")
