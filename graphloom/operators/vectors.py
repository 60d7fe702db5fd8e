"""Vector search and the fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for empty ones, unlike lengths or a zero length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = add(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(add(F.transform(a, lambda x: x * x))) * F.sqrt(add(F.transform(b, lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(0.0)


def semantic(vectors: DataFrame, query: Sequence[float], k: int = 10, least: float = 0.4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(node_id, score) of the k vectors most like ``query``; a narrow pass and a bounded top-k."""
    if k <= 0:
        raise ValueError("k must be positive")
    literal = F.array([F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_col).alias("node_id"), F.round(cosine(F.col(vector_col), literal), 6).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "node_id").limit(k)


def ranked(df: DataFrame, *ties: str) -> DataFrame:
    """Adds the 1-based place by score. For lists already cut to a top-k, so one partition holds them."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *(ties or ("node_id",)))).cast("bigint"))


def reciprocal_rank_fusion(canonical: DataFrame, semantic_hits: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """(node_id, source, score): the sum of 1 / (constant + place) over two lists (node_id, score) cut to a top-k."""
    a = ranked(canonical).select("node_id", F.col("rank").alias("ra"))
    b = ranked(semantic_hits).select("node_id", F.col("rank").alias("rb"))
    part = lambda r: F.coalesce(1 / (F.col(r) + constant), F.lit(0.0))
    source = F.when(F.col("ra").isNull(), "Semantic").when(F.col("rb").isNull(), "Canonical").otherwise("Merged")
    fused = a.join(b, "node_id", "full").select("node_id", source.alias("source"), F.round(part("ra") + part("rb"), 6).alias("score"))
    return fused.orderBy(F.desc("score"), "node_id").limit(k)


def canonical_first(canonical: DataFrame, semantic_hits: DataFrame, k: int = 10) -> DataFrame:
    """(node_id, source, score, place): the canonical list in its order, scores of nodes in both added, then the rest."""
    a = ranked(canonical).select("node_id", F.col("score").alias("sa"), F.col("rank").alias("ra"))
    b = ranked(semantic_hits).select("node_id", F.col("score").alias("sb"), F.col("rank").alias("rb"))
    both = a.join(b, "node_id", "full")
    source = F.when(F.col("ra").isNull(), "Semantic").when(F.col("rb").isNull(), "Canonical").otherwise("Merged")
    place = F.row_number().over(Window.orderBy(F.col("ra").isNull(), F.coalesce("ra", "rb")))
    out = both.select("node_id", source.alias("source"), F.round(F.coalesce("sa", F.lit(0.0)) + F.coalesce("sb", F.lit(0.0)), 6).alias("score"), place.cast("bigint").alias("place"))
    return out.where(F.col("place") <= k)
