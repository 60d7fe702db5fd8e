"""Weighted rendezvous sharding of stable record keys.

Every (key, shard) pair has a pseudo-random draw u in (0, 1); a record goes to the shard with the greatest
``-weight / ln(u)``. A shard that is added takes records from the others in proportion to its weight and none move
between the others; a shard that is removed loses only its own records.

Defined cases: a null key is the key of its own name (all null keys share a shard); equal keys, so repeated rows,
share a shard; a tie goes to the greatest shard id; an empty table gives an empty table; other columns pass through
untouched, and a column that already has the name of the result raises ValueError.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shards of equal weight but for two that hold double and half.
SHARDS = {i: (2.0 if i == 0 else 0.5 if i == 1 else 1.0) for i in range(64)}
_HEX = 13  # 52 bits of the digest: exact in a double


def rendezvous(key: Column, shards: Mapping[int, float]) -> Column:
    """The shard of a key, as a built-in expression (one digest a shard, no shuffle)."""
    if not shards or any(w <= 0 for w in shards.values()):
        raise ValueError("shards need positive weights")
    name = F.coalesce(key.cast("string"), F.lit("\x00null"))
    table = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(shards.items())])

    def draw(one: Column) -> Column:
        digest = F.substring(F.md5(F.concat(name, F.lit("#"), one["shard"].cast("string")).cast("binary")), 1, _HEX)
        u = (F.conv(digest, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(16**_HEX))
        return F.struct((-one["weight"] / F.ln(u)).alias("score"), one["shard"].alias("shard"))

    return F.array_max(F.transform(table, draw))["shard"]


def assign_shards(df: DataFrame, key: str, shards: Mapping[int, float] = SHARDS, out: str = "shard_id") -> DataFrame:
    """``df`` with the shard of each row in ``out``; a narrow projection."""
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    return df.select("*", rendezvous(F.col(f"`{key}`"), shards).alias(out))


def laid_out(df: DataFrame, key: str, shards: Mapping[int, float] = SHARDS, out: str = "shard_id", files: int = 1) -> DataFrame:
    """Whole rows moved to the tasks of their shards; one shuffle, salted so that a shard isn't a single task."""
    salt = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(files))
    return assign_shards(df, key, shards, out).repartition(len(shards) * files, out, salt)


def write_shards(df: DataFrame, key: str, path: str, shards: Mapping[int, float] = SHARDS, out: str = "shard_id", files: int = 1) -> None:
    """One directory a shard, each of ``files`` files; the rows of ``laid_out``."""
    laid_out(df, key, shards, out, files).write.mode("overwrite").partitionBy(out).parquet(path)


def oracle(table: str, key: str, columns: str, shards: Mapping[int, float] = SHARDS) -> str:
    values = ", ".join(f"({s}, {w!r}::DOUBLE)" for s, w in sorted(shards.items()))
    return f"""
WITH shards(shard, weight) AS (VALUES {values}),
drawn AS (
  SELECT {columns}, shard,
         -weight / ln((('0x' || substr(md5({key}::VARCHAR || '#' || shard::VARCHAR), 1, {_HEX}))::BIGINT::DOUBLE + 0.5) / {float(16**_HEX)!r}::DOUBLE) AS score
  FROM {table}, shards)
SELECT {columns}, max(struct_pack(score := score, shard := shard)).shard AS shard_id FROM drawn GROUP BY {columns}"""
