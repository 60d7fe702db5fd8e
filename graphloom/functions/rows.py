"""Functions of one row at a time, in Arrow batches: a worker holds few rows as objects, however large a batch is."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a batch that the executor sends, of its rows that are objects at once, and rows that are sent back at once.
BATCH_BYTES, CHUNK_BYTES, OUT_ROWS = 8 << 20, 1 << 20, 4096


def small_batches(spark: SparkSession) -> None:
    """Batches for Python of at most ``BATCH_BYTES``: a task holds one in the executor and one in its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark.conf.get(key).rstrip("bB")
    if not most.isdigit() or not 0 < int(most) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes, at least a row each."""
    if batch.num_rows:
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def flat_map(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """The rows that ``f`` gives for the values of each row of ``df``."""
    small_batches(df.sparkSession)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(kind)

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for values in zip(*(c.to_pylist() for c in part.columns)):
                    rows += f(*values)
                    if len(rows) >= OUT_ROWS:
                        yield sent(rows)
                        rows = []
                if rows:
                    yield sent(rows)

    return df.mapInArrow(run, kind)
