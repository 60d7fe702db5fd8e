"""Files as documents: strict text decoding and media types."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA_TYPES = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "text": "text/plain", "log": "text/plain", "csv": "text/csv", "json": "application/json", "jsonl": "application/json", "yaml": "application/yaml", "yml": "application/yaml", "html": "text/html"}
_MARKS = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
_CONTROL = set(range(32)) - {9, 10, 12, 13}


def decode(data: bytes, encoding: str | None = None) -> str | None:
    """Text of a file, or None where it isn't text: by the encoding given, a byte-order mark, else strict UTF-8."""
    try:
        if encoding:
            return data.decode(encoding).removeprefix("﻿")
        for mark, name in _MARKS:
            if data.startswith(mark):
                return data.decode(name).removeprefix("﻿")
        return None if _CONTROL & set(data) else data.decode("utf-8")
    except (UnicodeDecodeError, LookupError):
        return None


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text/plain")
    for name, kind in MEDIA_TYPES.items():
        out = F.when(ext == name, kind).otherwise(out)
    return out


def read(spark: SparkSession, path: str, glob: str | None = None, encoding: str | None = None, skip_unreadable: bool = True) -> DataFrame:
    """(path, content, media_type) of a file or of all files below a folder; paths are relative to it.

    Files that aren't text are left out, or raise if ``skip_unreadable`` is off.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: decode(bytes(b), encoding))

    files = reader.load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("full"), F.pandas_udf(text, "string")("content").alias("content"))
    root = "/" + path.removeprefix("file:").strip("/")
    inside = F.when(F.startswith("full", F.lit(root + "/")), F.substring("full", F.lit(len(root) + 2), F.length("full"))).otherwise(F.substring_index("full", "/", -1))
    if skip_unreadable:
        files = files.where("content IS NOT NULL")
    else:
        files = files.withColumn("content", F.coalesce("content", F.raise_error(F.concat(F.lit("not text: "), "full")).cast("string")))
    return files.select(inside.alias("path"), "content").withColumn("media_type", media_type(F.col("path")))


def inline(spark: SparkSession, sources: list[tuple[str | None, str | None]]) -> DataFrame:
    """(path, content, media_type) of texts given here; without a path ``document.md``, without content an empty text."""
    df = spark.createDataFrame([(p or "document.md", c or "") for p, c in sources], "path string, content string")
    return df.withColumn("media_type", media_type(F.col("path")))
