"""Triple pattern fragments: pages of triples with a link to the next one, read over HTTP into a graph."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlencode, urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.triples import COLUMNS, SCHEMA
from graphloom.sources.rdf import expanded

_HYDRA = "http://www.w3.org/ns/hydra/core#"
_CONTROL = (_HYDRA, "http://rdfs.org/ns/void#")


def fetch(url: str) -> object:
    """A page as JSON-LD."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/ld+json"}), timeout=30) as r:
        return json.loads(r.read())


def page(document: object, url: str) -> tuple[list[tuple], str | None]:
    """The data of a page, and the address of the next one; a page's controls and counts aren't data."""
    rows = expanded(document, url)
    following = next((o for _, _, p, o, *_ in rows if p in (_HYDRA + "next", _HYDRA + "nextPage")), None)
    own = {s for s, _, p, *_ in rows if p.startswith(_CONTROL)}
    return [r for r in rows if not r[2].startswith(_CONTROL) and r[0] not in own and not r[3].startswith(_CONTROL)], urljoin(url, following) if following else None


def read(spark: SparkSession, address: str, patterns: list[dict[str, str]] | None = None, get: Callable[[str], object] = fetch) -> DataFrame:
    """Triples of an endpoint that fit any of the patterns (subject, predicate, object), all without one. Each pattern's
    pages are followed by a task of its own; a page is held at a time."""
    urls = [f"{address}?{urlencode(p)}" if p else address for p in patterns or [{}]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["url"]:
                seen = set()
                while url and url not in seen:
                    seen.add(url)
                    rows, following = page(get(url), url)
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    url = following

    asked = spark.createDataFrame([(u,) for u in urls], "url string").repartition(len(urls))
    return asked.mapInPandas(run, SCHEMA).dropDuplicates(COLUMNS)
