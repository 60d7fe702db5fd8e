"""Where graphs, manifests and contracts are kept: folders of any file system that Spark reads, or memory."""

from __future__ import annotations

import json
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import shapes
from graphloom.operators.search import Profile
from graphloom.sources import rdf
from graphloom.sources.yamlish import load_yaml


class GraphStore(Protocol):
    """Saves and loads graphs by location."""

    def save(self, location: str, graph: DataFrame, kind: str | None = None) -> None: ...

    def load(self, location: str, kind: str | None = None) -> DataFrame: ...

    def exists(self, location: str) -> bool: ...

    def delete(self, location: str) -> None: ...


class FolderStore:
    """Graphs below a root folder, local or of a cluster's file system."""

    def __init__(self, spark: SparkSession, root: str, compression: str = "none") -> None:
        self.spark, self.root, self.compression = spark, root.rstrip("/"), compression

    def path(self, location: str) -> str:
        if ".." in location.split("/"):
            raise ValueError(f"outside the store: {location}")
        return f"{self.root}/{location.strip('/')}"

    def _file(self, location: str) -> tuple[Any, Any]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(location))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, location: str, graph: DataFrame, kind: str | None = None) -> None:
        rdf.write(graph, self.path(location), kind or rdf.kind_of(location), self.compression)

    def load(self, location: str, kind: str | None = None) -> DataFrame:
        if not self.exists(location):
            raise FileNotFoundError(location)
        return rdf.read(self.spark, self.path(location), kind)

    def exists(self, location: str) -> bool:
        at, fs = self._file(location)
        return fs.exists(at)

    def delete(self, location: str) -> None:
        at, fs = self._file(location)
        fs.delete(at, True)


class MemoryStore:
    """Graphs by name within a session; nothing is copied."""

    def __init__(self) -> None:
        self.graphs: dict[str, DataFrame] = {}

    def save(self, location: str, graph: DataFrame, kind: str | None = None) -> None:
        self.graphs[location] = graph

    def load(self, location: str, kind: str | None = None) -> DataFrame:
        if location not in self.graphs:
            raise FileNotFoundError(location)
        return self.graphs[location]

    def exists(self, location: str) -> bool:
        return location in self.graphs

    def delete(self, location: str) -> None:
        self.graphs.pop(location, None)


def save_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest (path, fingerprint) as lines of JSON in the order of paths."""
    manifest.select("path", "fingerprint").orderBy("path").write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, fingerprint string").json(path)


_CONTRACT = ("required", "facets", "links", "target")


def contract_text(contract: dict[str, Any], profile: Profile = Profile(), kind: str = "json") -> str:
    """A search contract (required texts, facets, links and the class they are of) with its search profile."""
    unknown = set(contract) - set(_CONTRACT)
    if unknown:
        raise ValueError(f"no part of a contract: {sorted(unknown)}")
    whole = {**{k: contract[k] for k in _CONTRACT if k in contract}, "profile": profile.__dict__}
    if kind == "json":
        return json.dumps(whole, indent=2, default=list)
    plain = json.loads(json.dumps(whole, default=list))
    return "".join(f"{k}: {json.dumps(v)}\n" for k, v in plain.items())  # flow style is YAML too


def read_contract(text: str) -> tuple[list[shapes.Shape], Profile]:
    """The shapes and the profile of a contract written as JSON or YAML."""
    try:
        whole = json.loads(text)
    except ValueError:
        whole = load_yaml(text)
        whole = {k: json.loads(v) if isinstance(v, str) and v[:1] in "[{" else v for k, v in whole.items()} if isinstance(whole, dict) else whole
    if not isinstance(whole, dict):
        raise ValueError("a contract must be a map")
    profile = dict(whole.get("profile") or {})
    for k in ("labels", "types", "excluded_types"):
        if k in profile:
            profile[k] = tuple(profile[k])
    if "facets" in profile:
        profile["facets"] = tuple(tuple(x) for x in profile["facets"])
    parts = {k: whole[k] for k in _CONTRACT if whole.get(k) is not None}
    return shapes.contract(**{"required": (), **parts}), Profile(**profile)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file, replaced as a whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = at.suffix(".new")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(new, at)


def load_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).select(F.col("value")).first()["value"]
