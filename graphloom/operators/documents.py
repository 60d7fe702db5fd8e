"""Documents to sections, blocks, chunks, segments and links.

What has a built-in expression is one; YAML, the outline and the greedy packing run as Arrow-batched functions on whole
columns. All of it is narrow: no operator here shuffles texts.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text as X
from graphloom.functions.rows import flat_map
from graphloom.sources.yamlish import load_yaml

TARGET, OVERLAP = 750, 0
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+)$", re.M)
_LINK = re.compile(r"(?P<wiki>\[\[(?P<wt>[^\]|]+)(?:\|(?P<wl>[^\]]+))?\]\])|(?P<bang>!?)\[(?P<label>[^\]]*)\]\((?P<target>[^)\s]+)(?:\s+\"[^\"]*\")?\)")
_WIDE = re.compile(X.WIDE)
#: Expected passages of one automaton.
MOST_PASSAGES = 200_000

SECTION = "ord bigint, level int, heading string, path array<string>, text string"
LINK = "ord bigint, kind string, label string, target string, resolved string, external boolean"
CHUNK = "ord bigint, section bigint, path array<string>, text string, tokens bigint"
_CHUNK_FIELDS = ("ord", "section", "path", "text", "tokens")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", ""), "\r\n?", "\n")


def front_matter(text: str) -> tuple[dict, str]:
    """Fields (lower-case keys without _ and -) and body. An unclosed block or bad YAML raises ValueError."""
    if not text.startswith("---\n") and text != "---":
        return {}, text
    lines = text.split("\n")
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() == "---"), None)
    if end is None:
        raise ValueError("front matter isn't closed")
    loaded = load_yaml("\n".join(lines[1:end]))
    if loaded is not None and not isinstance(loaded, dict):
        raise ValueError("front matter must be a map")
    return {re.sub(r"[_-]", "", str(k)).lower(): v for k, v in (loaded or {}).items()}, "\n".join(lines[end + 1 :])


def outline(body: str) -> list[dict]:
    """Sections by headings, those within code fences too; text before the first heading is a section of level 0."""
    out, stack, at, head = [], [], 0, None
    marks = [*_HEADING.finditer(body), None]
    for m in marks:
        text = body[at : m.start() if m else len(body)].strip()
        if head is not None or text:
            level = len(head[1]) if head else 0
            title = head[2].strip() if head else None
            if head:
                while stack and len(stack) >= level:
                    stack.pop()
                stack.append(title)
            out.append({"ord": len(out), "level": level, "heading": title, "path": list(stack), "text": text})
        if m:
            head, at = m, m.end()
    return out


_ITEM = re.compile(r"\s{0,3}(?:[-*+]|\d{1,9}[.)])\s")
_HTML = re.compile(r"\s{0,3}</?[A-Za-z!?][^>]*>?")
_RULE = re.compile(r"\s{0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")


def blocks(text: str) -> list[str]:
    """Top-level blocks: fenced and indented code, lists, quotes, tables, HTML, rules, headings and paragraphs. Blank lines
    end a block, but for a fence and for a list whose next line is an item or is indented."""
    out: list[str] = []
    held: list[str] = []
    kind, fence, gap = "", None, 0

    def close() -> None:
        nonlocal held, kind, gap
        if held:
            out.append("\n".join(held))
        held, kind, gap = [], "", 0

    for line in text.split("\n"):
        mark = re.match(r"\s{0,3}(```+|~~~+)", line)
        if kind == "fence":
            held.append(line)
            if mark and mark[1].startswith(fence) and not line.strip().strip(mark[1][0]):
                close()
            continue
        if not line.strip():
            if kind in ("list", "code"):
                gap += 1
            else:
                close()
            continue
        deep = line.startswith(("  ", "\t"))
        own = "list" if _ITEM.match(line) and not _RULE.match(line) else "quote" if line.lstrip().startswith(">") else "table" if line.lstrip().startswith("|") else "html" if _HTML.match(line) else ""
        if mark and not (kind == "list" and deep):
            close()
            kind, fence, held = "fence", mark[1], [line]
            continue
        if kind == "list" and (deep or own == "list" or not gap and not own) or kind == "code" and line.startswith(("    ", "\t")):
            held += [""] * gap + [line]
            gap = 0
            continue
        if kind == "code" or kind == "list" or (kind == "quote" and gap):
            close()
        if _RULE.match(line) and not held or re.match(r"#{1,6}[ \t]", line):
            close()
            out.append(line)
            continue
        if not held and line.startswith(("    ", "\t")):
            kind, held = "code", [line]
            continue
        if own in ("list", "quote", "table", "html") and own != kind and not (own in ("table", "html") and kind == "paragraph"):
            close()
        held.append(line)
        kind = kind or own or "paragraph"
    close()
    return out


def units(text: str) -> int:
    """Quarters of a token."""
    return len(text) + 5 * len(_WIDE.findall(text))


def pack(sizes: list[int], target: int = TARGET, joint: int = 2) -> list[int]:
    """The chunk of each block: a block goes on with the chunk before unless their estimate then exceeds the target."""
    out, held, chunk = [], -1, -1
    for size in sizes:
        grown = held + joint + size
        if held < 0 or max(1, grown // 4) > target:
            chunk, grown = chunk + 1, size
        out.append(chunk)
        held = grown
    return out


def chunks_of(body: str, target: int = TARGET, overlap: int = OVERLAP) -> list[dict]:
    """Chunks of whole blocks, section by section; with an overlap each begins with the last blocks before it that fit."""
    out = []
    for section in outline(body):
        held: list[str] = []
        carried = 0

        def emit(section: dict = section) -> None:
            text = "\n\n".join(held)
            out.append({"ord": len(out), "section": section["ord"], "path": section["path"], "text": text, "tokens": max(1, units(text) // 4)})

        for b in blocks(section["text"]):
            if held and max(1, units("\n\n".join([*held, b])) // 4) > target and len(held) > carried:
                emit()
                keep: list[str] = []
                for x in reversed(held):
                    if overlap <= 0 or units("\n\n".join([x, *keep])) // 4 > overlap:
                        break
                    keep.insert(0, x)
                held, carried = keep, len(keep)
            held.append(b)
        if len(held) > carried:
            emit()
    return out


def whole_sections(body: str) -> list[dict]:
    """The chunker that takes every section with text as one chunk."""
    full = [s for s in outline(body) if s["text"]]
    return [{"ord": i, "section": s["ord"], "path": s["path"], "text": s["text"], "tokens": max(1, units(s["text"]) // 4)} for i, s in enumerate(full)]


def resolve(target: str, source: str) -> tuple[str, bool]:
    """A link's target as a document path, and whether it is external."""
    if re.match(r"(?i)(https?|mailto):", target):
        return target, True
    path, mark, rest = re.match(r"([^?#]*)([?#]?)(.*)", target, re.S).groups()
    if path:
        path = posixpath.normpath(urljoin("/" + source, path)).lstrip("/")
        path = re.sub(r"(?i)\.(md|markdown)$", "", path).rstrip("/") + "/"
    else:
        path = re.sub(r"(?i)\.(md|markdown)$", "", source) + "/"
    return path + mark + rest, False


def links_of(body: str, source: str = "") -> list[dict]:
    """Wiki links, images and links in order; equal ones once."""
    out, seen = [], set()
    for m in _LINK.finditer(body or ""):
        if m["wiki"]:
            kind, target = "wiki", m["wt"].strip()
            label, page = (m["wl"] or target).strip(), X.slug_of(target) + "/"
            resolved, external = page, False
        else:
            kind, label, target = "image" if m["bang"] else "link", m["label"], m["target"]
            resolved, external = resolve(target, source)
        key = (kind, label, target)
        if key not in seen:
            seen.add(key)
            out.append({"ord": len(out), "kind": kind, "label": label, "target": target, "resolved": resolved, "external": external})
    return out


def _per_text(docs: DataFrame, f: Callable[..., list[dict]], kind: str, id_col: str, text_col: str, source: Column) -> DataFrame:
    """The id with each of the records that ``f`` makes of a text and its source."""
    made = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"), source.alias("source"))
    return flat_map(made, lambda i, b, s: [(i, *r.values()) for r in f(b or "", s or "")], T.StructType([made.schema["doc_id"], *T.StructType.fromDDL(kind).fields]))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, level, heading, path, text)."""
    return _per_text(docs, lambda b, _: outline(b), SECTION, id_col, text_col, F.lit(""))


def chunks(docs: DataFrame, chunker: Callable[[str], list[dict]] = chunks_of, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, section, path, text, tokens) by any chunker of a body."""
    return _per_text(docs, lambda b, _: [{k: c[k] for k in _CHUNK_FIELDS} for c in chunker(b)], CHUNK, id_col, text_col, F.lit(""))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, ord, kind, label, target, resolved, external)."""
    return _per_text(docs, links_of, LINK, id_col, text_col, F.col(path_col) if path_col else F.lit(""))


def segments(docs: DataFrame, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ord, segment, n_tokens): trimmed lines with at least so many tokens, numbered by document, without a shuffle."""
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.struct(F.trim(x).alias("segment"), F.size(X.tokens(x)).cast("bigint").alias("n_tokens")))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.filter(lines, lambda x: (x["segment"] != "") & (x["n_tokens"] >= least))).alias("ord", "x")).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "x.segment", "x.n_tokens")


def _packed(sizes: pd.Series, target: pd.Series, joint: pd.Series) -> pd.Series:
    return pd.Series([pack([int(x) for x in s], int(t), int(j)) for s, t, j in zip(sizes, target, joint)])


def line_chunks(docs: DataFrame, target: int = TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, n_blocks, tokens, text): lines packed greedily; only their sizes leave the JVM."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    size = F.transform(lines, lambda x: F.length(x) + 5 * F.regexp_count(x, F.lit(X.WIDE)))
    placed = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines"), size.alias("sizes")).withColumn("at", F.pandas_udf(_packed, "array<int>")("sizes", F.lit(target), F.lit(1)))
    one = lambda k: F.transform(F.filter(F.arrays_zip("lines", "at"), lambda x: x["at"] == k), lambda x: x["lines"])
    spans = F.transform(F.sequence(F.lit(0), F.array_max("at")), lambda k: F.struct(k.cast("bigint").alias("chunk"), one(k).alias("own")))
    out = placed.where(F.size("lines") > 0).select("doc_id", F.inline(spans))
    text = F.array_join("own", "\n")
    return out.select("doc_id", "chunk", F.size("own").cast("bigint").alias("n_blocks"), X.token_estimate(text).alias("tokens"), text.alias("text"))


def size_distribution(found: DataFrame, small: int = 100, large: int = 600) -> DataFrame:
    """One row of counts and statistics over ``tokens``."""
    t = F.col("tokens")
    return found.agg(F.count("*").alias("n"), F.count_if(t < small).alias("n_small"), F.count_if(t.between(small, large)).alias("n_in_range"), F.count_if(t > large).alias("n_large"), F.min(t).alias("least"), F.max(t).alias("most"), F.round(F.avg(t), 6).alias("average"), F.median(t).alias("median"))


def quality_sample(found: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` chunks in an order drawn from the seed, with flags for abrupt starts and ends."""
    ends = F.rlike(F.rtrim(F.col("text")), F.lit(r"[.!?:;\"')\]`]$"))
    starts = F.rlike(F.ltrim(F.col("text")), F.lit(r"^[\p{Lu}\p{N}#*\-\[\"'(`>|]"))
    return found.orderBy(F.xxhash64("doc_id", "chunk", F.lit(seed)), "doc_id", "chunk").limit(n).withColumns({"starts_abruptly": ~starts, "ends_abruptly": ~ends}).orderBy("doc_id", "chunk")


def containing(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_id: str = "item_id", passage: str = "text", most: int = MOST_PASSAGES) -> DataFrame:
    """(item_id, doc_id) of texts that contain a passage, letter case aside.

    Passages are taken in blocks of about ``most``: each block is one automaton that tasks build and run over their texts
    once, so the driver and an executor hold one block, however many passages there are."""
    wanted = passages.select(F.col(passage_id).alias("item_id"), F.lower(F.col(passage)).alias("passage")).where("passage <> ''")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("low"))
    schema = T.StructType([T.StructField("item_id", wanted.schema["item_id"].dataType), T.StructField("doc_id", texts.schema["doc_id"].dataType)])
    spark, parts = docs.sparkSession, max(1, -(-wanted.count() // most))

    def block(ids: dict[str, list]) -> DataFrame:
        shared = spark.sparkContext.broadcast(ids)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for text, items in shared.value.items():
                automaton.add_word(text, items)
            automaton.make_automaton()
            for batch in batches:
                out = []
                for doc, low in zip(batch["doc_id"], batch["low"]):
                    found = {i for _, items in automaton.iter(low or "") for i in items}
                    out += [(i, doc) for i in sorted(found)]
                yield pd.DataFrame(out, columns=["item_id", "doc_id"])

        return texts.mapInPandas(run, schema)

    found = []
    for i in range(parts):
        ids: dict[str, list] = {}
        for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).collect():
            ids.setdefault(r["passage"], []).append(r["item_id"])
        if ids:
            found.append(block(ids))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def coverage(docs: DataFrame, expectations: DataFrame, **names: str) -> DataFrame:
    """(item_id, doc_id, found): for every expectation the first text that contains it."""
    hits = containing(docs, expectations, **names).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    every = expectations.select(F.col(names.get("passage_id", "item_id")).alias("item_id"))
    return every.join(hits, "item_id", "left").withColumn("found", F.col("doc_id").isNotNull())


def merged_facts(facts: DataFrame) -> DataFrame:
    """(key, label, type, confidence, source, sources) of entity rows (label, type, confidence, source, ordinal).

    Labels that differ in case are one entity: longest label, most specific type, highest confidence, first source.
    """
    kind = F.when(F.col("type").isNull() | (F.col("type") == "schema:Thing"), 0).otherwise(1)
    return facts.groupBy(F.lower(F.trim("label")).alias("key")).agg(
        F.max_by("label", F.struct(F.length("label"), -F.col("ordinal"))).alias("label"), F.max_by("type", F.struct(kind, -F.col("ordinal"))).alias("type"),
        F.max("confidence").alias("confidence"), F.min_by("source", F.when(F.trim(F.coalesce("source", F.lit(""))) != "", F.col("ordinal"))).alias("source"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
