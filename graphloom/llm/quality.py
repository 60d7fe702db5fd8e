"""Document quality from a linear-chain conditional random field over lines.

Every line of a text gets a good or bad state. Its features are taken from the line itself, from the lines before and
after it and from the document; they are computed for whole Arrow batches at once. Forward-backward gives each line's
marginal probability of being good; their mean, weighted by line length, is the document's quality.

The field is fitted on at most ``MAX_TRAIN`` labelled documents (those with the least hash of their id), a line taking
the label of its document; of these every fifth is held out and gives the cut below which a document is rejected: the
greatest that keeps ``KEEP`` of the good ones, or the middle of the gap where good and bad do not overlap.

Defined cases: a null or blank text has no lines; its quality is null and it is rejected. A null label, or a label of
a document that isn't there, isn't used; repeated labels count once; of several texts
of one labelled id the one with the least hash is used. With no usable labels of both kinds there is no
model, and every document with text has quality 1. Ties at the cut are kept. Repeated rows are scored alike. Other
columns pass through; a column named ``quality_score`` or ``quality_keep`` in the input raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .lineage import positional

MAX_TRAIN = 4000
#: Labelled documents of more lines take no part in the fit, so what comes to the driver is bounded. Scoring has no bound.
MAX_LINES = 400
KEEP = 0.995
#: Features of a line itself.
_OWN = 10
N_FEATURES = 1 + 3 * _OWN + 3

_UPPER, _LOWER, _DIGIT, _MARK, _STOP = (np.zeros(256, np.int8) for _ in range(5))
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_LOWER[128:] = 1
_DIGIT[48:58] = 1
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = 1
_STOP[[ord(c) for c in ".,;:'\"()-?"]] = 1


def _sums(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(table[data], out=total[1:], dtype=np.int32)
    return (total[ends] - total[starts]).astype(np.float32)


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, text index and length (bytes) of every line that has a word."""
    data, offsets = K.flat(texts)
    size = int(offsets[-1])
    starts, ends, doc = K.words(data, offsets)
    if not len(starts):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32)
    breaks = np.flatnonzero(data[:size] == 10)
    line_of_word = np.searchsorted(breaks, starts) + doc  # a new text is a new line too
    first = np.flatnonzero(np.concatenate([[True], line_of_word[1:] != line_of_word[:-1]]))
    n_words = np.diff(np.concatenate([first, [len(starts)]])).astype(np.float32)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    begin, stop, of = starts[first], ends[last], doc[first]
    length = (stop - begin).astype(np.float32)
    hashes = K.span_hashes(data, starts, ends)
    line_id = np.repeat(np.arange(len(first)), n_words.astype(np.int64))
    # repeated words of a line: words less distinct ones
    key = K.join_hashes(hashes, line_id.astype(np.uint64))
    order = np.sort(key)
    # distinct by line: sort once, keep the line in a parallel order
    perm = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], order[1:] != order[:-1]])
    distinct = np.bincount(line_id[perm[fresh]], minlength=len(first)).astype(np.float32)
    marked = np.bincount(line_id, weights=_MARK[data[np.maximum(ends - 1, 0)]], minlength=len(first)).astype(np.float32)
    shouted = np.bincount(line_id, weights=_UPPER[data[starts]] & _UPPER[data[np.maximum(ends - 2, starts)]], minlength=len(first)).astype(np.float32)
    lone = np.bincount(line_id, weights=((ends - starts) == 1) & (_MARK[data[starts]] > 0), minlength=len(first)).astype(np.float32)
    line_hash = np.add.reduceat(hashes, first)
    dkey = K.join_hashes(line_hash, of.astype(np.uint64))
    _, back, counts = np.unique(dkey, return_inverse=True, return_counts=True)
    own = np.stack(
        [
            _sums(_UPPER, data, begin, stop) / length,
            _sums(_MARK, data, begin, stop) / length,
            _sums(_DIGIT, data, begin, stop) / length,
            _sums(_STOP, data, begin, stop) / length,
            marked / n_words,
            shouted / n_words,
            lone / n_words,
            (1 - distinct / n_words) * np.minimum(1, n_words / 8),
            np.log1p(length) / 8,
            (counts[back] > 1).astype(np.float32),
        ],
        1,
    ).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = of[1:] == of[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    edge_first = np.concatenate([[True], ~same]).astype(np.float32)
    edge_last = np.concatenate([~same, [True]]).astype(np.float32)
    n_lines = np.bincount(of, minlength=len(texts))[of]
    return np.concatenate([np.ones((len(own), 1), np.float32), own, before, after, np.stack([edge_first, edge_last, np.log1p(n_lines) / 8], 1)], 1).astype(np.float32), of, length


def _lanes(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each document, longest first."""
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    count = np.diff(np.concatenate([first, [len(of)]]))
    order = np.argsort(-count, kind="stable")
    return first[order], count[order]


@dataclass
class Field:
    """weights: N_FEATURES by 2 states (0 bad, 1 good); moves: state to next state."""

    weights: np.ndarray
    moves: np.ndarray
    cut: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights if self.mean is not None else x @ self.weights

    def marginals(self, e: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(state) of every line, expected moves, log partition sum; all documents advance together."""
        n = len(e)
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        if not n:
            return fwd, np.zeros((2, 2)), 0.0
        first, count = _lanes(of)
        active = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")
        fwd[first] = e[first]
        for t in range(1, count[0]):
            at = first[: active[t]] + t
            fwd[at] = np.logaddexp(fwd[at - 1, :1] + self.moves[0], fwd[at - 1, 1:] + self.moves[1]) + e[at]
        for t in range(count[0] - 2, -1, -1):
            at = first[: active[t + 1]] + t
            after = bwd[at + 1] + e[at + 1]
            bwd[at] = np.logaddexp(after[:, :1] + self.moves[:, 0], after[:, 1:] + self.moves[:, 1])
        total = np.logaddexp(fwd[:, 0] + bwd[:, 0], fwd[:, 1] + bwd[:, 1])
        p = np.exp(fwd + bwd - total[:, None])
        inner = np.flatnonzero(np.concatenate([of[1:] == of[:-1], [False]]))
        pair = fwd[inner][:, :, None] + self.moves + (e + bwd)[inner + 1][:, None, :] - total[inner][:, None, None]
        return p, np.exp(pair).sum(0), float(total[first].sum())

    def quality(self, x: np.ndarray, of: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
        """Length-weighted mean marginal of each of n texts; nan without lines."""
        p, _, _ = self.marginals(self.emissions(x).astype(float), of)
        weight = np.bincount(of, weights=length, minlength=n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.bincount(of, weights=length * p[:, 1], minlength=n) / np.where(weight > 0, weight, np.nan)


def fit(x: np.ndarray, of: np.ndarray, state: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> Field:
    """Maximum penalised likelihood by Adam on the full gradient; classes weigh alike."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-4] = 1
    field = Field(np.zeros((x.shape[1], 2)), np.zeros((2, 2)), mean=mean, scale=scale)
    z = (x - mean) / scale
    gold = np.eye(2)[state]
    inner = np.flatnonzero(of[1:] == of[:-1])
    gold_moves = np.zeros((2, 2))
    np.add.at(gold_moves, (state[inner], state[inner + 1]), 1)
    n = len(x)
    m, v = [np.zeros_like(field.weights), np.zeros((2, 2))], [np.zeros_like(field.weights), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        p, moves, _ = field.marginals(z @ field.weights, of)
        grads = [z.T @ (gold - p) / n - ridge * field.weights, (gold_moves - moves) / n - ridge * field.moves]
        for i, (g, w) in enumerate(zip(grads, (field.weights, field.moves))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            w += 0.15 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return field


def choose_cut(score: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """The middle of the gap between the KEEP-quantile of the good and the bad below it."""
    low = np.sort(score[good])[int((1 - keep) * good.sum())]
    below = score[~good & (score < low)]
    return float((low + below.max()) / 2) if len(below) else float(low)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Field | None:
    """A field from ``labels`` (doc_id, quality); only features of the bounded sample come to the driver."""
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text"), "text")).alias("own"))
    texts = texts.select("doc_id", "y", F.col("own.text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, "text"):
                x, of, length = line_features(part.column("text"))
                n = np.bincount(of, minlength=part.num_rows)
                at = np.concatenate([[0], np.cumsum(n)])
                rows = np.flatnonzero((n > 0) & (n <= MAX_LINES))
                blobs = ([v[at[i] : at[i + 1]].tobytes() for i in rows] for v in (x, length))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in ("doc_id", "y")), *(pa.array(v, pa.binary()) for v in blobs)], names=["doc_id", "y", "x", "length"])

    id_type, y_type = docs.schema["doc_id"].dataType, sample.schema["y"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("y", y_type), T.StructField("x", T.BinaryType()), T.StructField("length", T.BinaryType())])
    rows = sorted(texts.select("doc_id", "y", "text").mapInArrow(features, schema).collect(), key=lambda r: r["doc_id"])
    if len({r["y"] for r in rows}) < 2:
        return None
    held = rows[::5] if len({r["y"] for r in rows[::5]}) == 2 else rows
    own = [r for i, r in enumerate(rows) if i % 5] if held is not rows else rows
    if len({r["y"] for r in own}) < 2:
        own = rows

    def gather(some: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        xs = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, N_FEATURES) for r in some]
        n = [len(x) for x in xs]
        return np.concatenate(xs), np.repeat(np.arange(len(some)), n), np.repeat([int(r["y"]) for r in some], n), np.concatenate([np.frombuffer(bytes(r["length"]), np.float32) for r in some])

    x, of, state, _ = gather(own)
    field = fit(x, of, state)
    x, of, _, length = gather(held)
    field.cut = choose_cut(field.quality(x, of, length, len(held)), np.array([r["y"] == 1 for r in held]))
    return field


def score(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (null without words) and ``quality_keep``; a narrow map."""
    for name in ("quality_score", "quality_keep"):
        if name in docs.columns:
            raise ValueError(f"column {name} exists")
    at, names, docs = docs.columns.index(text_col), docs.columns, positional(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part in K.chunks(batch, f"c{at}"):
                x, of, length = line_features(part.column(at))
                if field is None:
                    q = np.where(np.bincount(of, minlength=part.num_rows) > 0, 1.0, np.nan)
                else:
                    q = field.quality(x, of, length, part.num_rows)
                parts.append(q)
            q = np.concatenate(parts) if parts else np.zeros(0)
            keep = np.nan_to_num(q, nan=-1.0) >= (field.cut if field is not None else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(q, 6), pa.float64(), from_pandas=True), pa.array(keep)], names=[*batch.schema.names, "quality_score", "quality_keep"])

    return docs.mapInArrow(run, schema).toDF(*names, "quality_score", "quality_keep")
