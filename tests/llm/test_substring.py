import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import substring as S

from . import util


def brute(rows, length):
    """Spans and texts left over, by extending every window and its first occurrence word by word."""
    where = {}
    texts = {i: (t or "").split() for i, t in rows if i is not None}
    for i in sorted(texts):
        for s in range(len(texts[i]) - length + 1):
            where.setdefault(tuple(texts[i][s : s + length]), []).append((i, s))
    spans, later = {}, {}
    for places in where.values():
        (f, p), *rest = sorted(places)
        for i, s in rest:
            later.setdefault(i, set()).update(range(s, s + length))
            w, v, left, right = texts[i], texts[f], 0, length
            while s > left and p > left and w[s - left - 1] == v[p - left - 1]:
                left += 1
            while s + right < len(w) and p + right < len(v) and w[s + right] == v[p + right]:
                right += 1
            spans.setdefault(i, set()).add((s - left, s + right))
            spans.setdefault(f, set()).add((p - left, p + right))
    out = {(i, a, b, b - a, len([x for x in later.get(i, ()) if a <= x < b])) for i, own in spans.items() for a, b in own if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in own)}
    kept = {i: " ".join(x for k, x in enumerate(w) if k not in later.get(i, ())) for i, w in texts.items()}
    return out, kept


def corpus(seed):
    rng = random.Random(seed)
    passages = [util.prose(rng, rng.choice([8, 9, 12, 40])) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [util.prose(rng, rng.choice([0, 1, 5, 30]))]
        for _ in range(rng.choice([0, 1, 1, 3])):
            parts += [rng.choice(passages), util.prose(rng, rng.choice([0, 2, 20]))]
        rows.append((1000 + i, rng.choice([" ", "\n", "  "]).join(p for p in parts if p)))
    return [*rows, (2000, passages[0] * 1), (2001, "a b a b a b a b a b a b a b a b a b a b"), (2002, rows[5][1])]


@pytest.mark.parametrize("seed,length,run", [(1, 8, 3), (2, 10, 10), (3, 8, 1)])
def test_spans_equal_brute_force(spark, seed, length, run):
    df = util.docs(spark, corpus(seed))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert len({i for i, _ in rows}) == len(set(rows)) - 1  # two without an id
    got = {tuple(r) for r in S.repeats(df, length=length, seed=run).collect()}
    want, kept = brute(rows, length)
    assert got == want and len(want) > 20
    left = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in S.remove_repeats(df, length=length, seed=run).collect() if r["doc_id"] is not None}
    had = {i for i, t in rows if i is not None and not (t or "").split()}
    assert left == {i: t for i, t in kept.items() if t or i in had}


def test_awkward_rows(spark):
    df = util.docs(spark)
    out = S.remove_repeats(df)
    assert out.schema == df.schema
    rows = out.collect()
    assert len(rows) == df.count()  # nothing repeats but rows of one id, which are one document
    assert sorted(str(r["text"]) for r in rows if r["doc_id"] is None) == sorted(["no id " * 40, "None"])
    assert S.repeats(util.empty(spark)).count() == 0 and S.remove_repeats(util.empty(spark)).count() == 0


def test_passages_over_fifty_words_go_and_the_rest_stays(spark):
    rng = random.Random(9)
    passage, own = util.prose(rng, 55), [util.prose(rng, 80) for _ in range(30)]
    rows = [(i, f"{t}\n{passage}\nend {t}" if i % 3 == 0 else t) for i, t in enumerate(own)]
    left = {r["doc_id"]: r["text"] for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(passage in t for t in left.values()) == 1 and passage in left[0]
    assert all(own[i] in left[i] for i in range(30) if i % 3)


def test_neighbouring_passages_are_repeats_of_their_own(spark):
    rng = random.Random(2)
    p, q = util.prose(rng, 60), util.prose(rng, 60)
    rows = [(1, f"{p} {q}"), (2, p), (3, q)]
    got = sorted(tuple(r) for r in S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, 60, 60, 0), (1, 60, 120, 60, 0), (2, 0, 60, 60, 60), (3, 0, 60, 60, 60)]


def test_texts_of_one_id_are_cut_each_by_itself(spark):
    rng = random.Random(3)
    p, own = util.prose(rng, 60), util.prose(rng, 200)
    rows = [("1", p, b"a"), ("2", f"{p} x", b"b"), ("2", own, b"c"), ("2", own, b"d"), (None, p, b"e"), ("3", None, b"f"), ("4", "", b"g")]
    df = spark.createDataFrame(rows, "`doc.id` string, `the.text` string, __codes binary")
    out = S.remove_repeats(df, "doc.id", "the.text")
    assert out.schema == df.schema
    left = {bytes(r["__codes"]): r["the.text"] for r in out.collect()}
    assert left[b"a"] == p and left[b"b"].strip() == "x" and left[b"c"] == left[b"d"] == own and left[b"e"] == p and left[b"f"] is None and left[b"g"] == ""
    assert {tuple(r)[:3] for r in S.repeats(df, "doc.id", "the.text").collect()} == {("1", 0, 60), ("2", 0, 60)}
    numbers = spark.createDataFrame([(1, p), (2, p + " x"), (2, own)], "doc_id long, text string")
    assert sorted(r["text"].strip() for r in S.remove_repeats(numbers).collect()) == sorted([p, "x", own])


def test_texts_are_cut_a_chunk_at_a_time():
    first = " ".join(f"p{k}" for k in range(60))
    texts = [first, first, *(f"{first} own{i} " + "x" * 20_000 for i in range(2, 600)), None, "alone"]
    n = len(texts)
    later = S._packed(np.zeros(1, np.int64), np.array([11]), np.zeros(1, np.int64), np.zeros(1, np.int64)).tobytes()
    runs = [later] * (n - 2) + [None, None]
    names = ["c0", "c1", "c2", "doc", "runs"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts), pa.array(["en"] * n), pa.array(range(n)), pa.array(runs, pa.binary())], names=names)
    parts = list(S._without_repeats(batch, 1, 50))
    assert batch.column("c1").nbytes > 5 * S.K.CHUNK_BYTES and max(p.column("c1").nbytes for p in parts) < 1.1 * S.K.CHUNK_BYTES
    got = pa.Table.from_batches(parts)
    assert got.column_names == names[:3]
    # the first keeps its passage, the second has nothing else
    want = [first, *(f"own{i} " + "x" * 20_000 for i in range(2, 600)), None, "alone"]
    assert got.column("c1").to_pylist() == want and got.column("c0").to_pylist() == [0, *range(2, n)]
