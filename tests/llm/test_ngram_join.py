import itertools
import random

import pytest

from graphloom.llm import ngram_join as J

from . import util


def gram_set(text, n):
    w = (text or "").split()
    return frozenset([" ".join(w)] if 0 < len(w) < n else (" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))


def brute(rows, n, t):
    """Pairs of class heads, and head with members."""
    sets, pairs = {}, {}
    for i, text in {(i, text) for i, text in rows if i is not None}:
        s = gram_set(text, n)
        if s:
            sets.setdefault(s, set()).add(i)
    heads = {min(ids): s for s, ids in sets.items()}
    for a, b in itertools.combinations(sorted(heads), 2):
        x, y = heads[a], heads[b]
        if (j := len(x & y) / len(x | y)) >= t - 1e-12:
            pairs[a, b] = j
    for ids in sets.values():
        for i in ids - {min(ids)}:
            pairs[min(ids), i] = 1.0
    return pairs


def copies(seed, groups=12, short=False):
    """Groups of copies with edits, of all sizes, and passages that many share."""
    rng, out, at = random.Random(seed), [], 1000
    passage = util.prose(rng, 40, 500)
    for g in range(groups):
        base = util.prose(rng, rng.choice([2, 3, 4, 6, 9] if short else [4, 8, 20, 60, 200]), 500).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 12])):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(9)
            text = " ".join(w)
            out.append((at, f"{passage}\n{text}" if rng.random() < 0.3 else text))
            at += 1
    return out


@pytest.mark.parametrize("seed,short,t,n", [(1, False, 0.55, 3), (2, True, 0.55, 3), (3, False, 0.8, 2), (4, True, 0.3, 1), (5, False, 0.5, 5)])
@pytest.mark.parametrize("block,sent", [(4096, 2_000_000), (3, 0)])
def test_all_pairs(spark, seed, short, t, n, block, sent):
    df = util.docs(spark, copies(seed, short=short))
    got = {(r["doc_id_a"], r["doc_id_b"]): r["jaccard"] for r in J.jaccard_join(df, n=n, t=t, block=block, labels_sent=sent).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], n, t)
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def closure(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in list(parent)}


def brute_links(rows, n, t):
    """(id, class, links) of distinct (id, text) rows by comparing all of them."""
    docs = sorted({(i, text) for i, text in rows if i is not None and (text or "").split()})
    sets = [gram_set(text, n) for _, text in docs]
    near = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12]
    heads, count = closure(near), [0] * len(docs)
    for pair in near:
        for x in pair:
            count[x] += 1
    return sorted((docs[x][0], docs[heads[x]][0], count[x]) for x in heads)


@pytest.mark.parametrize("seed,short,t,n,block,sent", [(1, False, 0.55, 3, 4096, 2_000_000), (2, True, 0.55, 3, 3, 0), (3, False, 0.8, 2, 3, 2_000_000), (4, True, 0.3, 1, 4096, 0)])
def test_links_and_classes(spark, seed, short, t, n, block, sent):
    extra = copies(seed, short=short) + [(5000 + i, "a b c d e f g h i j k l m n o p q r s t") for i in range(5)] + [(5010, "a b c d e f g h i j k l m n o p q r s z")]
    extra += [(5000, "one two three four five six seven"), (5020, "one two three four five six seven"), (5021, "one two three four five six seven eight")]
    df = util.docs(spark, extra)
    got = sorted(tuple(r) for r in J.links(df, n=n, t=t, block=block, labels_sent=sent).collect())
    assert got == brute_links([(r["doc_id"], r["text"]) for r in df.collect()], n, t) and len(got) > 10


def test_groups_and_kept_documents(spark):
    df = util.docs(spark, copies(7))
    want = closure(brute([(r["doc_id"], r["text"]) for r in df.collect()], J.GRAM, J.THRESHOLD))
    assert {r["id"]: r["head"]["id"] for r in J.groups(df).collect()} == want
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    all_ids = {r["doc_id"] for r in df.collect()}
    assert {i for i in ids if i is not None} == {i for i in all_ids if i is not None and want.get(i, i) == i}
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and ids.count(None) == 2


def test_texts_of_one_id_are_judged_each_by_itself(spark):
    rng = random.Random(3)
    p, own, x = util.prose(rng, 60), util.prose(rng, 200), util.prose(rng, 40)
    rows = [("1", p, 0), ("2", p + " tail", 1), ("2", own, 2), ("3", x, 3), ("3", x, 3), ("3", x, 4), ("4", None, 5)]
    df = spark.createDataFrame(rows, "`doc.id` string, `the text` string, gone_id int")
    left = sorted((r[0], r[1], r[2]) for r in J.keep_one(df, "doc.id", "the text").collect() if r[1] is not None)
    assert left == sorted([("1", p, 0), ("2", own, 2), ("3", x, 3), ("3", x, 4)])
    assert J.keep_one(df, "doc.id", "the text").columns == df.columns and [tuple(r) for r in J.links(df, "doc.id", "the text").orderBy("doc_id").collect()] == [("1", "1", 1), ("2", "1", 1)]


@pytest.mark.parametrize("seed", range(4))
def test_components_on_the_cluster_equal_those_on_the_driver(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    edges = spark.createDataFrame(pairs, "doc_id_a long, doc_id_b long")
    assert dict(J.components(edges, 0).collect()) == dict(J.components(edges).collect()) == closure(pairs)


def test_no_documents(spark):
    assert J.jaccard_join(util.empty(spark)).count() == 0 and J.links(util.empty(spark)).count() == 0
    assert J.keep_one(util.empty(spark)).count() == 0
