import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality as Q

from . import util


def paths(field, e):
    """Log weight of every labelling of one text's lines."""
    out = {}
    for states in itertools.product((0, 1), repeat=len(e)):
        out[states] = sum(e[i][s] for i, s in enumerate(states)) + sum(field.moves[a][b] for a, b in zip(states, states[1:]))
    return out


def test_marginals_equal_those_over_all_labellings():
    rng = np.random.default_rng(3)
    field = Q.Field(np.zeros((Q.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    lengths = [1, 4, 2, 6]
    of = np.repeat(np.arange(4), lengths)
    e = rng.normal(size=(len(of), 2))
    p, _, total = field.marginals(e, of)
    logs = 0.0
    for doc in range(4):
        weights = paths(field, e[of == doc])
        z = sum(map(math.exp, weights.values()))
        logs += math.log(z)
        for line in range(lengths[doc]):
            good = sum(math.exp(w) for s, w in weights.items() if s[line] == 1) / z
            assert abs(p[of == doc][line, 1] - good) < 1e-9
    assert abs(total - logs) < 1e-9


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 2:
            text = "\n".join(" ".join(rng.choice(["CLICK", "$$$", "@@", "7781", "BUY", "!!!", "##"]) for _ in range(9)) for _ in range(rng.randint(1, 6)))
        else:
            text = "\n".join(util.prose(rng, rng.randint(6, 14)).capitalize() + "." for _ in range(rng.randint(1, 6)))
        rows.append((i, text))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    field = Q.train(docs, labels)
    fresh = spark.createDataFrame(corpus(2, 200), "doc_id long, text string")
    got = {r["doc_id"]: r["quality_keep"] for r in Q.score(fresh, field).collect()}
    right = sum(keep == (i % 2 == 0) for i, keep in got.items())
    assert len(got) == 200 and right >= 190
    assert sum(got[i] for i in range(0, 200, 2)) >= 98  # clean documents stay


def test_awkward_rows(spark):
    df = util.docs(spark)
    labels = spark.createDataFrame([(100, 1), (100, 1), (101, 0), (102, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    field = Q.train(df, labels)
    rows = Q.score(df, field).collect()
    assert len(rows) == df.count()
    for r in rows:
        blank = not (r["text"] or "").strip()
        assert (r["quality_score"] is None) == blank and not (blank and r["quality_keep"])
        assert r["bucket"] == 7 and r["hash"] == 9
    assert Q.score(util.empty(spark), field).count() == 0
    assert Q.train(util.empty(spark), labels) is None
    unfit = Q.score(df, None).where("trim(text) = 'one'").select("quality_score", "quality_keep").first()
    assert tuple(unfit) == (1.0, True)
    with pytest.raises(ValueError):
        Q.score(df.withColumn("quality_keep", F.lit(1)), field)


def test_batches_do_not_matter(spark):
    rows = util.awkward()
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(20)], "doc_id long, quality int")
    one = spark.createDataFrame(rows, util.DOCS).coalesce(1)
    field = Q.train(one, labels)
    key = lambda df: sorted((str(r["doc_id"]), str(r["quality_score"])) for r in Q.score(df, field).collect())
    assert key(one) == key(one.repartition(7))


def test_labelled_texts_that_repeat_or_are_long(spark):
    rows = corpus(1, 120)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = spark.createDataFrame([*rows, (3, "another text\n" * 3), (0, "line\n" * (Q.MAX_LINES + 5))], "doc_id long, text string")
    one, two = Q.train(docs, labels), Q.train(docs.repartition(5), labels)
    assert one.cut == two.cut and (one.weights == two.weights).all()


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, "A fine line of text.", "x")], "`doc.id` int, `the.text` string, c0 string")
    out = Q.score(df, None, "the.text")
    assert out.columns == [*df.columns, "quality_score", "quality_keep"] and out.first()["quality_score"] == 1.0
