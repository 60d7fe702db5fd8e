"""Related documents against plain Python."""

import math
import re
from collections import Counter

from graphloom.operators import terms
from graphloom.plans import catalog


def nearest(texts, k):
    """The k nearest other texts of each, by tf-idf distance, with ties by id."""
    tf = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in texts.items()}
    df = Counter(w for c in tf.values() for w in c)
    unit = {}
    for i, c in tf.items():
        w = {t: n * (math.log((len(texts) + 1) / (df[t] + 1)) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit[i] = {t: x / norm for t, x in w.items()}
    out = {}
    for a in unit:
        if unit[a]:
            far = sorted((round(math.sqrt(max(0, 2 - 2 * sum(x * unit[b].get(t, 0) for t, x in unit[a].items()))), 6), b) for b in unit if b != a and unit[b])
            out |= {(a, r): (b, d) for r, (d, b) in enumerate(far[:k], 1)}
    return out


TEXTS = {100: "red stone path", 2: "red stone path", 3: "red stone wall élan", 4: "blue sea", 5: None, 6: "blue blue sea wall", 7: "alone", 200: "the red sea"}


def alike(rows, want):
    got = {(r["doc_id"], r["rank"]): (r["related_id"], r["distance"]) for r in rows}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_every_text_and_those_asked_have_related_ones(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = nearest(TEXTS, 3)
    alike(terms.related(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect(), want)
    alike(catalog.QUERIES["related_documents"](spark, str(tmp_path)).collect(), {k: v for k, v in want.items() if k[0] % 100 == 0})
