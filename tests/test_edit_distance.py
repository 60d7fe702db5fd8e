"""Edit distances in characters, of terms in any alphabet."""

from graphloom.operators import terms
from graphloom.plans import catalog, ranking


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_accented_terms_are_matched(spark, tmp_path):
    words = "therre thérre thèrrê inenn ínénn stelp stélp štělp ステルプ erane éràne êrânê erané ther thér érane other".split()
    spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.QUERIES["edit_distance_join"](spark, str(tmp_path)).collect()]
    asked = terms.terms_of(ranking.MISSPELT)
    want = {(q, w, edits(q, w)) for q in asked for w in words if min(len(q), len(w)) >= 4 and edits(q, w) <= 2}
    assert set(got) == want and len(got) == len(want)
    assert ("therre", "thérre", 1) in want and ("stelp", "štělp", 2) in want
