"""The pipeline's stages against plain Python."""

import itertools
import random

import corpus_pipeline as C
from graphloom.llm import bpe, ngram_join, packing, pii, quality
from tests.llm import test_ngram_join, test_sharding_packing, test_substring, util  # noqa: F401


def corpus():
    rng = random.Random(21)
    prose = lambda n: "\n".join(util.prose(rng, 12).capitalize() + "." for _ in range(n))
    shared = util.prose(rng, 60)
    rows = [(i, prose(rng.randint(2, 9))) for i in range(40)]
    rows += [(100 + i, "\n".join("$$ CLICK @@ 99 BUY !!!" for _ in range(4)) + f" {i}") for i in range(40)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " extra"), (202, prose(3) + "\n" + shared), (203, prose(2) + "\n" + shared), (204, prose(2) + "\nmail ann@corp.example.org now"), (205, None), (206, "  "), (None, prose(3))]
    rows.append(rows[5])
    rows += [(3, prose(4)), (207, shared + " tail"), (207, prose(5))]  # ids with a text that is a copy, and one of their own
    return rows


def test_stages_and_run(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, t in rows if i is not None and i < 140], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, ids = df, lambda d: sorted(str(r["doc_id"]) for r in d.collect())
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality classifier":
            assert not {str(i) for i in range(100, 140)} & set(ids(docs)) and "205" not in ids(docs) and {"0", "5", "203", "None"} <= set(ids(docs))
        # a document is an id with a text
        had = sorted({(r["doc_id"], r["text"]) for r in before.collect() if r["doc_id"] is not None})
        left = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None)
        if name == "n-gram Jaccard join":
            sets = [test_ngram_join.gram_set(t, ngram_join.GRAM) for _, t in had]
            near = [(i, j) for i, j in itertools.combinations(range(len(had)), 2) if len(sets[i] & sets[j]) >= ngram_join.THRESHOLD * len(sets[i] | sets[j])]
            head = test_ngram_join.closure(near)
            assert left == [d for i, d in enumerate(had) if head.get(i, i) == i]
            assert not {200, 201} & {i for i, _ in left} and [i for i, _ in left].count(3) == 2 and (207, rows[-1][1]) in left
        if name == "substring dedup":
            _, kept = test_substring.brute([(d, d[1]) for d in had], 50)
            assert sorted((i, " ".join(t.split())) for i, t in left) == sorted((d[0], t) for d, t in kept.items() if t)
            assert (207, rows[-1][1]) in left
        if name == "PII":
            assert "[EMAIL]" in docs.where("doc_id = 204").first()["text"]
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    want = {(r["doc_id"], len(r["token_ids"])) for r in bpe.encode(docs).collect() if r["token_ids"]}
    got = [r.asDict() for r in C.run(spark, str(tmp_path)).collect()]
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == want  # no document here is longer than a window
    by = {}
    for r in got:
        by.setdefault(r["window_id"], []).append((r["window_offset"], r["n_tokens"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    assert pii.TYPES and quality.KEEP < 1
