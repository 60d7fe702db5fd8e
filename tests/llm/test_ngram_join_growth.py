"""What the join moves for large tables: counters, candidates and pairs outside of blocks."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.llm import ngram_join as J

from . import util


def test_counters_travel_packed(spark):
    rows = J.profile(J._keyed(util.docs(spark), "doc_id", "text"), 3, J.SKETCH_BITS)
    tasks = rows.where("block = -1").count()
    moved = rows.where("block >= 0").agg(F.sum(F.length("data"))).first()[0]
    assert tasks and moved < tasks * (4 << J.SKETCH_BITS) / 16
    (ranks, words), sizes, total, _ = J._merged_sketch(rows, J.SKETCH_BITS)
    want = [r["text"].split() for r in util.docs(spark).collect() if r["doc_id"] is not None and (r["text"] or "").split()]
    assert sizes.sum() == len(want) and total == sum(len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) for w in want)
    h = K.word_hashes(util.docs(spark).where("doc_id = 6").toArrow().column("text").combine_chunks())[0]
    assert (words[(h >> np.uint64(64 - J.WORD_BITS)).astype(np.int64)] > 0).all() and len(ranks) == 1 << J.SKETCH_BITS


def test_counters_of_any_size_are_packed_without_loss():
    counts = np.random.default_rng(1).integers(0, 2**31 - 1, 1 << J._BLOCK_BITS).astype(np.int32)
    assert (J._unpacked(J._packed(counts)) == counts).all()


def test_near_copies_lie_within_blocks(spark):
    rng = random.Random(11)
    rows = []
    for g in range(3):
        base = util.prose(rng, 150, 100_000).split()
        for i in range(120):
            words = list(base)
            for at in rng.sample(range(150), rng.choice([3, 9, 11])):
                words[at] = f"edit{rng.randrange(10**9)}"
            rows.append((1000 * g + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, _, within, across = J._joined(df, "doc_id", "text", J.GRAM, J.THRESHOLD, J.BLOCK, J._LABELS_SENT, False)
    inside, outside = within.count(), across.count()
    assert inside + outside > 10_000 and outside < 0.01 * (inside + outside), (inside, outside)


def test_a_task_holds_few_pairs_at_once():
    n = 3000
    sig = np.arange(1, n + 1, dtype=np.uint64)
    met = list(J._meet(np.full(n, 8, np.uint32), sig, np.full(n, 100, np.int64), np.zeros(n, np.uint64), J.THRESHOLD))
    assert sum(len(x[1]) for x in met) == n * (n - 1) // 2
    assert max(len(x[1]) for x in met) <= 300_000


def test_memory_of_grams_grows_with_the_grams_alone(spark):
    rng = random.Random(3)
    texts = pa.chunked_array([pa.array([util.prose(rng, 400, 100_000) for _ in range(2500)])])
    tracemalloc.start()
    of, value = J._distinct_grams(texts, J.GRAM)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.diff(of) >= 0).all() and len(np.unique(np.stack([of.astype(np.uint64), value]), axis=1).T) == len(of) > 900_000
    assert peak < 64 * len(of), peak / len(of)
    # a task has two pieces at most
    assert J.PIECE_GRAMS <= 500_000 and J.BLOCK <= 2048


def test_two_subsets_of_many_sets_are_made_a_few_at_a_time():
    sets, grams = 400, 100
    value = K.mix(np.arange(sets * grams, dtype=np.uint64))
    made = list(J._subsets(value, np.arange(sets) * grams, np.full(sets, grams), 100, J.THRESHOLD))
    assert sum(len(rows) for _, rows in made) == sets and {k.shape[1] for k, _ in made} == {47 * 46 // 2}
    assert len(made) > 1 and max(k.size for k, _ in made) <= J._HELD
