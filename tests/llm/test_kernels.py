import random
import re

import numpy as np
import pyarrow as pa

from graphloom.llm import kernels as K


def texts(n=2000):
    rng = random.Random(1)
    return ["".join(rng.choice("ab é\n\t\x0b") for _ in range(rng.randint(0, 30))) for _ in range(n)] + [None, "", "abc", "x" * 50 + " " + "y" * 9]


def test_words_match_a_regular_expression():
    t = texts()
    data, offsets = K.flat(pa.array(t))
    starts, ends, doc = K.words(data, offsets)
    got = [(int(d), bytes(data[a:b]).decode()) for a, b, d in zip(starts, ends, doc)]
    assert got == [(i, w) for i, x in enumerate(t) for w in re.split(K.SPACES, x or "") if w]


def test_hashes_tell_words_and_runs_apart():
    data, offsets = K.flat(pa.array(texts(500)))
    starts, ends, _ = K.words(data, offsets)
    h = K.span_hashes(data, starts, ends)
    by = {}
    for x, a, b in zip(h.tolist(), starts, ends):
        assert by.setdefault(bytes(data[a:b]), x) == x
    assert len(set(by.values())) == len(by)
    for n in (1, 2, 3, 5, 16, 50):
        runs = K.run_hashes(h, n)
        seen = {}
        for j in range(len(runs)):
            assert seen.setdefault(tuple(h[j : j + n].tolist()), int(runs[j])) == int(runs[j])
        assert len(set(seen.values())) == len(seen) and len(runs) == max(0, len(h) - n + 1)


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["x" * 100, None, "", "y" * 5000, "z"])})
    parts = list(K.chunks(batch, "t", 150))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist() and len(parts) > 1
    assert np.array_equal(K.flat(batch.column(0).slice(3, 2))[1], [0, 5000, 5001])
