import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, dac

from . import util


def merged(piece, ranks):
    """Byte pairs merged in rank order, the plain way."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_backtracking_equals_merging():
    tokens = bpe.load_ranks(bpe.VOCABULARY)
    ranks, encoder = {t: i for i, t in enumerate(tokens)}, bpe.encoder(bpe.VOCABULARY)
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"abcdeinrst ") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    pieces += [bytes(rng.randrange(256) for _ in range(rng.randint(1, 20))) for _ in range(200)]
    pieces += [rng.choice(tokens) + rng.choice(tokens) for _ in range(300)] + [b"a" * 500, b" " * 300]
    for p in pieces:
        assert encoder.encode(p) == merged(p, ranks), p


def test_texts_round_trip_and_equal_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(bpe.VOCABULARY))}, special_tokens={})
    extra = [(700, "it's  12 o'clock\n\n\tnaïve — 東京 🙂 don't stop"), (701, "   "), (702, "x" * 3000), (703, "<|endoftext|>")]
    df = util.docs(spark, extra)
    coded = bpe.encode(df)
    for r in bpe.decode(coded).collect():
        assert r["decoded"] == r["text"] and (r["token_ids"] is None) == (r["text"] is None)
        assert r["text"] is None or r["token_ids"] == own.encode_ordinary(r["text"])
    assert bpe.decode(bpe.encode(util.empty(spark))).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("token_ids", F.lit(1)))


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 2**31 - 1, 2**32 + 5, 2**63 - 1])
def test_any_token_without_decoding(top):
    rng = np.random.default_rng(top)
    lists = [rng.integers(0, top, n).tolist() for n in (0, 1, 511, 512, 513, 5000)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    for ids, blob in zip(lists, dac.encode_many(np.array([i for x in lists for i in x], np.int64), offsets)):
        reader = dac.Reader(blob)
        assert len(reader) == len(ids) and reader.ids().tolist() == ids
        assert all(reader[i] == ids[i] for i in range(0, len(ids), 97))
        with pytest.raises(IndexError):
            reader[len(ids)]
        places = np.array([-1, len(ids), *range(0, len(ids), 61)])
        assert dac.read_many([blob] * len(places), places).tolist() == [-1, -1, *(ids[i] for i in range(0, len(ids), 61))]


def test_mixed_blobs_are_read_at_once():
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 10 ** int(rng.integers(1, 12)), int(rng.integers(0, 2000))).tolist() for _ in range(80)]
    blobs = dac.encode_many(np.array([i for x in lists for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))
    places = np.array([int(rng.integers(-1, len(x) + 1)) for x in lists])
    assert dac.read_many(blobs, places).tolist() == [x[p] if 0 <= p < len(x) else -1 for x, p in zip(lists, places.tolist())]


def test_pieces_that_only_share_a_hash_keep_their_ids(monkeypatch):
    texts = pa.array(["alpha beta gamma delta", "beta beta  epsilon", None, "zeta"])
    want = [x.tolist() for x in bpe.Codec(bpe.VOCABULARY).encode(texts)]
    monkeypatch.setattr(bpe.K, "span_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64) + (ends - starts > 5))
    poor = bpe.Codec(bpe.VOCABULARY)
    for _ in range(2):
        assert [x.tolist() for x in poor.encode(texts)] == want
    assert poor.counts(texts).tolist() == np.diff(want[1]).tolist()


def test_codes_of_tables(spark):
    df = util.docs(spark)
    rows = dac.tokenise(df).collect()
    ids = {r["text"]: r["token_ids"] for r in bpe.encode(df).collect()}
    want = sorted((str(r["doc_id"]), str(None if r["text"] is None else len(ids[r["text"]]))) for r in df.collect())
    assert sorted((str(r["doc_id"]), str(r["n_tokens"])) for r in rows) == want
    assert all((r["dac"] is None) == (r["n_tokens"] is None) for r in rows)
    by = {r["doc_id"]: dac.Reader(r["dac"]).ids().tolist() for r in rows if r["dac"] is not None and r["doc_id"]}
    assert all(by[r["doc_id"]] == ids[r["text"]] for r in df.where("text IS NOT NULL AND doc_id IS NOT NULL").collect())
    lists = spark.createDataFrame([([1, None, 300],), (None,), ([],)], "ids array<int>")
    got = dac.token_at(dac.encode(lists, "ids").withColumn("i", F.lit(2)), "dac", "i").collect()
    assert sorted(str(r["token_id"]) for r in got) == ["300", "None", "None"]
    assert dac.tokenise(util.empty(spark)).count() == 0


def test_decoder_takes_ranges():
    values = np.arange(50)
    got = bpe.take_ranges(values, np.array([5, 0, 49]), np.array([3, 0, 1]))
    assert got.tolist() == [5, 6, 7, 49]
    assert pa.array(got).type == pa.int64()


def test_pieces_that_are_dropped_are_encoded_anew(monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 40)
    rng = random.Random(6)
    small, plain = bpe.Codec(bpe.VOCABULARY), bpe.library(bpe.VOCABULARY)
    for n in range(12):
        texts = [util.prose(rng, 15, 30) + f" only{n}x" for _ in range(3)]
        ids, offsets = small.encode(pa.array(texts))
        data, ends = bpe.decoder(bpe.VOCABULARY).decode(ids.astype(np.int64), offsets)
        assert [data.tobytes()[a:b].decode() for a, b in zip(ends, ends[1:])] == texts
        bytes_, starts = bpe.K.flat(pa.array(texts))
        begin, stop = bpe.pieces(bytes_, starts)
        assert ids.tolist() == [i for a, b in zip(begin, stop) for i in plain(bytes_.tobytes()[a:b])]
