import math
import struct

import numpy as np
import pytest

from graphloom.llm import embed as E
from graphloom.llm import media as M
from graphloom.llm import media_fixture as X

VECTORS = "vec_id long, embedding array<float>, list int, kind int, id long, v binary"


def vectors(seed, n, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n - 3, 5):
        x[i + 1] = x[i] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.4])
        x[i + 2] = x[i] * 3
    return x.astype(np.float32)


def brute_links(x, ids, t=E.THRESHOLD):
    """{id: (least id of its group, links)} by comparing all vectors."""
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= t - 1e-7
    np.fill_diagonal(near, False)
    head = np.array(ids)
    for _ in ids:
        head = np.minimum(head, np.where(near, head[None, :], max(ids)).min(1))
    return {ids[i]: (int(head[i]), int(near[i].sum())) for i in range(len(ids)) if near[i].any()}


@pytest.mark.parametrize("seed,n,piece", [(1, 400, E.PIECE), (2, 900, 7), (3, 12, E.PIECE)])
def test_recall_and_exactness(spark, seed, n, piece):
    x = vectors(seed, n)
    rows = [(i, v.tolist(), 1, 2, 3, b"") for i, v in enumerate(x)]
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in E.near_links(spark.createDataFrame(rows, VECTORS).repartition(3), piece=piece).collect()}
    want = brute_links(x, list(range(n)))
    assert want and got.keys() <= want.keys() and all(got[i][1] <= want[i][1] for i in got)
    found, true = sum(v[1] for v in got.values()), sum(v[1] for v in want.values())
    assert found >= 0.9 * true
    assert found < true or got == want


def test_pairs_close_to_the_threshold_are_found(spark):
    """Recall where it is hardest: every pair has a cosine just over the threshold, in 64 dimensions."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * b / np.linalg.norm(b, axis=1)[:, None]
    rows = [(i, v.tolist(), 1, 2, 3, b"") for i, v in enumerate(np.concatenate([a, b]).astype(np.float32))]
    got = E.near_links(spark.createDataFrame(rows, VECTORS)).collect()
    assert 0.9 * 3000 <= len(got) <= 3000 and all(r["class_id"] % 1500 == r["vec_id"] % 1500 and r["links"] == 1 for r in got)


def test_a_hot_group_is_counted_in_pieces(spark):
    """Copies and near copies of one vector make a third of the rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[:100] = x[0]
    x[100:200] = x[0] + rng.normal(size=(100, 16)).astype(np.float32) * 0.02
    rows = [(i, v.tolist(), 1, 2, 3, b"") for i, v in enumerate(x)]
    want = brute_links(x, list(range(600)))
    for piece in (E.PIECE, 16):
        got = {r["vec_id"]: (r["class_id"], r["links"]) for r in E.near_links(spark.createDataFrame(rows, VECTORS), piece=piece).collect()}
        assert got == want and want[150][1] >= 190


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (9, [1.0, None]), (10, [-1.0, -2.0]), (2, [5.0, -1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3, b"") for i, v in rows], VECTORS)
    assert sorted(tuple(r) for r in E.near_links(df).collect()) == [(1, 1, 1), (2, 1, 1)]
    for few in ([], [(1, [1.0, 2.0])], [(1, None)]):
        assert E.near_links(spark.createDataFrame([(i, v, 1, 2, 3, b"") for i, v in few], VECTORS)).count() == 0
    tie = [(1, [1.0, 0.0]), (2, [0.9, 0.435889894354067])]  # a cosine of 0.9
    assert E.near_links(spark.createDataFrame(tie, "`a.b` int, v array<double>"), "a.b", "v").count() == 2
    wide = spark.createDataFrame([(i, [float((i * j) % 7 + 1) for j in range(5000)]) for i in (1, 2, 9)], "vec_id long, embedding array<float>")
    assert {r["vec_id"] for r in E.near_links(wide).collect()} == set(brute_links(np.array([[float((i * j) % 7 + 1) for j in range(5000)] for i in (1, 2, 9)]), [1, 2, 9]))


def film(levels, index=True):
    return X.avi(X.encode_frames(np.array(levels), np.zeros((len(levels), 16), np.int64)) if levels else [], index=index)


def test_frames_decode_to_what_was_drawn():
    level = np.array([[8 * b + 4 for b in range(16)], [200] * 16])
    planes = M.decode_luma(X.encode_frames(level, np.zeros((2, 16), np.int64)))
    for plane, want in zip(planes, level):
        assert np.allclose([plane[8 * (b // 4) : 8 * (b // 4) + 8, 8 * (b % 4) : 8 * (b % 4) + 8].mean() for b in range(16)], want, atol=2)


def test_shots_and_times(spark):
    dark, light, grey = [20] * 16, [220] * 16, [120] * 16
    data = film([dark] * 5 + [light] * 4 + [grey] * 6)
    rows = [(1, data, 0), (2, None, 0), (3, b"", 0), (4, b"RIFF", 0), (5, b"no film at all", 0), (6, film([dark]), 0), (7, film([dark] * 5 + [light] * 4 + [grey] * 6, index=False), 0), (8, data[: len(data) // 2], 0), (1, data, 0), (9, film([]), 0)]
    got = M.clips(spark.createDataFrame(rows, "page_id long, media binary, shot long"), "page_id", "media").collect()
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["shot"], r["start_frame"], r["end_frame"], r["start_s"], r["end_s"]))
    fps = X.FPS
    want = [(0, 0, 4, 0.0, round(5 / fps, 6)), (1, 5, 8, round(5 / fps, 6), round(9 / fps, 6)), (2, 9, 14, round(9 / fps, 6), round(15 / fps, 6))]
    assert sorted(by[1]) == sorted(want * 2) and sorted(by[7]) == want
    assert by[6] == [(0, 0, 0, 0.0, round(1 / fps, 6))]
    assert by.keys() <= {1, 6, 7, 8} and 8 in by
    assert M.clips(spark.createDataFrame([], "page_id long, media binary"), "page_id", "media").count() == 0


def test_broken_frames_show_the_one_before():
    frames = X.encode_frames(np.array([[20] * 16] * 3), np.zeros((3, 16), np.int64))
    video = M.parse_avi(X.avi([frames[0], frames[1][: len(X.HEAD) + 1], frames[2]]))
    row, columns = M.shots_of([video])
    assert len(row) == 1 and columns[3][0] == 3


def test_filmed_texts_have_a_shot_a_section(spark):
    text = "".join(chr(33 + i % 90) for i in range(3000))
    df = X.film(spark.createDataFrame([(1, text), (2, None), (3, "")], "page_id long, html string"), "page_id", "html")
    got = M.clips(df, "page_id", "media").groupBy("page_id").count().collect()
    assert {r["page_id"] for r in got} == {1, 3}
    assert max(r["count"] for r in got) <= 3


ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def plain_jpeg(rng, width, height, grey=False, sampling=(2, 2), restart=0, tables=True):
    """A baseline frame with random coefficients, written bit by bit, and the brightness that it has by the textbook sum."""
    # every symbol that is used has a code of eight bits, but for the last ones
    symbols = {0: list(range(12)), 1: [0, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 8))]}
    counts = {k: [0] * 7 + [len(v)] + [0] * 8 for k, v in symbols.items()}
    code = {k: {x: format(i, "08b") for i, x in enumerate(v)} for k, v in symbols.items()}
    if not tables:  # those a player knows
        for k, (n, v) in enumerate((M._DC_LUMA, M._AC_LUMA)):
            code[k], at, now = {}, 0, 0
            for size, many in enumerate(n, 1):
                for _ in range(many):
                    code[k][list(v)[at]] = format(now, f"0{size}b")
                    at, now = at + 1, now + 1
                now <<= 1
    quant = [int(q) for q in rng.integers(1, 6, 64)]
    h, v = (1, 1) if grey else sampling
    shape = [(h, v)] if grey else [(h, v), (1, 1), (1, 1)]
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    luma = np.zeros((down * v * 8, across * h * 8))
    pieces, bits, before = [], "", [0] * 3

    def value(x):
        size = abs(x).bit_length()
        return size, format(x if x > 0 else x + (1 << size) - 1, f"0{size}b") if size else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        pieces.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
        bits = ""

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            flush()
            before = [0] * 3
        for c, (ch, cv) in enumerate(shape):
            for by in range(cv):
                for bx in range(ch):
                    z = [int(rng.integers(-60, 60))] + [int(x) if rng.random() < 0.2 else 0 for x in rng.integers(-40, 40, 63)]
                    if rng.random() < 0.2:
                        z[1:50] = [0] * 49  # long runs
                    size, extra = value(z[0] - before[c])
                    before[c] = z[0]
                    bits += code[0][size] + extra
                    run = 0
                    for k in range(1, 64):
                        if not z[k]:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + code[1][0xF0], run - 16
                        size, extra = value(z[k])
                        bits, run = bits + code[1][run << 4 | size] + extra, 0
                    if run:
                        bits += code[1][0]
                    if c == 0:
                        f = np.zeros((8, 8))
                        for k in range(64):
                            f[divmod(ZIGZAG[k], 8)] = z[k] * quant[k]
                        y0, x0 = (unit // across * v + by) * 8, (unit % across * h + bx) * 8
                        basis = np.array([[(math.sqrt(0.5) if u == 0 else 1) * math.cos((2 * x + 1) * u * math.pi / 16) / 2 for u in range(8)] for x in range(8)])
                        luma[y0 : y0 + 8, x0 : x0 + 8] = basis @ f @ basis.T + 128
    flush()
    scan = b"".join(p + (b"\xff" + bytes([0xD0 + i % 8]) if i + 1 < len(pieces) else b"") for i, p in enumerate(pieces))
    n = len(shape)
    out = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes(quant)
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * n, 8, height, width, n) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(shape))
    if tables:
        for k in (0, 1):
            out += b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols[k]), k << 4) + bytes(counts[k]) + bytes(symbols[k])
    if restart:
        out += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * n, n) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0])
    return out + scan + b"\xff\xd9", np.clip(luma, 0, 255)[:height, :width]


@pytest.mark.parametrize("kw", [{"grey": True}, {"sampling": (2, 2)}, {"sampling": (2, 1), "restart": 2}, {"sampling": (1, 1), "restart": 1}, {"grey": True, "tables": False, "restart": 3}])
def test_frames_of_a_plain_writer(kw):
    rng = np.random.default_rng(7)
    made = [plain_jpeg(rng, 43, 29, **kw) for _ in range(3)]
    for plane, (_, want) in zip(M.decode_luma([f for f, _ in made]), made):
        assert plane is not None and plane.shape == want.shape
        assert np.abs(plane.astype(float) - want).max() <= 1.01


def test_hostile_files():
    deep = b""
    for _ in range(3000):
        deep = b"LIST" + struct.pack("<I", len(deep) + 4) + b"hdrl" + deep
    assert M.parse_avi(b"RIFF" + struct.pack("<I", len(deep) + 4) + b"AVI " + deep) is None
    frame, _ = plain_jpeg(np.random.default_rng(1), 16, 16, grey=True)
    huge = frame.replace(struct.pack(">HH", 16, 16), struct.pack(">HH", 65500, 65500), 1)
    assert M.decode_luma([huge, frame.replace(b"\xff\xc0", b"\xff\xc2"), frame[:40], b"", frame])[:4] == [None] * 4
    good = film([[20] * 16] * 3)
    rng = np.random.default_rng(2)
    for _ in range(300):
        broken = bytearray(good)
        for at in rng.integers(0, len(good), 8):
            broken[at] = rng.integers(0, 256)
        M.shots_of([M.parse_avi(bytes(broken))])


def plain_cuts(hist):
    """First frames of shots of one video, frame by frame."""
    last, d = None, [float("nan")]
    seen = []
    for h in hist:
        last = last if math.isnan(h[0]) else h
        seen.append(last)
    for a, b in zip(seen, seen[1:]):
        d.append(0.0 if a is None else sum(abs(x - y) for x, y in zip(a, b)) / 2)
    out = [0]
    for i in range(1, len(d)):
        near = sorted(d[j] for j in range(max(1, i - M.AROUND), min(len(d), i + M.AROUND + 1)) if j != i)
        calm = near[: (len(near) + 1) // 2]
        mean = sum(calm) / len(calm) if calm else 0.0
        spread = math.sqrt(sum((x - mean) ** 2 for x in calm) / len(calm)) if calm else 0.0
        before = d[i - 1] if i > 1 else -1.0
        after = d[i + 1] if i + 1 < len(d) else -1.0
        peak = d[i] > before and d[i] >= after or d[i] >= 0.5
        if peak and d[i] >= max(M.LEAST_CUT, mean + M.DEVIATIONS * spread):
            out.append(i)
    return out


def test_cuts_equal_those_found_frame_by_frame():
    rng = np.random.default_rng(11)
    videos = []
    for n in (1, 2, 3, 9, 40, 80):
        base, rows = rng.dirichlet(np.ones(M.BINS)), []
        for _ in range(n):
            if rng.random() < 0.2:
                base = rng.dirichlet(np.ones(M.BINS) * rng.choice([0.1, 1, 5]))
            x = base + rng.random(M.BINS) * 0.01 * rng.integers(0, 4)
            rows.append(np.full(M.BINS, np.nan) if rng.random() < 0.1 else x / x.sum())
        videos.append(np.array(rows))
    got = M.cuts(np.concatenate(videos), np.array([len(v) for v in videos]))
    want, at = [], 0
    for v in videos:
        want += [at + i for i in plain_cuts(v)]
        at += len(v)
    assert got.tolist() == want and len(want) > 15
