"""AVI motion-JPEG columns: RIFF parsing, intra-frame decoding and shot detection.

Containers are read by their ``idx1`` index, or by walking ``movi`` lists where there is none. Frames are baseline JPEG
(grey or YCbCr, any sampling, restart intervals, default Huffman tables where a frame brings none). Frames with equal
headers are decoded together: each restart interval is a lane, and one step reads the next Huffman symbol of all lanes,
so the cost is a few array operations a symbol for thousands of frames. A cut lies between two frames where the
difference of their brightness histograms exceeds what the frames around it lead to expect.

Defined cases: null and empty media, bytes that are no AVI file and files without video frames give no rows; a frame that
can't be decoded (truncated, progressive, broken codes, of more than 64 million samples) shows what the frame before showed; a file that breaks off gives
the frames it has; a video of one frame is one shot; repeated rows give repeated rows; ties between neighbouring
differences cut at the first; an empty table gives no rows; only id and media are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 32
#: A cut needs this difference (half the sum of absolute bin differences) and this many deviations over its surroundings.
LEAST_CUT, DEVIATIONS, AROUND = 0.25, 2.5, 6
_FRAMES_AT_ONCE = 8192
#: Lists within lists that are followed, and blocks of 8 x 8 samples of a frame that is decoded (64 million samples).
_DEPTH, _MOST_BLOCKS = 16, 1 << 20

ZIGZAG = np.array([i for s in range(15) for i in (lambda d: d if s % 2 else d[::-1])([r * 8 + s - r for r in range(max(0, s - 7), min(8, s + 1))])])
_COSINE = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: 64 coefficients (row by row) to 64 samples.
INVERSE = np.einsum("ux,vy->uvxy", _COSINE, _COSINE).reshape(64, 64).astype(np.float32)

_DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
_DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
_AC_LUMA = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    bytes.fromhex(
        "0102030004110512213141061351610722711432819 1a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa".replace(" ", "")
    ),
)
_AC_CHROMA = (
    [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    bytes.fromhex(
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")
    ),
)


class Broken(ValueError):
    pass


def codes(counts: list[int], symbols: list[int] | bytes) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol of a Huffman table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(counts: list[int], symbols: list[int] | bytes) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in codes(counts, symbols).items():
        table[code << 16 - length : (code + 1) << 16 - length] = length << 8 | symbol
    return table


_DEFAULTS = {0: _lookup(*_DC_LUMA), 1: _lookup(*_DC_CHROMA), 16: _lookup(*_AC_LUMA), 17: _lookup(*_AC_CHROMA)}


@dataclass
class Video:
    width: int = 0
    height: int = 0
    fps: float = 0.0
    frames: list[bytes] = field(default_factory=list)


def parse_avi(data: bytes | None) -> Video | None:
    """The first video stream of an AVI file."""
    if not data or data[:4] != b"RIFF" or data[8:12] not in (b"AVI ", b"AVIX"):
        return None
    video, stream, streams, index = Video(), None, 0, None
    movies: list[tuple[int, int]] = []

    open_ = [(0, len(data), 0)]
    while open_:
        at, end, depth = open_.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, to = at + 8, min(at + 8 + size, end)
            at += 8 + size + (size & 1)
            if kind in (b"RIFF", b"LIST"):
                name = data[body : body + 4]
                if name == b"movi":
                    movies.append((body, to))
                elif name in (b"AVI ", b"AVIX", b"hdrl", b"strl") and depth < _DEPTH:
                    open_ += [(at, end, depth), (body + 4, to, depth + 1)]
                    break
            elif kind == b"avih" and to - body >= 40:
                period, = struct.unpack_from("<I", data, body)
                video.fps = video.fps or (1e6 / period if period else 0.0)
                video.width, video.height = struct.unpack_from("<II", data, body + 32)
            elif kind == b"strh" and to - body >= 28:
                if data[body : body + 4] == b"vids" and stream is None:
                    stream = streams
                    scale, rate = struct.unpack_from("<II", data, body + 20)
                    video.fps = rate / scale if scale and rate else video.fps
                streams += 1
            elif kind == b"idx1" and index is None:
                index = data[body:to]

    if stream is None or not movies:
        return None
    wanted = (b"%02ddc" % stream, b"%02ddb" % stream)
    if index and len(movies) == 1:
        entries = [struct.unpack_from("<4sIII", index, 16 * i) for i in range(len(index) // 16)]
        entries = [(o, n) for kind, _, o, n in entries if kind in wanted]
        for base in (movies[0][0], 0):  # offsets count from the list's name, or from the file
            if entries and data[base + entries[0][0] : base + entries[0][0] + 4] in wanted:
                video.frames = [data[base + o + 8 : base + o + 8 + n] for o, n in entries]
                return video

    open_ = [(body + 4, to, 0) for body, to in reversed(movies)]
    while open_:
        at, end, depth = open_.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, to = at + 8, min(at + 8 + size, end)
            at += 8 + size + (size & 1)
            if kind == b"LIST" and depth < _DEPTH:
                open_ += [(at, end, depth), (body + 4, to, depth + 1)]
                break
            if kind in wanted:
                video.frames.append(data[body:to])
    return video


@dataclass
class Header:
    width: int
    height: int
    #: Of each component of the scan: horizontal and vertical sampling, quantisation in zigzag order, lookups.
    parts: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]
    restart: int
    h: int
    v: int

    @property
    def across(self) -> int:
        return -(-self.width // (8 * self.h)) if len(self.parts) > 1 else -(-self.width // 8)

    @property
    def units(self) -> int:
        return self.across * (-(-self.height // (8 * self.v)) if len(self.parts) > 1 else -(-self.height // 8))


def _header_end(frame: bytes) -> int:
    """Where the coded data of the first scan starts."""
    if frame[:2] != b"\xff\xd8":
        raise Broken("no JPEG")
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise Broken("no marker")
        kind = frame[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", frame, at + 2)
        at += 2 + size
        if kind == 0xDA:
            return at
    raise Broken("no scan")


@functools.lru_cache(64)
def parse_header(head: bytes) -> Header:
    at, quants, tables, restart, size, comps = 2, {}, dict(_DEFAULTS), 0, None, {}
    while at + 4 <= len(head):
        kind = head[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", head, at + 2)
        body = head[at + 4 : at + 2 + n]
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide, which = body[k] >> 4, body[k] & 15
                quants[which] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                counts = list(body[k + 1 : k + 17])
                tables[body[k]] = _lookup(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise Broken("sample precision")
            size = struct.unpack_from(">HH", body, 1)
            comps = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise Broken("not baseline")
        elif kind == 0xDD:
            (restart,) = struct.unpack_from(">H", body)
        elif kind == 0xDA:
            if size is None or not all(size) or body[0] != len(comps):
                raise Broken("scan of some components")
            parts = []
            for i in range(body[0]):
                h, v, q = comps[body[1 + 2 * i]]
                use = body[2 + 2 * i]
                parts.append((h, v, quants[q], tables[use >> 4], tables[16 | use & 15]))
            if len(parts) == 1:
                parts = [(1, 1, *parts[0][2:])]
            return Header(size[1], size[0], parts, restart, max(p[0] for p in parts), max(p[1] for p in parts))
        at += 2 + n
    raise Broken("no scan")


_RST = re.compile(rb"\xff[\xd0-\xd7]")
_END = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")


def _luma(header: Header, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Brightness planes of frames with one header, and which of them decoded cleanly."""
    units, parts = header.units, header.parts
    per_unit = sum(h * v for h, v, *_ in parts)
    lanes, owner, first_unit = [], [], []
    good = np.ones(len(coded), bool)
    for i, data in enumerate(coded):
        stop = _END.search(data)
        data = data[: stop.start()] if stop else data
        pieces = _RST.split(data) if header.restart else [data]
        step = header.restart or units
        if len(pieces) < -(-units // step):
            good[i] = False
        for k, piece in enumerate(pieces[: -(-units // step)]):
            lanes.append(piece.replace(b"\xff\x00", b"\xff"))
            owner.append(i)
            first_unit.append(k * step)
    n_lanes, frames = len(lanes), len(coded)
    lengths = np.array([len(x) for x in lanes])
    buffer = np.frombuffer(b"".join(x + b"\0" * 8 for x in lanes) + b"\0" * 16, np.uint8)
    view = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    begin = (np.concatenate([[0], np.cumsum(lengths + 8)[:-1]]) * 8).astype(np.int64)
    limit, at = begin + lengths * 8, begin.copy()
    owner, first_unit = np.array(owner), np.array(first_unit)
    many = np.minimum(header.restart or units, units - first_unit)
    blocks = np.zeros((frames * units * per_unit, 64), np.int32)
    predicted = np.zeros((len(parts), n_lanes), np.int64)
    bad = np.zeros(n_lanes, bool)
    highest = 0  # the last coefficient that any block uses

    def symbols(table: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of lanes, and the value of its extra bits."""
        pos = at[who]
        word = view[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
        found = table[(word >> np.uint64(48)).astype(np.int64)]
        length, symbol = found >> 8, found & 255
        extra = symbol & 15
        word = word << length.astype(np.uint64)
        raw = ((word >> np.uint64(32)).astype(np.int64)) >> (32 - extra)
        value = np.where((extra > 0) & (raw < (1 << np.maximum(extra - 1, 0))), raw - (1 << extra) + 1, raw)
        after = pos + length + extra
        wrong = (length == 0) | (after > limit[who])
        bad[who[wrong]] = True
        at[who] = np.minimum(after, limit[who])
        return np.where(wrong, 0, symbol), np.where(wrong, 0, value)

    for unit in range(int(many.max(initial=0))):
        live = np.flatnonzero((many > unit) & ~bad)
        if not len(live):
            break
        base = (owner[live] * units + first_unit[live] + unit) * per_unit
        for c, (h, v, _, dc, ac) in enumerate(parts):
            for _ in range(h * v):
                _, diff = symbols(dc, live)
                predicted[c, live] += diff
                blocks[base, 0] = predicted[c, live]
                who, row, k = live, base, np.ones(len(live), np.int64)
                while len(who):
                    symbol, value = symbols(ac, who)
                    k = k + (symbol >> 4)
                    size = symbol & 15
                    hit = (size > 0) & (k < 64)
                    blocks[row[hit], k[hit]] = value[hit]
                    highest = max(highest, int(k[hit].max(initial=0)))
                    bad[who[(size > 0) & (k >= 64)]] = True
                    going = ((size > 0) | (symbol == 0xF0)) & (k < 63)
                    who, row, k = who[going], row[going], k[going] + 1
                base = base + 1
    good &= ~np.bincount(owner, weights=bad, minlength=frames).astype(bool)
    # brightness is the first component
    h, v, quant, _, _ = parts[0]
    own = blocks.reshape(frames * units, per_unit, 64)[:, : h * v, : highest + 1].reshape(-1, highest + 1)
    samples = own.astype(np.float32) @ (INVERSE[ZIGZAG] * quant[:, None].astype(np.float32))[: highest + 1]
    samples += np.float32(128.5)
    samples = np.clip(samples, 0, 255, out=samples).astype(np.uint8)
    across = header.across
    planes = samples.reshape(frames, units // across, across, v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(frames, units // across * v * 8, across * h * 8)
    width, height = -(-header.width * h // header.h), -(-header.height * v // header.v)
    return planes[:, :height, :width], good


def decode_luma(frames: list[bytes]) -> list[np.ndarray | None]:
    """Brightness of each frame, None where it can't be decoded; frames with equal headers go together."""
    out: list[np.ndarray | None] = [None] * len(frames)
    groups: dict[bytes, list[tuple[int, bytes]]] = {}
    for i, frame in enumerate(frames):
        try:
            end = _header_end(frame)
        except (Broken, struct.error, IndexError):
            continue
        groups.setdefault(frame[:end], []).append((i, frame[end:]))
    for head, group in groups.items():
        try:
            header = parse_header(head)
        except (Broken, struct.error, IndexError, KeyError, ValueError):
            continue
        blocks = header.units * sum(h * v for h, v, *_ in header.parts)
        # a block takes two bits at least, so a header that claims more than there is isn't followed
        group = [(i, data) for i, data in group if 2 * blocks <= 8 * len(data) and blocks <= _MOST_BLOCKS]
        step = max(1, min(_FRAMES_AT_ONCE, (1 << 18) // max(1, blocks)))
        for at in range(0, len(group), step):
            some = group[at : at + step]
            planes, good = _luma(header, [data for _, data in some])
            for (i, _), plane, ok in zip(some, planes, good):
                out[i] = plane if ok else None
    return out


def histograms(planes: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """Share of samples in each of ``BINS`` bins, and mean brightness; nan for None."""
    hist, mean = np.full((len(planes), BINS), np.nan), np.full(len(planes), np.nan)
    shapes: dict[tuple, list[int]] = {}
    for i, p in enumerate(planes):
        if p is not None:
            shapes.setdefault(p.shape, []).append(i)
    for rows in shapes.values():
        x = np.stack([planes[i] for i in rows]).reshape(len(rows), -1)
        cell = (np.arange(len(rows))[:, None] * BINS + (x >> 3)).ravel()
        hist[rows] = np.bincount(cell, minlength=len(rows) * BINS).reshape(-1, BINS) / x.shape[1]
        mean[rows] = x.mean(1)
    return hist, mean


def cuts(hist: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """First frames of shots, of videos of ``counts`` frames in a row: each video's first and every frame after a cut.

    Undecoded frames repeat the one before.
    """
    n = len(hist)
    counts = counts[counts > 0]
    if not n:
        return np.zeros(0, np.int64)
    video = np.repeat(np.arange(len(counts)), counts)
    begin = (np.cumsum(counts) - counts)[video]
    seen = np.maximum.accumulate(np.where(np.isnan(hist[:, 0]), -1, np.arange(n)))
    seen = np.where(seen < begin, -1, seen)
    # before the first decoded frame of a video there is nothing to differ from
    d = np.abs(hist[seen[1:]] - hist[seen[:-1]]).sum(1) / 2
    d[(seen[1:] < 0) | (seen[:-1] < 0)] = 0
    d = np.concatenate([[np.nan], d])
    d[begin == np.arange(n)] = np.nan
    # differences with room between videos
    place = np.arange(n) + AROUND * (video + 1)
    pad = np.full(n + AROUND * (len(counts) + 1), np.nan)
    pad[place] = d
    near = np.lib.stride_tricks.sliding_window_view(pad, 2 * AROUND + 1)[place - AROUND].copy()
    near[:, AROUND] = np.nan
    # what to expect comes from the calmer half of the surroundings, which other cuts don't raise
    near.sort(1)
    valid = (~np.isnan(near)).sum(1)
    half = (valid + 1) // 2
    use = np.arange(near.shape[1]) < half[:, None]
    calm = np.where(use, near, 0)
    mean = calm.sum(1) / np.maximum(half, 1)
    spread = np.sqrt(np.where(use, (calm - mean[:, None]) ** 2, 0).sum(1) / np.maximum(half, 1))
    before, after = np.nan_to_num(pad[place - 1], nan=-1), np.nan_to_num(pad[place + 1], nan=-1)
    now = np.nan_to_num(d, nan=-1)
    peak = (now > before) & (now >= after) | (now >= 0.5)
    return np.flatnonzero((begin == np.arange(n)) | (now >= np.maximum(LEAST_CUT, mean + DEVIATIONS * spread)) & peak)


_SHOTS = "shot long, start_frame long, end_frame long, n_frames long, start_s double, end_s double, width long, height long, mean_luma double"


def shots_of(videos: list[Video | None]) -> tuple[np.ndarray, list]:
    """Row of the video, and the columns of ``_SHOTS``, of all shots."""
    counts = np.array([len(v.frames) if v else 0 for v in videos], np.int64)
    hist, mean = histograms(decode_luma([f for v in videos if v for f in v.frames]))
    first = cuts(hist, counts)
    if not len(first):
        return np.zeros(0, np.int64), [[] for _ in range(9)]
    total = np.cumsum(counts)
    row = np.searchsorted(total, first, "right")
    base = (total - counts)[row]
    end = np.minimum(np.append(first[1:], total[-1]), total[row])
    light = np.add.reduceat(np.nan_to_num(mean), first) / np.maximum(np.add.reduceat((~np.isnan(mean)).astype(float), first), 1)
    fps = np.array([v.fps or 1.0 if v else 1.0 for v in videos])[row]
    shot = np.arange(len(first)) - np.searchsorted(row, row)
    wide, high = (np.array([getattr(v, k) if v else 0 for v in videos])[row] for k in ("width", "height"))
    return row, [shot, first - base, end - 1 - base, end - first, (first - base) / fps, (end - base) / fps, wide, high, light]


def clips(df: DataFrame, id_col: str, media_col: str, at_once: int = 256) -> DataFrame:
    """Rows (id, shot, start_frame, end_frame, n_frames, start_s, end_s, width, height, mean_luma); a narrow map.

    Times are seconds, the end of a shot is the start of the next; mean_luma is that of its decoded frames.
    """
    schema = T.StructType([T.StructField(id_col, df.schema.fields[df.columns.index(id_col)].dataType), *T.StructType.fromDDL(_SHOTS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                part = batch.slice(k, at_once)
                row, columns = shots_of([parse_avi(x) for x in part.column(1).to_pylist()])
                kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.int64()] * 2 + [pa.float64()]
                columns[4:6] = [np.round(c, 6) for c in columns[4:6]]
                columns[8] = np.round(columns[8], 6)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["id", *schema.names[1:]])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{media_col}`")).toDF("id", "media").mapInArrow(run, T.StructType([T.StructField("id", schema[0].dataType), *schema.fields[1:]])).toDF(*schema.names)
