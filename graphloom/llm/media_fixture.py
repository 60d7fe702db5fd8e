"""Motion-JPEG clips made from bytes: the given tables hold no media, so pages are filmed.

Every 1024 bytes of a page are a shot of three to six frames of 32 by 32 samples; its sixteen blocks take their
brightness from sums of 64 bytes each. Frames of a shot differ by a grey level. The writer is a baseline encoder of
blocks with a mean and one gradient; container and codes are those any player reads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .media import _AC_LUMA, _DC_LUMA, codes

SIDE, SECTION, FPS = 32, 1024, 25
_BLOCKS = (SIDE // 8) ** 2


def _table(kind: int, counts: list[int], symbols: list[int] | bytes) -> bytes:
    body = bytes([kind, *counts, *symbols])
    return b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body


HEAD = (
    b"\xff\xd8" + b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
    + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0])
    + _table(0, *_DC_LUMA) + _table(16, *_AC_LUMA)
    + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0])
)


def encode_frames(level: np.ndarray, slope: np.ndarray) -> list[bytes]:
    """JPEG frames of blocks with mean brightness ``level`` (0..255) and gradient coefficient ``slope`` (-1, 0, 1)."""
    n = len(level)
    dc = level.astype(np.int64) - 128
    diff = np.diff(dc, axis=1, prepend=0)
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    dc_codes, ac_codes = codes(*_DC_LUMA), codes(*_AC_LUMA)
    code, length = (np.array([dc_codes[s][i] for s in range(12)]) for i in (0, 1))
    value, bits = code[size], length[size]
    value = value << size | np.where(diff < 0, diff + (1 << size) - 1, diff)
    bits = bits + size
    one, one_n = ac_codes[1]
    moved = slope != 0
    value = np.where(moved, (value << one_n | one) << 1 | (slope > 0), value)
    bits = bits + moved * (one_n + 1)
    end, end_n = ac_codes[0]
    value, bits = value << end_n | end, bits + end_n
    start = np.cumsum(bits, 1) - bits
    total = bits.sum(1)
    wide = int(-(-total.max(initial=0) // 8) * 8)
    out = np.ones((n, wide), bool)
    rows = np.arange(n)[:, None]
    for k in range(int(bits.max(initial=0))):
        use = bits > k
        out[np.broadcast_to(rows, bits.shape)[use], (start + k)[use]] = (value[use] >> (bits[use] - 1 - k)) & 1
    packed = np.packbits(out, axis=1)
    return [HEAD + row[: -(-t // 8)].tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row, t in zip(packed, total)]


def avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS, index: bool = True) -> bytes:
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    avih = struct.pack("<10I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, width, height) + b"\0" * 16
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body, entries, at = [], [], 4
    for f in frames:
        entries.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(chunk(b"00dc", f))
        at += len(body[-1])
    rest = chunk(b"LIST", b"movi" + b"".join(body)) + (chunk(b"idx1", b"".join(entries)) if index else b"")
    return b"RIFF" + struct.pack("<I", 4 + len(hdrl) + len(rest)) + b"AVI " + hdrl + rest


def scenes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brightness and gradient of the blocks of every frame that films ``data``, and frames a shot."""
    n = max(1, -(-len(data) // SECTION))
    x = np.zeros(n * SECTION, np.int64)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    sums = x.reshape(n, _BLOCKS, -1).sum(2)
    shade = (sums * 37 + np.arange(_BLOCKS) * 11) % 28 + 2
    many = 3 + sums.sum(1) % 4
    of = np.repeat(np.arange(n), many)
    tick = np.arange(len(of)) % 3 - 1
    return shade[of] * 8 + 4 + tick[:, None], (sums % 3 - 1)[of], many


def film(df: DataFrame, id_col: str, text_col: str, out: str = "media") -> DataFrame:
    """(id, media): a clip of every text's bytes; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = part.column(1).to_pylist()
                made = [scenes(t.encode()) for t in texts if t is not None]
                frames, at, media = [], 0, []
                if made:
                    frames = encode_frames(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]))
                counts = iter(len(m[0]) for m in made)
                for t in texts:
                    n = next(counts) if t is not None else 0
                    media.append(avi(frames[at : at + n]) if t is not None else None)
                    at += n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=[id_col, out])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out, T.BinaryType())])
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
