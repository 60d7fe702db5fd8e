"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Encoder: an Aho-Corasick automaton over the vocabulary gives the longest token that starts at each place. Going left to
right, the longest token is taken if it may follow the one before, which a pair table decides (two tokens may stand
side by side only if merging the text of both gives back just these two); else the next shorter one is tried, and where
none fits the encoder steps back. Places that cannot be reached again are marked, so the work is linear. The result is
that of merging pairs in rank order.

Texts are split by the vocabulary's pattern first. That is done for whole batches on arrays of character classes,
equal pieces of a batch are encoded once, and pieces of earlier batches are looked up, by a hash and then their bytes.

Decoder: all tokens' bytes lie in one array with a table of offsets; ids become byte ranges and the ranges are copied
at once.

Defined cases: a null text has null ids, an empty one no ids; null ids decode to null; repeated rows are encoded alike;
long texts are encoded whole; an empty table gives an empty table; other columns pass through and a column that already
has the name of the result raises ValueError. An id outside the vocabulary raises IndexError.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .lineage import positional

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers; beyond it those are dropped that only one batch had, and encoded anew if they come again.
_REMEMBERED = 500_000
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def load_ranks(path: str) -> list[bytes]:
    """Tokens by id of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Encoder:
    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.lengths = list(map(len, tokens))
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t) - 1))
        self.automaton.make_automaton()
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(tokens))]
        self.merge: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * len(tokens)
        for i, t in enumerate(tokens):
            for k in range(len(t) - 1, 0, -1):
                if (j := self.rank.get(t[:k])) is not None:
                    self.shorter[i] = j
                    break
        # the last merge that makes each token: the pair whose own merging ends in it
        for i in sorted(self.rank.values()):
            t = tokens[i]
            if len(t) < 2:
                continue
            pair = self._last_pair(t, i)
            if pair:
                self.split[i] = pair
                self.merge[pair] = i
        self.fits: dict[int, bool] = {}  # by both tokens in one number

    def _last_pair(self, t: bytes, rank: int) -> tuple[int, int] | None:
        parts = [self.rank[bytes([b])] for b in t]
        tokens = self.tokens
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(tokens[parts[k]] + tokens[parts[k + 1]], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None  # a token that merging never makes
            parts[at : at + 2] = [best]
        return (parts[0], parts[1])

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b leaves them side by side."""
        first, x, y, limit, ok = a << 32 | b, a, b, 1 << 60, True
        known = self.fits.get(first)
        if known is not None:
            return known
        while True:
            made = self.merge.get((x, y))
            if made is not None and made < limit:
                ok = False
                break
            if x > y:
                limit = x
                x = self.split[x][1]
                if x == limit:
                    limit = y + 1
                    y = self.split[y][0]
                    if y + 1 == limit:
                        break
            else:
                limit = y + 1
                y = self.split[y][0]
                if y + 1 == limit:
                    limit = x
                    x = self.split[x][1]
                    if x == limit:
                        break
        if len(self.fits) < 150_000:
            self.fits[first] = ok
        return ok

    def longest_matches(self, piece: bytes) -> list[int]:
        """The longest token that starts at each place."""
        out = [-1] * len(piece)
        # matches of one start come by their ends, so the last is the longest
        for end, (token, back) in self.automaton.iter(piece.decode("latin-1")):
            out[end - back] = token
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None and (len(piece) == 1 or self.split[whole][0] != whole):
            return [whole]
        match, n, lengths, fits = self.longest_matches(piece), len(piece), self.lengths, self.fits.get
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, match[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + lengths[token]
                if open_[end] and (last < 0 or (self.compatible(last, token) if (known := fits(last << 32 | token)) is None else known)):
                    out.append(token)
                    at = end
                    token = match[at] if at < n else -1
                    break
                token = self.shorter[token]
                if token < 0:
                    open_[at] = 0
                    if not out:
                        raise ValueError("bytes outside the vocabulary")
                    token = out.pop()
                    at -= lengths[token]
                    last = out[-1] if out else -1
                    token = self.shorter[token]
                    while token < 0:
                        open_[at] = 0
                        if not out:
                            raise ValueError("bytes outside the vocabulary")
                        token = out.pop()
                        at -= lengths[token]
                        last = out[-1] if out else -1
                        token = self.shorter[token]
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(load_ranks(path))


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """Character classes of all code points: white space, letter, number, other."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    out[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]] = _SPACE
    out[28:32] = _OTHER
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the pieces of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` over a chunk of texts."""
    size = int(offsets[-1])
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = data[:size]
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(lead) == size:
        point = raw.astype(np.int32)
    else:
        b = [data[lead + k].astype(np.int32) for k in range(4)]
        point = np.where(
            b[0] < 0x80, b[0],
            np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)),
        )
    kind = _classes()[point]
    n = len(lead)
    text_start = np.zeros(n + 1, bool)
    inner = offsets[:-1][offsets[:-1] < size]
    text_start[np.searchsorted(lead, inner)] = True
    text_start[n] = True
    new = text_start[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]  # runs of one class
    space = kind == _SPACE
    begin = new & ~space
    # a single space goes with what follows; white space before it is a piece of its own
    after_space = begin.copy()
    after_space[0] = False
    after_space[1:] &= space[:-1] & ~text_start[1:n]
    join = np.flatnonzero(after_space)
    plain = point[join - 1] == 32
    begin[join[plain]] = False
    begin[join[plain] - 1] = True
    run = new & space
    begin |= run
    # the last character of a run of white space before something stands alone if it isn't a plain space
    last = join[~plain] - 1
    begin[last] = True
    # contractions cut an apostrophe and letters off, where the apostrophe opens a piece
    ticks = np.flatnonzero((point == 39) & begin)
    if len(ticks):
        letters = np.concatenate([point, np.zeros(3, np.int32)])
        ends = np.concatenate([text_start, np.ones(3, bool)])
        for short in ("s", "t", "re", "ve", "m", "ll", "d"):
            m = np.ones(len(ticks), bool)
            for k, c in enumerate(short, 1):
                m &= (letters[ticks + k] == ord(c)) & ~ends[ticks + k]
            hit = ticks[m]
            begin[hit + 1] = False
            stop = hit + len(short) + 1
            ok = (stop < n) & ~ends[np.minimum(stop, n)]
            begin[stop[ok]] = True
            ticks = ticks[~m]
    at = np.flatnonzero(begin)
    starts = lead[at]
    return starts, np.append(starts[1:], size)


def same_bytes(data: np.ndarray, starts: np.ndarray, other: np.ndarray, there: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether spans of two byte arrays (with 8 bytes of padding) are equal, eight bytes a step."""
    out = np.ones(len(starts), bool)
    a, b = (np.ndarray((len(x) - 7,), "<u8", x, strides=(1,)) for x in (data, other))
    left, at = np.arange(len(starts)), 0
    while len(left):
        rest = length[left] - at
        out[left] &= ((a[starts[left] + at] ^ b[there[left] + at]) & K.MASK[np.minimum(rest, 8)]) == 0
        left, at = left[(rest > 8) & out[left]], at + 8
    return out


class Codec:
    """Encodes chunks of texts; remembers pieces by hash. A piece found by its hash is compared byte by byte, and one
    that only shares the hash is encoded by itself."""

    def __init__(self, path: str, backend: str = "backtracking") -> None:
        self.encode_piece = encoder(path).encode if backend == "backtracking" else library(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes, and of each the ids and bytes of its piece
        self.first, self.count, self.place, self.length, self.uses = (np.zeros(0, np.int64) for _ in range(5))
        self.flat, self.raw = np.zeros(0, np.int32), np.zeros(8, np.uint8)

    def trim(self) -> None:
        """Keeps the pieces that came in several batches, or none if these are too many as well."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > _REMEMBERED * 3 // 4:
            self.forget()
            return
        self.flat = take_ranges(self.flat, self.first[keep], self.count[keep])
        self.raw = np.concatenate([take_ranges(self.raw, self.place[keep], self.length[keep]), np.zeros(8, np.uint8)])
        for name in ("known", "count", "length", "uses"):
            setattr(self, name, getattr(self, name)[keep])
        self.first, self.place = np.cumsum(self.count) - self.count, np.cumsum(self.length) - self.length
        self.uses[:] = 1

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans in a row, and how many each has."""
        raw, encode = data.tobytes(), self.encode_piece
        lists = [encode(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((x for ids in lists for x in ids), np.int32, int(count.sum())), count

    def _add(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        flat, count = self._encoded(data, starts, ends)
        length = ends - starts
        new = {
            "known": hashes, "first": len(self.flat) + np.cumsum(count) - count, "count": count,
            "place": len(self.raw) - 8 + np.cumsum(length) - length, "length": length, "uses": np.zeros(len(hashes), np.int64),
        }
        self.flat = np.concatenate([self.flat, flat])
        self.raw = np.concatenate([self.raw[:-8], take_ranges(data, starts, length), np.zeros(8, np.uint8)])
        by = None
        for name, value in new.items():
            value = np.concatenate([getattr(self, name), value])
            by = np.argsort(value, kind="stable") if by is None else by
            setattr(self, name, value[by])

    def _found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids known so far, where those of each piece of the texts are and how many, and n + 1 offsets of pieces."""
        data, offsets = K.flat(texts)
        starts, ends = pieces(data, offsets)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return self.flat, none, none, np.zeros(len(offsets), np.int64)
        hashes, where, back = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        new = ~np.isin(hashes, self.known, assume_unique=True)
        if len(self.known) > _REMEMBERED and new.any():
            self.trim()
            new = ~np.isin(hashes, self.known, assume_unique=True)
        if new.any():
            self._add(data, hashes[new], starts[where[new]], ends[where[new]])
        at = np.searchsorted(self.known, hashes)
        self.uses[at] += 1
        length = ends - starts
        # each piece against the first of its hash here, and that one against what is remembered
        alike = (length[where] == self.length[at]) & same_bytes(data, starts[where], self.raw, self.place[at], np.minimum(length[where], self.length[at]))
        mine = where[back]
        own = alike[back] & (length == length[mine]) & same_bytes(data, starts, data, starts[mine], np.minimum(length, length[mine]))
        first, count, flat = self.first[at][back], self.count[at][back], self.flat
        if not own.all():
            odd = np.flatnonzero(~own)
            more, count[odd] = self._encoded(data, starts[odd], ends[odd])
            first[odd] = len(flat) + np.cumsum(count[odd]) - count[odd]
            flat = np.concatenate([flat, more])
        return flat, first, count, np.searchsorted(starts, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and n + 1 offsets."""
        flat, first, count, edges = self._found(texts)
        return take_ranges(flat, first, count), np.concatenate([[0], np.cumsum(count)])[edges]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        _, _, count, edges = self._found(texts)
        return np.diff(np.concatenate([[0], np.cumsum(count)])[edges])


def take_ranges(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[f : f + c] for each f and c, in a row."""
    if not len(first):
        return values[:0]
    total = np.cumsum(count)
    step = np.ones(int(total[-1]), np.int64)
    keep = count > 0
    f, c = first[keep], count[keep]
    if not len(f):
        return values[:0]
    at = np.concatenate([[0], np.cumsum(c)[:-1]])
    step[at] = f - np.concatenate([[0], f[:-1] + c[:-1] - 1])
    return values[np.cumsum(step)]


class Decoder:
    def __init__(self, tokens: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and their offsets."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.offsets) - 1):
            raise IndexError("id outside the vocabulary")
        count = self.offsets[ids + 1] - self.offsets[ids]
        total = np.concatenate([[0], np.cumsum(count)])
        return take_ranges(self.data, self.offsets[ids], count), total[offsets]


def library(path: str) -> Callable[[bytes], list[int]]:
    """The installed library's encoder of a piece; equal to ``Encoder.encode``, and compiled."""
    import tiktoken

    ranks = {t: i for i, t in enumerate(load_ranks(path)) if t}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


@functools.lru_cache(2)
def codec(path: str, backend: str = "backtracking") -> Codec:
    return Codec(path, backend)


@functools.lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


def count(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row; null for a null text. A narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, "text", K.CHUNK_BYTES // 2):
                texts = part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec(path).counts(texts), pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "n_tokens"])

    schema = T.StructType([T.StructField("doc_id", df.schema.fields[df.columns.index(id_col)].dataType), T.StructField("n_tokens", T.LongType())])
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def encode(df: DataFrame, text_col: str = "text", out: str = "token_ids", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the ids of ``text_col`` in ``out`` (array of int); a narrow map."""
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    at, names, df = df.columns.index(text_col), df.columns, positional(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, f"c{at}", K.CHUNK_BYTES // 2):
                texts = part.column(at)
                ids, offsets = codec(path).encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null() if texts.null_count else None)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "out"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("out", T.ArrayType(T.IntegerType()))])).toDF(*names, out)


def decode(df: DataFrame, ids_col: str = "token_ids", out: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``out``; bytes that are no UTF-8 become U+FFFD. A narrow map."""
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    at, names, df = df.columns.index(ids_col), df.columns, positional(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                lists = part.column(at)
                offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
                data, ends = decoder(path).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets)
                raw = data.tobytes()
                texts = [None if null else raw[a:b].decode("utf-8", "replace") for a, b, null in zip(ends.tolist(), ends[1:].tolist(), lists.is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "out"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("out", T.StringType())])).toDF(*names, out)
