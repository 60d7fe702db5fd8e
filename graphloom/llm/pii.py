"""Personal data and secrets found by a semi-Markov conditional random field.

The types are e-mail addresses, telephone numbers, payment cards, network addresses (v4 and v6), secrets (keys, tokens,
passwords after a word that says so), social security numbers and bank account numbers (IBAN). Names of people and
postal addresses are not among them. All of these have a digit or an @ or follow a cue such as "password:", so a text is
cut into zones of such words, joined over single spaces to neighbours without letters (and groups of up to four capitals
and digits to each other). Within a zone every span of up to ``MAX_TOKENS`` tokens is a candidate segment of every type.
Features look at the whole span (its shape, digit count, checksums, octets) and at what stands around it; a bounded
dynamic programme picks the segmentation of the zone, boundaries and types together, with the greatest score. No entity
lies outside a zone. A span is left out only if no segmentation that has it can be the best, by a bound on what it adds.

The weights are fitted by maximum likelihood on sentences made here from a fixed seed: entities of each type in many
formats, and look-alikes (dates, prices, versions, order numbers, numbers that fail their checksum, short hashes).

Defined cases: null and blank texts have no entities and stay as they are; equal scores go to the shorter segment, then
the earlier type; repeated rows give repeated results; long texts are handled whole, at a cost that grows with their
zones; an empty table gives no rows; other columns are neither read nor changed, and names may hold dots. Offsets count
characters.
"""

from __future__ import annotations

import functools
import ipaddress
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .lineage import positional

TYPES = ("EMAIL", "PHONE", "CARD", "IP", "SECRET", "SSN", "IBAN")
MAX_TOKENS = 24
_TOKEN = re.compile(r"\w+|\s|[^\w\s]")
_EMAIL = re.compile(r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"0{1,3}(?:\.0{1,3}){3}")
_IP6 = re.compile(r"[0aA:]{2,39}")
_PHONE = re.compile(r"(?:\+0{1,3}[ .-]?)?(?:\(0{2,4}\)[ .-]?|0{2,4}[ .-])?0{3,4}[ .-]0{3,4}(?:[ .-]0{2,4})?|\+0{1,3}[ .-]?(?:0{1,4}[ .-]?){1,4}0{2,6}")
_CARD = re.compile(r"0{13,19}|0{4}(?:[ -]0{4}){2}[ -]0{1,7}|0{4}[ -]0{6}[ -]0{5}")
_HEX = re.compile(r"[0aA]+")
_DATE = re.compile(r"0{4}[-/.]0{1,2}[-/.]0{1,2}|0{1,2}[-/.]0{1,2}[-/.]0{2,4}|0{1,2}:0{2}(?::0{2})?")
_SSN = re.compile(r"000[- ]00[- ]0000")
_IBAN = re.compile(r"[AG]{2}00(?: ?[AG0]{4}){2,7}(?: ?[AG0]{1,3})?")
_MARK = re.compile(r"(?:sk|pk|rk)[-_](?:live|test|proj)?[-_]?|gh[pousr]_|github_pat_|xox[abprs]-|AKIA|ASIA|AIza|glpat-|npm_|hf_|SG\.")
_JWT = re.compile(r"eyJ[\w-]+\.[\w-]+\.[\w-]+")
_CUE = re.compile(r"(?i)(?:token|secret|passw|pwd|key|auth|bearer|api)")
_PASS = re.compile(r"(?i)(?:passw\w*|pwd|passphrase|secret|kennwort|passwort|contraseña|mot de passe)[\"']?\s*(?:[:=]|is|ist|es|est)?\s*[\"']?$")
_CALL = re.compile(r"(?i)(?:call|phone|tel|mobile|fax|ring|sms)")
N_FEATURES = 36
_ASSIGN = re.compile(rb"(?i)(?:passw\w*|pwd|passphrase|kennwort|passwort)[\"']?[:=]?[\"']?")

_DIGIT_AT, _LETTER, _TAIL, _GROUP, _UPPER = (np.zeros(256, np.int32) for _ in range(5))
_DIGIT_AT[48:58] = 1
_DIGIT_AT[64] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_TAIL[128:192] = 1
_GROUP[48:58] = _GROUP[65:91] = 1
_UPPER[65:91] = 1
#: Of a character what its shape keeps: 0 digits, a and A hexadecimal letters, g and G other ones.
_SHAPE = {**{ord(c): "0" for c in "123456789"}, **{ord(c): "a" for c in "bcdef"}, **{ord(c): "A" for c in "BCDEF"}, **{c: "g" for c in range(ord("h"), ord("z") + 1)}, **{c: "G" for c in range(ord("H"), ord("Z") + 1)}}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ip6(text: str) -> bool:
    try:
        return ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


@functools.lru_cache(1 << 16)
def _of_shape(shape: str) -> tuple[tuple[float, ...], int] | None:
    """What the features of a span owe to its shape alone, and which checks are to be made; None where no entity can be."""
    if not (shape[0].isalnum() or shape[0] in "+(:") or not (shape[-1].isalnum() or shape[-1] in "):"):
        return None
    n, size = shape.count("0"), len(shape)
    at, spaces = "@" in shape, " " in shape
    ssn, bank = _SSN.fullmatch(shape) is not None, _IBAN.fullmatch(shape) is not None
    card = _CARD.fullmatch(shape) is not None
    if spaces and not (ssn or bank or card) and (n > 15 or not shape[0] in "+(0" or any(c.isalpha() for c in shape)):
        return None
    ip = _IP.fullmatch(shape) is not None
    six = shape.count(":") > 1 and _IP6.fullmatch(shape) is not None
    x = np.zeros(N_FEATURES)
    x[0] = 1
    phone = not ip and not card and not ssn and 7 <= n <= 15 and _PHONE.fullmatch(shape) is not None
    x[6] = phone
    x[7] = phone and (shape[0] == "+" or "(" in shape)
    x[8] = phone and n >= 10
    hexa = _HEX.fullmatch(shape) is not None and n < size
    x[9] = hexa and size >= 24
    x[10] = hexa and size < 24
    x[11] = shape.isalnum() and size >= 20 and 0 < n < size and not hexa
    x[18] = _DATE.fullmatch(shape) is not None
    x[19] = n == size
    x[20] = n == size and n >= 13
    x[21] = size > 60
    x[22] = n < 7
    x[29] = not n and not at
    x[30] = shape.isalpha() or shape.isalnum() and n < 3
    x[31] = size < 6
    x[32] = spaces
    x[33] = 0 < n < size and not spaces and not at and size >= 8
    checks = ip | card << 1 | (at << 2) | (six << 3) | (ssn << 4) | (bank << 5) | ((not spaces and size >= 12) << 6)
    return tuple(x), int(checks)


def candidates(zone: str, before: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Token bounds of a zone, its candidate segments (first token, number of tokens), and their features.

    before: the two words ahead of the zone."""
    tokens = [m.span() for m in _TOKEN.finditer(zone)]
    shape = zone.translate(_SHAPE)
    cue, call, told = _CUE.search(before) is not None, _CALL.search(before) is not None, _PASS.search(before) is not None
    digits = np.cumsum([0, *(c == "0" for c in shape)]).tolist()
    found, rows, size = [], [], len(zone)
    starts = [zone[a].isalnum() or zone[a] in "+(:" for a, _ in tokens]
    for i, (a, _) in enumerate(tokens):
        if not starts[i]:
            continue
        left = zone[a - 1] if a else ""
        left2 = zone[a - 2] if a > 1 else ""
        glued = bool(left) and (left.isalnum() or left in "+(@" or left in ".-/:_" and left2.isalnum())
        lead = zone[max(0, a - 20) : a]
        hint = cue or bool(lead) and _CUE.search(lead) is not None
        said = told and not a or bool(lead) and _PASS.search(lead) is not None
        mark = _MARK.match(zone, a) is not None
        most = 0
        for k in range(1, min(MAX_TOKENS, len(tokens) - i) + 1):
            b = tokens[i + k - 1][1]
            last = shape[b - 1]
            most += last == " "
            n = digits[b] - digits[a]
            if most and n > (19 if zone[a] in "0123456789+(" else 34) or most > 8:
                break  # no type is written like that
            if not (last.isalnum() or last in "):"):
                continue
            if not n and not said and "@" not in zone[a:b] and not (mark or hint):
                continue
            known = _of_shape(shape[a:b])
            if known is None:
                continue
            base, checks = known
            s = zone[a:b]
            right = zone[b] if b < size else ""
            right2 = zone[b + 1] if b + 1 < size else ""
            x = list(base)
            if checks & 1:
                x[2] = all(int(p) < 256 for p in s.split("."))
                x[3] = not x[2]
            if checks & 2:
                number = s.replace(" ", "").replace("-", "")
                x[4] = 13 <= n <= 19 and luhn(number)
                x[5] = not x[4]
            if checks & 4:
                x[1] = _EMAIL.fullmatch(s) is not None
                x[23] = not x[1]
            if checks & 8:
                x[2] = _ip6(s)
                x[24] = not x[2]
            if checks & 16:
                x[25] = s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
            if checks & 32:
                x[26] = iban(s)
                x[27] = not x[26]
            if checks & 64:
                x[28] = mark or _JWT.fullmatch(s) is not None
            x[12] = glued
            x[13] = bool(right) and (right.isalnum() or right in "@(" or right in ".-/:_" and right2.isalnum())
            x[14] = left == " " and left2.isalnum() or right == " " and (right2.isalnum() or right2 == "(")
            x[15] = hint
            x[16] = bool(left) and bool(right) and left in "\"'" and right in "\"'"
            x[17] = call
            x[34] = said
            x[35] = said and (not right or right in " \"',;.)\n" and not right2.isalnum())
            found.append((i, k))
            rows.append(x)
    return tokens, found, np.array(rows, float).reshape(len(rows), N_FEATURES)


class Model:
    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves  # features by types; label to next label, 0 for outside

    def gain(self, score: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The most that a segment of k tokens can add to a segmentation over leaving its tokens outside."""
        m = self.moves
        into = (m[:, 1:] - m[:, :1]).max(0)
        out = (m[1:] - m[:1]).max(1)
        return (score + into + out).max(1) - (k - 1) * m[0, 0]

    def entities(self, zone: str, before: str) -> list[tuple[int, int, str]]:
        """(start, end, type) in characters of the zone, by Viterbi over segments."""
        tokens, found, x = candidates(zone, before)
        if not found:
            return []
        score = x @ self.weights
        size = np.array([k for _, k in found])
        able = np.flatnonzero(self.gain(score, size) >= 0)
        if not len(able):
            return []
        ending: dict[int, list[tuple[int, list[float]]]] = {}
        for r in able.tolist():
            i, k = found[r]
            ending.setdefault(i + k, []).append((i, score[r].tolist()))
        n, labels, moves = len(tokens), len(TYPES) + 1, self.moves.tolist()
        low = -math.inf
        best = [[low] * labels for _ in range(n + 1)]
        back: dict[tuple[int, int], tuple[int, int]] = {}
        best[0][0] = 0.0
        every, outside = range(labels), [row[0] for row in moves]
        for t in range(1, n + 1):
            row = best[t - 1]
            y = 0
            top = row[0] + outside[0]
            for z in every[1:]:
                if row[z] + outside[z] > top:
                    top, y = row[z] + outside[z], z
            now = best[t]
            now[0], back[t, 0] = top, (t - 1, y)
            for i, gained in reversed(ending.get(t, ())):
                row = best[i]
                for y in every[1:]:
                    z = max(every, key=lambda v: row[v] + moves[v][y])
                    total = row[z] + moves[z][y] + gained[y - 1]
                    if total > now[y] + 1e-12:
                        now[y], back[t, y] = total, (i, z)
        out, t, y = [], n, max(every, key=lambda v: best[n][v])
        while t:
            i, earlier = back[t, y]
            if y:
                out.append((tokens[i][0], tokens[t - 1][1], TYPES[y - 1]))
            t, y = i, earlier
        return out[::-1]


def _number(rng: random.Random, n: int, valid: bool) -> str:
    d = str(rng.randint(2, 6)) + "".join(rng.choice("0123456789") for _ in range(n - 2))
    check = next(c for c in "0123456789" if luhn(d + c))
    return d + (check if valid else rng.choice([c for c in "0123456789" if c != check]))


def _sample(rng: random.Random) -> tuple[str, str | None]:
    """An entity or a look-alike, and its type (None for the latter)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvy") for _ in range(rng.randint(2, 8)))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    group = lambda s, k, sep: sep.join(s[i : i + k] for i in range(0, len(s), k))
    kind = rng.randrange(26)
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    if kind in (20, 21):
        area = rng.choice([f"{rng.randint(1, 665):03d}", f"{rng.randint(667, 899)}"])
        return f"{area}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", "SSN"
    if kind in (22, 23):
        country, body = rng.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), rng.choice([digits(18), digits(20), upper(4) + digits(14), digits(10) + upper(11) + digits(2)])
        check = next(c for c in (f"{k:02d}" for k in range(2, 99)) if iban(country + c + body))
        s = country + check + body
        if rng.random() < 0.15:
            return country + f"{(int(check) + 5) % 97:02d}" + body, None
        return rng.choice([s, group(s, 4, " ")]), "IBAN"
    if kind == 24:
        s = rng.choice([f"sk-{mixed(rng.randint(20, 48))}", f"sk_live_{mixed(24)}", f"sk-live_{mixed(rng.randint(12, 24))}", f"ghp_{mixed(36)}", f"AKIA{upper(16)}", f"xoxb-{digits(11)}-{mixed(24)}", f"AIza{mixed(35)}", f"glpat-{mixed(20)}", f"hf_{mixed(34)}", f"eyJ{mixed(17)}.eyJ{mixed(rng.randint(20, 60))}.{mixed(43)}"])
        return s, "SECRET"
    if kind == 25:
        s = rng.choice([name() + digits(rng.randint(1, 4)) + name(), name() + digits(2), mixed(rng.randint(8, 16)) + "4x", name() + name(), name().capitalize() + digits(3)])
        s = s if len(s) > 5 else s + "word77"
        return rng.choice(["password: ", "password ", "pwd=", "password is ", "Passwort: ", "passwd = ", 'password="']) + s, "SECRET"
    if kind < 3:
        user = rng.choice([name(), f"{name()}.{name()}", f"{name()}.{digits(2)}", f"{name()}_{digits(3)}", f"{name()}+{name()}"])
        host = rng.choice([f"{name()}.com", f"mail{digits(1)}.{name()}.org", f"{name()}.co.uk", f"{name()}-{name()}.net"])
        return f"{user}@{host}", "EMAIL"
    if kind < 6:
        a, b, c = digits(3), digits(3), digits(4)
        if rng.random() < 0.15:
            return f"call {b}-{c}", "PHONE"
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+{digits(2)} {digits(2)} {digits(4)} {c}", f"{a}.{b}.{c}", f"+49 {digits(2)} {digits(rng.randint(5, 7))}", f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{rng.choice(['1', '44', '34'])}{digits(9)}"]), "PHONE"
    if kind < 8:
        s = _number(rng, rng.choice([16, 16, 16, 16, 15, 19]), True)
        return rng.choice([s, s, group(s, 4, " "), group(s, 4, "-")] if len(s) == 16 else [s]), "CARD"
    if kind < 10:
        if rng.random() < 0.6:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4)), "IP"
        part = lambda: hexa(rng.randint(1, 4))
        return rng.choice([":".join(hexa(4) for _ in range(8)), f"2001:db8::{part()}", f"fe80::{part()}:{part()}ff:fe{hexa(2)}:{hexa(4)}", f"2a02:{part()}:{part()}::{part()}:{part()}"]), "IP"
    if kind < 12:
        s = hexa(rng.choice([32, 40, 40, 64]))
        s = s.upper() if rng.random() < 0.3 else s
        if rng.random() < 0.3:
            s = "".join(rng.choice("ABCDEFghijklmnopq0123456789") for _ in range(rng.randint(20, 44))) + "7x"
        return rng.choice([f'token = "{s}"', f"key: {s}", f"api_key={s}", s]), "SECRET"
    if kind < 15:
        s = _number(rng, rng.choice([16, 16, 16, 15, 19]), False)
        return rng.choice([s, s, group(s, 4, " ")] if len(s) == 16 else [s]), None
    if kind == 15:
        return rng.choice([f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(3)}", f"4.0.", "3.0", f"{digits(2)}.{digits(2)}"]), None
    if kind == 16:
        return rng.choice([f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", f"1{digits(1)}/0{rng.randint(1, 9)}/19{digits(2)}", f"1{digits(1)}:3{digits(1)}", f"19{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}"]), None
    if kind == 17:
        return rng.choice([f"{digits(3)},{digits(3)}", f"${digits(2)}.99", digits(rng.randint(1, 9)), f"{digits(2)}%", f"No. {digits(6)}", f"{digits(11)}", digits(rng.randint(20, 30)), f"{digits(5)}-{digits(4)}"]), None
    if kind == 18:
        return rng.choice([f"{rng.randint(256, 999)}.{digits(2)}.{digits(3)}.{digits(2)}", f"1.{digits(2)}.{digits(2)}.{digits(1)}.{digits(1)}", f"{digits(2)}.{digits(3)}.{digits(2)}"]), None
    return rng.choice([hexa(7) + "3", f"{name()}{digits(2)}", f"{digits(3)}-{digits(4)}", f"{digits(1)}:{digits(2)}:{digits(2)}", f"{upper(4)} {digits(4)}", f"password {name()} the", f"key {digits(3)}", f"{name()}-{digits(3)}", f"@{name()}", f"{name()}@{name()}", f"{hexa(12)}4a"]), None


def zones_of(text: str) -> Iterator[tuple[int, int, str]]:
    """Character bounds of the zones of a text, and the two words before each."""
    data, offsets = K.flat(pa.array([text]))
    chars = np.concatenate([[0], np.cumsum(1 - _TAIL[data[:-8]])])
    for _, a, b, before in _zones(data, offsets):
        yield int(chars[a]), int(chars[b]), before


def _zones(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """Text index and byte bounds of zones, and the two words before each."""
    starts, ends, doc = K.words(data, offsets)
    if not len(starts):
        return
    hot, letters, group, upper = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_DIGIT_AT, _LETTER, _GROUP, _UPPER))
    size = ends - starts
    hot, plain, capital = hot[ends] > hot[starts], letters[ends] == letters[starts], (size <= 4) & (group[ends] - group[starts] == size)
    head = (size == 4) & (upper[np.minimum(starts + 2, ends)] - upper[starts] == 2) & hot  # as of an account number
    beside = np.zeros(len(starts), bool)
    beside[1:] = (doc[1:] == doc[:-1]) & (starts[1:] == ends[:-1] + 1) & (data[np.maximum(starts[1:] - 1, 0)] == 32)
    link = np.zeros(len(starts), bool)
    link[1:] = beside[1:] & (plain[1:] & plain[:-1] | capital[1:] & (head[:-1] | capital[:-1] & hot[:-1] | capital[:-1] & hot[1:]))
    # a word after one that says that a password follows
    raw = data.tobytes()
    cue = np.zeros(len(starts), bool)
    for m in _ASSIGN.finditer(raw):
        k = int(np.searchsorted(starts, m.start(), "right")) - 1
        k += k + 1 < len(starts) and m.end() >= ends[k]
        while k + 1 < len(starts) and beside[k] and raw[starts[k] : ends[k]].lower() in (b":", b"=", b"is", b"ist", b"es", b"est"):
            k += 1
        cue[k] = True
    group = np.cumsum(~link) - 1
    first = np.flatnonzero(~link)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    for g in np.unique(group[hot | cue]):
        i, j = first[g], last[g]
        p = max(i - 2, int(np.searchsorted(doc, doc[i])))
        yield int(doc[i]), int(starts[i]), int(ends[j]), raw[starts[p] : starts[i]].decode("utf-8", "replace")


@functools.lru_cache(1)
def train(seed: int = 7, sentences: int = 1000, steps: int = 110) -> Model:
    """Maximum likelihood by Adam; forward and backward sums over all sentences' zones at once."""
    rng = random.Random(seed)
    zones, spans, gold = [], [], []
    words = "the of and la que der von call key mail in thon ering version para".split()
    for _ in range(sentences):
        text, truth = f"{rng.choice(words)} {rng.choice(words)} ", []
        for _ in range(rng.choice([1, 1, 2])):
            entity, kind = _sample(rng)
            value = entity
            if kind == "SECRET":
                value = re.sub(r"(?i)^(?:token = \"|key: |api_key=|password: |password is |password |pwd=|passwort: |passwd = |password=\")", "", entity).rstrip('"')
            elif kind == "PHONE":
                value = entity.removeprefix("call ")
            lead = rng.choice(["", "", "", "(", '"']) if kind not in ("PHONE", "SECRET") else ""
            if kind:
                at = len(text) + len(lead) + entity.index(value)
                truth.append((at, at + len(value), TYPES.index(kind) + 1))
            text += lead + entity + rng.choice(["", "", "", ".", ",", "!!", "***", "###", ";", " and"]) + " "
        text += rng.choice(words)
        for a, b, before in zones_of(text):
            tokens, found, x = candidates(text[a:b], before)
            begin, end = {x: i for i, (x, _) in enumerate(tokens)}, {y: i for i, (_, y) in enumerate(tokens)}
            inside = [(begin.get(lo - a), end.get(hi - a), k) for lo, hi, k in truth if a <= lo and hi <= b]
            able = set(found)
            if len(tokens) > 40 or any(i is None or j is None or (i, j - i + 1) not in able for i, j, _ in inside):
                continue
            spans += [(len(zones), i, k, row) for (i, k), row in zip(found, x)]
            gold.append([(i, j - i + 1, k) for i, j, k in inside])
            zones.append(len(tokens))
    n, longest, labels = len(zones), max(zones), len(TYPES) + 1
    which = np.array([(b, i, k) for b, i, k, _ in spans])
    features = np.stack([x for *_, x in spans])
    size = np.array(zones)
    target = np.zeros((len(spans), labels - 1))
    index = {tuple(w): r for r, w in enumerate(which)}
    gold_moves = np.zeros((labels, labels))
    for b, segments in enumerate(gold):
        labelled = np.zeros(size[b], np.int64)
        heads = np.ones(size[b], bool)
        for i, k, y in segments:
            target[index[b, i, k], y - 1] = 1
            labelled[i : i + k] = y
            heads[i + 1 : i + k] = False
        path = [0, *labelled[heads]]
        np.add.at(gold_moves, (path[:-1], path[1:]), 1)
    weights, moves = np.zeros((N_FEATURES, labels - 1)), np.zeros((labels, labels))
    by_end = [np.flatnonzero(which[:, 1] + which[:, 2] == t) for t in range(longest + 1)]
    by_start = [np.flatnonzero(which[:, 1] == t) for t in range(longest + 1)]
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (weights, moves)]

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        top[~np.isfinite(top)] = 0
        with np.errstate(divide="ignore"):
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    for step in range(1, steps + 1):
        score = features @ weights
        fwd = np.full((n, longest + 1, labels), -np.inf)
        fwd[:, 0, 0] = 0
        for t in range(1, longest + 1):
            fwd[:, t, 0] = logsum(fwd[:, t - 1] + moves[:, 0], 1)
            r = by_end[t]
            into = logsum(fwd[which[r, 0], which[r, 1]][:, :, None] + moves[:, 1:], 1) + score[r]
            for y in range(1, labels):
                np.logaddexp.at(fwd[:, t, y], which[r, 0], into[:, y - 1])
        bwd = np.full((n, longest + 1, labels), -np.inf)
        bwd[np.arange(n), size] = 0
        for t in range(longest - 1, -1, -1):
            live = size > t
            step_out = moves[:, 0] + bwd[:, t + 1, :1]
            r = by_start[t]
            out = moves[None, :, 1:] + (score[r] + bwd[which[r, 0], t + which[r, 2], 1:])[:, None, :]
            total = np.where(live[:, None], step_out, bwd[:, t])
            for y in range(labels):
                np.logaddexp.at(total[:, y], which[r, 0], logsum(out[:, y], 1))
            bwd[:, t] = np.where(live[:, None], total, bwd[:, t])
        z = logsum(fwd[np.arange(n), size], 1)
        before = fwd[which[:, 0], which[:, 1]]
        after = bwd[which[:, 0], which[:, 1] + which[:, 2], 1:]
        joint = np.exp(before[:, :, None] + moves[:, 1:] + (score + after)[:, None, :] - z[which[:, 0]][:, None, None])
        used = np.zeros_like(moves)
        used[:, 1:] = joint.sum(0)
        for t in range(longest):
            live = size > t
            used[:, 0] += np.exp(fwd[live, t] + moves[:, 0] + bwd[live, t + 1, :1] - z[live][:, None]).sum(0)
        grads = [features.T @ (target - joint.sum(1)) / n - 2e-4 * weights, (gold_moves - used) / n - 2e-4 * moves]
        for (m, v), g, w in zip(state, grads, (weights, moves)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(weights, moves)


def _found(texts: pa.Array, model: Model) -> tuple[list[int], list[int], list[int], list[str], list[int], list[int]]:
    """Text index, character bounds, type, and byte bounds within the chunk of every entity."""
    data, offsets = K.flat(texts)
    out = ([], [], [], [], [], [])
    chars = None
    for doc, a, b, before in _zones(data, offsets):
        zone = data[a:b].tobytes().decode("utf-8", "replace")
        for x, y, kind in model.entities(zone, before):
            if chars is None:
                chars = np.concatenate([[0], np.cumsum(1 - _TAIL[data])])
            lo, hi = a + len(zone[:x].encode()), a + len(zone[:y].encode())
            base = chars[offsets[doc]]
            for v, value in zip(out, (doc, int(chars[lo] - base), int(chars[hi] - base), kind, lo - int(offsets[doc]), hi - int(offsets[doc]))):
                v.append(value)
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Rows (doc_id, start_char, end_char, pii_type); a narrow map."""
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, "text"):
                doc, start, end, kind, _, _ = _found(part.column(1), model)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(kind, pa.string())], names=["doc_id", "start_char", "end_char", "pii_type"])

    schema = T.StructType([T.StructField("doc_id", docs.schema.fields[docs.columns.index(id_col)].dataType), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("pii_type", T.StringType())])
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with every entity of the text replaced by its type in brackets; a narrow map."""
    model = model or train()
    at, names, docs = docs.columns.index(text_col), docs.columns, positional(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch, f"c{at}"):
                doc, _, _, kind, lo, hi = _found(part.column(at), model)
                if not doc:
                    yield part
                    continue
                texts = part.column(at).to_pylist()
                for i in set(doc):
                    raw, out, last = texts[i].encode(), [], 0
                    for j in (j for j, d in enumerate(doc) if d == i):
                        out += [raw[last : lo[j]], f"[{kind[j]}]".encode()]
                        last = hi[j]
                    texts[i] = b"".join([*out, raw[last:]]).decode()
                columns = list(part.columns)
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema).toDF(*names)
