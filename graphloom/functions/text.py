"""Text expressions: search tokens, token estimates, slugs, fingerprints, snippets.

All are built-in expressions but for Unicode normalisation, which Spark lacks.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A search token: a maximal run of letters and digits, in lower case.
TOKEN = r"[\p{L}\p{N}]+"
#: Scripts without spaces between words; one such character weighs six quarters of a token, any other one quarter.
WIDE = r"[ᄀ-ᇿ⺀-鿿가-힯豈-﫿＀-￯]"
_WORD = r"[\p{L}\p{M}\p{Nd}]+(?:[-'][\p{L}\p{M}\p{Nd}]+)*"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def search_tokens(text: str) -> list[str]:
    """Search tokens of a string, as the expression makes them."""
    out, word = [], []
    for c in text.lower() + " ":
        if c.isalpha() or c.isnumeric():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out


def words(text: Column) -> Column:
    """Words of key phrases: letters, marks and digits with inner hyphens and apostrophes."""
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def token_estimate(text: Column) -> Column:
    wide = F.regexp_count(text, F.lit(WIDE))
    return F.greatest(F.lit(1), F.floor((F.length(text) + 5 * wide) / 4)).cast("bigint")


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(path: Column, canonical: Column, content: Column) -> Column:
    return F.upper(F.sha2(F.concat(path, F.lit("\n"), F.coalesce(canonical, F.lit("")), F.lit("\n"), content), 256))


def uri_part(text: Column) -> Column:
    """A text as a part of an address: UTF-8 bytes but letters, digits and -._~ in percent form."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def slug_of(label: str | None) -> str:
    """A label as an identifier: unaccented, lower case, runs of space and hyphen as one hyphen; blank gives ``item``."""
    if label is None or not label.strip():
        return "item"
    bare = "".join(c for c in unicodedata.normalize("NFD", label) if unicodedata.category(c) != "Mn").lower()
    return re.sub(r"-+", "-", re.sub(r"\s+", "-", re.sub(r"[^a-z0-9\s-]", "", bare))).strip("-")


def _slugs(labels: pd.Series) -> pd.Series:
    return labels.map(slug_of)


def slug(label: Column) -> Column:
    return F.pandas_udf(_slugs, "string")(label)


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).lower())


def nfc_lower(text: Column) -> Column:
    return F.pandas_udf(_nfc, "string")(text)


def snippet(text: Column, query: Column, limit: int = 240) -> Column:
    """A window of ``limit`` characters around the first place of the query (else of its first token that occurs).

    ``...`` marks ends that are cut off. The whole text where it is short enough.
    """
    low, q = F.lower(text), F.lower(query)
    by_token = F.array_max(F.transform(tokens(query), lambda t: F.struct((F.instr(low, t) > 0).alias("hit"), F.length(t).alias("n"), (-F.instr(low, t)).alias("at"))))
    at = F.when(F.instr(low, q) > 0, F.instr(low, q)).when(by_token["hit"], -by_token["at"]).otherwise(1)
    start = F.greatest(F.lit(1), F.least(at - limit // 2, F.length(text) - limit + 1))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, F.lit(limit)), F.when(start + limit <= F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= limit, text).otherwise(cut)
