"""What built-in functions can't express, as Arrow-batched pandas functions."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("string")
def lexical(s: pd.Series) -> pd.Series:
    """Entities decoded, tags to spaces, compatibility forms composed, dashes alike, case folded, spaces collapsed."""
    dashes = dict.fromkeys(map(ord, "‐‑‒–—−"), "-")

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = re.sub(r"<[^>]*>", " ", re.sub(r"</?su[bp]>", "", html.unescape(t)))
        return " ".join(unicodedata.normalize("NFKC", t).translate(dashes).casefold().split())

    return s.map(one)


@F.pandas_udf("string")
def without_marks(s: pd.Series) -> pd.Series:
    """Case folded, without combining marks, spaces collapsed."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return s.map(lambda t: None if t is None else " ".join(plain(t).casefold().split()))


@F.pandas_udf("double")
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, 0 to 1."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
