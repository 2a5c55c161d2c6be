"""Text functions as column expressions: normalising, tokens, sentences, citations, numbers, page statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a technical token, tried in this order: a ratio, a percentage, a word with inner joints.
TOKEN = r"(\d+(?:[.,]\d+)?\s*:\s*\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?%|[\p{L}\p{N}][\p{L}\p{N}_]*(?:[./·_-][\p{L}\p{N}_]+)*)"
CITATION = r"\[Source ([1-9][0-9]*)\]"
NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"


def folded(c: Column) -> Column:
    """Lower case with sharp s spelled out."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_page(c: Column) -> Column:
    """Page text: one kind of line end and space, words joined across hyphenated line ends, at most one blank line."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), " ", " ")
    c = F.regexp_replace(c, r"(?<=\w)-\n(?=\w)", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def without_tags(c: Column) -> Column:
    """Markup to text: tags become spaces, the five basic entities characters, spaces collapse."""
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return collapse(c)


def plain_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?m)^#{1,6}\s*", "")
    c = F.regexp_replace(c, r"[*_`|]+", " ")
    return collapse(F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1"))


#: White space within a token, between the numbers of a ratio.
_GAPS = " \t\n\x0b\f\r"


def raw_tokens(c: Column) -> Column:
    """Technical tokens of a text, folded, as they stand."""
    return F.regexp_extract_all(folded(c), F.lit(TOKEN), 1)


def without_gaps(token: str) -> str:
    return token.translate(dict.fromkeys(map(ord, _GAPS)))


def tokens(c: Column) -> Column:
    """Technical tokens of a text, folded, without inner spaces."""
    return F.transform(raw_tokens(c), lambda t: F.translate(t, _GAPS, ""))


def estimated_tokens(c: Column) -> Column:
    """0 for an empty text, else a quarter of the characters, rounded up."""
    n = F.length(c)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def sentences(c: Column) -> Column:
    """Parts between a sentence mark with space and a capital or digit."""
    return F.split(c, r"(?<=[.!?])\s+(?=[\p{Lu}0-9])")


def citations(c: Column) -> Column:
    """Cited source numbers in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(CITATION), 1))


def numbers(c: Column) -> Column:
    """Canonical numbers: decimal point, no trailing zeros."""
    n = F.transform(F.regexp_extract_all(c, F.lit(NUMBER), 1), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    return F.array_distinct(F.transform(n, lambda x: F.regexp_replace(F.when(x.contains("."), F.regexp_replace(x, "0+$", "")).otherwise(x), r"\.$", "")))


def excerpt(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def truncated(c: Column, tokens_: int) -> Column:
    """At most so many estimated tokens, cut at the last space, with an ellipsis."""
    cut = F.regexp_replace(F.substring(c, 1, 4 * tokens_ - 1), r" [^ ]*$", "")
    return F.when(estimated_tokens(c) <= tokens_, c).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def slug(c: Column) -> Column:
    """Identifier from a file name: no extension, lower case, runs of other characters to underscores."""
    c = F.regexp_replace(F.lower(F.regexp_replace(c, r"\.[A-Za-z0-9]+$", "")), r"[^a-z0-9]+", "_")
    return F.regexp_replace(c, r"^_+|_+$", "")


def stable_id(*cs: Column, n: int = 16) -> Column:
    """First n hex digits of the SHA-256 of the parts, joined by unit separators."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *cs), 256), 1, n)


def hash_split(c: Column, n: int = 3) -> Column:
    """Stable split number: first four bytes of the SHA-256, modulo n."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % n


def _is_in(words: list[str]):
    return lambda t: t.isin(*words)


def language(c: Column, words: dict[str, list[str]], default: str) -> Column:
    """Language with most stop words in the text (ties: in the order given), `default` if there are none."""
    toks = F.split(F.lower(c), r"[^\p{L}]+")
    hits = {k: F.size(F.filter(toks, _is_in(w))) for k, w in words.items()}
    best = F.greatest(*hits.values()) if len(hits) > 1 else next(iter(hits.values()))
    out = F.lit(default)
    for k in reversed(hits):
        out = F.when((best > 0) & (hits[k] == best), k).otherwise(out)
    return out


def merged_paragraphs(*cs: Column) -> Column:
    """Paragraphs of the texts in order, each once (spaces and case don't tell them apart)."""
    p = F.filter(F.transform(F.split(F.concat_ws("\n\n", *cs), r"\n\s*\n"), strip), lambda x: x != "")
    key = F.transform(p, lambda x: F.lower(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(p, lambda x, i: F.array_position(key, F.lower(F.regexp_replace(x, r"\s+", " "))) == i + 1)
