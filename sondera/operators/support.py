"""Support of claims: an answer's claims, the numbers and units they state, and those that no cited source holds.

Everything about one text happens within its row; claims meet only the sources that they cite, by an equi-join that carries
numbers and units but no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CITATION, citations, strip
from .checks import UNIT_NAMES, any_of

_NOT_AFTER, _NOT_BEFORE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: Number words and their numbers.
NUMBER_WORDS = {"deux": "2", "trois": "3", "two": "2", "three": "3", "four": "4"}
#: Ways to write a unit, and the one that they become; tried in this order.
UNIT_FORMS = [
    (r"(?:tonnes?|tons?|t)\s*(?:/|per)\s*(?:h|hr|hours?|heures?)", "t/h"),
    (r"kg\s*(?:/|per)\s*(?:s|sec|seconds?|secondes?)", "kg/s"),
    (r"kg\s*(?:/|per)\s*(?:h|hr|hours?|heures?)", "kg/h"),
    (r"(?:m3|m\^3|cubic\s+met(?:er|re)s?)\s*(?:/|per)\s*(?:h|hr|hours?|heures?)", "m3/h"),
    (r"(?:m|met(?:er|re)s?)\s*(?:/|per)\s*(?:s|sec|seconds?|secondes?)", "m/s"),
    (r"(?:°\s*c|degrees?\s*c(?:elsius)?|degr[eé]s?\s*c(?:elsius)?)", "°c"),
    (r"(?:percent|pour\s*cent)", "%"),
]

#: For each of these forms: how it begins (other words may begin so too), and parts one of which a lower-case text of single
#: spaces holds if it holds the form.
_SIGNS = [
    (r"t(?:on|\s*(?:/|per))", ["ton", "t/", "t /", "tper", "t per"]),
    (r"kg", ["kg"]),
    (r"kg", ["kg"]),
    (r"[mc](?:3|\^3|ubic)", ["m3", "m^3", "cubic"]),
    (r"m(?:et|\s*(?:/|per))", ["/s", "/ s", "pers", "per s"]),
    (r"[°d](?:egr|(?<=°))", ["°", "degr"]),
    (r"p(?:erc|our)", ["percent", "pour"]),
]


def measured(c: Column, forms: list[tuple[str, str]] = UNIT_FORMS) -> Column:
    """Text in which equal measurements are spelled alike: lower case, one space, no list number in front, hyphens for dashes, a
    point between digits for a comma or point, no spaces between thousands, units by `forms`, no space before %.

    A regular expression costs a pass over the text, and most if it looks behind at every character: so a step begins with what it
    looks for, and meets only texts that hold a sign of it. Forms of the caller's own have no signs and meet every text.
    """
    at = F.array(F.lower(c))  # one text; as an element it has a name that each step can use twice

    def step(change, *signs):
        nonlocal at
        at = F.transform(at, lambda t: F.when(any_of(t, list(signs)), change(t)).otherwise(t) if signs else change(t))

    def swap(a, b):
        return lambda t: F.replace(t, F.lit(a), F.lit(b))

    def match(pattern, form):
        return lambda t: F.regexp_replace(t, pattern, form)

    for space in "\t\n\x0b\f\r":
        step(swap(space, " "), space)
    step(match("  +", " "), "  ")
    step(F.trim)
    at = F.transform(at, lambda t: F.when(F.ascii(t).between(48, 57), F.regexp_replace(t, r"^\d+[.)]\s*", "")).otherwise(t))
    for a, b in zip("–—−³", "---3", strict=True):
        step(swap(a, b), a)
    step(match(r"(\d)\s*[.,]\s*(?=\d)", "$1."))
    step(match(r"(\d)\s+(?=\d{3}(?:\D|$))", "$1"))
    for (pattern, form), (begins, signs) in zip(forms, _SIGNS if forms == UNIT_FORMS else [("", [])] * len(forms), strict=True):
        left = "" if pattern.startswith("(?:°") else _NOT_AFTER
        step(match(f"(?={begins}){left}{pattern}{_NOT_BEFORE}", form), *signs)
    step(match(r"(\d)\s+%", "$1%"), "%")
    return at[0]


def canonical(n: Column) -> Column:
    """A number without zeros that don't count, in front or behind its point."""
    n = F.regexp_replace(n, r"^0+(?=\d)", "")
    return F.when(n.contains("."), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n)


def stated_numbers(m: Column, words: dict[str, str] = NUMBER_WORDS) -> Column:
    """Sorted distinct canonical numbers of a measured text, number words included."""
    found = F.transform(F.regexp_extract_all(m, F.lit(r"\d(?<![\p{L}\p{N}_.]\d)\d*(?:\.\d+)?"), 0), canonical)
    said = F.filter(F.array(*(F.when(m.contains(w) & m.rlike(w + _NOT_BEFORE + rf"(?<![\p{{L}}\p{{N}}_]{w})"), n) for w, n in words.items())), lambda x: x.isNotNull())
    return F.sort_array(F.array_union(found, said))


def stated_units(m: Column) -> Column:
    """Sorted distinct units of a measured text."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(m, F.lit(UNIT_NAMES + _NOT_BEFORE), 1)))


def claims(answers: DataFrame) -> DataFrame:
    """(answer, claim_no, claim), claims numbered from 0 in their order: lines, within them sentences (the number of a list item
    ends none), and clauses apart by ; where every clause has a citation. Blank ones are left out; a null text has none."""
    not_blank = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")
    mark = "\x01"

    def clauses(s: Column) -> Column:
        parts = not_blank(F.split(s, ";"))
        return F.when((F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(CITATION)), parts).otherwise(F.array(s))

    def sentences(line: Column) -> Column:
        kept = F.regexp_replace(line, r"^(\s*\d+)\.\s+", "$1" + mark + " ")
        return not_blank(F.transform(F.split(kept, r"(?<=[.!?])\s+"), lambda s: F.replace(s, F.lit(mark), F.lit("."))))

    lines = not_blank(F.split("text", r"\r\n|\r|\n"))
    every = F.flatten(F.transform(F.flatten(F.transform(lines, sentences)), clauses))
    return answers.select("answer", F.posexplode(every).alias("claim_no", "claim"))


def support(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer, claim_no, n_cited, n_known, supported, missing_numbers, missing_units) of every claim with a citation.

    answers(answer, text), sources(answer, number, text). A claim is supported if one of the sources that it cites holds all
    its numbers and units; missing are those that the cited source with the fewest gaps lacks (ties: the smaller number; none
    known: all that the claim states). Sources with one number stand for each other. A null source text holds nothing.
    """
    c = claims(answers).withColumn("cited", citations(F.col("claim"))).where(F.size("cited") > 0)
    m = measured(F.regexp_replace("claim", CITATION, ""))
    c = c.select("answer", "claim_no", "cited", m.alias("m")).select("answer", "claim_no", "cited", stated_numbers(F.col("m")).alias("ns"), stated_units(F.col("m")).alias("us"))
    s = sources.select("answer", F.col("number").cast("string").alias("number"), measured(F.coalesce("text", F.lit(""))).alias("m"))
    s = s.select("answer", "number", stated_numbers(F.col("m")).alias("have_n"), stated_units(F.col("m")).alias("have_u"), F.lit(1).alias("known"))
    j = c.select("answer", "claim_no", F.size("cited").cast("long").alias("n_cited"), "ns", "us", F.explode("cited").alias("number")).join(s, ["answer", "number"], "left")
    no = F.array().cast("array<string>")
    j = j.withColumns({"mn": F.array_except("ns", F.coalesce("have_n", no)), "mu": F.array_except("us", F.coalesce("have_u", no))})
    gaps = F.size("mn") + F.size("mu")
    best = F.min(F.struct(F.when(F.col("known") == 1, 0).otherwise(1).alias("unknown"), gaps.alias("gaps"), F.length("number").alias("l"), "number", "mn", "mu"))
    known = F.count_distinct(F.when(F.col("known") == 1, F.col("number")))
    g = j.groupBy("answer", "claim_no").agg(F.first("n_cited").alias("n_cited"), known.alias("n_known"), best.alias("b"))
    return g.select("answer", "claim_no", "n_cited", "n_known", ((F.col("b.unknown") == 0) & (F.col("b.gaps") == 0)).alias("supported"), F.col("b.mn").alias("missing_numbers"), F.col("b.mu").alias("missing_units"))
