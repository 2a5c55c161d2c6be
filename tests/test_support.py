"""Claims of answers and their support: spelled-out cases and plain Python rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sondera.operators import support as sp

ANSWERS, SOURCES = "answer long, text string", "answer long, number int, text string"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1. The  Flow is 1 234 567 890,5 kg / hr", "the flow is 1234567890.5 kg/h"),
        ("12 34 567 8901", "12 34567 8901"),
        ("1,2,3 and 4 . 5", "1.2.3 and 4.5"),
        ("5 % — 3 percent, dix pour cent", "5% - 3%, dix %"),
        ("80 degrees Celsius, 20 ° C, 3 degrés C, 4 °cool", "80 °c, 20 °c, 3 °c, 4 °cool"),
        ("2 tonnes per hour, 3 t/h, étt/h, 1 m³/h, 1 m^3 per heure, 4 cubic metres/h", "2 t/h, 3 t/h, étt/h, 1 m3/h, 1 m3/h, 4 m3/h"),
        ("9 metre per sec; form/s; kg per second", "9 m/s; form/s; kg/s"),
        ("2) ", ""),
        ("", ""),
        (None, None),
    ],
)
def test_measured(spark, text, want):
    assert one(spark, sp.measured, text) == want


def plainly_measured(text):
    """Every rule on the whole text, one after the other."""
    t = re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ")
    t = re.sub(r"^[0-9]+[.)] ?", "", t).translate(str.maketrans("–—−³", "---3"))
    t = re.sub(r"(?<=[0-9]) ?[.,] ?(?=[0-9])", ".", t)
    t = re.sub(r"(?<=[0-9]) +(?=[0-9]{3}(?:[^0-9]|\Z))", "", t)
    for pattern, form in sp.UNIT_FORMS:
        t = re.sub(("" if pattern.startswith("(?:°") else r"(?<!\w)") + pattern + r"(?!\w)", form, t)
    return re.sub(r"(?<=[0-9]) *%", "%", t)


def test_measured_as_by_plain_rules(spark):
    rnd = random.Random(19)
    parts = "t ton tonnes kg m3 m^3 m³ cubic meter metres m / / per per h hr hours heure s sec secondes ° c celsius degree degrés percent pour cent % 1 2 007 345 678 0.50 , . – − ³ two é _ x ( ; 1. KG Per T".split()
    gaps = ["", "", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\f", " \n "]
    texts = ["".join(rnd.choice(parts) + rnd.choice(gaps) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    rates = ["".join(rnd.choice(gaps + ["x", "5"]) + rnd.choice(parts[:11]) + rnd.choice(gaps) + rnd.choice(["/", "per"]) + rnd.choice(gaps) + rnd.choice(parts[15:22]) for _ in range(4)) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts + rates], "text string")
    got = d.select("text", sp.measured(F.col("text")).alias("m")).collect()
    assert [r["m"] for r in got] == [plainly_measured(r["text"]) for r in got]
    assert sum(bool(re.search("t/h|kg/[hs]|m3/h|m/s", r["m"])) for r in got) > 1000


def test_own_forms_meet_every_text(spark):
    assert one(spark, lambda c: sp.measured(c, [("stone", "st"), sp.UNIT_FORMS[1]]), "5 stone, 2 kg per s, 3 percent") == "5 st, 2 kg/s, 3 percent"


def test_white_space_before_a_line_end_that_is_no_white_space(spark):
    assert one(spark, sp.measured, " 5 bar \x85") == "5 bar \x85"  # as SQL has it: only the end of the text is an end


def test_no_step_over_whole_texts_begins_by_looking_behind(spark):
    from sondera.plans.claims import t16  # a look behind at every character cost most of the query's time

    plan = t16(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(" in plan and ", (?<" not in plan


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("007 1.50 2.0 0.0 10 100.00 a5 5a 1.2.3", ["0", "1.2", "1.5", "10", "100", "2", "5", "7"]),
        ("two, deux, trois fours four", ["2", "3", "4"]),
        ("twos étwo", []),
        ("", []),
    ],
)
def test_stated_numbers(spark, text, want):
    assert one(spark, sp.stated_numbers, text) == want


def test_stated_units(spark):
    assert one(spark, sp.stated_units, "5% 3 kw, 2 kwh 1 kj/kg %% 7 bar.") == ["%", "bar", "kj/kg", "kw"]
    assert one(spark, sp.stated_units, "5%kw") == ["kw"]  # a letter behind: not a unit
    assert one(spark, sp.stated_units, "") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1. One. Two!  Three?\n\n  2) Four", ["1. One.", "Two!", "Three?", "2) Four"]),
        ("A [Source 1]; b [Source 2]; ", ["A [Source 1]", "b [Source 2]"]),
        ("A [Source 1]; b", ["A [Source 1]; b"]),
        ("A [Source 1];;", ["A [Source 1];;"]),
        ("Same. Same.\r\nSame.", ["Same.", "Same.", "Same."]),
        (" \n ", []),
        ("", []),
        (None, []),
    ],
)
def test_claims(spark, text, want):
    rows = sp.claims(spark.createDataFrame([(1, text)], ANSWERS)).orderBy("claim_no").collect()
    assert [r["claim"] for r in rows] == want
    assert [r["claim_no"] for r in rows] == list(range(len(want)))


def supported(spark, text, sources):
    a = spark.createDataFrame([(1, text)], ANSWERS).withColumn("number", F.lit("x")).withColumn("claim", F.lit("x"))
    s = spark.createDataFrame(sources, SOURCES).withColumn("claim_no", F.lit(7)).withColumn("cited", F.lit(7))
    return [tuple(r)[1:] for r in sp.support(a, s).orderBy("claim_no").collect()]


def test_one_source_with_all_of_it_is_enough(spark):
    got = supported(spark, "It is 5 kW and two bar [Source 1][Source 2].", [(1, 1, "5 kW"), (1, 2, "2 bar, 5.0 kw"), (2, 1, "5 kw 2 bar")])
    assert got == [(0, 2, 2, True, [], [])]


def test_halves_of_two_sources_are_not(spark):
    assert supported(spark, "It is 5 kW and 2 bar [Source 2][Source 1].", [(1, 1, "5 kW"), (1, 2, "2 bar")]) == [(0, 2, 2, False, ["2"], ["bar"])]


def test_unknown_null_and_repeated_sources(spark):
    assert supported(spark, "It is 5% [Source 3].", [(1, 1, "5%")]) == [(0, 1, 0, False, ["5"], ["%"])]
    assert supported(spark, "No number at all [Source 3].", []) == [(0, 1, 0, False, [], [])]
    assert supported(spark, "It is 5% [Source 1] [Source 1].", [(1, 1, None)]) == [(0, 1, 1, False, ["5"], ["%"])]
    assert supported(spark, "It is 5% [Source 1] [Source 99999999999999999999].", [(1, 1, "none"), (1, 1, "5%")]) == [(0, 2, 1, True, [], [])]
    assert supported(spark, "Not cited: 5%.", [(1, 1, "5%")]) == []


def test_empty_tables(spark):
    assert sp.support(spark.createDataFrame([], ANSWERS), spark.createDataFrame([], SOURCES)).collect() == []


def test_ungrounded_numbers_by_key(spark):
    from sondera.operators.evidence import ungrounded_numbers

    t = "k string, text string, n_numbers int"
    c = spark.createDataFrame([("a", "1 and 2,50", 0), ("a", "2.5 and 3", 0), ("b", "none", 0), ("c", None, 0), (None, "7", 0)], t)
    e = spark.createDataFrame([("a", "2.5", 0), ("a", "1.0", 0), ("a", None, 0), ("d", "3", 0), (None, "7", 0)], t)
    assert sorted(map(tuple, ungrounded_numbers(c, e, "k").collect()), key=str) == [("a", 3, 1), ("b", 0, 0), ("c", 0, 0), (None, 1, 1)]
    assert ungrounded_numbers(c.limit(0), e, "k").collect() == []


def test_section_bonus_takes_the_best_section(spark):
    from sondera.operators.planning import section_bonus

    s = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (2, "z", 40)], "query_id long, s string, rank int")
    m = spark.createDataFrame([("x", 5), ("y", 5), ("y", 6), ("z", 5), ("w", 9)], "s string, doc_id long")
    assert sorted(map(tuple, section_bonus(s, m, "s").collect())) == [(1, 5, 0.006), (1, 6, 0.005), (2, 5, 0.0005)]
