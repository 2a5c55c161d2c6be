"""Section search: candidates, boosts, the cap by document, and chunks of each question's own sections."""

import pytest
from pyspark.sql import functions as F

from sondera.operators import sections as sx


@pytest.fixture(scope="module")
def made(spark):
    chunks = [(f"c{d}{s}{k}", f"s{d}{s}", f"pump text {'valve ' * s} word{d} {'seal' if k else ''}") for d in range(3) for s in range(5) for k in range(2)] + [("cz", "sz", None), ("cy", "sy", "pump contents")]
    sections = [(f"s{d}{s}", f"d{d}", f"d{d} > Part {s}", s, ["table"] if s == 2 else ["paragraph"]) for d in range(3) for s in range(5)] + [("sz", "dz", "dz > Pump", 1, ["caption"]), ("sy", "dy", "dy > Contents", 1, ["paragraph"])]
    c = spark.createDataFrame(chunks, "chunk_id string, section_id string, text string")
    s = spark.createDataFrame(sections, "section_id string, doc string, hierarchy_path string, page_start int, kinds array<string>")
    p = sx.chunk_postings(c).cache()
    return c, s, p, sx.index_of(sx.section_postings(p, s).cache(), s.count())


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, text string, preferred array<string>, penalised array<string>")


def test_cap_boosts_and_low_value(spark, made):
    _, s, _, index = made
    q = ask(spark, (1, "pump valve", None, None), (2, "pump valve", ["table"], ["paragraph"]), (3, "", None, None), (4, None, None, None), (5, "unknown", None, None))
    got = sx.search_sections(index, s, q, low_value="(?i)contents").collect()
    by = {i: sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"]) for i in (1, 2, 3, 4, 5)}
    assert [r["rank"] for r in by[1]] == list(range(1, 9)) and not (by[3] or by[4] or by[5])
    for rows in by.values():
        assert all(sum(r["doc"] == d for r in rows) <= 3 for d in {r["doc"] for r in rows})
    assert "sy" not in {r["section_id"] for r in got} and "sy" in {r["section_id"] for r in sx.search_sections(index, s, q, 100).collect()}
    assert {r["section_id"] for r in by[2][:3]} == {"s02", "s12", "s22"}  # the preferred kind first
    plain, boosted = ({r["section_id"]: r["score"] for r in by[i]} for i in (1, 2))
    assert all(abs(boosted[x] - plain[x] - 0.045) < 1e-9 for x in ("s02", "s12", "s22") if x in plain)


def test_chunks_of_the_winners_only(spark, made):
    c, _, p, _ = made
    index = sx.index_of(p, c.count())
    q = ask(spark, (1, "pump seal", None, None), (2, "seal", None, None))
    winners = spark.createDataFrame([(1, "s01"), (1, "s10"), (2, "s20"), (9, "s00")], "query_id long, section_id string")
    got = {(r["query_id"], r["doc_id"]) for r in sx.search_chunks(p, index, winners, q, 10).collect()}
    assert got == {(1, "c010"), (1, "c011"), (1, "c100"), (1, "c101"), (2, "c201")}
    from sondera.operators.search import bm25

    free = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25(index, q.select("query_id", "text"), None).collect()}
    assert all(abs(free[r["query_id"], r["doc_id"]] - r["score"]) < 1e-6 for r in sx.search_chunks(p, index, winners, q, 10).collect())
    assert sx.search_chunks(p, index, winners.where("false"), q, 10).count() == 0


def test_postings_of_sections_are_sums(made):
    c, s, p, _ = made
    got = {(r["doc_id"], r["tok"]): r["tf"] for r in sx.section_postings(p, s).where("tok IN ('pump', 'part')").collect()}
    assert got["s00", "pump"] == 2 and got["sz", "pump"] == 3 and got["s00", "part"] == 3
    assert sx.chunk_postings(c.where("false")).count() == 0 and sx.index_of(p.where("false"), 0).avgdl == 1.0
    assert s.where(F.size("kinds") == 1).count() == 17
