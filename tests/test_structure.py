"""Heading stack, units and the three linked tables against a plain reading of the pages in order."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sondera.operators import structure as st

DDL = "doc string, page long, text string, kind string, block int"


def stack_paths(pages):
    """(doc, page, at) -> path after each heading, by a stack for each document."""
    out, stack, last = {}, [], None
    for doc, page, text in sorted(((d, p, t or "") for d, p, t in pages), key=lambda x: x[:2]):
        if doc != last:
            stack, last = [], doc
        for at, line in enumerate(text.strip().split("\n")):
            line = line.strip()
            m = re.match(r"^(#{1,6})\s+(.+?)\s*$", line)
            if m:
                level, title = len(m[1]), m[2]
            elif len(line) <= 100 and 1 <= len(line.split()) <= 12 and sum(c.isalpha() for c in line) >= 4 and line == line.upper() and not line.endswith("."):
                level, title = (1 if line.startswith("CHAPTER ") else 2), line
            else:
                continue
            del stack[level - 1 :]
            stack += [""] * (level - 1 - len(stack)) + [title]
            out[doc, page, at] = list(stack)
    return out


def made_pages(n, seed):
    rng = random.Random(seed)
    pages = []
    for k in range(n):
        lines = []
        for j in range(rng.randrange(12)):
            lines.append(rng.choice(["", f"# Part {j}", f"## Sec {k}", f"### Deep {j}", f"###### Six {j}", "CHAPTER ONE", "PLAIN HEADING", "| a | b |", "| c | d |", "word and word", "- item", "Figure 2 shows", "NOT A HEADING.", "2) step"]))
        pages.append((f"d{k % 3}", k, "\n".join(lines)))
    return [*pages, ("d0", 5000, None), ("d1", 5001, ""), ("d2", 5002, "tail text"), ("bare", 1, "only text"), ("bare", 7, "and more")]


@pytest.mark.parametrize("size", [1024, 4, 1])
def test_heading_stack_across_pages(spark, monkeypatch, size):
    """Small blocks make many prefixes; levels are skipped and popped."""
    monkeypatch.setattr(st, "PAGES", size)
    pages = made_pages(60, 1)
    x = st.headings(spark.createDataFrame([(*p, "x", 1) for p in pages], DDL))
    assert {(r["doc"], r["page"], r["at"]): r["path"] for r in x.collect()} == stack_paths(pages)


def test_units(spark):
    text = "intro\nline two\n\n# Top\n- a\n- b\n\nFigure 1: a pump\n| x | y |\n| 1 | 2 |\nafter\n<!-- image -->\n![alt words](u.png)\n#nospace"
    u = st.units(spark.createDataFrame([("d", 1, text, "x", 1), ("d", 2, "still under", "x", 1), ("e", 1, None, "x", 1)], DDL)).orderBy("doc", "page", "unit_no").collect()
    assert [(r["kind"], r["path"], r["text"]) for r in u] == [
        ("paragraph", [], "intro line two"), ("paragraph", ["Top"], "- a\n- b"), ("caption", ["Top"], "Figure 1: a pump"), ("table", ["Top"], "| x | y |\n| 1 | 2 |"),
        ("paragraph", ["Top"], "after"), ("paragraph", ["Top"], "alt words #nospace"), ("paragraph", ["Top"], "still under"),
    ]


@pytest.mark.parametrize("size", [1024, 3])
def test_children_parents_and_sections(spark, monkeypatch, size):
    monkeypatch.setattr(st, "PAGES", size)
    pages = [(d, p, (t or "") + "\n\n" + "filler text " * 150 + "\n\nsame\n\nsame") for d, p, t in made_pages(40, 2)] + [("law", 2, "Copyright by all"), ("law", 6, "Copyright by all")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], DDL)
    c, p, s = st.hierarchy(df, r"(?i)\bcopyright\b", lambda t, _: t.cache())
    order = lambda r: (r["doc"], r["page"], r["unit_no"])
    rows, parents, sections = sorted(c.collect(), key=order), {r["parent_id"]: r for r in p.collect()}, {r["section_id"]: r for r in s.collect()}
    units = sorted(st.units(df).collect(), key=order)
    assert [order(r) for r in rows] == [order(u) for u in units if not (u["doc"] == "law" and u["page"] == 2)]
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    listed = Counter(i for x in parents.values() for i in x["child_chunk_ids"])
    assert listed == Counter(r["chunk_id"] for r in rows)
    heads = {k: (x["chapter"], x["section"]) for k, x in sections.items()}
    before, have = None, 0
    members = defaultdict(list)
    for r in rows:  # the fold, in the order of each document
        fresh = before is None or (before["doc"], before["section_id"]) != (r["doc"], r["section_id"]) or have + r["tokens"] > 1700 or have >= 1250
        assert fresh == (before is None or before["parent_id"] != r["parent_id"])
        have = r["tokens"] if fresh else have + r["tokens"]
        near = before is not None and before["doc"] == r["doc"] and heads[before["section_id"]] == heads[r["section_id"]]
        assert r["previous_chunk_id"] == (before["chunk_id"] if near else None)
        if before is not None:
            assert before["next_chunk_id"] == (r["chunk_id"] if near else None)
        members[r["parent_id"]].append(r["chunk_id"])
        before = r
    assert {k: list(x["child_chunk_ids"]) for k, x in parents.items()} == members
    texts = {(u["doc"], u["page"], u["unit_no"]): u["text"] for u in units}
    joined = defaultdict(list)
    for r in rows:
        joined[r["parent_id"]].append(texts[order(r)])
    assert {r["parent_id"]: r["text"] for r in st.parent_texts(st.units(df), c).collect()} == {k: "\n\n".join(x) for k, x in joined.items()}
    assert {k: x["n_children"] for k, x in sections.items()} == Counter(r["section_id"] for r in rows)
    assert all(parents[r["parent_id"]]["section_id"] == r["section_id"] for r in rows)
    assert all(any(f"Unlabelled pages {x}" in r["hierarchy_path"] for r in sections.values()) for x in ("1-5", "6-10"))


def test_nothing_gives_nothing(spark):
    df = spark.createDataFrame([], DDL)
    assert st.units(df).count() == 0
    assert [t.count() for t in st.hierarchy(df)] == [0, 0, 0]


def test_markup_lines(spark):
    html = "<html><title>t</title><h2 class='x'>Head <b>bold</b></h2><p>One &amp; two<br>three</p><ul><li>a</li><li>b</li></ul><script>x</script><pre>keep</pre>"
    got = spark.createDataFrame([(html,), (None,)], "h string").select(st.markup_lines(F.col("h")).alias("x")).collect()
    assert [x for x in got[0]["x"].split("\n") if x] == ["## Head bold", "One & two", "three", "- a", "- b", "keep"]
    assert got[1]["x"] == ""
