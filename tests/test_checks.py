"""Checks, assembly, the stored index, and queries without SQL, each against plain Python."""

import difflib
import html
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.functions import text as tx
from sondera.operators import checks, planning, search
from sondera.plans import retrieval
from sondera.plans.catalog import QUERIES
from sondera.sources.tables import Derived


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_neighbours_stop_at_the_first_that_differs(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 5, "a"), (3, 6, None), (3, 7, None), (3, 8, None)], "doc int, at int, sec string")
    got = {r["at"]: r["neighbours"] for r in checks.neighbours(d, "doc", "at", ["sec"], 2).collect()}
    assert got == {1: [2], 2: [1], 3: [], 4: [], 5: [], 6: [7, 8], 7: [6, 8], 8: [6, 7]}


@pytest.mark.parametrize("n", [1, 2, 3, 11, 12, 13, 100, 1001])
def test_sample_positions(spark, n):
    got = spark.range(1).select(checks.sample_positions(F.lit(n).cast("long")).alias("p")).first()["p"]
    s = min(12, n)
    assert got == sorted({round(i * (n - 1) / max(1, s - 1)) for i in range(s)})


def test_text_layer(spark):
    d = spark.createDataFrame([(1, ""), (2, "12 34 %%"), (3, "# " * 600 + "abc"), (4, "word " * 300), (5, "short text"), (6, "ab " * 400)], "id int, t string")
    assert rows(d.select("id", checks.text_layer(F.col("t")).alias("s")), "id", "s") == [(1, "no_text"), (2, "no_text"), (3, "unusable"), (4, "ok"), (5, "ok"), (6, "unusable")]


def test_catalogue_states(spark):
    c = spark.createDataFrame([(1, "x", 2), (2, "x", 2), (3, "x", 2), (4, "x", 2)], "k int, sha256 string, n_pages int")
    f = spark.createDataFrame([(1, "x", 2), (2, "y", 2), (3, "x", 3)], c.schema)
    assert rows(checks.verified(c, f, "k"), "k", "status") == [(1, "ok"), (2, "changed"), (3, "page_count"), (4, "missing")]


def test_upsert_keeps_old_values_for_nulls(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], old.schema)
    assert rows(checks.upserted(old, new, "k"), "k", "x", "y") == [(1, "a", 1), (2, "b", 5), (3, "c", None)]


def test_renamed_files_need_another_name(spark):
    old = spark.createDataFrame([("b", "1"), ("a", "1"), ("c", "2")], "name string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("z", "1"), ("y", "3")], old.schema)
    assert rows(checks.renamed(old, new), "name", "source") == [("z", "a")]


def test_names_of_several_words(spark):
    q = spark.createDataFrame([(1, "in New York, now"), (2, "a york"), (3, "newyork"), (4, "")], "id int, t string")
    a = spark.createDataFrame([("ny", "New-York"), ("y", "york")], "source string, alias string")
    f = F.regexp_replace(tx.folded(F.col("t")), r"[^\p{L}\p{N}]+", " ")
    assert rows(planning.named(q.withColumn("f", f), a, "f"), "id", "source") == [(1, "ny"), (1, "y"), (2, "y")]


def test_merged_paragraphs_keep_the_first_of_equal_ones(spark):
    d = spark.createDataFrame([("One  two\n\nb", "c\n \none TWO\n\n", "b")], "x string, y string, z string")
    assert d.select(tx.merged_paragraphs(F.col("x"), F.col("y"), F.col("z")).alias("p")).first()["p"] == ["One  two", "b", "c"]


def test_section_text_prefers_and_keeps_the_budget(spark):
    d = spark.createDataFrame([(1, i, "p" if i == 3 else "o", c * 40) for i, c in enumerate("abcdef")], "s int, at int, kind string, text string")
    got = checks.section_texts(d, "s", "at", F.col("kind") == "p", 40).first()
    assert got["n"] == 4 and got["text"].split("\n") == ["a" * 40, "d" * 40, "f" * 40, "b" * 40]


def test_balance_kinds(spark):
    d = spark.createDataFrame([("Heat of a component",), ("the Component",), ("H₂O balance",), ("mass flow",)], "t string")
    assert [r[0] for r in d.select(checks.balance_kind(F.col("t"))).collect()] == ["energy", "species", "species", "overall_mass"]


def test_the_index_is_built_once_and_anew_for_new_data(spark, tmp_path):
    at = f"{tmp_path}/documents.parquet"
    q = spark.createDataFrame([(1, "red cat")], "query_id long, text string")
    docs = spark.createDataFrame([(1, "red fox", "s", "en"), (2, None, "s", "en"), (3, "", "s", "en"), (4, "the cat, the cat", "s", "en")], "doc_id long, text string, source string, lang string")
    docs.write.parquet(at)
    x = retrieval.index(spark, str(tmp_path))
    same = retrieval.index(spark, str(tmp_path))
    assert x.postings.inputFiles() == same.postings.inputFiles() and (x.n_docs, x.avgdl) == (4.0, 2.0)
    assert rows(search.bm25(x, q, 5), "doc_id", "score", "rank") == rows(search.bm25(docs, q, 5), "doc_id", "score", "rank")
    docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10)).write.mode("overwrite").parquet(at)
    assert retrieval.index(spark, str(tmp_path)).n_docs == 8.0
    Derived(spark, at, "index").drop()


def test_an_index_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red")], "query_id long, text string")
    assert search.bm25(none, q, 5).count() == 0 and search.sparse(search.sparse_vectors(none), search.sparse_vectors(q, "query_id"), 5).count() == 0


def test_plain_forms_of_whole_tables(spark, sf):
    """t2 and t4 over all rows."""
    import hashlib

    dashes = dict.fromkeys(map(ord, "‐‑‒–—−"), "-")
    lex = lambda t: " ".join(unicodedata.normalize("NFKC", re.sub(r"<[^>]*>", " ", re.sub(r"</?su[bp]>", "", html.unescape(t)))).translate(dashes).casefold().split())
    want = {(r["page_id"], hashlib.sha256(lex(r["html"]).encode()).hexdigest()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {(r["page_id"], r["digest"]) for r in QUERIES["t2_lexical_normal_form"](spark, sf).collect()} == want
    plain = lambda t: " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold().split())
    want = {(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {(r["item_id"], r["plain"]) for r in QUERIES["t4_without_marks"](spark, sf).collect()} == want


def test_similarity_of_all_turns(spark, sf):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by[r["conv_id"]].append((r["turn"], r["text"]))
    want = {}
    for c, turns in by.items():
        turns.sort()
        for i, (t, x) in enumerate(turns):
            want[c, t] = round(difflib.SequenceMatcher(None, x, turns[i - 1][1]).ratio(), 6) if i else None
    assert {(r["conv_id"], r["turn"]): r["ratio"] for r in QUERIES["t35_turn_similarity"](spark, sf).collect()} == pytest.approx(want, abs=2e-6)


def test_two_caps_over_all_questions(spark, sf):
    hits = retrieval.bm25(spark, sf, 100).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang"), "doc_id").collect()
    by, want = defaultdict(list), set()
    for h in hits:
        by[h["query_id"]].append((-h["score"], h["doc_id"], h["source"], h["lang"]))
    for q, found in by.items():
        a, b, n = Counter(), Counter(), 0
        for _, d, s, x in sorted(found):
            if n < 12 and a[s] < 2 and b[x] < 5:
                a[s], b[x], n = a[s] + 1, b[x] + 1, n + 1
                want.add((q, d, n))
    assert {(r["query_id"], r["doc_id"], r["position"]) for r in QUERIES["w5_two_caps"](spark, sf).collect()} == want


def test_bootstrap_interval_of_the_query(spark, sf):
    from sondera.operators import evaluation as ev

    g = retrieval.gold(spark, sf)
    x, y = ({r["query_id"]: r["rr"] for r in ev.per_query(h, g).collect()} for h in (retrieval.bm25(spark, sf), retrieval.fused(spark, sf)))
    d = np.sort([y[q] - x[q] for q in x if q in y])
    r = QUERIES["a25_bootstrap_interval"](spark, sf).first()
    means = np.sort([np.random.default_rng(s).choice(d, (100, len(d))).mean(1) for s in range(100)], axis=None)
    assert r["low"] <= d.mean() <= r["high"]
    assert abs(r["low"] - means[250]) < 0.02 and abs(r["high"] - means[-250]) < 0.02


def test_chunks_hold_every_word_in_order(spark, sf):
    """g1 and q3 over all documents: without the tails that a chunk repeats, the chunks' words are the document's."""
    from sondera.operators import corpus

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    by = defaultdict(list)
    for r in corpus.chunks(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        by[r["doc_id"]].append((r["chunk_no"], r["text"]))
    for d, t in docs.items():
        words, at, last = t.split(), {0}, None  # places that the chunks so far may end at
        for _, c in sorted(by.get(d, [])):
            lines = c.split("\n")
            forms = [lines] + ([lines[1:]] if last is not None and lines[0] == last else [])
            at = {p + len(w) for p in at for f in forms for w in [" ".join(f).split()] if words[p : p + len(w)] == w}
            last = lines[-1]
        assert len(words) in at
    n = Counter(c for v in by.values() for _, c in v)
    assert sorted(r["n"] for r in QUERIES["q3_duplicate_chunks"](spark, sf).collect()) == sorted(v for v in n.values() if v > 1)
