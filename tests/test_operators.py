"""Operators on hand-made cases: ties, order-dependent picks, budgets, links, stores, streams."""

import pytest
from pyspark.sql import functions as F

from sondera.operators import corpus, evaluation, evidence, fusion, planning, search, store
from sondera.sources.tables import VersionedTable, discover, read_jsonl, write_jsonl
from sondera.streaming import jobs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bm25_ties_go_to_the_smaller_id(spark):
    d = spark.createDataFrame([(2, "red fox"), (1, "red fox"), (3, "blue cat")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red"), (2, "???"), (3, "unseen")], "query_id long, text string")
    assert rows(search.bm25(d, q, 5), "query_id", "rank", "doc_id") == [(1, 1, 1), (1, 2, 2)]
    with pytest.raises(ValueError):
        search.bm25(d, q, 0)


def test_bm25_statistics_stay_corpus_wide_under_an_allow_list(spark):
    d = spark.createDataFrame([(i, "red fox" if i % 2 else "blue red cat") for i in range(8)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "fox red")], "query_id long, text string")
    full = {r["doc_id"]: r["score"] for r in search.bm25_scores(d, q).collect()}
    some = {r["doc_id"]: r["score"] for r in search.bm25_scores(d, q, d.where("doc_id < 3")).collect()}
    assert some == {k: v for k, v in full.items() if k < 3}


def hits(spark, *rows_):
    return spark.createDataFrame([(1, d, r, float(-r)) for d, r in rows_], "query_id long, doc_id long, rank long, score double")


def test_safeguard_burns_the_slot_of_a_document_that_is_taken(spark):
    ranked, lexical = hits(spark, (10, 1), (11, 2), (12, 3), (13, 4)), hits(spark, (10, 1), (20, 2))
    assert rows(fusion.safeguard(ranked, lexical, 3, 1), "position", "doc_id", "tier") == [(1, 10, "reranker"), (2, 11, "reranker"), (3, 12, "fill")]
    assert rows(fusion.safeguard(ranked, hits(spark, (20, 1)), 3, 1), "position", "doc_id", "tier")[2] == (3, 20, "lexical")


def test_a_role_whose_best_is_taken_takes_its_next(spark):
    long = spark.createDataFrame([(1, 1, 5, 1), (1, 1, 6, 2), (1, 2, 5, 1), (1, 2, 7, 2)], "query_id long, role_no long, doc_id long, rank long")
    assert rows(fusion.reserve_by_role(long, 1), "role_no", "doc_id") == [(1, 5), (2, 7)]


def test_rrf_adds_nothing_for_a_miss(spark):
    long = fusion.runs(a=hits(spark, (1, 1), (2, 2)), b=hits(spark, (2, 1)))
    got = {r["doc_id"]: r for r in fusion.rrf(long, 5).collect()}
    assert got[2]["rank"] == 1 and got[1]["score"] == pytest.approx(1 / 61, abs=1e-9) and got[2]["n_retrievers"] == 2


def test_packing_keeps_the_budget(spark):
    ch = spark.createDataFrame([(p * 10 + i, p, i, 100) for p in range(4) for i in range(6)], "child_id long, parent_id long, pos long, tokens long")
    a = spark.createDataFrame([(1, 3, 0.9), (1, 12, 0.8), (1, 31, 0.7)], "query_id long, child_id long, score double")
    b = evidence.pack_evidence(a, ch, 300, 700).collect()
    assert sum(r["n_tokens"] for r in b) <= 700 and all(r["n_tokens"] <= 300 for r in b)
    ids = [c for r in b for c in r["child_ids"]]
    assert len(ids) == len(set(ids)) and {3, 12, 31} <= set(ids)
    assert evidence.pack_evidence(a, ch, 600, 2600).where("scope <> 'full_parent'").count() == 0


def test_groups_and_links_follow_adjacency(spark):
    d = spark.createDataFrame([(1, i, k) for i, k in enumerate("ABBA")], "doc long, pos long, key string")
    assert rows(corpus.consecutive_groups(d, "doc", "pos", "key"), "pos", "group_no") == [(0, 1), (1, 2), (2, 2), (3, 3)]
    linked = corpus.linked(d, "doc", "pos", "key")
    assert rows(linked, "pos", "prev_pos", "next_pos") == [(0, None, None), (1, None, 2), (2, 1, None), (3, None, None)]
    assert corpus.link_violations(linked, "doc", "pos", "key").count() == 0


def test_parent_groups_reset(spark):
    d = spark.createDataFrame([(1, i, "k", n) for i, n in enumerate([600, 700, 500, 1300, 100])], "doc_id long, pos long, key string, tokens long")
    assert rows(corpus.parent_groups(d), "pos", "parent_no") == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)]


def test_pearson_is_null_without_variance(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0)], "g string, x double, y double")
    assert rows(evaluation.pearson(d, "x", "y", "g"), "g", "r") == [("a", None), ("b", None), ("c", 1.0)]


def test_evidence_set_with_a_missing_group_is_not_complete(spark):
    s = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 99), (1, 2, 1, 7)], "query_id long, set_id long, group_id long, doc_id long")
    assert rows(evaluation.evidence_rank(s, hits(spark, (5, 1), (7, 4))), "best_rank", "coverage") == [(4, 1.0)]


def test_routing_needs_one_source(spark):
    q = spark.createDataFrame([(1, "in the book alpha"), (2, "alpha and beta in the book"), (3, "alpha"), (4, "the book alphabet")], "query_id long, text string")
    a = spark.createDataFrame([("s1", "Alpha"), ("s2", "beta")], "source string, alias string")
    assert rows(planning.route(q, a, "book"), "query_id", "source") == [(1, "s1")]


def test_snapshot_states(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, d string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "n"), (5, "a")], "id long, d string")
    assert rows(store.snapshot_diff(old, new, "id", "d"), "id", "state") == [(1, "unchanged"), (2, "modified"), (3, "removed"), (4, "new"), (5, "duplicate")]


def test_a_failed_build_leaves_readers_on_the_old_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.publish(spark.range(3), "v1")
    with pytest.raises(ValueError):
        t.publish(spark.range(5), "v2", lambda d: d.count() == 4)
    assert t.version == "v1" and t.read().count() == 3
    t.publish(spark.range(5), "v3")
    t.rollback("v1")
    assert t.read().count() == 3


def test_json_lines_round_trip_and_discovery(spark, tmp_path):
    d = spark.createDataFrame([(2, "b"), (1, "é")], "n long, s string")
    write_jsonl(d, str(tmp_path / "j"), ["n"])
    assert rows(read_jsonl(spark, str(tmp_path / "j"), "n long, s string"), "n", "s") == [(1, "é"), (2, "b")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.jsonl").write_text('﻿{"n": 1}\n\nbroken\n')
    got = read_jsonl(spark, str(tmp_path / "x" / "a.jsonl"), "n long", strict=False).collect()
    assert [r["n"] for r in got] == [1, None] and got[1]["_malformed"] == "broken"
    (tmp_path / "x" / "sub").mkdir()
    (tmp_path / "x" / "sub" / "b.pdf").write_bytes(b"%PDF")
    assert discover(spark, str(tmp_path / "x")).count() == 1


def test_chunks_cover_and_keep_the_limit(spark):
    text = "\n".join(" ".join(f"w{i}_{j}." for j in range(40)) for i in range(30)) + "\n" + "long " * 3000
    c = corpus.chunks(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).collect()
    assert all(r["n_tokens"] <= 580 for r in c) and {w for w in text.split()} <= {w for r in c for w in r["text"].split()}


def test_stream_equals_batch(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns.where("turn < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.running_memory(s).writeStream.format("memory").queryName("mem").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    turns.where("turn >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = {(r["conv_id"], r["turn"]): (r["n_turns"], r["recent"]) for r in spark.table("mem").collect()}
    want = {}
    for r in turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t")).collect():
        for i, t in enumerate(r["t"]):
            want[r["conv_id"], t] = (i + 1, ",".join(map(str, r["t"][max(0, i - 1) : i + 1])))
    assert got == want


def test_ingest_is_incremental_and_replays_once(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    d.write.parquet(str(tmp_path / "in"))
    t = VersionedTable(spark, str(tmp_path / "t"))
    src = lambda: spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    jobs.ingest(src(), t, "id", str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string").write.mode("append").parquet(str(tmp_path / "in"))
    jobs.ingest(src(), t, "id", str(tmp_path / "c")).awaitTermination()
    assert rows(t.read(), "id", "v") == [(1, "a"), (2, "B"), (3, "c")]


def test_caps_act_on_each_other(spark):
    h = spark.createDataFrame([(1, i, float(-i), s, d) for i, (s, d) in enumerate([("a", "x"), ("a", "x"), ("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")])], "query_id long, doc_id long, score double, sec string, doc string")
    assert rows(fusion.two_caps(h, "sec", "doc", 2, 3, 10), "position", "doc_id") == [(1, 0), (2, 1), (3, 3), (4, 5)]


def test_a_role_without_a_free_document_shares_its_best(spark):
    ranked = hits(spark, (1, 1), (2, 2), (3, 3)).select("query_id", "doc_id", "rank")
    role = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 2, 1), (1, 3, 2, 1), (1, 3, 3, 2)], "query_id long, role_no long, doc_id long, rank long")
    assert rows(fusion.one_per_role(ranked, role, 3), "position", "doc_id", "origin") == [(1, 2, "role 1+2"), (2, 3, "role 3"), (3, 1, "fill")]


def test_pandas_functions(spark):
    from sondera.functions import udfs

    d = spark.createDataFrame([("<b>ﬁ</b> Stra&szlig;e x<sub>2</sub> – É", "abcd", "abce"), (None, None, "x")], "t string, a string, b string")
    r = d.select(udfs.lexical("t").alias("l"), udfs.without_marks("t").alias("m"), udfs.similarity("a", "b").alias("s")).collect()
    assert r[0]["l"] == "fi strasse x2 - é" and r[0]["s"] == 0.75 and r[1]["l"] is None
    assert r[0]["m"].endswith("e")


def test_focused_window_holds_the_terms(spark):
    text = " ".join(f"Sentence number {i} says little." for i in range(60)) + " The needle is here. " + " ".join(f"More of {i} follows." for i in range(60))
    d = spark.createDataFrame([(text, ["needle"]), ("short", ["needle"]), (None, None)], "text string, terms array<string>")
    w = [r["window"] for r in evidence.focused_windows(d, 200).collect()]
    assert "needle" in w[0] and len(w[0]) <= 200 and w[1] == "short" and w[2] is None


def test_turn_similarity_is_of_whole_texts(spark, tmp_path):
    import difflib

    from sondera.plans.catalog import QUERIES

    texts = ["word " * 50 + "tail one", "word " * 50 + "another end", "short", "x" * 150 + " y" * 100]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["turn"]: r["ratio"] for r in QUERIES["t35_turn_similarity"](spark, str(tmp_path)).collect()}
    assert got == {0: None} | {i: pytest.approx(difflib.SequenceMatcher(None, texts[i], texts[i - 1]).ratio(), abs=1e-6) for i in range(1, 4)}
    assert got[1] < 1


def test_searches_without_k_keep_every_hit(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(30)], "doc_id long, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, v array<double>")
    want = sorted((k, rank, i) for k, ids in ((1, [i for i in range(30) if i % 3]), (2, range(0, 30, 3))) for rank, i in enumerate(ids, 1))
    assert rows(search.dense(v, q, None, 0.5), "query_id", "rank", "doc_id") == want
    d = spark.createDataFrame([(i, "red fox") for i in range(30)], "doc_id long, text string")
    assert rows(search.bm25(d, spark.createDataFrame([(1, "red")], "query_id long, text string"), None), "rank", "doc_id") == [(i + 1, i) for i in range(30)]


@pytest.mark.parametrize("name", ["f2_dense_minimum", "p31_failure_classes", "j6_semi_and_j7_anti"])
def test_unbounded_queries_have_no_rank_limit(spark, sf, monkeypatch, name):
    from sondera.plans.catalog import QUERIES

    asked = []
    for f in ("dense", "bm25"):
        monkeypatch.setattr(search, f, lambda *a, f=getattr(search, f): (asked.append(a[2]), f(*a))[1])
    QUERIES[name](spark, sf)
    assert None in asked and 1_000_000 not in asked


def test_max_sim_takes_any_number_of_query_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    n = search.QUERY_BLOCK + 500
    q, d = np.round(rng.normal(size=(n, 2)), 3), np.round(rng.normal(size=(9, 2)), 3)
    docs = spark.createDataFrame([(i % 3, x.tolist()) for i, x in enumerate(d)], "doc_id long, v array<double>")
    queries = spark.createDataFrame([(i % 2, x.tolist()) for i, x in enumerate(q)], "query_id long, v array<double>")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in search.max_sim(docs, queries).collect()}
    best = np.stack([(q @ d[k::3].T).max(1) for k in range(3)], 1)
    assert got == {(j, k): pytest.approx(best[j::2, k].mean(), abs=2e-6) for j in range(2) for k in range(3)}
    assert search.max_sim(docs, queries.where("false")).count() == 0


def test_page_ranges_join_runs_across_blocks(spark):
    n = 3 * corpus.PAGE_BLOCK
    pages = [(k, p) for k in ("a", None) for p in [*range(n), n + 5, n + 7, n + 8, n + 5]] + [("b", None), ("c", -1), ("c", 0), ("c", None)]
    d = spark.createDataFrame(pages, "source string, page long")
    want = f"0-{n - 1}, {n + 5}, {n + 7}-{n + 8}"
    assert {r["source"]: r["pages"] for r in corpus.page_ranges(d, "source").collect()} == {"a": want, None: want, "b": None, "c": "-1-0"}
    many = spark.range(1_500_000).selectExpr("id % 2 AS source", "id div 2 + id div 20000 AS page")  # work by the square would take hours
    assert {r["source"]: r["pages"].count(",") for r in corpus.page_ranges(many, "source").collect()} == {0: 74, 1: 74}


def test_a_search_shuffles_the_best_rows_only(spark, tmp_path):
    """Hits of every document with a frequent word stay in the task that found them; ties and shared ids are as without k."""
    d = spark.createDataFrame([(i % 900, f"common word{i % 7} 3 : 4 " + "common " * (i % 5)) for i in range(1000)] + [(None, "common"), (5000, None)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"common word{i % 7} 3:4 3:4") for i in range(20)] + [(99, "")], "query_id long, text string")
    for find in (lambda k: search.bm25(d, q, k), lambda k: search.sparse(search.Index.over(d), search.sparse_vectors(q, "query_id"), k)):
        full = rows(find(None), "query_id", "rank", "doc_id", "score")
        assert len(full) == 20 * 901 and rows(find(7), "query_id", "rank", "doc_id", "score") == [r for r in full if r[1] <= 7]
    want = {(r["query_id"], r["doc_id"]): r["score"] for r in search.sparse(search.sparse_vectors(d), search.sparse_vectors(q, "query_id"), None).collect()}
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in find(None).collect()} == pytest.approx(want, abs=1.5e-6)
    x = search.Index.over(d.where("doc_id < 100"))
    x.rows.write.parquet(str(tmp_path / "rows"))
    x.rows = spark.read.parquet(str(tmp_path / "rows"))
    plan = search.bm25(x, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan


def test_dense_keeps_the_best_in_blocks_of_any_size(spark, monkeypatch):
    import numpy as np

    v = np.round(np.random.default_rng(1).normal(size=(700, 2)), 1).tolist()  # many ties
    d = spark.createDataFrame([(i * 37 % 700, x) for i, x in enumerate(v)], "doc_id long, v array<double>").repartition(3)
    q = d.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(search, "CELLS", 35 * 16)
    full = rows(search.dense(d, q, None, -1.0), "query_id", "rank", "doc_id", "score")
    assert rows(search.dense(d, q, 9, -1.0), "query_id", "rank", "doc_id", "score") == [r for r in full if r[1] <= 9]


def test_dense_holds_few_scores_at_once():
    """4096 queries times a batch were six arrays of 327 MB; slices of CELLS scores are eight MB each."""
    import numpy as np

    pick = search.Leaders(2)
    got = [pick(np.array(s), np.array(s) > -1) for s in ([[1.0, 3.0, 3.0, 3.0]], [[3.0, 2.0]], [[5.0, 0.0]])]
    assert [c.tolist() for _, c in got] == [[1, 2], [0], [0]] and search.CELLS * 8 <= 8 << 20


def test_max_sim_multiplies_equal_vectors_once(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    q, d = np.round(rng.normal(size=(6, 2)), 2), np.round(rng.normal(size=(40, 2)), 2)
    docs = spark.createDataFrame([(i % 3, x.tolist()) for i, x in enumerate(d)] * 50 + [(1, None)], "doc_id long, v array<double>")
    queries = spark.createDataFrame([(0, x.tolist()) for i, x in enumerate(q) for _ in range(i + 1)] + [(0, None)], "query_id long, v array<double>")
    best = np.stack([(q @ d[k::3].T).max(1) for k in range(3)], 1)
    got = {r["doc_id"]: r["score"] for r in search.max_sim(docs, queries).collect()}
    assert got == {k: pytest.approx(np.average(best[:, k], weights=range(1, 7)), abs=1e-6) for k in range(3)}
