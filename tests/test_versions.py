"""Tables in versions: one pointer, deltas, rollback; the index that follows its corpus; the chat store."""

import pytest

from sondera.operators import search as se
from sondera.operators.chat import ChatStore
from sondera.operators.incremental import IncrementalIndex
from sondera.sources.tables import Pointer, VersionedTables


def test_pointer_of_two_writers(spark, tmp_path):
    p = Pointer(spark, str(tmp_path / "p"))
    assert p.state() == (0, {"version": None, "history": []})
    p.move(0, {"version": "a", "history": ["a"]})
    p.move(1, {"version": "b", "history": ["a", "b"]})
    with pytest.raises(RuntimeError):
        p.move(1, {"version": "c", "history": ["a", "c"]})
    assert p.state() == (2, {"version": "b", "history": ["a", "b"]})


def test_tables_change_together(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "t"))
    row = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    have = lambda n: sorted(r["i"] for r in t.read(n).collect())
    with t.change("v1") as c:
        c.replace("a", row(1))
        c.replace("b", row(1))
    with pytest.raises(KeyError), t.change("v2") as c:
        c.add("a", row(2))
        raise KeyError
    assert t.version == "v1" and have("a") == [1]
    with t.change("v2") as c:
        c.add("a", row(2))
        assert t.version == "v1" and have("a") == [1]
    assert have("a") == [1, 2] and have("b") == [1]
    assert t.tables()["b"][0].startswith("v1/")  # not written again
    with pytest.raises(ValueError), t.change("v1"):
        pass
    t.rollback("v1")
    assert have("a") == [1]


OLD = [(1, "alpha beta"), (2, "beta gamma"), (3, "gamma gamma"), (4, None), (5, ""), (6, "alpha beta")]
NEW = [(1, "alpha beta"), (2, "beta delta"), (30, "gamma gamma"), (4, None), (7, "epsilon"), (8, "epsilon"), (9, "alpha beta")]
QUERIES = [(1, "alpha"), (2, "gamma gamma"), (3, "epsilon beta"), (4, ""), (5, None)]


def test_index_follows_its_corpus(spark, tmp_path):
    x = IncrementalIndex(VersionedTables(spark, str(tmp_path / "x")))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    found = lambda d, k=5: sorted(map(tuple, d.select("query_id", "doc_id", "score", "rank").collect()))
    fresh = lambda rows, k=5: found(se.bm25(docs(rows), q, k))
    x.sync(docs(OLD), "v1")
    assert found(x.search(q, 5)) == fresh(OLD)
    states = {r["doc_id"]: r["state"] for r in x.states(docs(NEW)).collect()}
    assert states == {1: "unchanged", 2: "modified", 3: "removed", 30: "renamed", 4: "unchanged", 5: "removed", 6: "removed", 7: "new", 8: "new", 9: "renamed"}
    x.sync(docs(NEW), "v2")
    new = x.store.spark.read.parquet(f"{x.store.path}/{x.store.tables()['postings'][-1]}")
    assert {r["tok"] for r in new.collect()} == {"beta", "delta", "epsilon"}  # contents that it knew are not read again
    assert found(x.search(q, 5)) == fresh(NEW) and found(x.search(q, 1)) == fresh(NEW, 1)
    x.compact("v3")
    assert len(x.store.tables()["postings"]) == 1 and found(x.search(q, 5)) == fresh(NEW)
    with pytest.raises(ValueError):
        x.sync(docs([(1, "a"), (1, "b")]), "v4")
    assert x.store.version == "v3"
    x.sync(docs(OLD), "v5")  # contents that were dropped come back
    assert found(x.search(q, 5)) == fresh(OLD)
    x.store.rollback("v2")
    assert found(x.search(q, 5)) == fresh(NEW)
    x.sync(docs([]), "v6")
    assert x.search(q, 5).count() == 0


def test_chat_store(spark, tmp_path):
    chat = ChatStore(VersionedTables(spark, str(tmp_path / "c")))
    s = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "session long, title string")
    m = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "session long, message int")
    c = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 0, "z")], "session long, message int, source string")
    with pytest.raises(ValueError):
        chat.create(s, m, c.union(spark.createDataFrame([(3, 0, "x")], c.schema)), "v0")
    assert chat.store.version is None
    chat.create(s, m, c, "v1")
    have = lambda: sorted(map(tuple, chat.overview().collect()))
    assert have() == [(1, "one", 2, 2), (2, "two", 1, 1), (3, None, 0, 0)]
    chat.rename(spark.createDataFrame([(1, "first"), (2, " "), (3, None), (9, "nobody")], s.schema), "v2")
    assert have() == [(1, "first", 2, 2), (2, "two", 1, 1), (3, None, 0, 0)]
    chat.delete(spark.createDataFrame([(1,), (1,), (9,), (None,)], "session long"), "v3")
    assert have() == [(2, "two", 1, 1), (3, None, 0, 0)]
    assert chat.store.read("citations").count() == 1 and chat.store.read("messages").count() == 1
    chat.store.rollback("v1")
    assert have() == [(1, "one", 2, 2), (2, "two", 1, 1), (3, None, 0, 0)]
