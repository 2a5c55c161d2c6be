"""Gold passages in blocks, and draws that any engine repeats."""

import hashlib

import pytest

from sondera.operators import evaluation as ev


def test_gold_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "ab cd ef"), (2, "cd"), (3, None), (4, "")], "doc_id long, text string")
    passages = spark.createDataFrame([(10, "ab"), (11, "cd"), (12, "cd"), (13, ""), (14, None), (15, "ef"), (10, "ef"), (16, "zz")], "query_id long, text string")
    want = {(10, 1), (11, 1), (12, 1), (11, 2), (12, 2), (15, 1)}
    for size in (100, 2, 1):
        monkeypatch.setattr(ev, "PASSAGES", size)
        got = [tuple(r) for r in ev.gold_by_containment(docs, passages).collect()]
        assert set(got) == want and len(got) == len(want)
    assert ev.gold_by_containment(docs, passages.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 5, 700])
def test_bootstrap_interval(spark, n):
    rows = [(i * 3, (i * 7 % 11) / 11, (i * 5 % 13) / 13) for i in range(n)]
    a, b = (spark.createDataFrame([(r[0], r[k]) for r in rows] + [(-k, None)], "query_id long, rr double") for k in (1, 2))
    got = ev.bootstrap_interval(a, b, "rr", draws=200, seed=3).first()
    order = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    d = [round((r[2] - r[1]) * 1e9) for r in order]
    sums = sorted(sum(d[int(hashlib.md5(f"3:{r}:{p}".encode()).hexdigest()[:8], 16) % n] for p in range(n)) for r in range(200))
    assert (got["n"], got["low"], got["high"]) == (n, round(sums[4] / n / 1e9, 6), round(sums[194] / n / 1e9, 6))


def test_interval_of_nothing(spark):
    a = spark.createDataFrame([], "query_id long, rr double")
    assert ev.bootstrap_interval(a, a, "rr").count() == 0
