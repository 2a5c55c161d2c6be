"""The stored vector index and late interaction against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.operators import vectors as ve
from sondera.sources.tables import Derived


@pytest.fixture(params=[512, 8])
def made(spark, tmp_path, monkeypatch, request):
    monkeypatch.setattr(ve, "BLOCK", request.param)
    monkeypatch.setattr(ve, "DIRECTIONS", 16)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 16))
    x = np.concatenate([centre[k % 12] * (1 + k % 3) + 0.1 * rng.standard_normal(16) for k in range(300)]).reshape(300, 16)
    x[7] = 0
    x[20:26] = x[20]  # ties
    rows = [(i, [float(a) for a in v], 1, 2) for i, v in enumerate(x)] + [(900, None, 1, 2), (5, [float(a) for a in x[5]], 1, 2)]
    ddl = "doc_id long, v array<double>, cell int, near int"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/v")
    df = spark.read.parquet(f"{tmp_path}/v")
    return df, ve.DenseIndex.build(df, Derived(spark, f"{tmp_path}/v", f"dense{request.param}")), [(i, np.array(v)) for i, v, *_ in rows if v]


def test_finds_what_all_pairs_give(spark, made):
    df, index, rows = made
    q = df.where("doc_id % 7 = 0 AND doc_id < 300").select(F.col("doc_id").alias("query_id"), "v")
    for k, least in ((5, -1e9), (40, 3.0), (None, 9.0), (1000, -1e9)):
        got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in index.search(q, k, least).collect())
        want = []
        for i, v in rows:
            if i % 7 == 0 and i < 300:
                s = sorted((-round(float(v @ w), 6), j) for j, w in rows if round(float(v @ w), 6) >= least)[:k]
                want += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-6)
    assert index.search(q.where("false"), 5).count() == 0
    with pytest.raises(ValueError, match="positive"):
        index.search(q, 0)


def test_holds_each_vector_once(spark, made):
    df, index, rows = made
    assert sorted(r["doc_id"] for r in index.members().collect()) == sorted(i for i, _ in rows)
    assert index.misaligned(df).count() == 0
    more = df.union(spark.createDataFrame([(77_000, [0.0] * 16, 1, 2)], df.schema)).where("doc_id <> 3")
    assert sorted(tuple(r) for r in index.misaligned(more).collect()) == [(3, 0, 1), (77_000, 1, 0)]
    m = index.manifest().first()
    assert (m["n_vectors"], m["dim"], m["min_norm"]) == (len(rows), 16, 0.0)


def test_index_of_nothing(spark, tmp_path):
    spark.createDataFrame([(1, None)], "doc_id long, v array<double>").write.parquet(f"{tmp_path}/v")
    df = spark.read.parquet(f"{tmp_path}/v")
    index = ve.DenseIndex.build(df, Derived(spark, f"{tmp_path}/v", "dense"))
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, v array<double>")
    assert index.search(q, 3).count() == 0 and index.manifest().first()["n_vectors"] == 0 and index.misaligned(df).count() == 0


def test_late_interaction(spark):
    rng = np.random.default_rng(2)
    d = {i: rng.standard_normal((1 + i % 4, 6)) for i in range(12)}
    dv = spark.createDataFrame([(i, [float(a) for a in v]) for i, x in d.items() for v in x] + [(3, None)], "doc_id long, v array<double>")
    qv = spark.createDataFrame([(i, p, [float(a) for a in v]) for i in (0, 5) for p, v in enumerate(d[i])], "query_id long, pos int, v array<double>")
    c = spark.createDataFrame([(0, 1), (0, 1), (0, 7), (5, 5), (5, 99), (8, 2)], "query_id long, doc_id long")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in ve.late_interaction(c, qv, dv).collect()}
    want = {p: float((d[p[0]] @ d[p[1]].T).max(1).mean()) for p in ((0, 1), (0, 7), (5, 5))}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-5 for p in want)
    assert ve.late_interaction(c.where("false"), qv, dv).count() == 0
