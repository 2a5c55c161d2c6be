"""Archive, embeddings and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondera.llm import embeddings, warc


def test_archive_round_trip(spark, scratch):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (4, "http://a/\r\n4", "short"), (5, "u", "short"), (6, "u", None), (8, "u", ""), (9, "é", "é" * 700), (9, "é", "é" * 700), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sha256", "2 AS payload")
    to = scratch.path("warc")
    warc.write_archive(pages, to)
    back = warc.read_archive(spark, to)
    got = Counter(tuple(r) for r in warc.describe(back).collect())
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        top = max(x for x, _, y in rows if (y or "") == (h or "") and x is not None)
        revisit = len(b) >= 1000 and i != top
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert got == want
    assert spark.read.parquet(f"{to}/payloads").count() == len({h or "" for _, _, h in rows})
    records = [bytes(r["record"]) for r in back.orderBy("page_id").collect()]
    for data in (b"".join(records), warc.warc_gz(records)):
        parsed = list(warc.parse_warc(data))
        assert len(parsed) == len(rows)
        assert Counter(h["WARC-Type"] for h, _ in parsed) == Counter(x[3] for x in want.elements())
        for h, block in parsed:
            if h["WARC-Type"] == "response":
                assert h["WARC-Payload-Digest"] == f"sha1:{hashlib.sha1(block).hexdigest()}"
            else:
                assert not block and h["WARC-Refers-To"] == "<urn:page:7>"
    with pytest.raises(Exception, match="does not match its digest"):
        warc.describe(back.where("page_id = 7").withColumn("record", F.expr("concat(substring(record, 1, octet_length(record) - 9), X'414243444546474849')"))).collect()
    warc.write_archive(pages.where("false"), scratch.path("none"))
    assert warc.describe(warc.read_archive(spark, scratch.path("none"))).count() == 0


@pytest.mark.parametrize(("dim", "cell"), [(64, 64), (64, 16), (8, 64), (8, 16)])
def test_embedding_dedup(spark, scratch, dim, cell):
    """The smaller cells deal the crowd in tiles."""
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((150, dim))
    near = base[:40] + 0.02 * rng.standard_normal((40, dim))
    crowd = base[50] + 0.05 * rng.standard_normal((120, dim))
    x = np.concatenate([base, near, crowd, base[:10], 3 * base[10:15]]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * dim), (1002, [float("nan")] * dim), (1003, [None] * dim), (1004, [float("inf")] + [1.0] * (dim - 1)), (1005, []), (1006, [1.0, 2.0]), (1006, [1.0, 2.0])]
    e = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS node")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.dedup_embeddings(e, scratch, cell=cell).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T >= 0.95
    np.fill_diagonal(c, False)
    root = np.arange(len(u))
    for _ in range(len(u)):
        new = np.array([min([root[i], *root[c[i]]]) for i in range(len(u))])
        if (new == root).all():
            break
        root = new
    want = {(i, int(c[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(u))}
    want |= {(i, 0, i, True) for i in range(1000, 1006)} | {(1006, 1, 1006, True)}
    links = sum(x[1] for x in want)
    assert sum(x[1] for x in got) >= 0.999 * links
    assert len(got ^ want) <= 0.002 * len(want)
    assert embeddings.dedup_embeddings(e.where("false"), scratch).count() == 0


def test_window_count_is_calibrated():
    directions, w, groups, least = embeddings.plan(64)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = rng.standard_normal((4000, 64))
    o -= (o * x).sum(1, keepdims=True) * x
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * o  # pairs at the least cosine
    a, b = embeddings.project(x, 64), embeddings.project(y, 64)
    hit = embeddings.close(a, b, w)
    assert (hit.sum(1) >= least).mean() > 0.999
    assert np.any([hit[:, g].all(1) for g in groups], axis=0).mean() > 0.99


def test_pipeline(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
        kept.append({r["doc_id"] for r in out.select("doc_id").collect()})
        d = out
    assert {5001, 5002, 5003, 5009}.isdisjoint(kept[0]) and 5004 in kept[0]
    assert len({5004, 5005, 5006} & kept[2]) == 1
    assert len(kept[2]) > 150 and kept[3] <= kept[2] and kept[4] == kept[3]
    empty = spark.read.parquet(f"{tmp_path}/0").where("false")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


@pytest.mark.parametrize("dim", [16, 64])
def test_embedding_links_below_the_default_cosine(spark, scratch, dim):
    rng = np.random.default_rng(12)
    a = rng.standard_normal((250, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    x = np.concatenate([a, 0.81 * a + (1 - 0.81**2) ** 0.5 * o])  # each with a partner at 0.81
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sum(r["n_links"] for r in embeddings.dedup_embeddings(e, scratch, cosine=0.8, cell=128).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int((u @ u.T >= 0.8).sum()) - len(x)
    assert want >= 500 and (got == want if dim < 48 else 0.95 * want <= got <= want)


def test_embedding_recall_just_above_the_threshold(spark, scratch):
    rng = np.random.default_rng(14)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    c = rng.uniform(0.9402, 0.96, (3000, 1))
    x = np.concatenate([a, c * a + (1 - c**2) ** 0.5 * o])
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"] for r in embeddings.dedup_embeddings(e, scratch, cell=512).where("n_links > 0").collect()}
    want = set(np.flatnonzero(c[:, 0] >= 0.95 + 1e-9))
    below = set(np.flatnonzero(c[:, 0] < 0.95 - 1e-9))
    assert not below & got and len(want & got) >= 0.99 * len(want) > 1000


def test_count_of_collisions_decides_candidates(monkeypatch, spark, scratch):
    """With a least count that no pair reaches nothing links; the windows alone don't decide."""
    x = np.random.default_rng(1).standard_normal((20, 64))
    e = spark.createDataFrame([(i, (v * (1 + i % 2)).tolist()) for i, v in enumerate(np.repeat(x, 2, axis=0))], "vec_id long, embedding array<double>")
    assert embeddings.dedup_embeddings(e, scratch).where("n_links = 1").count() == 40
    plan = embeddings.plan
    monkeypatch.setattr(embeddings, "plan", lambda dim, cosine=embeddings.COSINE: (*plan(dim, cosine)[:3], 65))
    q = embeddings.project(x / np.linalg.norm(x, axis=1, keepdims=True), 64)
    t = pa.table({"dim": pa.array([64] * 20, pa.int32()), "grp": pa.array([0] * 20, pa.int32()), "home": [True] * 20, "query": [True] * 20, "node": range(20), "mult": [1] * 20, "v": np.repeat(x[:10], 2, axis=0).tolist()})
    assert embeddings.count_cell(0.95, 0)(t).num_rows == 0 and len(q) == 20
    monkeypatch.setattr(embeddings, "plan", plan)
    assert embeddings.count_cell(0.95, 0)(t).num_rows == 20


def test_pipeline_loses_no_rows_that_share_ids(spark):
    """Rows of one doc_id or of none, and rows alike but for one column, are documents of their own in every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    a, b, c = text(1), text(2), text(3)
    rows = [
        (1, a, "en", "s", 1), (7, a + " end", "en", "s", 1), (7, b, "en", "s", 1), (None, b + " more", "en", "s", 1), (None, c, "en", "s", 1), (None, c + " tail", "en", "s", 1),
        (9, text(4), "en", "s", 1), (9, text(4), "en", "s", 1), (10, None, "en", "s", 1), (11, "", "en", "s", 1), (12, " ", None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:4]) for r in pipeline.dedup_documents(spark, docs, "").collect())
    assert got == sorted([(1, "w1x0"), (7, "w2x0"), (0, "w3x0"), (9, "w4x0"), (10, ""), (11, ""), (12, " ")])
    alike = [(1, a, "en", "s", 1), (1, a, "fr", "s", 1), (1, a, "fr", "s", None), (1, a, None, "s", 1), (2, b, "en", "s", 1), (2, b, "en", "s", 1), (3, None, "en", "s", 1)]
    mixed = pipeline.mix_sources(spark, spark.createDataFrame(alike, docs.schema), "")
    n = Counter((r["doc_id"], r["lang"], r["n_chars"]) for r in mixed.collect())
    assert sum(n.values()) == 9 and max(n[x] for x in n if x[0] == 1) <= 2  # 1.5 times six documents of one size
    assert {x for x in n if x[0] == 1} == {(1, "en", 1), (1, "fr", 1), (1, "fr", None), (1, None, 1)} and n[2, "en", 1] <= 4
    lines = spark.createDataFrame([(1, "one line\ntwo lines\nthree", "en", "s", 1), (1, "one line\ntwo lines\nthree", "fr", "t", 1), (2, "one line\ntwo lines", "en", "s", 1)], docs.schema)
    assert sorted((r["doc_id"], r["lang"]) for r in pipeline.dedup_lines(spark, lines, "").collect()) == [(1, "en"), (1, "fr")]


def test_packing_keeps_the_order_of_the_mix(spark, sf, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pipeline.mix_sources(spark, docs, sf).write.parquet(f"{tmp_path}/mix")
    stored = spark.read.parquet(f"{tmp_path}/mix")
    want = [r["doc_id"] for r in stored.select("doc_id", F.monotonically_increasing_id().alias("at")).orderBy("at").collect()]
    got = pipeline.pack(spark, stored, sf).orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in got if r["start"] == 0] == want
    assert want != sorted(want)
    twice = [i for i, n in Counter(want).items() if n > 1]
    inside = Counter((r["doc_id"], r["sequence_id"]) for r in got if r["start"] == 0)
    assert len(twice) > 20 and sum(n > 1 for n in inside.values()) < len(twice) / 3


def test_parallel_vectors_of_all_magnitudes_link(spark, scratch):
    rng = np.random.default_rng(1)
    v, w = rng.standard_normal((2, 64))
    rows = [(k, [float(x) for x in s * y]) for k, (s, y) in enumerate((s, y) for y in (v, w) for s in (1.0, 2.0, 1e-200, 3e-180, 1e200))]
    got = embeddings.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(k, 4, k // 5 * 5) for k in range(10)]
