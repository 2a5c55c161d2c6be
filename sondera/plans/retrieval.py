"""Queries of retrieval, fusion, selection and evaluation: benchmark passages are the questions, documents the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..operators import evaluation as ev
from ..operators import fusion as fu
from ..operators import search as se
from ..sources.tables import Derived, table
from .registry import query

#: Every 20th vector is a query of the dense searches.
EVERY = 20

_TOKS = f"list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{TOKEN}', 1), lambda t: regexp_replace(t, '\\s+', '', 'g'))"
BM25 = f"""
d AS (SELECT doc_id, {_TOKS} AS toks FROM documents), dl AS (SELECT doc_id, toks, len(toks) AS dl FROM d),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM dl), post AS (SELECT doc_id, dl, unnest(toks) AS tok FROM dl),
tf AS (SELECT doc_id, dl, tok, count(*) AS tf FROM post GROUP BY ALL), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
qt AS (SELECT item_id AS query_id, unnest({_TOKS}) AS tok FROM benchmark), q AS (SELECT query_id, tok, count(*) AS qtf FROM qt GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))), 6) AS score
  FROM q JOIN tf USING (tok) JOIN df USING (tok), st GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0)"""
SPARSE = """
dw0 AS (SELECT doc_id, tok, 1 + ln(tf) AS w FROM tf), dw AS (SELECT doc_id, tok, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dw0),
qw0 AS (SELECT query_id, tok, 1 + ln(qtf) AS w FROM q), qw AS (SELECT query_id, tok, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qw0),
sp AS (SELECT query_id, doc_id, round(sum(dw.w * qw.w), 6) AS score FROM dw JOIN qw USING (tok) GROUP BY ALL),
spr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sp WHERE score > 0)"""
LONG = """
lng AS (SELECT query_id, 'bm25' AS retriever, doc_id, rank, score FROM bmr WHERE rank <= 20 UNION ALL SELECT query_id, 'sparse', doc_id, rank, score FROM spr WHERE rank <= 20)"""
GOLD = """
gold AS (SELECT item_id AS query_id, doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text))"""
RRF = """
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS n_retrievers, min(rank) AS best_rank FROM lng GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_retrievers DESC, best_rank, doc_id) AS rank FROM f)"""
ALL = f"WITH {BM25}, {SPARSE}, {LONG}, {RRF}, {GOLD} "


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return ev.gold_by_containment(docs(spark, sf), questions(spark, sf))


def index(spark: SparkSession, sf: str) -> se.Index:
    """The index of documents: tokenised once in a session, read by every search."""
    return se.Index.build(docs(spark, sf), Derived(spark, f"{sf}/documents.parquet", "index"))


def bm25(spark: SparkSession, sf: str, k: int | None = 20) -> DataFrame:
    return se.bm25(index(spark, sf), questions(spark, sf), k)


def sparse(spark: SparkSession, sf: str, k: int | None = 20) -> DataFrame:
    return se.sparse(index(spark, sf), se.sparse_vectors(questions(spark, sf), "query_id"), k)


def long(spark: SparkSession, sf: str) -> DataFrame:
    return fu.runs(bm25=bm25(spark, sf), sparse=sparse(spark, sf))


def fused(spark: SparkSession, sf: str, k: int | None = 20) -> DataFrame:
    return fu.rrf(long(spark, sf), k)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid retrieval of all passages, with the gold documents marked."""
    g = gold(spark, sf).withColumn("is_gold", F.lit(True))
    return fused(spark, sf, 10).join(g, ["query_id", "doc_id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))


@query("r1_bm25_topk", f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bmr WHERE rank <= 10")
def r1(spark, sf):
    return bm25(spark, sf, 10).select("query_id", "doc_id", "score", "rank")


@query("a3_token_statistics", f"WITH {BM25} SELECT count(*) AS n_tokens, sum(df)::BIGINT AS n_postings, max(df) AS max_df, (SELECT round(a, 6) FROM st) AS avgdl FROM df")
def a3(spark, sf):
    x = index(spark, sf)
    return x.frequencies.agg(F.count("*").alias("n_tokens"), F.sum("df").alias("n_postings"), F.max("df").alias("max_df")).withColumn("avgdl", F.round(F.lit(x.avgdl), 6))


@query("f1_bm25_allowed_documents", f"WITH {BM25}, al AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm WHERE score > 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) SELECT query_id, doc_id, score, r AS rank FROM al WHERE r <= 10")
def f1(spark, sf):
    return se.bm25(index(spark, sf), questions(spark, sf), 10, allowed=docs(spark, sf).where("lang = 'en'")).select("query_id", "doc_id", "score", "rank")


@query("f2_bm25_threshold", f"WITH {BM25} SELECT query_id, count(*) AS n FROM bm WHERE score > 5 GROUP BY 1")
def f2(spark, sf):
    return se.bm25_scores(index(spark, sf), questions(spark, sf)).where("score > 5").groupBy("query_id").agg(F.count("*").alias("n"))


_DENSE = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.v, b.v), 6) AS score FROM v a, v b WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) """


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


@query("r2_dense_topk", _DENSE + "SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 20")
def r2(spark, sf):
    v = vectors(spark, sf)
    return se.dense(v, v.where(F.col("doc_id") % EVERY == 0).withColumnRenamed("doc_id", "query_id"), 20).select("query_id", "doc_id", "score", "rank")


@query("f2_dense_minimum", _DENSE + "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 0.5")
def f2_dense(spark, sf):
    v = vectors(spark, sf)
    q = v.where(F.col("doc_id") % EVERY == 0).withColumnRenamed("doc_id", "query_id")
    return se.dense(v, q, None, 0.5).select("query_id", "doc_id", "score", "rank")


@query("r3_sparse_topk", f"WITH {BM25}, {SPARSE} SELECT query_id, doc_id, score, rank FROM spr WHERE rank <= 20")
def r3(spark, sf):
    return sparse(spark, sf).select("query_id", "doc_id", "score", "rank")


@query("t25_max_sim", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT a.label AS query_id, a.vec_id, b.label AS doc_id, max(list_inner_product(a.v, b.v)) AS best FROM v a, v b GROUP BY ALL) SELECT query_id::BIGINT AS query_id, doc_id::BIGINT AS doc_id, round(avg(best), 6) AS score FROM m GROUP BY ALL")
def t25(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("embedding").alias("v"))
    return se.max_sim(v, v.withColumnRenamed("doc_id", "query_id"))


@query("r4_hybrid_rrf", ALL + "SELECT query_id, doc_id, score, n_retrievers, best_rank, rank FROM fr WHERE rank <= 20")
def r4(spark, sf):
    return fused(spark, sf)


@query("a13_weighted_rrf", ALL + ", w AS (SELECT query_id, doc_id, round(sum(CASE retriever WHEN 'bm25' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (60 + rank)), 9) AS score, count(*) AS n, min(rank) AS b FROM lng GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n DESC, b, doc_id) AS rank FROM w) SELECT query_id, doc_id, score, rank FROM o WHERE rank <= 10")
def a13w(spark, sf):
    return fu.rrf(long(spark, sf), 10, {"bm25": 0.7, "sparse": 0.3}).select("query_id", "doc_id", "score", "rank")


@query("a13_minmax_fusion", ALL + ", b AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM lng WINDOW w AS (PARTITION BY query_id, retriever)), s AS (SELECT query_id, doc_id, round(sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END), 6) AS score, count(DISTINCT retriever) AS n FROM b GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank FROM o WHERE rank <= 10")
def a13m(spark, sf):
    return fu.min_max(long(spark, sf), 10).select("query_id", "doc_id", "score", "rank")


@query("a12_multi_query_support", ALL + "SELECT retriever, doc_id, min(rank) AS rank, count(*) AS support FROM lng GROUP BY ALL")
def a12(spark, sf):
    return fu.multi_query(long(spark, sf).withColumn("query_id", F.lit(0))).select("retriever", "doc_id", "rank", "support")


_ROLES = ALL + ", ro AS (SELECT query_id // 2 AS query_id, query_id % 2 AS role, retriever, doc_id, rank, score FROM lng)"


def roles(spark, sf):
    """Pairs of passages as two roles of one question."""
    return long(spark, sf).withColumns({"role": F.col("query_id") % 2, "query_id": F.floor(F.col("query_id") / 2).cast("long")})


@query("r6_planned_roles", _ROLES + ", s AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(DISTINCT role) AS n_roles, min(rank) AS best_rank FROM ro GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_roles DESC, doc_id) AS rank FROM s) SELECT * FROM o WHERE rank <= 30")
def r6(spark, sf):
    return fu.planned(roles(spark, sf), 30).select("query_id", "doc_id", "score", "n_roles", "best_rank", "rank")


@query("w3_reserved_by_role", _ROLES + ", a AS (SELECT query_id, role, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS pick FROM ro WHERE retriever = 'bm25' AND role = 0 QUALIFY pick <= 3), b AS (SELECT query_id, role, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS pick FROM ro WHERE retriever = 'bm25' AND role = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = ro.query_id AND a.doc_id = ro.doc_id) QUALIFY pick <= 3) SELECT query_id, role::BIGINT AS role_no, doc_id, pick FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def w3(spark, sf):
    r = roles(spark, sf).where("retriever = 'bm25'").withColumn("role_no", F.col("role").cast("long"))
    return fu.reserve_by_role(r, 3)


@query("o10_round_robin", ALL + ", r AS (SELECT query_id, doc_id, min(rank * 10 + CASE retriever WHEN 'sparse' THEN 1 ELSE 2 END) AS o FROM lng GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id) AS rank FROM r) SELECT query_id, doc_id, rank FROM n WHERE rank <= 15")
def o10(spark, sf):
    return fu.round_robin(long(spark, sf), ["sparse", "bm25"], 15).select("query_id", "doc_id", "rank")


@query("o11_reserve_then_fill", ALL + ", u AS (SELECT query_id, doc_id, 1 AS tier, rank FROM spr WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, 2, rank FROM fr), g AS (SELECT query_id, doc_id, min(tier * 1000 + rank) AS o FROM u GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id) AS rank FROM g) SELECT query_id, doc_id, (o // 1000)::BIGINT AS tier, rank FROM n WHERE rank <= 20")
def o11(spark, sf):
    return fu.reserve_then_fill(sparse(spark, sf, 5), fused(spark, sf, None), 20)


@query("o8_lexical_safeguard", ALL + ", u AS (SELECT query_id, doc_id, 'reranker' AS tier, 1 AS t, rank FROM fr WHERE rank <= 4 UNION ALL SELECT query_id, doc_id, 'lexical', 2, rank FROM bmr WHERE rank <= 1 UNION ALL SELECT query_id, doc_id, 'fill', 3, rank FROM fr WHERE rank <= 20), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY t, rank) AS n FROM u), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t, rank, doc_id) AS position FROM o WHERE n = 1) SELECT query_id, doc_id, tier, position FROM p WHERE position <= 5")
def o8(spark, sf):
    return fu.safeguard(fused(spark, sf), bm25(spark, sf), 5, 1)


@query("w4_cap_per_group", ALL + ", g AS (SELECT b.*, source FROM bmr b JOIN documents USING (doc_id) WHERE rank <= 100), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS n FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM c WHERE n <= 3) SELECT query_id, doc_id, source, position FROM p WHERE position <= 12")
def w4(spark, sf):
    h = bm25(spark, sf, 100).join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    return fu.cap_per_group(h, "source", 3, 12).select("query_id", "doc_id", "source", "position")


@query("a4_document_rank", ALL + ", g AS (SELECT query_id, source AS group_id, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM bmr JOIN documents USING (doc_id) WHERE rank <= 50), s AS (SELECT query_id, group_id, round(sum(CASE WHEN n <= 3 THEN 1.0::DOUBLE / rank END), 9) AS score, min(rank) AS best_rank, count(*) AS hits FROM g GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(best_rank, 1000000000), hits DESC, group_id) AS position FROM s")
def a4(spark, sf):
    h = bm25(spark, sf, 50).join(docs(spark, sf).select("doc_id", F.col("source").alias("group_id")), "doc_id")
    return fu.document_rank(h)


_METRICS = ALL + """, j AS (SELECT g.query_id, g.doc_id, fr.rank FROM gold g LEFT JOIN fr ON g.query_id = fr.query_id AND g.doc_id = fr.doc_id AND fr.rank <= 20),
m AS (SELECT query_id, count(*) AS n_gold, min(rank) AS first_rank, round(coalesce(1.0::DOUBLE / min(rank), 0), 9) AS rr,
(count(*) FILTER (rank <= 5) > 0)::BIGINT AS hit_5, round(count(*) FILTER (rank <= 5) / count(*), 9) AS recall_5, (count(*) FILTER (rank <= 10) > 0)::BIGINT AS hit_10, round(count(*) FILTER (rank <= 10) / count(*), 9) AS recall_10,
(count(*) FILTER (rank <= 20) > 0)::BIGINT AS hit_20, round(count(*) FILTER (rank <= 20) / count(*), 9) AS recall_20 FROM j GROUP BY 1) """


@query("j5_gold_by_containment", f"WITH {GOLD} SELECT query_id, doc_id FROM gold")
def j5(spark, sf):
    return gold(spark, sf)


@query("a9_hits_and_reciprocal_rank", _METRICS + "SELECT * FROM m")
def a9(spark, sf):
    return ev.per_query(fused(spark, sf), gold(spark, sf))


@query("a10_recall_summary", _METRICS + "SELECT count(*) AS n_queries, round(avg(rr), 6) AS rr, round(avg(hit_5), 6) AS hit_5, round(avg(recall_5), 6) AS recall_5, round(avg(hit_10), 6) AS hit_10, round(avg(recall_10), 6) AS recall_10, round(avg(hit_20), 6) AS hit_20, round(avg(recall_20), 6) AS recall_20 FROM m")
def a10(spark, sf):
    return ev.summary(ev.per_query(fused(spark, sf), gold(spark, sf)))


@query("a11_union_recall", ALL + ", s AS (SELECT DISTINCT query_id, doc_id FROM lng WHERE rank <= 10) SELECT g.query_id, count(*) AS n_gold, count(s.doc_id) AS n_seen, round(count(s.doc_id) / count(*), 9) AS recall FROM gold g LEFT JOIN s USING (query_id, doc_id) GROUP BY 1")
def a11(spark, sf):
    return ev.union_recall(long(spark, sf), gold(spark, sf), 10)


@query("a15_evidence_sets", ALL + ", es AS (SELECT query_id, doc_id % 2 AS set_id, doc_id AS group_id, doc_id FROM gold), g AS (SELECT es.query_id, set_id, group_id, min(rank) AS r FROM es LEFT JOIN bmr ON es.query_id = bmr.query_id AND es.doc_id = bmr.doc_id AND rank <= 20 GROUP BY ALL), s AS (SELECT query_id, set_id, CASE WHEN count(r) = count(*) THEN max(r) END AS r, count(*) AS n, count(r) AS k FROM g GROUP BY ALL) SELECT query_id, min(r) AS best_rank, round(max(k / n), 9) AS coverage FROM s GROUP BY 1")
def a15(spark, sf):
    sets = gold(spark, sf).select("query_id", (F.col("doc_id") % 2).alias("set_id"), F.col("doc_id").alias("group_id"), "doc_id")
    return ev.evidence_rank(sets, bm25(spark, sf))


@query("p31_failure_classes", ALL + ", j AS (SELECT g.query_id, g.doc_id, b.rank AS b, f.rank AS f FROM gold g LEFT JOIN bmr b ON b.query_id = g.query_id AND b.doc_id = g.doc_id LEFT JOIN fr f ON f.query_id = g.query_id AND f.doc_id = g.doc_id) SELECT query_id, doc_id, CASE WHEN b IS NULL THEN 'not_retrieved' WHEN b > 30 THEN 'outside_window' WHEN f IS NULL OR f > 20 THEN 'dropped' ELSE 'kept' END AS class FROM j")
def p31(spark, sf):
    b = bm25(spark, sf, None).select("query_id", "doc_id", F.col("rank").alias("b"))
    f = fused(spark, sf, None).select("query_id", "doc_id", F.col("rank").alias("f"))
    j = gold(spark, sf).join(b, ["query_id", "doc_id"], "left").join(f, ["query_id", "doc_id"], "left")
    return j.select("query_id", "doc_id", ev.failure_class(F.col("b"), F.when(F.col("b") <= 30, F.col("b")), F.col("f"), 20).alias("class"))


_PAIRED = ALL + """, mb AS (SELECT g.query_id, coalesce(1.0::DOUBLE / min(rank), 0) AS rr FROM gold g LEFT JOIN bmr r ON r.query_id = g.query_id AND r.doc_id = g.doc_id AND rank <= 20 GROUP BY 1),
mf AS (SELECT g.query_id, coalesce(1.0::DOUBLE / min(rank), 0) AS rr FROM gold g LEFT JOIN fr r ON r.query_id = g.query_id AND r.doc_id = g.doc_id AND rank <= 20 GROUP BY 1),
jj AS (SELECT query_id, round(mb.rr, 9) AS x, round(mf.rr, 9) AS y FROM mb JOIN mf USING (query_id)) """


@query("a25_paired_comparison", _PAIRED + "SELECT count(*) AS n, round(avg(y - x), 6) AS mean_diff, count(*) FILTER (y > x) AS wins, count(*) FILTER (y = x) AS ties, count(*) FILTER (y < x) AS losses FROM jj")
def a25(spark, sf):
    g = gold(spark, sf)
    return ev.paired(ev.per_query(bm25(spark, sf), g), ev.per_query(fused(spark, sf), g), "rr")


@query("a25_bootstrap_interval")
def a25b(spark, sf):
    g = gold(spark, sf)
    return ev.bootstrap(ev.per_query(bm25(spark, sf), g), ev.per_query(fused(spark, sf), g), "rr", 2000)


@query("a25_reproducible_interval", _PAIRED + """, dn AS (SELECT row_number() OVER (ORDER BY md5(query_id::VARCHAR), query_id) - 1 AS no, round((y - x) * 1e9)::BIGINT AS d FROM jj), nn AS (SELECT count(*) AS n FROM dn),
dr AS (SELECT r AS draw, ('0x' || substring(md5('7:' || r || ':' || p), 1, 8))::BIGINT % n AS no FROM nn, (SELECT unnest(range(10000)) AS r), LATERAL (SELECT unnest(range(n)) AS p)),
ms AS (SELECT draw, sum(d)::BIGINT AS s FROM dr JOIN dn USING (no) GROUP BY 1), mk AS (SELECT s, row_number() OVER (ORDER BY s, draw) AS k FROM ms)
SELECT n, round(min(s) / n / 1e9, 6) AS low, round(max(s) / n / 1e9, 6) AS high FROM mk, nn WHERE k IN (250, 9750) GROUP BY n""")
def a25c(spark, sf):
    g = gold(spark, sf)
    return ev.bootstrap_interval(ev.per_query(bm25(spark, sf), g), ev.per_query(fused(spark, sf), g), "rr")


@query("p33_outcomes", _PAIRED + "SELECT query_id, CASE WHEN y > x THEN 'improved' WHEN y < x THEN 'regressed' ELSE 'unchanged' END AS outcome FROM jj")
def p33(spark, sf):
    g = gold(spark, sf)
    a, b = ev.per_query(bm25(spark, sf), g), ev.per_query(fused(spark, sf), g)
    j = a.select("query_id", F.col("rr").alias("x")).join(b.select("query_id", F.col("rr").alias("y")), "query_id")
    return j.select("query_id", ev.outcome(F.col("x"), F.col("y")).alias("outcome"))


@query("a14_weight_grid", ALL + """, w AS (SELECT a, b FROM (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS a), (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS b) WHERE a + b > 0),
s AS (SELECT a, b, query_id, doc_id, round(sum(CASE retriever WHEN 'bm25' THEN a ELSE b END / (60 + rank)), 9) AS score FROM lng, w GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY a, b, query_id ORDER BY score DESC, doc_id) AS rank FROM s),
r AS (SELECT o.a, o.b, g.query_id, coalesce(1.0::DOUBLE / min(rank), 0) AS rr FROM gold g JOIN o ON o.query_id = g.query_id AND o.doc_id = g.doc_id GROUP BY ALL),
t AS (SELECT a, b, round(sum(rr) / (SELECT count(DISTINCT query_id) FROM gold), 6) AS mrr FROM r GROUP BY ALL) SELECT a AS w_bm25, b AS w_sparse, mrr, row_number() OVER (ORDER BY mrr DESC, a, b) AS place FROM t""")
def a14(spark, sf):
    from pyspark.sql.window import Window

    at = [(float(a), float(b)) for a in (0, 0.5, 1, 2) for b in (0, 0.5, 1, 2) if a + b]
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in at)))
    s = long(spark, sf).withColumn("g", grid).select("g.a", "g.b", "query_id", "doc_id", F.when(F.col("retriever") == "bm25", F.col("g.a")).otherwise(F.col("g.b")).alias("w"), "rank")
    s = s.groupBy("a", "b", "query_id", "doc_id").agg(F.round(F.sum(F.col("w") / (60 + F.col("rank"))), 9).alias("score"))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b", "query_id").orderBy(F.desc("score"), "doc_id")))
    g = gold(spark, sf)
    r = s.join(g, ["query_id", "doc_id"]).groupBy("a", "b", "query_id").agg((1.0 / F.min("rank")).alias("rr"))
    n = g.agg(F.countDistinct("query_id").alias("n"))
    t = r.groupBy("a", "b").agg(F.sum("rr").alias("s")).join(n).select("a", "b", F.round(F.col("s") / F.col("n"), 6).alias("mrr"))
    return t.select(F.col("a").alias("w_bm25"), F.col("b").alias("w_sparse"), "mrr", F.row_number().over(Window.orderBy(F.desc("mrr"), "a", "b")).cast("long").alias("place"))


@query("r11_annotation_pool", ALL + "SELECT query_id, doc_id, count(*) AS n_systems, min(rank) AS best_rank, string_agg(DISTINCT retriever, ',' ORDER BY retriever) AS systems FROM lng WHERE rank <= 10 GROUP BY ALL")
def r11(spark, sf):
    return ev.pool(long(spark, sf), 10)


@query("w13_blind_order", ALL + ", p AS (SELECT DISTINCT query_id, doc_id FROM lng WHERE rank <= 10) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY sha256('v1|' || query_id || '|' || doc_id)) AS position FROM p")
def w13(spark, sf):
    return ev.blind_order(ev.pool(long(spark, sf), 10).select("query_id", "doc_id"), "v1")


@query("a33_pool_overlap", ALL + ", p AS (SELECT query_id, doc_id, count(*) AS n_systems FROM lng WHERE rank <= 10 GROUP BY ALL) SELECT n_systems, count(*) AS n FROM p GROUP BY 1")
def a33(spark, sf):
    return ev.pool(long(spark, sf), 10).groupBy("n_systems").agg(F.count("*").alias("n"))


@query("j15_annotation_progress", ALL + ", p AS (SELECT DISTINCT query_id, doc_id FROM lng WHERE rank <= 10) SELECT query_id, count(*) AS n_pool, count(quality) AS n_judged, CASE WHEN count(quality) = count(*) THEN 'complete' WHEN count(quality) = 0 THEN 'todo' ELSE 'partial' END AS status FROM p LEFT JOIN labels USING (doc_id) GROUP BY 1")
def j15(spark, sf):
    p = ev.pool(long(spark, sf), 10).select("query_id", "doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    n, k = F.count("*"), F.count("quality")
    return p.groupBy("query_id").agg(n.alias("n_pool"), k.alias("n_judged"), F.when(k == n, "complete").when(k == 0, "todo").otherwise("partial").alias("status"))


@query("f13_weak_lexical_repair", ALL + ", m AS (SELECT query_id, max(score) AS best FROM bmr GROUP BY 1) SELECT query_id, doc_id, rank FROM bmr JOIN m USING (query_id) WHERE rank <= 20 AND score >= greatest(0.12, 0.15 * best)")
def f13(spark, sf):
    from pyspark.sql.window import Window

    h = bm25(spark, sf).withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    return h.where(F.col("score") >= F.greatest(F.lit(0.12), 0.15 * F.col("best"))).select("query_id", "doc_id", "rank")


@query("j6_semi_and_j7_anti", ALL + "SELECT query_id, count(*) AS n_gold, count(*) FILTER (NOT EXISTS (SELECT 1 FROM bmr b WHERE b.query_id = gold.query_id AND b.doc_id = gold.doc_id)) AS n_lost FROM gold GROUP BY 1")
def j7(spark, sf):
    g = gold(spark, sf)
    lost = g.join(bm25(spark, sf, None), ["query_id", "doc_id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("n_lost"))
    return g.groupBy("query_id").agg(F.count("*").alias("n_gold")).join(lost, "query_id", "left").select("query_id", "n_gold", F.coalesce("n_lost", F.lit(0)).alias("n_lost"))
