"""Queries of the stored vector index and of late interaction on candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as ve
from ..operators.search import ranked
from ..sources.tables import Derived, table
from .registry import query
from .retrieval import _DENSE, EVERY, vectors

#: Vectors of a multi-vector document in these queries: runs of vec_id.
TOKENS = 8


def index(spark, sf):
    return ve.DenseIndex.build(vectors(spark, sf), Derived(spark, f"{sf}/embeddings.parquet", "dense"))


def asked(spark, sf):
    return vectors(spark, sf).where(F.col("doc_id") % EVERY == 0).withColumnRenamed("doc_id", "query_id")


@query("s11_dense_index_search", _DENSE + "SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 20")
def s11_search(spark, sf):
    return index(spark, sf).search(asked(spark, sf), 20).select("query_id", "doc_id", "score", "rank")


@query("s11_dense_index_minimum", _DENSE + "SELECT query_id, count(*) AS n, round(min(score), 6) AS least FROM s WHERE score >= 0.5 GROUP BY 1")
def s11_minimum(spark, sf):
    return index(spark, sf).search(asked(spark, sf), None, 0.5).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least"))


@query("s11_dense_index_manifest", "SELECT count(*) AS n_vectors, max(len(embedding))::BIGINT AS dim, round(min(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS min_norm, round(max(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS max_norm, 0::BIGINT AS n_misaligned FROM embeddings")
def s11_manifest(spark, sf):
    x = index(spark, sf)
    return x.manifest().crossJoin(x.misaligned(vectors(spark, sf)).agg(F.count("*").alias("n_misaligned")))


@query("t25_candidates", f"""WITH v AS (SELECT vec_id, vec_id // {TOKENS} AS doc, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT doc, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM v), m0 AS (SELECT doc, i, avg(x) AS x FROM e GROUP BY ALL), m AS (SELECT doc, list(x ORDER BY i) AS v FROM m0 GROUP BY doc),
s AS (SELECT a.doc AS query_id, b.doc AS doc_id, round(list_inner_product(a.v, b.v), 6) AS score FROM m a, m b WHERE a.doc % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s),
c AS (SELECT query_id, doc_id FROM r WHERE rank <= 20),
b AS (SELECT c.query_id, c.doc_id, a.vec_id, max(list_inner_product(a.v, d.v)) AS best FROM c JOIN v a ON a.doc = c.query_id JOIN v d ON d.doc = c.doc_id GROUP BY ALL),
l AS (SELECT query_id, doc_id, round(avg(best), 6) AS score FROM b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM l)
SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 10""")
def t25_candidates(spark, sf):
    """First the 20 documents of the nearest mean vector, from the stored index of means; then late interaction with these alone."""
    v = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / TOKENS).cast("long").alias("doc_id"), F.col("embedding").alias("v"))
    e = v.select("doc_id", F.posexplode("v").alias("i", "x")).groupBy("doc_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = e.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("v"))
    x = ve.DenseIndex.build(mean, Derived(spark, f"{sf}/embeddings.parquet", "means"))
    q = x.members().where(F.col("doc_id") % EVERY == 0).withColumnRenamed("doc_id", "query_id")
    c = x.search(q, 20).select("query_id", "doc_id")
    tokens = v.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("vec_id").alias("pos"), "v")
    return ranked(ve.late_interaction(c, tokens, v.select("doc_id", "v")), 10).select("query_id", "doc_id", "score", "rank")
