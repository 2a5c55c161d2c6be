"""Queries of aggregates, joins, stores, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import vectors as ve
from ..functions.text import estimated_tokens
from ..operators import conversation as cv
from ..operators import corpus as co
from ..operators import evaluation as ev
from ..operators import planning as pl
from ..operators import store as st
from ..sources.tables import table
from .planning import ALIASES
from .registry import query


@query("a17_nearest_rank_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def a17(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("a18_interpolated_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def a18(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("a19_summary_statistics", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def a19(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


_LE = [1.0, 5.0, 10.0, 50.0, 100.0, 500.0]


@query("a20_cumulative_histogram", "SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 500.0])::DOUBLE AS le) GROUP BY ALL")
def a20(spark, sf):
    return ev.histogram(table(spark, sf, "events"), "value", _LE, "event_type")


@query("a21_category_breakdown", "SELECT source, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(avg(n_chars), 6) AS n_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a21(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.avg("n_chars"), 6).alias("n_chars"))


@query("a22_value_counts", "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def a22(spark, sf):
    g = table(spark, sf, "documents").groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"), F.grouping("lang").alias("g"))
    return g.select(F.when(F.col("g") == 0, "lang").otherwise("source").alias("field"), F.when(F.col("g") == 0, F.col("lang")).otherwise(F.col("source")).alias("value"), "n")


@query("a23_confusion_matrix", "SELECT quality::BIGINT AS label_a, toxic::BIGINT AS label_b, count(*) AS n FROM labels GROUP BY ALL")
def a23(spark, sf):
    return ev.confusion(table(spark, sf, "labels"), "quality", "toxic")


@query("j16_label_agreement", "WITH d AS (SELECT abs(quality - toxic) AS d FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) SELECT count(*) AS n, round(avg((d = 0)::INT), 6) AS exact, round(avg((d <= 1)::INT), 6) AS within_one FROM d")
def j16(spark, sf):
    return ev.agreement(table(spark, sf, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL"), "quality", "toxic")


@query("a24_pearson", "SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def a24(spark, sf):
    return ev.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query("a34_reduction", "SELECT l_returnflag, round(100.0 * (1 - sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice)), 2)::DOUBLE AS percent FROM lineitem GROUP BY 1")
def a34(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(100.0 * (1 - F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_extendedprice")), 2).alias("percent"))


@query("a31_vector_statistics", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT sqrt(list_inner_product(v, v)) AS n FROM v) SELECT count(*) AS n, round(min(n), 5) AS least, round(max(n), 5) AS most, round(avg(n), 5) AS mean FROM n")
def a31(spark, sf):
    n = table(spark, sf, "embeddings").select(ve.norm(F.col("embedding")).alias("n"), ve.finite(F.col("embedding")).alias("ok")).where("ok")
    return n.agg(F.count("*").alias("n"), F.round(F.min("n"), 5).alias("least"), F.round(F.max("n"), 5).alias("most"), F.round(F.avg("n"), 5).alias("mean"))


@query("a5_group_centroids", "WITH e AS (SELECT label, unnest(generate_series(0, 63)) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS m FROM e GROUP BY ALL) SELECT label, dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m")
def a5(spark, sf):
    return co.group_centroids(table(spark, sf, "embeddings"), "label", "embedding")


@query("t22_normalised_vectors", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM v")
def t22(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(ve.normalised(F.col("embedding"))[0], 6).alias("first"))


@query("w11_min_max_scaled", "SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def w11(spark, sf):
    e = table(spark, sf, "events")
    m = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # joined back: no window over a hot type
    return e.join(m, "event_type").select("event_id", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0), 6).alias("scaled"))


@query("w16_latest_event", "SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def w16(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("w17_canonical_name", "WITH n AS (SELECT c_nationkey, c_mktsegment, c_name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END, lower(c_name)) AS r FROM customer) SELECT c_nationkey, c_mktsegment, c_name FROM n WHERE r = 1")
def w17(spark, sf):
    o = F.struct(F.when(F.col("c_acctbal") > 0, 0).otherwise(1).alias("p"), F.lower("c_name").alias("n"))
    return table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min_by("c_name", o).alias("c_name"))


@query("j13_session_listing", "WITH s AS (SELECT o_orderkey, o_orderdate FROM orders) SELECT o_orderkey, count(l_orderkey) AS n_messages FROM s LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10")
def j13(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("updated"), F.col("o_orderdate").alias("created"))
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    return st.listing(s, m, "key", 50, 10).select(F.col("key").alias("o_orderkey"), "n_messages")


@query("j14_session_history", "SELECT o_orderkey, count(*) AS n, string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j14(spark, sf):
    j = table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return j.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["l_linenumber"].cast("string"))), ",").alias("items"))


_SNAP = "o AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE doc_id >= 20), n AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS d FROM documents WHERE doc_id % 11 <> 0)"


def snapshots(spark, sf):
    d = table(spark, sf, "documents")
    old = d.where("doc_id >= 20").select("doc_id", F.sha2("text", 256).alias("d"))
    new = d.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "!").otherwise("")), 256).alias("d"))
    return old, new


@query("j17_snapshot_diff", f"WITH {_SNAP}, j AS (SELECT n.doc_id AS a, o.doc_id AS b, n.d AS x, o.d AS y, row_number() OVER (PARTITION BY n.d ORDER BY (o.doc_id IS NULL)::INT, n.doc_id) AS r FROM n FULL JOIN o ON n.doc_id = o.doc_id) SELECT coalesce(a, b) AS doc_id, CASE WHEN a IS NULL THEN 'removed' WHEN r > 1 THEN 'duplicate' WHEN b IS NULL THEN 'new' WHEN x = y THEN 'unchanged' ELSE 'modified' END AS state FROM j")
def j17(spark, sf):
    return st.snapshot_diff(*snapshots(spark, sf), "doc_id", "d")


@query("s12_upsert", f"WITH {_SNAP} SELECT doc_id, d FROM n UNION ALL SELECT doc_id, d FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def s12(spark, sf):
    return st.upsert(*snapshots(spark, sf), "doc_id")


@query("j22_digest_drift", f"WITH {_SNAP} SELECT o.doc_id, CASE WHEN n.d IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM o LEFT JOIN n USING (doc_id) WHERE n.d IS NULL OR n.d <> o.d")
def j22(spark, sf):
    return st.drift(*snapshots(spark, sf), "doc_id", "d")


@query("j12_three_way_cache", f"WITH {_SNAP}, c AS (SELECT doc_id, d, doc_id AS v FROM o WHERE doc_id % 2 = 0), l AS (SELECT doc_id, -doc_id AS v FROM o WHERE doc_id % 3 = 0), t AS (SELECT d, min(doc_id) + 1000000 AS v FROM o GROUP BY 1) SELECT n.doc_id, coalesce(c.v, l.v, t.v) AS value, CASE WHEN c.v IS NOT NULL THEN 'exact' WHEN l.v IS NOT NULL THEN 'legacy' WHEN t.v IS NOT NULL THEN 'text' ELSE 'miss' END AS hit FROM n LEFT JOIN c ON c.doc_id = n.doc_id AND c.d = n.d LEFT JOIN l ON l.doc_id = n.doc_id LEFT JOIN t ON t.d = n.d")
def j12(spark, sf):
    old, new = snapshots(spark, sf)
    o = old.select(F.col("doc_id").alias("id"), F.col("d").alias("digest"))
    cache = o.where("id % 2 = 0").withColumn("value", F.col("id"))
    legacy = o.where("id % 3 = 0").select("id", (-F.col("id")).alias("value"))
    return st.cached(new.select(F.col("doc_id").alias("id"), F.col("d").alias("digest")), cache, legacy, o.withColumn("value", F.col("id") + 1_000_000)).select(F.col("id").alias("doc_id"), "value", "hit")


@query("j9_alias_in_text", "WITH a(source, alias) AS (VALUES " + ", ".join(map(str, ALIASES)) + r"), q AS (SELECT conv_id, turn, ' ' || regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS f FROM conversations), m AS (SELECT conv_id, turn, source, max(length(alias)) AS longest FROM q JOIN a ON contains(f, ' ' || alias || ' ') GROUP BY ALL) SELECT conv_id, turn, count(*) AS n, CASE WHEN count(*) = 1 THEN min(source) END AS found, max(longest)::BIGINT AS longest FROM m GROUP BY ALL")
def j9(spark, sf):
    a = spark.createDataFrame(ALIASES, "source string, alias string")
    f = F.regexp_replace(tx.folded(F.col("text")), r"[^\p{L}\p{N}]+", " ")
    m = pl.named(table(spark, sf, "conversations").select("conv_id", "turn", f.alias("f")), a, "f").groupBy("conv_id", "turn", "source").agg(F.max(F.length("alias")).alias("longest"))
    n = F.count("*")
    return m.groupBy("conv_id", "turn").agg(n.alias("n"), F.when(n == 1, F.min("source")).alias("found"), F.max("longest").cast("long").alias("longest"))


@query("j10_neighbours_within_two", "SELECT a.conv_id, a.turn, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) BETWEEN 1 AND 2 AND a.role = b.role GROUP BY ALL")
def j10(spark, sf):
    w = Window.partitionBy("conv_id", "role").orderBy("turn").rangeBetween(-2, 2)  # a range frame instead of a self-join
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.count("*").over(w) - 1).alias("n")).where("n > 0")


@query("j11_parent_children", "SELECT conv_id AS parent, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS children FROM conversations GROUP BY 1")
def j11(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("parent")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda x: x.cast("string")), ",").alias("children"))


@query("j3_bonus_lookup", "WITH r AS (SELECT label, row_number() OVER (ORDER BY label) AS rank FROM (SELECT DISTINCT label FROM embeddings)) SELECT vec_id, round(greatest(0.0005, 0.006 - 0.0005 * (rank - 1))::DOUBLE, 6) AS bonus FROM embeddings JOIN r USING (label)")
def j3(spark, sf):
    e = table(spark, sf, "embeddings")
    r = e.select("label").distinct().withColumn("rank", F.row_number().over(Window.orderBy("label")))
    return e.join(r, "label").select("vec_id", F.round(F.greatest(F.lit(0.0005), 0.006 - 0.0005 * (F.col("rank") - 1)), 6).alias("bonus"))


@query("j20_grid", "SELECT b.item_id, g.k, length(b.text) % g.k AS x FROM benchmark b, (SELECT unnest([5, 10, 20]) AS k) g")
def j20(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("k", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))))
    return b.select("item_id", "k", (F.length("text") % F.col("k")).cast("long").alias("x"))


@query("u3_set_equality", "SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS n_unknown, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS n_empty")
def u3(spark, sf):
    o, l = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return l.join(o, "o_orderkey", "left_anti").agg(F.count("*").alias("n_unknown")).join(o.join(l, "o_orderkey", "left_anti").agg(F.count("*").alias("n_empty")))


@query("o16_natural_order", "SELECT c_custkey, row_number() OVER (ORDER BY regexp_extract(c_name, '^([^0-9]*)', 1), nullif(regexp_extract(c_name, '([0-9]+)', 1), '')::BIGINT, c_name) AS n FROM customer")
def o16(spark, sf):
    c = table(spark, sf, "customer")
    o = Window.orderBy(F.regexp_extract("c_name", "^([^0-9]*)", 1), F.nullif(F.regexp_extract("c_name", "([0-9]+)", 1), F.lit("")).cast("long"), "c_name")
    return c.select("c_custkey", F.row_number().over(o).cast("long").alias("n"))


@query("st1_last_mention", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS last_user, last_value(CASE WHEN length(text) > 200 THEN turn END IGNORE NULLS) OVER w AS last_long FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def st1(spark, sf):
    t = F.col("turn")
    return cv.last_mention(table(spark, sf, "conversations"), "conv_id", "turn", {"last_user": F.when(F.col("role") == "user", t), "last_long": F.when(F.length("text") > 200, t)}).select("conv_id", "turn", "last_user", "last_long")


@query("st3_source_lock", "WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'auto' WHEN turn % 3 = 1 THEN 's' || (turn % 7) END AS e FROM conversations), l AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS l FROM e) SELECT conv_id, turn, nullif(l, 'auto') AS lock FROM l")
def st3(spark, sf):
    e = F.when(F.col("turn") % 5 == 4, F.lit("auto")).when(F.col("turn") % 3 == 1, F.concat(F.lit("s"), (F.col("turn") % 7).cast("string")))
    return cv.locked_source(table(spark, sf, "conversations"), "conv_id", "turn", e).select("conv_id", "turn", "lock")


@query("st2_memory", """WITH t AS (SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4))::BIGINT END AS k FROM conversations), r AS (SELECT *, row_number() OVER w AS n, sum(k) OVER (w ROWS UNBOUNDED PRECEDING) AS r FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
o AS (SELECT *, n <= 2 AND r <= 60 AS recent FROM r), s AS (SELECT *, sum(CASE WHEN recent THEN 0 ELSE k END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT conv_id, turn, CASE WHEN recent THEN 'recent' WHEN s <= 80 THEN 'summary' ELSE 'dropped' END AS place FROM s""")
def st2(spark, sf):
    c = table(spark, sf, "conversations").withColumn("k", estimated_tokens(F.col("text")))
    return cv.memory(c, "conv_id", "turn", "k", 60, 80).select("conv_id", "turn", "place")


@query("t31_json_fields", "SELECT event_id, len(json_keys(props))::BIGINT AS n_keys FROM events")
def t31(spark, sf):
    return table(spark, sf, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))
