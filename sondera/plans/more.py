"""Further queries of projections, predicates, selection and checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import fusion as fu
from ..operators import planning as pl
from ..sources.tables import table
from .registry import query
from .retrieval import ALL, bm25, docs, fused, gold, questions, sparse


def T(name):  # noqa: N802
    return lambda spark, sf: table(spark, sf, name)


conv, pages, documents = T("conversations"), T("pages"), T("documents")


@query("p6_request_path", r"SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'bypass' WHEN regexp_matches(lower(text), '^(hello|hi)\b') THEN 'greeting' WHEN length(text) < 40 THEN 'direct' ELSE 'retrieve' END AS path FROM conversations")
def p6(spark, sf):
    path = F.when(F.col("role") == "system", "bypass").otherwise(pl.first_match(F.col("text"), [("greeting", r"(?i)^(hello|hi)\b"), ("direct", r"^(?s:.{0,39})$")], "retrieve"))
    return conv(spark, sf).select("conv_id", "turn", path.alias("path"))


@query("p8_letter_shares", r"SELECT lang, round(avg(len(regexp_extract_all(text, '[àâçéèêëîïôûùüÿœæ]')) / greatest(1, length(text))), 6) AS accented FROM documents GROUP BY 1")
def p8(spark, sf):
    return documents(spark, sf).groupBy("lang").agg(F.round(F.avg(F.regexp_count("text", F.lit("[àâçéèêëîïôûùüÿœæ]")) / F.greatest(F.lit(1), F.length("text"))), 6).alias("accented"))


@query("p14_heading_fields", "WITH h AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS h FROM pages) SELECT page_id, CASE WHEN len(h) >= 3 THEN h[-3] WHEN len(h) >= 1 THEN h[1] END AS chapter, CASE WHEN len(h) >= 3 THEN h[-2] WHEN len(h) = 2 THEN h[2] END AS section, CASE WHEN len(h) >= 3 THEN h[-1] END AS subsection FROM h")
def p14(spark, sf):
    h = pages(spark, sf).select("page_id", F.filter(F.split(F.regexp_replace("url", "^https?://", ""), "/"), lambda x: x != "").alias("h"))
    n, at = F.size("h"), lambda i: F.get(F.col("h"), F.size("h") + i)
    return h.select("page_id", F.when(n >= 3, at(-3)).when(n >= 1, F.get("h", F.lit(0))).alias("chapter"), F.when(n >= 3, at(-2)).when(n == 2, F.get("h", F.lit(1))).alias("section"), F.when(n >= 3, at(-1)).alias("subsection"))


@query("p16_text_with_context", "SELECT conv_id, turn, sha256(concat_ws(chr(10), role, right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 40), text)) AS digest FROM conversations")
def p16(spark, sf):
    before = F.right(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(40))
    return conv(spark, sf).select("conv_id", "turn", F.sha2(F.concat_ws("\n", "role", before, "text"), 256).alias("digest"))


@query("p23_document_of_chunk_id", r"SELECT c_custkey, regexp_extract(replace(c_name, '#', '_'), '^(.*)_[^_]*$', 1) AS document FROM customer")
def p23(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.regexp_extract(F.replace("c_name", F.lit("#"), F.lit("_")), "^(.*)_[^_]*$", 1).alias("document"))


@query("p25_covered_pages", "SELECT conv_id, sum(len(generate_series(turn, turn + length(text) // 200)))::BIGINT AS n_pages FROM conversations GROUP BY 1")
def p25(spark, sf):
    span = F.sequence(F.col("turn"), F.col("turn") + F.floor(F.length("text") / 200).cast("long"))
    return conv(spark, sf).groupBy("conv_id").agg(F.sum(F.size(span)).alias("n_pages"))


@query("p30_truncation_salvage", r"SELECT conv_id, turn, sha256(CASE WHEN length(text) >= 200 AND NOT regexp_matches(text, '[.!?]\z') THEN coalesce(nullif(regexp_extract(text, '^((?s:.*)[.!?])', 1), ''), text) ELSE text END) AS digest FROM conversations")
def p30(spark, sf):
    c = conv(spark, sf).select("conv_id", "turn", "text")
    cut = F.coalesce(F.nullif(F.regexp_extract("text", r"^((?s:.*)[.!?])", 1), F.lit("")), F.col("text"))
    return c.select("conv_id", "turn", F.sha2(F.when((F.length("text") >= 200) & ~F.col("text").rlike(r"[.!?]\z"), cut).otherwise(F.col("text")), 256).alias("digest"))


@query("p32_rescue_classes", ALL + ", j AS (SELECT g.query_id, g.doc_id, b.rank AS b, s.rank AS s, f.rank AS f FROM gold g LEFT JOIN bmr b ON b.query_id = g.query_id AND b.doc_id = g.doc_id AND b.rank <= 20 LEFT JOIN spr s ON s.query_id = g.query_id AND s.doc_id = g.doc_id AND s.rank <= 20 LEFT JOIN fr f ON f.query_id = g.query_id AND f.doc_id = g.doc_id AND f.rank <= 10) SELECT query_id, doc_id, CASE WHEN f IS NULL THEN 'not_preserved' WHEN b IS NOT NULL AND s IS NOT NULL THEN 'multiple' WHEN b IS NOT NULL THEN 'bm25_rescue' WHEN s IS NOT NULL THEN 'sparse_rescue' ELSE 'fusion_rescue' END AS class FROM j")
def p32(spark, sf):
    r = lambda df, n: df.select("query_id", "doc_id", F.col("rank").alias(n))
    j = gold(spark, sf).join(r(bm25(spark, sf), "b"), ["query_id", "doc_id"], "left").join(r(sparse(spark, sf), "s"), ["query_id", "doc_id"], "left").join(r(fused(spark, sf, 10), "f"), ["query_id", "doc_id"], "left")
    b, s = F.col("b").isNotNull(), F.col("s").isNotNull()
    return j.select("query_id", "doc_id", F.when(F.col("f").isNull(), "not_preserved").when(b & s, "multiple").when(b, "bm25_rescue").when(s, "sparse_rescue").otherwise("fusion_rescue").alias("class"))


@query("p34_rank_outcomes", ALL + ", j AS (SELECT g.query_id, min(f.rank) AS f, min(l.rank) AS c FROM gold g LEFT JOIN fr f ON f.query_id = g.query_id AND f.doc_id = g.doc_id AND f.rank <= 20 LEFT JOIN lng l ON l.query_id = g.query_id AND l.doc_id = g.doc_id GROUP BY 1) SELECT query_id, CASE WHEN f = 1 THEN 'rank_1' WHEN f <= 5 THEN 'top_5' WHEN c IS NOT NULL THEN 'ranking_miss' ELSE 'candidate_miss' END AS outcome FROM j")
def p34(spark, sf):
    from .retrieval import long

    f = fused(spark, sf).select("query_id", "doc_id", F.col("rank").alias("f"))
    c = long(spark, sf).groupBy("query_id", "doc_id").agg(F.min("rank").alias("c"))
    j = gold(spark, sf).join(f, ["query_id", "doc_id"], "left").join(c, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("f").alias("f"), F.min("c").alias("c"))
    return j.select("query_id", F.when(F.col("f") == 1, "rank_1").when(F.col("f") <= 5, "top_5").when(F.col("c").isNotNull(), "ranking_miss").otherwise("candidate_miss").alias("outcome"))


@query("p36_input_variants", "SELECT doc_id, variant, length(t)::BIGINT AS n FROM (SELECT doc_id, 'text' AS variant, text AS t FROM documents UNION ALL SELECT doc_id, 'titled', source || ': ' || text FROM documents UNION ALL SELECT doc_id, 'sectioned', lang || chr(10) || text FROM documents UNION ALL SELECT doc_id, 'full', 'Document: ' || source || chr(10) || 'Section: ' || lang || chr(10) || 'Passage: ' || text FROM documents)")
def p36(spark, sf):
    v = F.array(F.struct(F.lit("text").alias("variant"), F.col("text").alias("t")), F.struct(F.lit("titled").alias("variant"), F.concat("source", F.lit(": "), "text").alias("t")), F.struct(F.lit("sectioned").alias("variant"), F.concat("lang", F.lit("\n"), "text").alias("t")), F.struct(F.lit("full").alias("variant"), F.concat(F.lit("Document: "), "source", F.lit("\nSection: "), "lang", F.lit("\nPassage: "), "text").alias("t")))
    return documents(spark, sf).select("doc_id", F.explode(v).alias("v")).select("doc_id", "v.variant", F.length("v.t").cast("long").alias("n"))


@query("f4_low_value_lines", r"SELECT count(*) AS n_lines, count(*) FILTER (regexp_matches(lower(x), '^(contents|index|bibliography|references)\b|license')) AS n_low FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents)")
def f4(spark, sf):
    x = documents(spark, sf).select(F.explode(F.split("text", "\n")).alias("x"))
    return x.agg(F.count("*").alias("n_lines"), F.count(F.when(F.lower("x").rlike(r"^(contents|index|bibliography|references)\b|license"), 1)).alias("n_low"))


@query("f7_protected_lines", r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]|[|=]')))::BIGINT AS n_protected FROM documents")
def f7(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("[0-9]|[|=]"))).cast("long").alias("n_protected"))


@query("f14_eligible_variants", ALL + ", m AS (SELECT g.query_id, coalesce(1.0::DOUBLE / min(b.rank), 0) AS x, coalesce(1.0::DOUBLE / min(f.rank), 0) AS y FROM gold g LEFT JOIN bmr b ON b.query_id = g.query_id AND b.doc_id = g.doc_id AND b.rank <= 20 LEFT JOIN fr f ON f.query_id = g.query_id AND f.doc_id = g.doc_id AND f.rank <= 20 GROUP BY 1) SELECT round(avg(x), 6) AS baseline, round(avg(y), 6) AS variant, round(avg(y), 6) >= round(avg(x), 6) - 0.01 AS eligible FROM m")
def f14(spark, sf):
    g = gold(spark, sf)
    a = ev.summary(ev.per_query(bm25(spark, sf), g)).select(F.col("rr").alias("baseline"))
    b = ev.summary(ev.per_query(fused(spark, sf), g)).select(F.col("rr").alias("variant"))
    return a.join(b).withColumn("eligible", F.col("variant") >= F.col("baseline") - 0.01)


@query("a26_bundle_diagnostics", "WITH s AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS n_roles, sum(length(text))::BIGINT AS used, max(length(text)) AS most FROM conversations GROUP BY 1) SELECT conv_id, round(used / greatest(1, most), 6) AS expansion, round(n_roles / n, 6) AS unique_share, round(least(1.0, used / 2000), 6)::DOUBLE AS utilisation FROM s")
def a26(spark, sf):
    s = conv(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("role").alias("k"), F.sum(F.length("text")).alias("used"), F.max(F.length("text")).alias("most"))
    return s.select("conv_id", F.round(F.col("used") / F.greatest(F.lit(1), "most"), 6).alias("expansion"), F.round(F.col("k") / F.col("n"), 6).alias("unique_share"), F.round(F.least(F.lit(1.0), F.col("used") / 2000), 6).alias("utilisation"))


@query("a29_review_metrics", "SELECT source, count(*) AS n, round(count(*) FILTER (quality = 1) / count(*), 6) AS success, round(count(*) FILTER (toxic = 0) / greatest(1, count(toxic)), 6) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a29(spark, sf):
    j = documents(spark, sf).select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    n = F.count("*")
    return j.groupBy("source").agg(n.alias("n"), F.round(F.count(F.when(F.col("quality") == 1, 1)) / n, 6).alias("success"), F.round(F.count(F.when(F.col("toxic") == 0, 1)) / F.greatest(F.lit(1), F.count("toxic")), 6).alias("precision"))


@query("w12_first_anchor", ALL + "SELECT query_id, source, min(rank) AS position FROM bmr JOIN documents USING (doc_id) WHERE rank <= 30 GROUP BY ALL")
def w12(spark, sf):
    return bm25(spark, sf, 30).join(docs(spark, sf).select("doc_id", "source"), "doc_id").groupBy("query_id", "source").agg(F.min("rank").alias("position"))


@query("o6_missing_score_order", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(nullif(l_discount, 0), -1) DESC, l_linenumber, l_partkey) AS n FROM lineitem")
def o6(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.coalesce(F.nullif("l_discount", F.lit(0.0)), F.lit(-1.0)).desc(), "l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("n"))


@query("o12_three_tier_composition", ALL + ", t AS (SELECT query_id, doc_id, 1 AS t, rank FROM bmr WHERE rank <= 3 UNION ALL SELECT query_id, doc_id, 2, rank FROM spr WHERE rank <= 3 UNION ALL SELECT query_id, doc_id, 3, rank FROM fr WHERE rank <= 20), g AS (SELECT query_id, doc_id, min(t * 1000 + rank) AS o FROM t GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id) AS rank FROM g) SELECT query_id, doc_id, rank FROM n WHERE rank <= 12")
def o12(spark, sf):
    a = fu.reserve_then_fill(bm25(spark, sf, 3), sparse(spark, sf, 3), None)
    return fu.reserve_then_fill(a, fused(spark, sf), 12).select("query_id", "doc_id", "rank")


@query("o15_best_variant", "WITH v AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 4) AS a, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, arg_max(c_mktsegment, struct_pack(n := n, a := a, s := c_mktsegment)) AS best FROM v GROUP BY 1")
def o15(spark, sf):
    v = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("a"), F.count("*").alias("n"))
    return v.groupBy("c_nationkey").agg(F.max_by("c_mktsegment", F.struct("n", "a", "c_mktsegment")).alias("best"))


@query("u1_ordered_union", "WITH e AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM e GROUP BY 1")
def u1(spark, sf):
    r = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return conv(spark, sf).groupBy("conv_id").agg(F.array_join(F.array_distinct(r), ",").alias("roles"))


@query("u5_pool_with_evidence", ALL + "SELECT query_id, doc_id, string_agg(retriever || ':' || rank, ',' ORDER BY retriever) AS found_by FROM lng WHERE rank <= 10 GROUP BY ALL")
def u5(spark, sf):
    from .retrieval import long

    e = F.array_sort(F.collect_list(F.struct("retriever", "rank")))
    p = long(spark, sf).where("rank <= 10").groupBy("query_id", "doc_id").agg(e.alias("e"))
    return p.select("query_id", "doc_id", F.array_join(F.transform("e", lambda x: F.concat(x["retriever"], F.lit(":"), x["rank"].cast("string"))), ",").alias("found_by"))


@query("t5_alnum_normalised", r"SELECT item_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9%]+', ' ', 'g')) AS t FROM benchmark")
def t5(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.trim(F.regexp_replace(tx.folded(F.col("text")), "[^a-z0-9%]+", " ")).alias("t"))


@query("t6_passage_lines", r"WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS l FROM pages) SELECT page_id, len(l)::BIGINT AS n, sha256(array_to_string(l, chr(10))) AS digest FROM p")
def t6(spark, sf):
    l = F.filter(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n"), lambda x: F.trim(x) != "")
    p = pages(spark, sf).select("page_id", l.alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("n"), F.sha2(F.array_join("l", "\n"), 256).alias("digest"))


@query("t8_comparison_keys", r"SELECT count(DISTINCT replace(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), 'ß', 'ss')) AS n FROM documents")
def t8(spark, sf):
    return documents(spark, sf).agg(F.countDistinct(F.xxhash64(tx.folded(tx.collapse(F.col("text"))))).alias("n"))


@query("t19_ocr_tolerant_numbers", r"SELECT doc_id, array_to_string(regexp_extract_all(translate(text, 'lo', '10'), '(?:^|[ \n])([0-9]{2,})', 1), ' ') AS numbers FROM documents")
def t19(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(F.regexp_extract_all(F.translate("text", "lo", "10"), F.lit(r"(?:^|[ \n])([0-9]{2,})"), 1), " ").alias("numbers"))


@query("t32_titles", r"SELECT page_id, substring(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 200) AS title FROM pages")
def t32(spark, sf):
    return pages(spark, sf).select("page_id", F.substring(tx.collapse(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), 1, 200).alias("title"))


@query("t36_sample_positions", "SELECT n, i, CAST(round_even(i * (n - 1) / 11.0, 0) AS BIGINT) AS pos FROM (SELECT DISTINCT n_chars AS n FROM documents WHERE n_chars > 12), (SELECT unnest(generate_series(0, 11)) AS i)")
def t36(spark, sf):
    n = documents(spark, sf).select(F.col("n_chars").alias("n")).where("n > 12").distinct()
    return n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("i")).withColumn("pos", F.bround(F.col("i") * (F.col("n") - 1) / 11.0, 0).cast("long"))


@query("q6_hierarchy_violations", "WITH c AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS u, min(l_linenumber) AS a, max(l_linenumber) AS z FROM lineitem GROUP BY 1) SELECT count(*) FILTER (u <> n) AS n_double, count(*) FILTER (a <> 1) AS n_bad_first, count(*) FILTER (z - a + 1 <> u) AS n_gaps FROM c")
def q6(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("u"), F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("z"))
    k = lambda c: F.count(F.when(c, 1))
    return c.agg(k(F.col("u") != F.col("n")).alias("n_double"), k(F.col("a") != 1).alias("n_bad_first"), k(F.col("z") - F.col("a") + 1 != F.col("u")).alias("n_gaps"))


@query("q8_evaluation_set_rules", "SELECT (length(text) > 0) AS has_text, item_id % 2 AS split, count(*) AS n, count(DISTINCT text) AS n_families FROM benchmark GROUP BY ALL")
def q8(spark, sf):
    b = questions(spark, sf)
    return b.groupBy((F.length("text") > 0).alias("has_text"), (F.col("query_id") % 2).alias("split")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_families"))


@query("q15_corpus_totals", "SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, sum(n_chars)::BIGINT AS n_chars, sum(length(text))::BIGINT = sum(n_chars)::BIGINT AS agrees FROM documents")
def q15(spark, sf):
    return documents(spark, sf).agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars"), (F.sum(F.length("text")) == F.sum("n_chars")).alias("agrees"))


@query("t2_lexical_normal_form")
def t2f(spark, sf):
    from ..functions.udfs import lexical

    return pages(spark, sf).select("page_id", F.sha2(lexical("html"), 256).alias("digest"))


@query("t4_without_marks")
def t4(spark, sf):
    from ..functions.udfs import without_marks

    return table(spark, sf, "benchmark").select("item_id", without_marks("text").alias("plain"))


@query("t35_turn_similarity")
def t35(spark, sf):
    from ..functions.udfs import similarity

    c = conv(spark, sf).withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.round(similarity("text", "before"), 6).alias("ratio"))


@query("w5_two_caps")
def w5(spark, sf):
    h = bm25(spark, sf, 100).join(docs(spark, sf).select("doc_id", "source", "lang"), "doc_id")
    return fu.two_caps(h, "source", "lang", 2, 5, 12)


@query("o9_one_per_role", ALL + ", a AS (SELECT query_id, doc_id FROM lng WHERE retriever = 'bm25' AND rank = 1), b0 AS (SELECT s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.doc_id IS NOT DISTINCT FROM a.doc_id, s.rank) AS n FROM lng s LEFT JOIN a USING (query_id) WHERE retriever = 'sparse'), t AS (SELECT query_id, doc_id, 1 AS o, 'role 1' AS origin FROM a UNION ALL SELECT query_id, doc_id, 2, 'role 2' FROM b0 WHERE n = 1 UNION ALL SELECT query_id, doc_id, 10 + rank, 'fill' FROM fr WHERE rank <= 20), g AS (SELECT query_id, doc_id, min(o) AS o, CASE WHEN count(*) FILTER (o <= 2) = 2 THEN 'role 1+2' ELSE min_by(origin, o) END AS origin FROM t GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id) AS position FROM g) SELECT query_id, doc_id, position, origin FROM p WHERE position <= 8")
def o9(spark, sf):
    from .retrieval import long

    roles = long(spark, sf).select("query_id", F.when(F.col("retriever") == "bm25", 1).otherwise(2).cast("long").alias("role_no"), "doc_id", "rank")
    return fu.one_per_role(fused(spark, sf), roles, 8)


@query("g6_focused_windows")
def g6(spark, sf):
    from ..operators.evidence import focused_windows

    t = questions(spark, sf).select("query_id", F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) > 3)).alias("terms"))
    j = gold(spark, sf).join(t, "query_id").join(docs(spark, sf).select("doc_id", "text"), "doc_id")
    return focused_windows(j, 400).select("query_id", "doc_id", F.length("window").alias("n"), F.sha2("window", 256).alias("digest"))
