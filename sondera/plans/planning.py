"""Queries of planning, answers and evidence checks, over conversations, documents and passages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import corpus as co
from ..operators import evidence as evi
from ..operators import planning as pl
from ..sources.tables import table
from .registry import query
from .retrieval import ALL, bm25, docs, fused, gold, questions

#: Ordered kinds of a turn: the first that matches counts.
RULES = [("list", r"[|]"), ("number", r"[0-9]"), ("long", r"^(?s:.{300,})$"), ("short", r"^(?s:.{0,60})$")]


def turns(spark, sf):
    return table(spark, sf, "conversations")


@query("p5_first_matching_kind", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[|]') THEN 'list' WHEN regexp_matches(text, '[0-9]') THEN 'number' WHEN length(text) >= 300 THEN 'long' WHEN length(text) <= 60 THEN 'short' ELSE 'other' END AS kind FROM conversations")
def p5(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", pl.first_match(F.col("text"), RULES, "other").alias("kind"))


@query("p4_chunk_types", r"SELECT doc_id, CASE WHEN regexp_matches(text, '\|.*\|') THEN 'table' WHEN regexp_matches(text, '(?i)license') THEN 'legal' WHEN regexp_matches(text, '[#$%&]{3}') THEN 'symbols' ELSE 'narrative' END AS kind FROM documents")
def p4(spark, sf):
    rules = [("table", r"\|.*\|"), ("legal", "(?i)license"), ("symbols", r"[#$%&]{3}")]
    return table(spark, sf, "documents").select("doc_id", pl.first_match(F.col("text"), rules, "narrative").alias("kind"))


_LEX = [("the", "le", 1), ("the", "der", 2), ("and", "et", 3), ("of", "de", 4), ("que", "that", 5)]


@query("p11_lexicon_expansion", "WITH l(phrase, term, ord) AS (VALUES " + ", ".join(map(str, _LEX)) + "), q AS (SELECT item_id, replace(lower(text), 'ß', 'ss') AS f FROM benchmark), h AS (SELECT item_id, term, min(ord) AS ord FROM q JOIN l ON contains(f, phrase) AND NOT contains(f, term) GROUP BY ALL) SELECT item_id AS query_id, coalesce(string_agg(term, ' ' ORDER BY ord), '') AS added FROM q LEFT JOIN h USING (item_id) GROUP BY 1")
def p11(spark, sf):
    lex = spark.createDataFrame(_LEX, "phrase string, term string, ord int")
    return pl.expand(questions(spark, sf), lex).select("query_id", F.array_join("added", " ").alias("added"))


_HINTS = [("a", 1, "definition", "definition"), ("a", 2, "example", "for example"), ("b", 1, "cause", "because")]


@query("p9_role_plan", "WITH h(kind, role_no, role, hint) AS (VALUES " + ", ".join(map(str, _HINTS)) + r"), q AS (SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS kind FROM benchmark) SELECT item_id AS query_id, coalesce(role_no, 1)::BIGINT AS role_no, coalesce(role, 'primary') AS role, regexp_replace(regexp_replace(text || coalesce(' ' || hint, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS role_query FROM q LEFT JOIN h USING (kind)")
def p9(spark, sf):
    hints = spark.createDataFrame(_HINTS, "kind string, role_no int, role string, hint string")
    q = questions(spark, sf).withColumn("kind", F.when(F.col("query_id") % 3 == 0, "a").when(F.col("query_id") % 3 == 1, "b").otherwise("c"))
    return pl.plan_roles(q, hints)


#: (source, alias): names by which a question may ask for a source.
ALIASES = [("s0", "the"), ("s0", "of the"), ("s1", "und"), ("s1", "der"), ("s2", "les"), ("s3", "los"), ("s3", "de los")]


@query("p13_source_route", "WITH a(source, alias) AS (VALUES " + ", ".join(map(str, ALIASES)) + r"), q AS (SELECT item_id, ' ' || regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS f FROM benchmark WHERE regexp_matches(lower(text), '(^|[^\p{L}])(of|de|in|zu)([^\p{L}]|$)')), m AS (SELECT item_id, source FROM q JOIN a ON contains(f, ' ' || alias || ' ')) SELECT item_id AS query_id, min(source) AS source FROM m GROUP BY 1 HAVING count(DISTINCT source) = 1")
def p13(spark, sf):
    return pl.route(questions(spark, sf), spark.createDataFrame(ALIASES, "source string, alias string"), r"(^|[^\p{L}])(of|de|in|zu)([^\p{L}]|$)")


@query("p28_clean_query", r"SELECT item_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)^(please|the|and)\s+', ''), '[.,;:!?]+$', ''), '\s+', ' ', 'g') AS clean FROM benchmark")
def p28(spark, sf):
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?i)^(please|the|and)\s+", ""), r"[.,;:!?]+$", ""), r"\s+", " ")
    return table(spark, sf, "benchmark").select("item_id", c.alias("clean"))


@query("p29_follow_up", r"WITH e AS (SELECT *, nullif(regexp_extract(text, '\b([A-Z][a-z]{7,})\b', 1), '') AS e FROM conversations), k AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM e) SELECT conv_id, turn, sha256(CASE WHEN regexp_matches(text, '\bthe\b') AND e IS NULL AND k IS NOT NULL THEN regexp_replace(text, '\bthe\b', k, 'g') ELSE text END) AS digest FROM k")
def p29(spark, sf):
    e = F.nullif(F.regexp_extract("text", r"\b([A-Z][a-z]{7,})\b", 1), F.lit(""))
    out = pl.follow_up(turns(spark, sf), "conv_id", "turn", "text", e, r"\bthe\b")
    return out.select("conv_id", "turn", F.sha2("resolved", 256).alias("digest"))


@query("p35_formulations", r"WITH f AS (SELECT item_id, 0 AS i, 'current' AS form, regexp_replace(text, '\s+', ' ', 'g') AS t FROM benchmark UNION ALL SELECT item_id, 1, 'lower', regexp_replace(lower(text), '\s+', ' ', 'g') FROM benchmark UNION ALL SELECT item_id, 2, 'words', regexp_replace(regexp_replace(text, '[.,]', '', 'g'), '\s+', ' ', 'g') FROM benchmark), g AS (SELECT item_id, t, min(i) AS i, min_by(form, i) AS form FROM f GROUP BY ALL) SELECT item_id AS query_id, form, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text FROM g")
def p35(spark, sf):
    t = F.col("text")
    return pl.formulations(questions(spark, sf), {"current": t, "lower": F.lower(t), "words": F.regexp_replace(t, "[.,]", "")})


@query("o4_adjusted_order", ALL + ", b(kind, boost) AS (VALUES ('en', 0.0::DOUBLE), ('fr', 0.6::DOUBLE), ('de', -0.8::DOUBLE)), h AS (SELECT r.query_id, doc_id, rank, round(score + coalesce(boost, 0), 6) AS adjusted FROM bmr r JOIN documents USING (doc_id) LEFT JOIN b ON kind = lang WHERE rank <= 20) SELECT query_id, doc_id, adjusted, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank, doc_id) AS position FROM h")
def o4(spark, sf):
    boosts = spark.createDataFrame([("en", 0.0), ("fr", 0.6), ("de", -0.8)], "kind string, boost double")
    h = bm25(spark, sf).join(docs(spark, sf).select("doc_id", "lang"), "doc_id")
    return pl.adjusted(h, boosts, "lang").select("query_id", "doc_id", "adjusted", "position")


@query("r7_section_bonus", ALL + ", s AS (SELECT query_id, source, max(score) AS s FROM bmr JOIN documents USING (doc_id) WHERE rank <= 50 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source) AS rank FROM s) SELECT query_id, doc_id, round(greatest(0.0005, 0.006 - 0.0005 * (rank - 1))::DOUBLE, 6) AS bonus FROM k JOIN documents USING (source) WHERE rank <= 3")
def r7(spark, sf):
    d = docs(spark, sf).select("doc_id", "source")
    s = bm25(spark, sf, 50).join(d, "doc_id").groupBy("query_id", "source").agg(F.max("score").alias("s"))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "source"))).where("rank <= 3")
    return pl.section_bonus(s, d, "source")


@query("g8_first_success", ALL + ", a AS (SELECT query_id, source AS grp, min(rank) AS place, count(*) FILTER (lang = 'fr') AS n_found FROM bmr JOIN documents USING (doc_id) WHERE rank <= 50 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM a WHERE n_found > 0) SELECT query_id, grp, place, n_found FROM o WHERE n = 1")
def g8(spark, sf):
    h = bm25(spark, sf, 50).join(docs(spark, sf).select("doc_id", F.col("source").alias("grp"), "lang"), "doc_id")
    return pl.first_success(h.groupBy("query_id", "grp").agg(F.min("rank").alias("place"), F.count(F.when(F.col("lang") == "fr", 1)).alias("n_found")))


_CLAIMS = r"(SELECT conv_id, turn, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+([\p{Lu}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS claim FROM conversations WHERE role = 'assistant')"


def claims(spark, sf):
    c = turns(spark, sf).where("role = 'assistant'")
    return c.select("conv_id", "turn", F.explode(tx.sentences(F.col("text"))).alias("claim"))


@query("t14_claims", f"SELECT conv_id, turn, count(*) AS n, max(length(claim))::BIGINT AS longest FROM {_CLAIMS} GROUP BY ALL")
def t14(spark, sf):
    return claims(spark, sf).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max(F.length("claim")).cast("long").alias("longest"))


@query("j18_claims_and_evidence", f"WITH c AS {_CLAIMS}, e AS (SELECT conv_id, text FROM conversations WHERE role = 'user') SELECT c.conv_id, c.turn, count(*) AS n_pairs, count(*) FILTER (contains(e.text, c.claim)) AS n_supported FROM c LEFT JOIN e USING (conv_id) GROUP BY ALL")
def j18(spark, sf):
    e = turns(spark, sf).where("role = 'user'").select("conv_id", "text")
    j = claims(spark, sf).join(e, "conv_id", "left")
    return j.groupBy("conv_id", "turn").agg(F.count("*").alias("n_pairs"), F.count(F.when(F.col("text").contains(F.col("claim")), 1)).alias("n_supported"))


@query("a28_number_grounding", r"WITH n AS (SELECT doc_id, list_distinct(list_transform(list_transform(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?)', 1), lambda x: replace(x, ',', '.')), lambda x: regexp_replace(CASE WHEN contains(x, '.') THEN regexp_replace(x, '0+$', '') ELSE x END, '\.$', ''))) AS n, source FROM documents), e AS (SELECT source, list_distinct(flatten(list(n))) AS h FROM n WHERE doc_id % 2 = 0 GROUP BY 1), c AS (SELECT source, list_distinct(flatten(list(n))) AS n FROM n WHERE doc_id % 2 = 1 GROUP BY 1) SELECT source, len(n)::BIGINT AS n_numbers, len(list_filter(n, lambda x: NOT list_contains(coalesce(h, []), x)))::BIGINT AS n_missing FROM c LEFT JOIN e USING (source)")
def a28(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    return evi.ungrounded_numbers(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "source")


@query("a16_access_summary", ALL + ", j AS (SELECT g.query_id, min(rank) AS r FROM gold g LEFT JOIN fr ON g.query_id = fr.query_id AND g.doc_id = fr.doc_id AND rank <= 20 GROUP BY 1) SELECT count(*) AS n, round(avg((r IS NOT NULL)::INT), 6) AS access, round(avg(CASE WHEN r <= 5 THEN 1 ELSE 0 END), 6) AS access_5 FROM j")
def a16(spark, sf):
    j = gold(spark, sf).join(fused(spark, sf).select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    return j.agg(F.count("*").alias("n"), F.round(F.avg(F.col("r").isNotNull().cast("int")), 6).alias("access"), F.round(F.avg(F.when(F.col("r") <= 5, 1).otherwise(0)), 6).alias("access_5"))


@query("a27_coverage_classes", ALL + ", j AS (SELECT b.item_id AS query_id, count(g.doc_id) AS n, count(r.doc_id) AS k FROM benchmark b LEFT JOIN gold g ON g.query_id = b.item_id LEFT JOIN (SELECT * FROM fr WHERE rank <= 5) r ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY 1) SELECT query_id, CASE WHEN n = 0 THEN 'unannotated' WHEN k = n THEN 'full' WHEN k > 0 THEN 'partial' ELSE 'none' END AS coverage FROM j")
def a27(spark, sf):
    g = gold(spark, sf).join(fused(spark, sf, 5).select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    n = questions(spark, sf).select("query_id").join(g, "query_id", "left").groupBy("query_id").agg(F.count("doc_id").alias("n"), F.count("rank").alias("k"))
    return n.select("query_id", F.when(F.col("n") == 0, "unannotated").when(F.col("k") == F.col("n"), "full").when(F.col("k") > 0, "partial").otherwise("none").alias("coverage"))


@query("q12_source_lock_leaks", ALL + "SELECT r.query_id, count(*) AS n_leaks FROM bmr r JOIN documents USING (doc_id) WHERE rank <= 10 AND lang <> 'en' GROUP BY 1")
def q12(spark, sf):
    locked = docs(spark, sf).where("lang = 'en'").select("doc_id")
    return bm25(spark, sf, 10).join(locked, "doc_id", "left_anti").groupBy("query_id").agg(F.count("*").alias("n_leaks"))


@query("o17_best_sentences", r"""WITH q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) > 2)) AS t FROM benchmark), g AS (SELECT item_id, doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text)), s AS (SELECT item_id, doc_id, unnest(generate_series(1, len(p))) AS pos, unnest(p) AS s FROM (SELECT item_id, doc_id, string_split(text, chr(10)) AS p FROM g JOIN documents USING (doc_id))),
k AS (SELECT s.item_id, doc_id, pos, len(list_intersect(q.t, list_distinct(string_split_regex(lower(s), '[^\p{L}]+')))) AS hits FROM s JOIN q USING (item_id)), o AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY hits DESC, pos) AS n FROM k) SELECT item_id AS query_id, doc_id, pos::BIGINT AS pos, hits::BIGINT AS hits FROM o WHERE n <= 2""")
def o17(spark, sf):
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) > 2))
    q = questions(spark, sf).select("query_id", terms.alias("t"))
    s = gold(spark, sf).join(docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "s")), "doc_id").join(q, "query_id")
    s = s.withColumn("hits", F.size(F.array_intersect("t", F.split(F.lower("s"), r"[^\p{L}]+"))))
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("hits"), "pos")
    return s.withColumn("n", F.row_number().over(w)).where("n <= 2").select("query_id", "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("hits").cast("long").alias("hits"))


@query("t16_measurements", r"SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(text, '([0-9]),([0-9])', '\1.\2', 'g'), '[0-9]+(?:\.[0-9]+)?'), ' ') AS measures FROM documents")
def t16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.regexp_extract_all(F.regexp_replace("text", r"([0-9]),([0-9])", "$1.$2"), F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0), " ").alias("measures"))


@query("t11_query_terms", r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'was')))), ' ') AS terms FROM benchmark")
def t11(spark, sf):
    t = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: (F.length(x) >= 3) & ~x.isin("the", "and", "for", "was"))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.sort_array(F.array_distinct(t)), " ").alias("terms"))


@query("p18_passages", r"SELECT doc_id, sha256('Document: ' || source || chr(10) || 'Section: ' || lang || chr(10) || 'Passage: ' || regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def p18(spark, sf):
    p = F.concat(F.lit("Document: "), "source", F.lit("\nSection: "), "lang", F.lit("\nPassage: "), tx.collapse(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(p, 256).alias("digest"))


@query("u4_uncovered_pages", "WITH c AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 500) SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM c")
def u4(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.select("doc_id").distinct().join(d.where("n_chars > 500").select("doc_id"), "doc_id", "left_anti")


@query("q3_duplicate_chunks")
def q3(spark, sf):
    c = co.chunks(docs(spark, sf))
    return c.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")
