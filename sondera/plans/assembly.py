"""Queries of assembly, gates and whole retrievals: chunks, catalogues, bundles, validation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import checks as ck
from ..operators import fusion as fu
from ..operators import planning as pl
from ..operators import search as se
from ..sources.tables import table
from .planning import _LEX
from .registry import query
from .retrieval import ALL, BM25, RRF, SPARSE, bm25, docs, fused, gold, index, questions, sparse

count_if = lambda c: F.count(F.when(c, 1))
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def conv(spark, sf):
    return table(spark, sf, "conversations")


def documents(spark, sf):
    return table(spark, sf, "documents")


def pages(spark, sf):
    return table(spark, sf, "pages")


def lines(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "x"))


_LINES = "l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS x FROM documents)"


@query("p1_clean_pages", r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(\w)-\n(\w)', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)
SELECT page_id, length(t)::BIGINT AS n_chars, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> ''))::BIGINT AS n_words, t = '' AS is_empty, sha256(t) AS digest FROM p""")
def p1(spark, sf):
    p = pages(spark, sf).select("page_id", tx.clean_page(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"), F.regexp_count("t", F.lit(r"\S+")).cast("long").alias("n_words"), (F.col("t") == "").alias("is_empty"), F.sha2("t", 256).alias("digest"))


_HAS = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query("p10_balance_kind", f"WITH t AS (SELECT item_id, translate(lower(text), '₂₅', '25') AS t FROM benchmark UNION ALL SELECT l_orderkey * 10 + l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'heat of h2o' WHEN 1 THEN 'the component' WHEN 2 THEN 'x2y5 in' ELSE 'flow' END FROM lineitem) SELECT item_id, CASE WHEN {_HAS('t', ck.ENERGY)} THEN 'energy' WHEN {_HAS('t', ck.SPECIES)} OR regexp_matches(t, '{ck.FORMULA}') THEN 'species' ELSE 'overall_mass' END AS kind FROM t")
def p10(spark, sf):
    q = questions(spark, sf).select(F.col("query_id").alias("item_id"), "text")
    n = F.col("l_linenumber") % 4
    made = table(spark, sf, "lineitem").select(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.when(n == 0, "heat of h2o").when(n == 1, "the component").when(n == 2, "x2y5 in").otherwise("flow"))
    return q.union(made).select("item_id", ck.balance_kind(F.col("text")).alias("kind"))


_XB = "l(phrase, term, ord) AS (VALUES " + ", ".join(map(str, _LEX)) + "), q0 AS (SELECT item_id, text, replace(lower(text), 'ß', 'ss') AS f FROM benchmark), h0 AS (SELECT item_id, term, min(ord) AS ord FROM q0 JOIN l ON contains(f, phrase) AND NOT contains(f, term) GROUP BY ALL), xb AS (SELECT item_id, any_value(text) AS plain, any_value(text) || coalesce(' ' || string_agg(term, ' ' ORDER BY ord), '') AS text FROM q0 LEFT JOIN h0 USING (item_id) GROUP BY 1)"


def expanded(spark, sf):
    """Questions with the terms that the lexicon adds to them."""
    lex = spark.createDataFrame(_LEX, "phrase string, term string, ord int")
    q = pl.expand(questions(spark, sf), lex).select("query_id", F.array_join("added", " ").alias("_added"))
    return questions(spark, sf).join(q, "query_id", "left").select("query_id", F.concat_ws(" ", "text", F.nullif("_added", F.lit(""))).alias("text"))


@query("p12_dense_and_lexical_text", f"WITH {_XB} SELECT item_id AS query_id, sha256('query: ' || plain) AS dense, sha256(lower(text)) AS lexical FROM xb")
def p12(spark, sf):
    e = expanded(spark, sf).join(questions(spark, sf).withColumnRenamed("text", "plain"), "query_id")
    return e.select("query_id", F.sha2(F.concat(F.lit("query: "), "plain"), 256).alias("dense"), F.sha2(F.lower("text"), 256).alias("lexical"))


@query("p17_lexical_text", r"SELECT doc_id, sha256(replace(regexp_replace(source || '_part.txt', '\.[^.]*$', ''), '_', ' ') || chr(10) || CASE WHEN trim(lang) <> '' THEN lang || chr(10) ELSE '' END || text) AS digest FROM documents")
def p17(spark, sf):
    stem = F.replace(F.regexp_replace(F.concat("source", F.lit("_part.txt")), r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))
    return documents(spark, sf).select("doc_id", F.sha2(F.concat_ws("\n", stem, F.when(F.trim("lang") != "", F.col("lang")), "text"), 256).alias("digest"))


@query("p19_evidence_blocks", ALL + r"SELECT query_id, rank, sha256('[Source ' || rank || ']' || chr(10) || 'Document: ' || source || chr(10) || 'Filename: ' || source || '.txt' || chr(10) || 'Chapter: ' || coalesce(lang, 'Not specified') || chr(10) || 'Section: Not specified' || chr(10) || 'Pages: 1-1' || chr(10) || 'Evidence:' || coalesce(chr(10) || nullif(" + _TRIM.format("text") + ", ''), '')) AS digest FROM bmr JOIN documents USING (doc_id) WHERE rank <= 5")
def p19(spark, sf):
    h = bm25(spark, sf, 5).join(docs(spark, sf), "doc_id")
    missing = F.lit("Not specified")
    head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]\nDocument: "), "source", F.lit("\nFilename: "), "source", F.lit(".txt\nChapter: "), F.coalesce("lang", missing), F.lit("\nSection: "), missing, F.lit("\nPages: 1-1\nEvidence:"))
    return h.select("query_id", "rank", F.sha2(F.concat_ws("\n", head, F.nullif(tx.strip(F.col("text")), F.lit(""))), 256).alias("digest"))


@query("f3_sparse_allowed", f"WITH {BM25}, {SPARSE}, a AS (SELECT sp.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sp JOIN documents USING (doc_id) WHERE score > 0.05 AND lang = 'en') SELECT query_id, doc_id, score, r AS rank FROM a WHERE r <= 10")
def f3(spark, sf):
    allowed = docs(spark, sf).where("lang = 'en'")
    return se.sparse(index(spark, sf), se.sparse_vectors(questions(spark, sf), "query_id"), 10, 0.05, allowed).select("query_id", "doc_id", "score", "rank")


@query("f5_non_evidentiary", rf"WITH p AS (SELECT page_id, lower(url || ' ' || regexp_replace(html, '<[^>]*>', ' ', 'g')) AS t FROM pages) SELECT page_id, trim(t) = '' OR {_HAS('t', ck.LOW_VALUE)} AS rejected FROM p")
def f5(spark, sf):
    t = F.lower(F.concat("url", F.lit(" "), F.regexp_replace("html", "<[^>]*>", " ")))
    return pages(spark, sf).select("page_id", ((F.trim(t) == "") | ck.any_of(t, ck.LOW_VALUE)).alias("rejected"))


_NAV, _LEGAL = "^(contents|abbreviations|bibliography|index)", "(license|copyright|all rights reserved)"


@query("f6_primary_chunks", f"WITH {_LINES} SELECT doc_id, count(*) FILTER (NOT x) AS n_kept, count(*) FILTER (x) AS n_excluded FROM (SELECT doc_id, regexp_matches(lower(x), '{_NAV}') OR (pos < 5 AND regexp_matches(lower(substring(x, 1, 500)), '{_LEGAL}')) AS x FROM l) GROUP BY 1")
def f6(spark, sf):
    out = F.lower("x").rlike(_NAV) | ((F.col("pos") < 5) & F.lower(F.substring("x", 1, 500)).rlike(_LEGAL))
    return lines(spark, sf).withColumn("_out", out).groupBy("doc_id").agg(count_if(~F.col("_out")).alias("n_kept"), count_if(F.col("_out")).alias("n_excluded"))


@query("f8_text_layer_gate", f"WITH {_LINES}, n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1), sm AS (SELECT DISTINCT doc_id, round_even(i * (n - 1) / greatest(1, least(12, n) - 1), 0)::BIGINT AS pos FROM n, (SELECT unnest(range(12)) AS i) WHERE i < least(12, n)), t AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY l.pos) AS t FROM l JOIN sm USING (doc_id, pos) GROUP BY 1), " + r"c AS (SELECT doc_id, len(regexp_extract_all(t, '\S')) AS v, len(regexp_extract_all(t, '\p{L}')) AS a, len(regexp_extract_all(t, '\p{L}{3,}')) AS w FROM t) SELECT doc_id, CASE WHEN a = 0 THEN 'no_text' WHEN v >= 500 AND (a / v < 0.15 OR w < 10) THEN 'unusable' ELSE 'ok' END AS status FROM c")
def f8(spark, sf):
    d = documents(spark, sf).where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("p"))
    at = ck.sample_positions(F.size("p").cast("long"))
    return d.select("doc_id", ck.text_layer(F.array_join(F.transform(at, lambda i: F.get("p", i.cast("int"))), "\n")).alias("status"))


@query("j8_compatible_neighbours", """WITH w AS (SELECT event_id, lag(event_id, 1) OVER k AS a1, lag(event_id, 2) OVER k AS a2, lead(event_id, 1) OVER k AS z1, lead(event_id, 2) OVER k AS z2,
event_type IS NOT DISTINCT FROM lag(event_type, 1) OVER k AS sa1, event_type IS NOT DISTINCT FROM lag(event_type, 2) OVER k AS sa2, event_type IS NOT DISTINCT FROM lead(event_type, 1) OVER k AS sz1, event_type IS NOT DISTINCT FROM lead(event_type, 2) OVER k AS sz2 FROM events WINDOW k AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, concat_ws(',', CASE WHEN sa1 AND sa2 THEN a2 END, CASE WHEN sa1 THEN a1 END, CASE WHEN sz1 THEN z1 END, CASE WHEN sz1 AND sz2 THEN z2 END) AS neighbours FROM w""")
def j8(spark, sf):
    n = ck.neighbours(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_type"], 2)
    return n.select("event_id", F.array_join("neighbours", ",").alias("neighbours"))


@query("j4_rehydrated_sources", ALL + "SELECT query_id, rank, doc_id, source, lang, length(text)::BIGINT AS n_chars FROM fr JOIN documents USING (doc_id) WHERE rank <= 5")
def j4(spark, sf):
    return fused(spark, sf, 5).join(docs(spark, sf), "doc_id").select("query_id", "rank", "doc_id", "source", "lang", F.length("text").cast("long").alias("n_chars"))


@query("j23_renamed_files", "WITH f AS (SELECT doc_id, source || '/' || doc_id AS name, sha256(text) AS s FROM documents), o AS (SELECT s, min(name) AS source FROM f WHERE doc_id % 2 = 0 GROUP BY 1) SELECT name, o.source, substring(sha256(name), 1, 12) AS file_id FROM f JOIN o USING (s) WHERE doc_id % 2 = 1")
def j23(spark, sf):
    f = documents(spark, sf).where("text IS NOT NULL").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha256"))
    return ck.renamed(f.where("doc_id % 2 = 0"), f.where("doc_id % 2 = 1"))


@query("o3_rerank_order", ALL + ", h AS (SELECT f.query_id, f.doc_id, f.rank, coalesce(round(b.score), 0) AS score FROM fr f LEFT JOIN bmr b ON b.query_id = f.query_id AND b.doc_id = f.doc_id AND b.rank <= 20 WHERE f.rank <= 20), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id) AS position FROM h) SELECT query_id, doc_id, position FROM p WHERE position <= 5")
def o3(spark, sf):
    return rerank(spark, sf, 5).select("query_id", "doc_id", "position")


def rerank(spark, sf, k):
    """The fused candidates in the order of a second score (whole BM25 points, 0 where that search missed)."""
    b = bm25(spark, sf).select("query_id", "doc_id", F.round("score").alias("_s"))
    h = fused(spark, sf).select("query_id", "doc_id", "rank").join(b, ["query_id", "doc_id"], "left")
    return ck.reranked(h.withColumn("score", F.coalesce("_s", F.lit(0.0))), k)


@query("o14_section_order", "WITH s AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS a, max(l_linenumber) AS z FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, z, l_returnflag) AS position FROM s")
def o14(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("z"))
    w = Window.partitionBy("l_orderkey").orderBy("a", "z", "l_returnflag")
    return s.select("l_orderkey", "l_returnflag", F.row_number().over(w).cast("long").alias("position"))


_UNITS_SQL = ck.UNITS


@query("t18_units", f"WITH t AS (SELECT doc_id, lower(text || CASE doc_id % 3 WHEN 0 THEN ' 12 kg/s, 3 bar' WHEN 1 THEN ' 5% at 80 °C' ELSE '' END) AS t FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '{_UNITS_SQL}', 1))), ' ') AS units FROM t")
def t18(spark, sf):
    more = F.when(F.col("doc_id") % 3 == 0, " 12 kg/s, 3 bar").when(F.col("doc_id") % 3 == 1, " 5% at 80 °C").otherwise("")
    d = documents(spark, sf).select("doc_id", F.lower(F.concat("text", more)).alias("t"))
    return d.select("doc_id", F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all("t", F.lit(ck.UNITS), 1))), " ").alias("units"))


_TECH = r"(sources?|chunks?|scores?|rrf|reranker|bm25|dense)\s*:"


@query("t20_memory_text", rf"WITH t AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' [Source 2] so' WHEN 1 THEN chr(10) || ' Scores: 0.4' || chr(10) || 'end' ELSE ' dense: 1' END AS t FROM conversations) SELECT conv_id, turn, sha256(" + _TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\[Source [1-9]\d*\]', '', 'g'), '(?im)^\s*" + _TECH + r".*$', '', 'g'), '(?i)\b" + _TECH + r"[^\n]*\z', '', 'g'), '\s+', ' ', 'g')") + ") AS digest FROM t")
def t20(spark, sf):
    more = F.when(F.col("turn") % 3 == 0, " [Source 2] so").when(F.col("turn") % 3 == 1, "\n Scores: 0.4\nend").otherwise(" dense: 1")
    t = F.regexp_replace(F.concat("text", more), r"\[Source [1-9]\d*\]", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"(?im)^\s*{_TECH}.*$", ""), rf"(?i)\b{_TECH}[^\n]*\z", "")
    return conv(spark, sf).select("conv_id", "turn", F.sha2(tx.collapse(t), 256).alias("digest"))


@query("t26_heading_tests", f"WITH {_LINES}, " + r"k AS (SELECT doc_id, length(x) <= 100 AND len(regexp_extract_all(x, '[^\s]+')) BETWEEN 1 AND 12 AND len(regexp_extract_all(x, '\p{L}')) >= 4 AND x = upper(x) AND NOT ends_with(x, '.') AS h, regexp_matches(lower(x), '^(fig\.|figure |table |diagram )') AS c FROM l) SELECT doc_id, count(*) FILTER (h) AS n_headings, count(*) FILTER (c) AS n_captions FROM k GROUP BY 1")
def t26(spark, sf):
    x = F.col("x")
    words = F.regexp_count(x, F.lit(r"[^\s]+"))
    heading = (F.length(x) <= 100) & words.between(1, 12) & (F.regexp_count(x, F.lit(r"\p{L}")) >= 4) & (x == F.upper(x)) & ~x.endswith(".")
    return lines(spark, sf).groupBy("doc_id").agg(count_if(heading).alias("n_headings"), count_if(F.lower(x).rlike(r"^(fig\.|figure |table |diagram )")).alias("n_captions"))


@query("t27_common_path", "WITH p AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS a FROM pages), w AS (SELECT a.page_id, a.a, b.a AS b FROM p a JOIN p b ON b.page_id = a.page_id - 1) SELECT page_id, (SELECT count(*) FROM (SELECT unnest(range(1, len(a) + 1)) AS k) WHERE k <= len(b) AND a[1:k] = b[1:k])::BIGINT AS n, array_to_string(a[1:(SELECT count(*) FROM (SELECT unnest(range(1, len(a) + 1)) AS k) WHERE k <= len(b) AND a[1:k] = b[1:k])], '/') AS common FROM w")
def t27(spark, sf):
    p = pages(spark, sf).select("page_id", F.filter(F.split("url", "/"), lambda x: x != "").alias("a"))
    w = p.join(p.select((F.col("page_id") + 1).alias("page_id"), F.col("a").alias("b")), "page_id")
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    n = F.when(F.array_position(same, F.lit(False)) > 0, F.array_position(same, F.lit(False)) - 1).otherwise(F.size(same))
    return w.select("page_id", n.cast("long").alias("n"), F.array_join(F.slice("a", F.lit(1), n.cast("int")), "/").alias("common"))


@query("t28_merged_paragraphs", r"WITH b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), p AS (SELECT conv_id, turn, unnest(range(len(q))) AS i, unnest(q) AS q FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(coalesce(before, '') || chr(10) || chr(10) || text || chr(10) || chr(10) || substring(text, 1, 0) || coalesce(before, ''), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS q FROM b)), f AS (SELECT conv_id, turn, min(i) AS i, min_by(q, i) AS q FROM p GROUP BY conv_id, turn, lower(regexp_replace(q, '\s+', ' ', 'g'))) SELECT conv_id, turn, count(*) AS n, sha256(string_agg(q, chr(10) || chr(10) ORDER BY i)) AS digest FROM f GROUP BY ALL")
def t28(spark, sf):
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    c = conv(spark, sf).select("conv_id", "turn", tx.merged_paragraphs(before, F.col("text"), before).alias("p"))
    return c.where(F.size("p") > 0).select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.sha2(F.array_join("p", "\n\n"), 256).alias("digest"))


@query("t33_printable_text", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[\p{C}\p{Z}]', ' ', 'g'), ' +', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents")
def t33(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(F.trim(F.regexp_replace(F.regexp_replace("text", r"[\p{C}\p{Z}]", " "), " +", " ")), 256).alias("digest"))


@query("t34_control_ratio", r"SELECT doc_id, round(len(regexp_extract_all(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')) / greatest(1, len(regexp_extract_all(t, '\S'))), 9) AS ratio FROM (SELECT doc_id, text || repeat(chr(1), (doc_id % 4)::INT) AS t FROM documents)")
def t34(spark, sf):
    t = F.concat("text", F.expr("repeat(char(1), int(doc_id % 4))"))
    ratio = F.regexp_count(t, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]")) / F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"\S")))
    return documents(spark, sf).select("doc_id", F.round(ratio, 9).alias("ratio"))


@query("s2_parser_route", r"""WITH p AS (SELECT page_id, html, list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)) AS l FROM pages), c AS (SELECT page_id, length(array_to_string(list_filter(l, lambda x: x <> ''), chr(10))) < 100 AS a, len(regexp_extract_all(html, '<(table|img|figure|svg)')) >= 2 AS b, len(list_filter(l, lambda x: x <> '' AND len(string_split_regex(x, '\s+')) <= 3 AND regexp_matches(x, '[0-9]'))) >= 8 AS c FROM p)
SELECT page_id, a OR b OR c AS structured, concat_ws(',', CASE WHEN a THEN 'insufficient_text' END, CASE WHEN b THEN 'complex_layout' END, CASE WHEN c THEN 'possible_broken_table_or_figure' END) AS warnings FROM c""")
def s2(spark, sf):
    l = F.filter(F.transform(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = pages(spark, sf).select("page_id", "html", l.alias("l"))
    few = F.length(F.array_join("l", "\n")) < 100
    layout = F.regexp_count("html", F.lit("<(table|img|figure|svg)")) >= 2
    broken = F.size(F.filter("l", lambda x: (F.size(F.split(x, r"\s+")) <= 3) & x.rlike("[0-9]"))) >= 8
    warn = F.concat_ws(",", F.when(few, "insufficient_text"), F.when(layout, "complex_layout"), F.when(broken, "possible_broken_table_or_figure"))
    return p.select("page_id", (few | layout | broken).alias("structured"), warn.alias("warnings"))


@query("s13_manifest_upsert", "SELECT c_custkey, coalesce(n.seg, o.seg) AS seg, coalesce(n.bal, o.bal) AS bal FROM (SELECT c_custkey, c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey, lower(c_mktsegment) AS seg, CASE WHEN c_acctbal > 0 THEN c_acctbal + 1 END AS bal FROM customer WHERE c_custkey % 2 = 0) n USING (c_custkey)")
def s13(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.lower("c_mktsegment").alias("seg"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") + 1).alias("bal"))
    return ck.upserted(old, new, "c_custkey")


@query("s18_catalog_verification", "WITH f AS (SELECT doc_id, sha256(text) AS s, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 10 <> 3), c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN sha256(text || 'x') ELSE sha256(text) END AS s, len(string_split(text, chr(10))) + CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS n FROM documents) SELECT c.doc_id, CASE WHEN f.s IS NULL THEN 'missing' WHEN f.s <> c.s THEN 'changed' WHEN f.n <> c.n THEN 'page_count' ELSE 'ok' END AS status FROM c LEFT JOIN f USING (doc_id)")
def s18(spark, sf):
    d = documents(spark, sf)
    n, k = F.size(F.split("text", "\n")), F.col("doc_id") % 10
    files = d.where("doc_id % 10 <> 3").select("doc_id", F.sha2("text", 256).alias("sha256"), n.alias("n_pages"))
    catalog = d.select("doc_id", F.sha2(F.when(k == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"), (n + F.when(k == 2, 1).otherwise(0)).alias("n_pages"))
    return ck.verified(catalog, files, "doc_id")


@query("st6_resumed_work", "SELECT source, count(*) AS n_open, min(doc_id) AS first FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def st6(spark, sf):
    """What a resumed run still has to do: all but the checkpointed keys."""
    done = table(spark, sf, "labels").select("doc_id")
    return documents(spark, sf).select("doc_id", "source").join(done, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n_open"), F.min("doc_id").alias("first"))


@query("g4_section_texts", "WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn = min(turn) OVER w THEN 0 WHEN role = 'assistant' THEN 1 WHEN turn = max(turn) OVER w THEN 2 ELSE 3 END AS t FROM conversations WINDOW w AS (PARTITION BY conv_id)), u AS (SELECT *, sum(ceil(length(text) / 4)) OVER (PARTITION BY conv_id ORDER BY t, turn) AS upto FROM c) SELECT conv_id, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY t, turn)) AS digest FROM u WHERE upto <= 900 GROUP BY 1")
def g4(spark, sf):
    return ck.section_texts(conv(spark, sf), "conv_id", "turn", F.col("role") == "assistant", 900).select("conv_id", "n", F.sha2("text", 256).alias("digest"))


@query("q1_page_metrics", r"SELECT count(*) FILTER (n_chars <> length(text)) AS n_wrong_length, count(*) FILTER (contains(text, chr(65533))) AS n_replacement, count(*) FILTER (trim(text) <> '' AND len(regexp_extract_all(text, '[^\s]+')) < 5) AS n_short, count(*) FILTER (regexp_matches(text, '^\s*$')) AS n_empty FROM documents")
def q1(spark, sf):
    t, words = F.col("text"), F.regexp_count("text", F.lit(r"[^\s]+"))
    return documents(spark, sf).agg(
        count_if(F.col("n_chars") != F.length(t)).alias("n_wrong_length"), count_if(t.contains("�")).alias("n_replacement"),
        count_if((F.trim(t) != "") & (words < 5)).alias("n_short"), count_if(words == 0).alias("n_empty"),
    )


@query("q2_manifest_status", "WITH s AS (SELECT source, count(*) FILTER (n_chars <> length(text)) AS e, count(*) FILTER (lang IS NULL OR trim(text) = '' OR contains(lower(text), 'license')) AS w, max(doc_id) - min(doc_id) + 1 - count(*) AS gaps FROM documents GROUP BY 1) SELECT source, CASE WHEN e > 0 THEN 'invalid' WHEN w > 0 THEN 'valid_with_warnings' ELSE 'valid' END AS status, gaps FROM s")
def q2(spark, sf):
    s = documents(spark, sf).groupBy("source").agg(
        count_if(F.col("n_chars") != F.length("text")).alias("e"), count_if(F.col("lang").isNull() | (F.trim("text") == "") | F.lower("text").contains("license")).alias("w"),
        (F.max("doc_id") - F.min("doc_id") + 1 - F.count("*")).alias("gaps"),
    )
    return s.select("source", F.when(F.col("e") > 0, "invalid").when(F.col("w") > 0, "valid_with_warnings").otherwise("valid").alias("status"), "gaps")


@query("q4_page_coverage", "WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT DISTINCT doc_id FROM labels) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'uncovered' ELSE 'unknown' END AS violation FROM a FULL JOIN b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def q4(spark, sf):
    a = documents(spark, sf).where("doc_id % 7 <> 0").select("doc_id").distinct()
    b = table(spark, sf, "labels").select("doc_id").distinct()
    return a.join(b, "doc_id", "left_anti").withColumn("violation", F.lit("uncovered")).union(b.join(a, "doc_id", "left_anti").withColumn("violation", F.lit("unknown")))


@query("q5_token_limits", "WITH c AS (SELECT doc_id, text, CASE WHEN doc_id % 50 = 0 THEN 'cut' ELSE source || ': ' || text END AS e FROM documents) SELECT doc_id, ceil(length(e) / 4)::BIGINT AS n_tokens, contains(e, text) AS holds_text FROM c WHERE ceil(length(e) / 4) > 580 OR NOT contains(e, text)")
def q5(spark, sf):
    c = documents(spark, sf).select("doc_id", "text", F.when(F.col("doc_id") % 50 == 0, "cut").otherwise(F.concat("source", F.lit(": "), "text")).alias("e"))
    c = c.select("doc_id", tx.estimated_tokens(F.col("e")).alias("n_tokens"), F.col("e").contains(F.col("text")).alias("holds_text"))
    return c.where((F.col("n_tokens") > 580) | ~F.col("holds_text"))


@query("q7_index_alignment", f"WITH {BM25}, i AS (SELECT DISTINCT doc_id FROM tf), m AS (SELECT doc_id FROM labels) SELECT (SELECT count(*) FROM i) AS n_indexed, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM i)) AS n_missing, (SELECT count(*) FROM i WHERE doc_id NOT IN (SELECT doc_id FROM m)) AS n_without_label, (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS n_double")
def q7(spark, sf):
    i = index(spark, sf).rows.select("doc_id")  # one row a document
    d, m = documents(spark, sf).select("doc_id"), table(spark, sf, "labels").select("doc_id")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    double = d.agg((F.count("*") - F.countDistinct("doc_id")).alias("n_double"))
    return n(i, "n_indexed").join(n(d.join(i, "doc_id", "left_anti"), "n_missing")).join(n(i.join(m, "doc_id", "left_anti"), "n_without_label")).join(double)


@query("q9_question_set", "SELECT count(*) BETWEEN 40 AND 60 AS size_fits, count(*) = count(DISTINCT item_id) AS unique_ids, count(*) FILTER (trim(text) = '') AS n_blank, count(*) FILTER (item_id % 4 = 0) >= 10 AS enough_of_first, count(DISTINCT item_id % 3) = 3 AS all_languages FROM benchmark")
def q9(spark, sf):
    i = F.col("query_id")
    return questions(spark, sf).agg(
        F.count("*").between(40, 60).alias("size_fits"), (F.count("*") == F.countDistinct("query_id")).alias("unique_ids"), count_if(F.trim("text") == "").alias("n_blank"),
        (count_if(i % 4 == 0) >= 10).alias("enough_of_first"), (F.countDistinct(i % 3) == 3).alias("all_languages"),
    )


@query("q10_annotation_status", "WITH p AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 5 <> 4), j AS (SELECT * FROM labels) SELECT source, count(*) AS n_pool, count(quality) AS n_judged, count(*) FILTER (lang = 'en' AND toxic = 1) AS n_errors, CASE WHEN count(quality) = 0 THEN 'not_started' WHEN count(quality) < count(*) THEN 'in_progress' ELSE 'complete' END AS status, (SELECT count(*) FROM j WHERE doc_id NOT IN (SELECT doc_id FROM p)) AS n_unknown FROM p LEFT JOIN j USING (doc_id) GROUP BY 1")
def q10(spark, sf):
    p, j = documents(spark, sf).where("doc_id % 5 <> 4").select("doc_id", "source", "lang"), table(spark, sf, "labels")
    unknown = j.join(p, "doc_id", "left_anti").agg(F.count("*").alias("n_unknown"))
    s = p.join(j, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_pool"), F.count("quality").alias("n_judged"), count_if((F.col("lang") == "en") & (F.col("toxic") == 1)).alias("n_errors"))
    status = F.when(F.col("n_judged") == 0, "not_started").when(F.col("n_judged") < F.col("n_pool"), "in_progress").otherwise("complete")
    return s.withColumn("status", status).join(F.broadcast(unknown))


@query("q11_snapshot_registry", "WITH r AS (SELECT url, sha256(html) AS s FROM pages WHERE page_id % 3 <> 0), c AS (SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN sha256(html || ' ') ELSE sha256(html) END AS s FROM pages) SELECT page_id, CASE WHEN count(r.s) = 0 THEN 'unregistered' WHEN count(*) FILTER (r.s = c.s) > 0 THEN 'match' ELSE 'mismatch' END AS status FROM c LEFT JOIN r USING (url) GROUP BY 1")
def q11(spark, sf):
    p = pages(spark, sf)
    r = p.where("page_id % 3 <> 0").select("url", F.sha2("html", 256).alias("r"))
    c = p.select("page_id", "url", F.sha2(F.when(F.col("page_id") % 11 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("s"))
    g = c.join(r, "url", "left").groupBy("page_id").agg(F.count("r").alias("n"), count_if(F.col("r") == F.col("s")).alias("same"))
    return g.select("page_id", F.when(F.col("n") == 0, "unregistered").when(F.col("same") > 0, "match").otherwise("mismatch").alias("status"))


@query("q13_bundle_invariants", "WITH b AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS z, count(*) FILTER (l_returnflag = 'R') AS anchors, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS anchor_ids, count(DISTINCT l_partkey) AS ids, count(*) AS n, sum(l_quantity) FILTER (l_returnflag <> 'R') AS context, sum(l_quantity) AS total FROM lineitem GROUP BY 1) SELECT count(*) FILTER (z < a) AS n_bad_pages, count(*) FILTER (anchor_ids <> anchors) AS n_double_anchor, count(*) FILTER (ids <> n) AS n_double_chunk, count(*) FILTER (context > total) AS n_over, count(*) FILTER (anchors = 0) AS n_without_anchor FROM b")
def q13(spark, sf):
    r = F.col("l_returnflag") == "R"
    b = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("z"), count_if(r).alias("anchors"), F.countDistinct(F.when(r, F.col("l_partkey"))).alias("anchor_ids"),
        F.countDistinct("l_partkey").alias("ids"), F.count("*").alias("n"), F.sum(F.when(~r, F.col("l_quantity"))).alias("context"), F.sum("l_quantity").alias("total"),
    )
    c = lambda e, name: count_if(F.expr(e)).alias(name)
    return b.agg(c("z < a", "n_bad_pages"), c("anchor_ids <> anchors", "n_double_anchor"), c("ids <> n", "n_double_chunk"), c("context > total", "n_over"), c("anchors = 0", "n_without_anchor"))


_EXPANDED = f"WITH {_XB}, " + BM25.replace("FROM benchmark", "FROM xb") + f", {SPARSE}"
_BONUS = "s AS (SELECT query_id, source, max(score) AS s FROM bmr JOIN documents USING (doc_id) WHERE rank <= 20 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source) AS srank FROM s)"


@query("r5_expanded_hybrid", _EXPANDED + f", {_BONUS}, u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS w FROM bmr WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM spr WHERE rank <= 20), c AS (SELECT query_id, doc_id, round(sum(w), 9) AS w FROM u GROUP BY ALL), o AS (SELECT c.query_id, c.doc_id, round(w + CASE WHEN srank <= 3 THEN greatest(0.0005, 0.006 - 0.0005 * (srank - 1))::DOUBLE ELSE 0 END, 9) AS score FROM c JOIN documents USING (doc_id) LEFT JOIN k ON k.query_id = c.query_id AND k.source = documents.source), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o) SELECT query_id, doc_id, score, rank FROM n WHERE rank <= 20")
def r5(spark, sf):
    """Expanded questions, two searches, and the order of the fused candidates with the bonus of their sections (A2)."""
    q = expanded(spark, sf)
    b = se.bm25(index(spark, sf), q, 20)
    s = se.sparse(index(spark, sf), se.sparse_vectors(q, "query_id"), 20)
    d = docs(spark, sf).select("doc_id", "source")
    sections = b.join(d, "doc_id").groupBy("query_id", "source").agg(F.max("score").alias("s"))
    sections = sections.withColumn("srank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "source"))).where("srank <= 3").drop("s")
    bonus = F.when(F.col("srank").isNotNull(), F.greatest(F.lit(0.0005), 0.006 - 0.0005 * (F.col("srank") - 1))).otherwise(0.0)
    c = fu.runs(bm25=b, sparse=s).groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("w"))
    c = c.join(d, "doc_id").join(sections, ["query_id", "source"], "left").select("query_id", "doc_id", F.round(F.col("w") + bonus, 9).alias("score"))
    return se.ranked(c, 20)


@query("r8_document_discovery", ALL + ", h AS (SELECT f.query_id, f.doc_id, f.rank, coalesce(round(b.score), 0) AS score FROM fr f LEFT JOIN bmr b ON b.query_id = f.query_id AND b.doc_id = f.doc_id AND b.rank <= 20 WHERE f.rank <= 20), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id) AS position FROM h), g AS (SELECT query_id, source, position, row_number() OVER (PARTITION BY query_id, source ORDER BY position) AS n FROM p JOIN documents USING (doc_id)), s AS (SELECT query_id, source, round(sum(CASE WHEN n <= 3 THEN 1.0::DOUBLE / position END), 9) AS score, min(position) AS best_rank, count(*) AS hits FROM g GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, hits DESC, source) AS position FROM s) SELECT query_id, source, score, position FROM o WHERE position <= 3")
def r8(spark, sf):
    h = rerank(spark, sf, 40).join(docs(spark, sf).select("doc_id", F.col("source").alias("group_id")), "doc_id")
    out = fu.document_rank(h.select("query_id", "group_id", F.col("position").alias("rank")))
    return out.where("position <= 3").select("query_id", F.col("group_id").alias("source"), "score", "position")


_RERANKED = ", h AS (SELECT f.query_id, f.doc_id, f.rank, coalesce(round(b.score), 0) AS score FROM fr f LEFT JOIN bmr b ON b.query_id = f.query_id AND b.doc_id = f.doc_id AND b.rank <= 20 WHERE f.rank <= 20), rr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id) AS rank FROM h)"
_SAFE = ", u AS (SELECT query_id, doc_id, 'reranker' AS tier, 1 AS t, rank FROM {0} WHERE rank <= 4 UNION ALL SELECT query_id, doc_id, 'lexical', 2, rank FROM bmr WHERE rank <= 1 UNION ALL SELECT query_id, doc_id, 'fill', 3, rank FROM {0} WHERE rank <= 20), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY t, rank) AS n FROM u), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t, rank, doc_id) AS position FROM o WHERE n = 1)"


@query("r10_frozen_retrieval", ALL + _RERANKED + _SAFE.format("rr") + " SELECT query_id, position, doc_id, tier, source, lang FROM p JOIN documents USING (doc_id) WHERE position <= 5")
def r10(spark, sf):
    """Fused candidates, reranked, four of them and a lexical one, with their sources."""
    ranked = rerank(spark, sf, 20).select("query_id", "doc_id", F.col("position").alias("rank"))
    return fu.safeguard(ranked, bm25(spark, sf), 5, 1).join(docs(spark, sf).select("doc_id", "source", "lang"), "doc_id").select("query_id", "position", "doc_id", "tier", "source", "lang")


_BOOST = ", b(kind, boost) AS (VALUES ('en', 0.0::DOUBLE), ('fr', 0.6::DOUBLE), ('de', -0.8::DOUBLE)), ha AS (SELECT h.query_id, doc_id, h.rank, round(score + coalesce(boost, 0), 6) AS adjusted FROM h JOIN documents USING (doc_id) LEFT JOIN b ON kind = lang), aj AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank, doc_id) AS rank FROM ha)"


@query("r9_quality_retrieval", ALL + _RERANKED + _BOOST + _SAFE.format("aj") + ", lk AS (SELECT query_id, min(source) AS locked FROM bmr JOIN documents USING (doc_id) WHERE rank = 1 GROUP BY 1) SELECT p.query_id, p.position, p.doc_id, p.tier, source <> locked AS leaks FROM p JOIN documents USING (doc_id) JOIN lk ON lk.query_id = p.query_id WHERE position <= 5")
def r9(spark, sf):
    """Candidates reranked, adjusted by kind, safeguarded, and checked against the source that the best hit locks."""
    d = docs(spark, sf).select("doc_id", "source", "lang")
    boosts = spark.createDataFrame([("en", 0.0), ("fr", 0.6), ("de", -0.8)], "kind string, boost double")
    h = rerank(spark, sf, 20).select("query_id", "doc_id", "rank", "score").join(d, "doc_id")
    ranked = pl.adjusted(h, boosts, "lang").select("query_id", "doc_id", F.col("position").alias("rank"))
    lexical = bm25(spark, sf)
    locked = lexical.where("rank = 1").join(d, "doc_id").select("query_id", F.col("source").alias("locked"))
    out = fu.safeguard(ranked, lexical, 5, 1).join(d, "doc_id").join(locked, "query_id")
    return out.select("query_id", "position", "doc_id", "tier", (F.col("source") != F.col("locked")).alias("leaks"))


_GRID = [(name, reserve, budget) for name in ("rrf", "weighted") for reserve in (0, 5) for budget in (5, 10, 20)]


def _grid_sql():
    wr = "wf AS (SELECT query_id, doc_id, round(sum(CASE retriever WHEN 'bm25' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / (60 + rank)), 9) AS score, count(*) AS n, min(rank) AS best FROM lng GROUP BY ALL), wr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n DESC, best, doc_id) AS rank FROM wf)"
    parts = []
    for name, reserve, budget in _GRID:
        t = "fr" if name == "rrf" else "wr"
        parts.append(f"SELECT '{name}__reserve{reserve}__b{budget}' AS policy, query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id) AS r FROM (SELECT query_id, doc_id, min(o) AS o FROM (SELECT query_id, doc_id, rank AS o FROM bmr WHERE rank <= {reserve} UNION ALL SELECT query_id, doc_id, 1000000 + rank FROM {t}) GROUP BY ALL)) WHERE r <= {budget}")
    return ALL + f", {wr}, c AS ({' UNION ALL '.join(parts)}) SELECT policy, count(*) AS n_candidates, count(g.doc_id) AS n_gold FROM c LEFT JOIN gold g ON g.query_id = c.query_id AND g.doc_id = c.doc_id GROUP BY 1"


@query("r12_policy_grid", _grid_sql())
def r12(spark, sf):
    """Gold documents among the candidates of each policy: fusion, documents reserved for the lexical search, budget."""
    from .retrieval import long

    runs, g = long(spark, sf), gold(spark, sf).withColumn("_g", F.lit(1))
    fusions = {"rrf": fu.rrf(runs, 40), "weighted": fu.rrf(runs, 40, {"bm25": 0.7, "sparse": 0.3})}
    lexical, out = bm25(spark, sf), None
    for name in ("rrf", "weighted"):
        for reserve in (0, 5):
            c = fu.reserve_then_fill(lexical.where(F.col("rank") <= reserve), fusions[name], 20)
            b = F.explode(F.array(*(F.lit(x) for x in (5, 10, 20))))
            c = c.withColumn("b", b).where(F.col("rank") <= F.col("b")).select(F.concat(F.lit(f"{name}__reserve{reserve}__b"), F.col("b").cast("string")).alias("policy"), "query_id", "doc_id")
            out = c if out is None else out.union(c)
    return out.join(g, ["query_id", "doc_id"], "left").groupBy("policy").agg(F.count("*").alias("n_candidates"), F.count("_g").alias("n_gold"))
