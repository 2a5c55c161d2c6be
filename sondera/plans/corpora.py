"""Queries of text functions, page quality, hygiene, structure and checks over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import corpus as co
from ..operators import evidence as evi
from ..operators.store import violations
from ..sources.tables import table
from .registry import query

_RX = tx.TOKEN
_S = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("t1_clean_page_text", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(\w)-\n(\w)', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def t1(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(tx.clean_page(F.col("text")), 256).alias("digest"))


@query("t2_markup_to_text", r"""WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS x FROM pages), e AS (SELECT page_id, replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM p), c AS (SELECT page_id, regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS x FROM e) SELECT page_id, length(x)::BIGINT AS n, sha256(x) AS digest FROM c""")
def t2(spark, sf):
    c = tx.without_tags(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(c).cast("long").alias("n"), F.sha2(c, 256).alias("digest"))


@query("t3_technical_tokens", f"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{_RX}', 1), lambda t: regexp_replace(t, '\\s+', '', 'g')) AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct, sha256(array_to_string(t, ' ')) AS digest FROM t""")
def t3(spark, sf):
    t = docs(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query("t7_markdown_to_text", r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\s*', '', 'g'), '[*_`|]+', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS x FROM documents) SELECT doc_id, sha256(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM m""")
def t7(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(tx.plain_markdown(F.col("text")), 256).alias("digest"))


@query("t9_estimated_tokens", "SELECT source, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END)::BIGINT AS n FROM documents GROUP BY 1")
def t9(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.sum(tx.estimated_tokens(F.col("text"))).alias("n"))


@query("t13_sentences", r"""SELECT doc_id, len(string_split_regex(regexp_replace(text, '([.!?])\s+([\p{Lu}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)))::BIGINT AS n FROM documents""")
def t13(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n"))


_ANSWERS = r"(SELECT conv_id, turn, text || ' [Source ' || (turn % 4) || '] and [Source ' || (1 + turn % 3) || ']' AS text, 2 AS n FROM conversations WHERE role = 'assistant')"


def answers(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    cite = F.concat(F.col("text"), F.lit(" [Source "), (F.col("turn") % 4).cast("string"), F.lit("] and [Source "), (1 + F.col("turn") % 3).cast("string"), F.lit("]"))
    return c.select("conv_id", "turn", cite.alias("text"), F.lit(2).alias("n"))


@query("t15_citations", rf"""WITH a AS {_ANSWERS}, c AS (SELECT conv_id, turn, regexp_extract_all(text, '\[Source ([1-9][0-9]*)\]', 1) AS c, n FROM a) SELECT conv_id, turn, CASE WHEN len(c) = 2 AND c[1] = c[2] THEN c[1] ELSE array_to_string(c, ',') END AS cited, len(list_filter(list_distinct(c), lambda x: x::BIGINT > n))::BIGINT AS n_out_of_range, len(c) > 0 AND len(list_filter(c, lambda x: x::BIGINT > n)) = 0 AS valid FROM c""")
def t15(spark, sf):
    c = evi.citation_check(answers(spark, sf), "n")
    return c.select("conv_id", "turn", F.array_join("cited", ",").alias("cited"), "n_out_of_range", "valid")


@query("t17_numbers_in_evidence", r"""WITH e AS (SELECT doc_id, text FROM documents), nums AS (SELECT doc_id, list_distinct(list_transform(list_transform(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?)', 1), lambda x: replace(x, ',', '.')), lambda x: regexp_replace(CASE WHEN contains(x, '.') THEN regexp_replace(x, '0+$', '') ELSE x END, '\.$', ''))) AS n FROM e) SELECT doc_id, len(n)::BIGINT AS n_numbers, coalesce(array_to_string(list_sort(n), ' '), '') AS numbers FROM nums""")
def t17(spark, sf):
    n = docs(spark, sf).select("doc_id", tx.numbers(F.col("text")).alias("n"))
    return n.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_join(F.sort_array("n"), " ").alias("numbers"))


@query("t21_truncated_text", r"""SELECT doc_id, CASE WHEN greatest(1, ceil(length(text) / 4)) <= 20 THEN text ELSE rtrim(regexp_replace(substring(text, 1, 79), ' [^ ]*$', '')) || '…' END AS short FROM documents""")
def t21(spark, sf):
    return docs(spark, sf).select("doc_id", tx.truncated(F.col("text"), 20).alias("short"))


@query("t12_repeated_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, count(*) AS n_lines, (count(*) - count(DISTINCT x))::BIGINT AS n_repeated FROM l GROUP BY 1")
def t12(spark, sf):
    l = F.split("text", "\n")
    return docs(spark, sf).select("doc_id", F.size(l).cast("long").alias("n_lines"), (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_repeated"))


@query("p2_page_quality", r"""WITH q AS (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g'))::BIGINT AS visible, len(regexp_extract_all(text, '[^\s]+'))::BIGINT AS words, len(regexp_extract_all(text, '\p{L}')) AS l, len(regexp_extract_all(text, '�')) AS r FROM documents),
m AS (SELECT *, round(l / greatest(1, visible), 6) AS letter_ratio FROM q) SELECT doc_id, visible, words, letter_ratio, CASE WHEN visible < 80 AND words < 5 THEN 'empty' WHEN letter_ratio < 0.15 OR r / greatest(1, visible) > 0.05 THEN 'corrupted' WHEN visible < 200 OR words < 10 THEN 'short' ELSE 'usable' END AS status FROM m""")
def p2(spark, sf):
    return co.page_quality(docs(spark, sf)).select("doc_id", "visible", "words", "letter_ratio", "status")


@query("f9_activation_gate", r"""WITH q AS (SELECT source, length(regexp_replace(text, '\s', '', 'g')) AS v, len(regexp_extract_all(text, '[^\s]+')) AS w FROM documents), s AS (SELECT source, count(*) AS n_pages, count(*) FILTER (NOT (v < 200 OR w < 10)) AS n_usable FROM q GROUP BY 1) SELECT source, n_pages, n_usable, n_usable > 0 AND (n_pages - n_usable) / n_pages <= 0.3 AS active FROM s""")
def f9(spark, sf):
    q = co.page_quality(docs(spark, sf)).groupBy("source").agg(F.count("*").alias("n_pages"), F.count(F.when((F.col("visible") >= 200) & (F.col("words") >= 10), 1)).alias("n_usable"))
    return q.withColumn("active", (F.col("n_usable") > 0) & ((F.col("n_pages") - F.col("n_usable")) / F.col("n_pages") <= 0.3))


@query("p3_content_type", r"""SELECT page_id, CASE WHEN length(trim(html)) = 0 THEN 'empty' WHEN len(regexp_extract_all(lower(html), '\b(?:table|figure)\b')) >= 2 OR len(regexp_extract_all(html, ' {4,}')) >= 3 THEN 'figure_table_and_text' ELSE 'text' END AS kind FROM pages""")
def p3(spark, sf):
    h = F.col("html")
    kind = F.when(F.length(F.trim(h)) == 0, "empty").when((F.regexp_count(F.lower(h), F.lit(r"\b(?:table|figure)\b")) >= 2) | (F.regexp_count(h, F.lit(" {4,}")) >= 3), "figure_table_and_text").otherwise("text")
    return table(spark, sf, "pages").select("page_id", kind.alias("kind"))


_STOP = {"en": ["the", "and", "of", "in", "to", "is"], "fr": ["le", "la", "les", "de", "et", "des"], "de": ["der", "die", "und", "das", "von", "zu"], "es": ["el", "los", "que", "y", "por", "se"]}


@query("p7_stop_word_language", r"""WITH t AS (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}]+') AS t FROM documents), h AS (SELECT doc_id, """ + ", ".join(f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in ws)}))) AS {k}" for k, ws in _STOP.items()) + """ FROM t), b AS (SELECT *, greatest(en, fr, de, es) AS m FROM h) SELECT doc_id, CASE WHEN m = 0 THEN 'und' WHEN en = m THEN 'en' WHEN fr = m THEN 'fr' WHEN de = m THEN 'de' ELSE 'es' END AS language FROM b""")
def p7(spark, sf):
    return docs(spark, sf).select("doc_id", tx.language(F.col("text"), _STOP, "und").alias("language"))


@query("p15_page_buckets", "SELECT conv_id, (turn // 5) * 5 AS bucket, count(*) AS n FROM conversations GROUP BY ALL")
def p15(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", (F.floor(F.col("turn") / 5) * 5).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("p20_stable_ids", "SELECT doc_id, substring(sha256(doc_id || chr(31) || source || chr(31) || text), 1, 16) AS stable_id FROM documents")
def p20(spark, sf):
    return docs(spark, sf).select("doc_id", tx.stable_id(F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("stable_id"))


@query("p21_page_ranges", "WITH p AS (SELECT DISTINCT lang, source, doc_id // 20 AS p FROM documents), g AS (SELECT *, p - row_number() OVER (PARTITION BY lang, source ORDER BY p) AS g FROM p), r AS (SELECT lang, source, min(p) AS a, max(p) AS z FROM g GROUP BY lang, source, g) SELECT lang, source, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '-' || z END, ', ' ORDER BY a) AS pages FROM r GROUP BY ALL")
def p21(spark, sf):
    p = docs(spark, sf).select("lang", "source", F.floor(F.col("doc_id") / 20).cast("long").alias("page"))
    return co.page_ranges(p, "lang", "source")


@query("p22_slugs", r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(url, '\.[A-Za-z0-9]+$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages""")
def p22(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("p24_excerpts", "SELECT doc_id, CASE WHEN length(text) > 60 THEN rtrim(substring(text, 1, 59)) || '…' ELSE text END AS excerpt FROM documents")
def p24(spark, sf):
    return docs(spark, sf).select("doc_id", tx.excerpt(F.col("text"), 60).alias("excerpt"))


@query("p26_stable_split", "SELECT doc_id, ('0x' || substring(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 3 AS split FROM documents")
def p26(spark, sf):
    return docs(spark, sf).select("doc_id", tx.hash_split(F.col("doc_id").cast("string")).alias("split"))


@query("p27_exact_holdout", "WITH r AS (SELECT item_id, row_number() OVER (ORDER BY sha256(item_id::VARCHAR), item_id) AS n FROM benchmark) SELECT item_id, n <= 10 AS held_out FROM r")
def p27(spark, sf):
    w = Window.orderBy(F.sha2(F.col("item_id").cast("string"), 256), "item_id")
    return table(spark, sf, "benchmark").select("item_id", (F.row_number().over(w) <= 10).alias("held_out"))


@query("a6_boilerplate_lines", rf"""WITH l AS (SELECT DISTINCT doc_id, replace(lower(regexp_replace(x, '^\s+|\s+$', '', 'g')), 'ß', 'ss') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)) SELECT line, count(*) AS n_docs FROM l WHERE length(line) BETWEEN 1 AND 160 AND len(string_split_regex(line, '\s+')) <= 10 GROUP BY 1 HAVING count(*) >= 10""")
def a6(spark, sf):
    return co.boilerplate(docs(spark, sf), 10, 0.0)


@query("a6_without_boilerplate", r"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT *, replace(lower(regexp_replace(line, '^\s+|\s+$', '', 'g')), 'ß', 'ss') AS k FROM l),
b AS (SELECT k FROM (SELECT DISTINCT doc_id, k FROM k WHERE length(k) BETWEEN 1 AND 160 AND len(string_split_regex(k, '\s+')) <= 10) GROUP BY k HAVING count(*) >= 10),
j AS (SELECT doc_id, pos, line, k IN (SELECT k FROM b) AS bad FROM k), g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad) AS t, string_agg(line, chr(10) ORDER BY pos) AS e, count(*) FILTER (bad) AS n, count(*) FILTER (NOT bad) AS m FROM j GROUP BY 1)
SELECT doc_id, sha256(CASE WHEN m > 0 THEN t ELSE e END) AS digest, (CASE WHEN m > 0 THEN n ELSE 0 END)::BIGINT AS n_removed FROM g""")
def a6b(spark, sf):
    d = docs(spark, sf)
    return co.without_lines(d, co.boilerplate(d, 10, 0.0)).select("doc_id", F.sha2("text", 256).alias("digest"), "n_removed")


@query("a7_exact_duplicates", r"""WITH k AS (SELECT doc_id, replace(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), 'ß', 'ss') AS k FROM documents) SELECT min(doc_id) AS kept, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM k GROUP BY k""")
def a7(spark, sf):
    return co.exact_duplicates(docs(spark, sf))


@query("a8_cleaning_statistics", "SELECT count(*) AS n_docs, count(DISTINCT text) AS n_distinct, (count(*) - count(DISTINCT text))::BIGINT AS n_removed, round(100.0 * (count(*) - count(DISTINCT text)) / count(*), 2)::DOUBLE AS percent FROM documents")
def a8(spark, sf):
    n, u = F.count("*"), F.countDistinct("text")
    return docs(spark, sf).agg(n.alias("n_docs"), u.alias("n_distinct"), (n - u).alias("n_removed"), F.round(100.0 * (n - u) / n, 2).alias("percent"))


@query("a30_corpus_profile", "SELECT source, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, median(n_chars)::DOUBLE AS median, count(*) FILTER (n_chars > 8000) AS n_over FROM documents GROUP BY 1")
def a30(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"), F.median("n_chars").alias("median"), F.count(F.when(F.col("n_chars") > 8000, 1)).alias("n_over"))


@query("a35_pattern_counts", r"""SELECT source, sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS n_numbers, sum(len(regexp_extract_all(text, '[#*$%&|<>]')))::BIGINT AS n_symbols FROM documents GROUP BY 1""")
def a35(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("[0-9]+"))).cast("long").alias("n_numbers"), F.sum(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).cast("long").alias("n_symbols"))


@query("a32_ordered_digest", "SELECT source, sha256(string_agg(doc_id || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def a32(spark, sf):
    ids = F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: F.concat(x.cast("string"), F.lit("\n")))
    return docs(spark, sf).groupBy("source").agg(F.sha2(F.array_join(ids, ""), 256).alias("digest"))


@query("a36_split_leakage", "WITH s AS (SELECT doc_id, sha256(text) AS family, ('0x' || substring(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 3 AS split FROM documents) SELECT family, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def a36(spark, sf):
    s = docs(spark, sf).select(F.sha2("text", 256).alias("family"), tx.hash_split(F.col("doc_id").cast("string")).alias("split"))
    return s.groupBy("family").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


_LINKS = "lag(turn) OVER w AS p, lead(turn) OVER w AS n, lag(role) OVER w AS pr, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


@query("w6_prev_next", f"SELECT conv_id, turn, CASE WHEN pr = role THEN p END AS prev_pos, CASE WHEN nr = role THEN n END AS next_pos FROM (SELECT conv_id, turn, role, {_LINKS})")
def w6(spark, sf):
    return co.linked(table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "prev_pos", "next_pos")


@query("w7_link_violations", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, role, {_LINKS}) WHERE CASE WHEN pr = role THEN p END IS DISTINCT FROM nullif(turn - 1, -1) OR CASE WHEN nr = role THEN n END IS DISTINCT FROM n")
def w7(spark, sf):
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    stored = c.withColumns({"prev_pos": F.when(F.col("turn") > 0, F.col("turn") - 1), "next_pos": F.lead("turn").over(w)})
    return co.link_violations(stored, "conv_id", "turn", "role").select("conv_id", "turn")


@query("w8_consecutive_groups", "WITH f AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, sum(f) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM f")
def w8(spark, sf):
    return co.consecutive_groups(table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "group_no")


@query("w9_parent_groups", "WITH RECURSIVE c AS (SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END::BIGINT AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), r AS (SELECT conv_id, turn, n, k AS have, 0::BIGINT AS no FROM c WHERE n = 1 UNION ALL SELECT c.conv_id, c.turn, c.n, CASE WHEN r.have + c.k > 90 OR r.have >= 60 THEN c.k ELSE r.have + c.k END, r.no + CASE WHEN r.have + c.k > 90 OR r.have >= 60 THEN 1 ELSE 0 END FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1) SELECT conv_id AS doc_id, turn AS pos, no AS parent_no FROM r")
def w9(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.lit("k").alias("key"), tx.estimated_tokens(F.col("text")).alias("tokens"))
    return co.parent_groups(c, 60, 90)


@query("w10_adjacent_overlap", r"""WITH t AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS t FROM conversations), p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM t) SELECT conv_id, turn, CASE WHEN q IS NOT NULL THEN round(len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))), 6) END AS jaccard FROM p""")
def w10(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("t"))
    t = t.withColumn("q", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.select("conv_id", "turn", F.round(F.size(F.array_intersect("t", "q")) / F.size(F.array_union("t", "q")), 6).alias("jaccard"))


@query("w14_contiguous_ids", "SELECT doc_id, expected FROM (SELECT doc_id, doc_id // 64 * 64 + row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) - 1 AS expected FROM labels) WHERE doc_id <> expected")
def w14(spark, sf):
    """Ids that aren't where a run without gaps has them, run by run."""
    start = F.floor(F.col("doc_id") / 64) * 64
    n = F.row_number().over(Window.partitionBy(start).orderBy("doc_id"))
    return table(spark, sf, "labels").select("doc_id", (start + n - 1).alias("expected")).where("doc_id <> expected")


@query("w15_missing_numbers", "WITH k AS (SELECT conv_id, turn FROM conversations WHERE role <> 'system'), m AS (SELECT conv_id, max(turn) AS m FROM k GROUP BY 1), s AS (SELECT conv_id, unnest(generate_series(0, m)) AS missing FROM m) SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = s.conv_id AND k.turn = s.missing)")
def w15(spark, sf):
    return co.missing_numbers(table(spark, sf, "conversations").where("role <> 'system'"), "conv_id", "turn")


@query("w18_token_windows", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 150)) AS s FROM w WHERE len(w) > 0) SELECT doc_id, (s // 150)::BIGINT AS window_no, least(200, len(w) - s)::BIGINT AS n_words, sha256(array_to_string(w[s + 1:s + 200], ' ')) AS digest FROM s""")
def w18(spark, sf):
    return co.token_windows(docs(spark, sf), 200, 50).select("doc_id", "window_no", "n_words", F.sha2("text", 256).alias("digest"))


@query("w18_token_windows_stop_early", r"""WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents), s AS (SELECT doc_id, n, unnest(range(0, greatest(1, ceil((n - 200) / 150)::BIGINT * 150 + 1), 150)) AS s FROM w WHERE n > 0) SELECT doc_id, (s // 150)::BIGINT AS window_no, least(200, n - s)::BIGINT AS n_words FROM s""")
def w18b(spark, sf):
    return co.token_windows(docs(spark, sf), 200, 50, True).select("doc_id", "window_no", "n_words")


@query("g1_chunks")
def g1(spark, sf):
    return co.chunks(docs(spark, sf)).select("doc_id", "chunk_no", "n_tokens", "chunk_id")


@query("g1_chunk_violations", "WITH l AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE x <> '' AND NOT regexp_matches(x, '^\\s*$') AND length(x) <= 2000) SELECT 0::BIGINT AS n_over, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM l")
def g1v(spark, sf):
    """Chunks over the limit (none), and what they keep: documents, and distinct lines that need no cut."""
    d = docs(spark, sf)
    c = co.chunks(d)
    over = c.agg(F.count(F.when(F.col("n_tokens") > 500 + 80, 1)).alias("n_over"))
    split = lambda t: t.select("doc_id", F.explode(F.split("text", "\n")).alias("x")).where((F.trim("x") != "") & ~F.col("x").rlike(r"^\s*$") & (F.length("x") <= 2000)).distinct()
    kept = split(c).join(split(d), ["doc_id", "x"], "left_semi")
    return over.join(kept.agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_lines")))


@query("g5_evidence_bundles")
def g5(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("child_id"), F.col("conv_id").alias("parent_id"), F.col("turn").alias("pos"), tx.estimated_tokens(F.col("text")).alias("tokens"))
    a = c.where("pos = 1").select((F.col("parent_id") % 10).alias("query_id"), "child_id", (F.col("tokens") / 100.0).alias("score"))
    return evi.pack_evidence(a, c, 200, 900)


@query("g7_fair_share", "WITH RECURSIVE c AS (SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations), r AS (SELECT conv_id, turn, n, size, least(size, 100 // k) AS share, 100 - least(size, 100 // k) AS rest FROM c WHERE n = 1 UNION ALL SELECT c.conv_id, c.turn, c.n, c.size, least(c.size, r.rest // (c.k - c.n + 1)), r.rest - least(c.size, r.rest // (c.k - c.n + 1)) FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1) SELECT conv_id, turn, size, share::BIGINT AS share FROM r")
def g7(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", tx.estimated_tokens(F.col("text")).alias("size"))
    return evi.fair_share(c, "conv_id", "turn", "size", 100)


@query("o18_history_within_budget", "SELECT * FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) WHERE used <= 400")
def o18(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", F.length("text").cast("long"))
    return evi.within_budget(c, "conv_id", "turn", "n", 400).select("conv_id", "turn", "used")


@query("u6_source_overlap", "WITH v AS (SELECT DISTINCT source, lang || ':' || (n_chars // 200) AS x FROM documents), n AS (SELECT source, count(*) AS n FROM v GROUP BY 1), i AS (SELECT a.source AS a, b.source AS b, count(*) AS k FROM v a JOIN v b ON a.x = b.x AND a.source < b.source GROUP BY ALL) SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM i JOIN n x ON x.source = a JOIN n y ON y.source = b")
def u6(spark, sf):
    v = docs(spark, sf).select("source", F.concat("lang", F.lit(":"), F.floor(F.col("n_chars") / 200).cast("string")).alias("x")).distinct()
    n = v.groupBy("source").agg(F.count("*").alias("n"))
    i = v.select(F.col("source").alias("a"), "x").join(v.select(F.col("source").alias("b"), "x"), "x").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    j = i.join(n.withColumnsRenamed({"source": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"source": "b", "n": "nb"}), "b")
    return j.select("a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


@query("q_document_rules", "SELECT 'length' AS rule, count(*) FILTER (length(text) <> n_chars) AS n FROM documents UNION ALL SELECT 'language', count(*) FILTER (lang NOT IN ('en', 'fr', 'de', 'es')) FROM documents UNION ALL SELECT 'long_enough', count(*) FILTER (n_chars < 20) FROM documents")
def q(spark, sf):
    return violations(docs(spark, sf), {"length": F.length("text") == F.col("n_chars"), "language": F.col("lang").isin("en", "fr", "de", "es"), "long_enough": F.col("n_chars") >= 20})


@query("q14_chat_rules", "SELECT 'role' AS rule, count(*) FILTER (role NOT IN ('user', 'assistant')) AS n FROM conversations UNION ALL SELECT 'not_blank', count(*) FILTER (trim(text) = '') FROM conversations UNION ALL SELECT 'turn', count(*) FILTER (turn < 0) FROM conversations")
def q14(spark, sf):
    return violations(table(spark, sf, "conversations"), {"role": F.col("role").isin("user", "assistant"), "not_blank": F.trim("text") != "", "turn": F.col("turn") >= 0})


@query("f10_question_validation", r"""SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'blank' WHEN length(text) > 400 THEN 'too_long' WHEN NOT regexp_matches(text, '[\p{L}\p{N}]') THEN 'no_words' ELSE 'ok' END AS status FROM conversations WHERE role = 'user'""")
def f10(spark, sf):
    t = F.col("text")
    status = F.when(F.trim(t) == "", "blank").when(F.length(t) > 400, "too_long").when(~t.rlike(r"[\p{L}\p{N}]"), "no_words").otherwise("ok")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", status.alias("status"))
