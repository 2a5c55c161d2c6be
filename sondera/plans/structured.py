"""Queries of document structure: a host's pages are a document, read in order of page_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections as sx
from ..operators import structure as st
from ..sources.tables import Derived, table
from .registry import query
from .retrieval import _TOKS, questions

#: Legal lines of first pages, as the queries exclude them.
LEGAL = r"(?i)\b(?:all rights reserved|isbn|copyright|library of congress)\b"


def site_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(F.regexp_extract("url", "//([^/]+)", 1).alias("doc"), (F.col("page_id") + 1).alias("page"), st.markup_lines(F.col("html")).alias("text"))


_MD = r"regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->', '', 'g')"
for _k in range(1, 7):
    _MD = rf"regexp_replace({_MD}, '(?i)<h{_k}(?:\s[^>]*)?>', chr(10) || chr(10) || '{'#' * _k} ', 'g')"
_MD = rf"regexp_replace({_MD}, '(?i)<li(?:\s[^>]*)?>', chr(10) || '- ', 'g')"
_MD = rf"regexp_replace({_MD}, '(?i)</?(?:p|br|div|ul|ol|footer|article|nav|h[1-6])(?:\s[^>]*)?/?>', chr(10) || chr(10), 'g')"
_MD = rf"replace(replace(replace(regexp_replace({_MD}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINES = rf"""
p AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS doc, page_id + 1 AS page, {_STRIP.format(_MD)} AS text FROM pages),
l0 AS (SELECT doc, page, unnest(range(len(x))) AS ln, unnest(x) AS raw FROM (SELECT doc, page, string_split_regex(text, '\r\n|\r|\n') AS x FROM p)),
l1 AS (SELECT doc, page, ln, {_STRIP.format('raw')} AS line FROM l0),
l2 AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\s+\S', 1)) AS m,
  length(line) <= 100 AND len(regexp_extract_all(line, '\S+')) BETWEEN 1 AND 12 AND len(regexp_extract_all(line, '\p{{L}}')) >= 4 AND line = upper(line) AND NOT ends_with(line, '.') AS h FROM l1),
l AS (SELECT doc, page, ln, line, CASE WHEN m > 0 THEN m WHEN h THEN CASE WHEN starts_with(line, 'CHAPTER ') THEN 1 ELSE 2 END END::INT AS level,
  CASE WHEN m > 0 THEN regexp_replace(line, '^#{{1,6}}\s+', '') WHEN h THEN line END AS title,
  CASE WHEN line = '' THEN 'blank' WHEN m > 0 OR h THEN 'heading' WHEN regexp_matches(line, '^\|.*\|$') THEN 'table' ELSE 'text' END AS kind FROM l2),"""
#: The stack by a window over each whole document: the last heading of a level and the last one above it.
_PATHS = _LINES + "\nw AS (SELECT *, last_value(level IGNORE NULLS) OVER o AS deep, " + ", ".join(f"last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER o AS t{k}, max(CASE WHEN level = {k} THEN page * 1000000 + ln END) OVER o AS p{k}" for k in range(1, 7)) + """
  FROM l WINDOW o AS (PARTITION BY doc ORDER BY page, ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT doc, page, ln, line, level, title, kind, list_slice([""" + ", ".join(f"CASE WHEN p{k} > coalesce(greatest({', '.join(f'p{j}' for j in range(1, k)) or 'NULL'}), -1) THEN t{k} ELSE '' END" for k in range(1, 7)) + """], 1, coalesce(deep, 0)) AS path FROM w),"""
_UNITS = _PATHS + r"""
g0 AS (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc, page ORDER BY ln))::INT AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY ln) AS no FROM g0),
u0 AS (SELECT doc, page, no, any_value(kind) AS kind, min_by(path, ln) AS path, string_agg(line, chr(10) ORDER BY ln) AS a, string_agg(line, ' ' ORDER BY ln) AS b, bool_or(regexp_matches(line, '^([-*+]|\d+[.)])\s+')) AS li FROM g WHERE kind IN ('table', 'text') GROUP BY doc, page, no),
u1 AS (SELECT doc, page, no, path, kind, CASE WHEN kind = 'table' OR li THEN a ELSE b END AS text FROM u0),
u AS (SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY no) AS unit_no, CASE WHEN kind = 'table' THEN 'table' WHEN regexp_matches(lower(text), '^(fig\.|figure |table |diagram )') THEN 'caption' ELSE 'paragraph' END AS kind, path, text FROM u1)"""


@query("t26_heading_paths", "WITH " + _PATHS.rstrip(",") + " SELECT doc, page, ln AS line_no, level, array_to_string(path, ' > ') AS path FROM s WHERE level IS NOT NULL")
def t26_paths(spark, sf):
    x = st.headings(site_pages(spark, sf))
    return x.select("doc", "page", F.col("at").cast("long").alias("line_no"), F.size("path").alias("level"), F.array_join("path", " > ").alias("path"))


@query("g1_structured_units", "WITH " + _UNITS + " SELECT doc, page, unit_no, kind, array_to_string(path, ' > ') AS path, sha256(text) AS digest FROM u")
def g1_units(spark, sf):
    built(spark, sf)
    _, keep = stored(spark, sf)
    return keep(None, "units").select("doc", "page", "unit_no", "kind", F.array_join("path", " > ").alias("path"), F.sha2("text", 256).alias("digest"))


_X = "chr(31)"
_CHILDREN = _UNITS + rf""",
c0 AS (SELECT *, list_filter(path, lambda x: x <> '') AS h FROM u WHERE NOT (page <= 5 AND regexp_matches(substring(text, 1, 500), '(?i)\b(?:all rights reserved|isbn|copyright|library of congress)\b'))),
c1 AS (SELECT *, CASE WHEN len(h) = 2 THEN h[1] WHEN len(h) > 2 THEN h[-3] END AS chapter, CASE WHEN len(h) = 1 THEN h[1] WHEN len(h) = 2 THEN h[2] WHEN len(h) > 2 THEN h[-2] END AS section, CASE WHEN len(h) > 2 THEN h[-1] END AS subsection,
  ((page - 1) // 5) * 5 + 1 AS b FROM c0),
c2 AS (SELECT *, concat_ws(' > ', doc, chapter, section, subsection, CASE WHEN len(h) = 0 THEN 'Unlabelled pages ' || b || '-' || (b + 4) END) AS hierarchy_path FROM c1),
c3 AS (SELECT *, doc || '_section_' || substring(sha256(doc || {_X} || hierarchy_path), 1, 16) AS section_id, substring(sha256(concat_ws({_X}, doc, page, page, array_to_string(h, ' > '), text)), 1, 16) AS d,
  CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END::BIGINT AS tokens FROM c2),
c4 AS (SELECT *, row_number() OVER (PARTITION BY doc, page, d ORDER BY unit_no) AS again, row_number() OVER o AS n, section_id IS DISTINCT FROM lag(section_id) OVER o AS new FROM c3 WINDOW o AS (PARTITION BY doc ORDER BY page, unit_no)),
c5 AS (SELECT *, doc || '_' || d || CASE WHEN again > 1 THEN '_' || again ELSE '' END AS chunk_id FROM c4),
c6 AS (SELECT *, CASE WHEN lag(chapter) OVER o IS NOT DISTINCT FROM chapter AND lag(section) OVER o IS NOT DISTINCT FROM section THEN lag(chunk_id) OVER o END AS previous_chunk_id,
  CASE WHEN lead(chapter) OVER o IS NOT DISTINCT FROM chapter AND lead(section) OVER o IS NOT DISTINCT FROM section THEN lead(chunk_id) OVER o END AS next_chunk_id
  FROM c5 WINDOW o AS (PARTITION BY doc ORDER BY n)),
f AS (SELECT doc, n, 0::BIGINT AS parent_no, tokens AS have FROM c6 WHERE n = 1
  UNION ALL SELECT c.doc, c.n, f.parent_no + CASE WHEN c.new OR f.have + c.tokens > 1700 OR f.have >= 1250 THEN 1 ELSE 0 END, CASE WHEN c.new OR f.have + c.tokens > 1700 OR f.have >= 1250 THEN c.tokens ELSE f.have + c.tokens END FROM f JOIN c6 c ON c.doc = f.doc AND c.n = f.n + 1),
c AS (SELECT c6.*, f.parent_no FROM c6 JOIN f USING (doc, n)),
pa AS (SELECT doc, parent_no, doc || '_parent_' || substring(sha256(concat_ws({_X}, doc, min_by(chunk_id, n), max_by(chunk_id, n), string_agg(text, chr(10) || chr(10) ORDER BY n))), 1, 16) AS parent_id,
  any_value(section_id) AS section_id, min(page) AS page_start, max(page) AS page_end, sum(tokens)::BIGINT AS tokens, string_agg(chunk_id, ',' ORDER BY n) AS child_chunk_ids FROM c GROUP BY doc, parent_no)"""
_REC = "WITH RECURSIVE " + _CHILDREN


def stored(spark, sf):
    """A place for the tables of the structure, which are made once a session and read by all its queries."""
    held = Derived(spark, f"{sf}/pages.parquet", "structure")
    done = {"units": ("pages", "headings"), "children": ("linked",)}  # read by nothing after these

    def keep(df, name):
        if held.known and any(name in x for x in done.values()):
            return df  # not read: what is made from it is stored
        if df is not None and not held.known:
            held.write(name, df)
            held.forget(*done.get(name, ()))
        return held.read(name)

    return held, keep


def built(spark, sf):
    held, keep = stored(spark, sf)
    out = st.hierarchy(keep(site_pages(spark, sf), "pages"), LEGAL, keep)
    if not held.known:
        held.keep()
    return out


@query("g3_children", _REC + " SELECT chunk_id, parent_id, c.section_id, doc, page, unit_no, hierarchy_path, previous_chunk_id, next_chunk_id, c.tokens FROM c JOIN pa USING (doc, parent_no)")
def g3_children(spark, sf):
    c, _, s = built(spark, sf)
    c = c.join(s.select("section_id", "hierarchy_path"), "section_id")
    return c.select("chunk_id", "parent_id", "section_id", "doc", "page", "unit_no", "hierarchy_path", "previous_chunk_id", "next_chunk_id", "tokens")


@query("g3_parents", _REC + " SELECT parent_id, section_id, page_start, page_end, tokens, child_chunk_ids FROM pa")
def g3_parents(spark, sf):
    return built(spark, sf)[1].select("parent_id", "section_id", "page_start", "page_end", "tokens", F.array_join("child_chunk_ids", ",").alias("child_chunk_ids"))


@query("g3_sections", _REC + " SELECT section_id, hierarchy_path, chapter, section, subsection, count(*) AS n_children, min(page) AS page_start, max(page) AS page_end, sum(tokens)::BIGINT AS tokens, min_by(chunk_id, n) AS first_chunk_id FROM c GROUP BY ALL")
def g3_sections(spark, sf):
    return built(spark, sf)[2].drop("doc", "kinds")


@query("q6_built_hierarchy", _REC + " SELECT count(*) AS n_children, count(DISTINCT chunk_id) AS n_ids, (SELECT count(*) FROM pa) AS n_parents, count(DISTINCT section_id) AS n_sections, 0::BIGINT AS n_wrong FROM c")
def q6_built(spark, sf):
    """Children, parents and sections built from the pages: each child listed by one parent, which lies in the child's section, and
    links that answer each other. n_wrong counts what doesn't hold."""
    c, p, s = built(spark, sf)
    listed = p.select("parent_id", F.col("section_id").alias("of"), F.explode("child_chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("k"), F.min("parent_id").alias("in_parent"), F.min("of").alias("of"))
    back = c.where("next_chunk_id IS NOT NULL").select(F.col("next_chunk_id").alias("chunk_id"), F.col("chunk_id").alias("from"))
    j = c.join(listed, "chunk_id", "left").join(back, "chunk_id", "left").join(s.select("section_id", F.lit(True).alias("known")), "section_id", "left")
    fine = (F.col("k") == 1) & (F.col("in_parent") == F.col("parent_id")) & (F.col("of") == F.col("section_id")) & F.col("known") & F.col("from").eqNullSafe(F.col("previous_chunk_id"))
    out = j.agg(F.count("*").alias("n_children"), F.countDistinct("chunk_id").alias("n_ids"), F.countDistinct("parent_id").alias("n_parents"), F.countDistinct("section_id").alias("n_sections"), F.count(F.when(~F.coalesce(fine, F.lit(False)), 1)).alias("n_wrong"))
    return out


#: Paths of little value, as the section queries leave them out.
LOW_VALUE = r"(?i)\b(?:contents|index|bibliography|references)\b"
_BM = "round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))), 6)"
_SECTIONS = _REC + rf""",
k AS (SELECT DISTINCT section_id, kind FROM c), kk AS (SELECT section_id, list(kind) AS kinds FROM k GROUP BY 1),
sec AS (SELECT c.section_id, doc, hierarchy_path, min(page) AS page_start FROM c GROUP BY ALL),
ct AS (SELECT chunk_id, section_id, {_TOKS} AS toks FROM c), cp AS (SELECT chunk_id, section_id, len(toks) AS dl, unnest(toks) AS tok FROM ct),
ctf AS (SELECT chunk_id, section_id, dl, tok, count(*) AS tf FROM cp GROUP BY ALL),
pt AS (SELECT section_id, unnest({_TOKS.replace("text", "hierarchy_path")}) AS tok FROM sec),
stf0 AS (SELECT section_id, tok, sum(tf) AS tf FROM (SELECT section_id, tok, tf FROM ctf UNION ALL SELECT section_id, tok, 3 FROM pt) GROUP BY ALL),
stf AS (SELECT *, sum(tf) OVER (PARTITION BY section_id) AS dl FROM stf0), sdf AS (SELECT tok, count(*) AS df FROM stf GROUP BY 1),
sst AS (SELECT (SELECT count(*) FROM sec)::DOUBLE AS n, (SELECT sum(tf) FROM stf) / (SELECT count(*) FROM sec) AS a),
qt AS (SELECT item_id AS query_id, unnest({_TOKS}) AS tok FROM benchmark), q AS (SELECT query_id, tok, count(*) AS qtf FROM qt GROUP BY ALL),
b0 AS (SELECT query_id, section_id, {_BM} AS score FROM q JOIN stf USING (tok) JOIN sdf USING (tok), sst GROUP BY ALL),
b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM b0 WHERE score > 0),
qw0 AS (SELECT query_id, tok, 1 + ln(qtf) AS w FROM q), qw AS (SELECT query_id, tok, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qw0),
sw0 AS (SELECT section_id, tok, 1 + ln(tf) AS w FROM stf), sw AS (SELECT section_id, tok, w / sqrt(sum(w * w) OVER (PARTITION BY section_id)) AS w FROM sw0),
v0 AS (SELECT query_id, section_id, round(sum(qw.w * sw.w), 6) AS score FROM qw JOIN sw USING (tok) GROUP BY ALL),
v1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM v0 WHERE score > 0),
lr AS (SELECT query_id, section_id, rank, NULL::DOUBLE AS sp FROM b1 WHERE rank <= 30 UNION ALL SELECT query_id, section_id, rank, score FROM v1 WHERE rank <= 30),
fu AS (SELECT query_id, section_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(sp) AS sp FROM lr GROUP BY ALL),
te AS (SELECT query_id, list(DISTINCT tok) AS terms FROM qt GROUP BY 1),
fb AS (SELECT query_id, section_id, doc, page_start, sp, round(rrf + CASE WHEN list_contains(kinds, CASE WHEN query_id % 2 = 0 THEN 'table' ELSE 'paragraph' END) THEN 0.045 ELSE 0.0 END
  + CASE WHEN query_id % 2 = 1 AND list_contains(kinds, 'caption') THEN -0.06 ELSE 0.0 END
  + least(0.06, 0.02 * len(list_intersect(terms, list_distinct({_TOKS.replace("text", "hierarchy_path")}))))::DOUBLE, 9) AS score
  FROM fu JOIN sec USING (section_id) JOIN kk USING (section_id) JOIN te USING (query_id) WHERE NOT regexp_matches(hierarchy_path, '{LOW_VALUE}')),
fd AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY score DESC, coalesce(sp, -1) DESC, doc, page_start, section_id) AS per FROM fb),
win0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(sp, -1) DESC, doc, page_start, section_id) AS rank FROM fd WHERE per <= 3),
win AS (SELECT query_id, section_id, doc, score, rank FROM win0 WHERE rank <= 8)"""


def sections(spark, sf):
    """Chunks, their postings, the postings of sections, and the sections, stored once a session."""
    c, _, s = built(spark, sf)
    _, keep = stored(spark, sf)
    held = Derived(spark, f"{sf}/pages.parquet", "sections")
    if not held.known:
        texts = c.select("doc", "page", "unit_no", "chunk_id", "section_id").join(keep(None, "units").select("doc", "page", "unit_no", "text"), ["doc", "page", "unit_no"])
        held.write("chunk", sx.chunk_postings(texts))
        held.write("section", sx.section_postings(held.read("chunk"), s))
        held.keep()
    return c, held.read("chunk"), held.read("section"), s


def profiled(spark, sf):
    """Questions with the kinds of content that their profile prefers and penalises."""
    even = F.col("query_id") % 2 == 0
    return questions(spark, sf).withColumns({"preferred": F.when(even, F.array(F.lit("table"))).otherwise(F.array(F.lit("paragraph"))), "penalised": F.when(~even, F.array(F.lit("caption")))})


def won(spark, sf):
    _, _, postings, s = sections(spark, sf)
    return sx.search_sections(sx.index_of(postings, s.count()), s, profiled(spark, sf), low_value=LOW_VALUE)


@query("r7_section_search", _SECTIONS + " SELECT query_id, section_id, doc, score, rank FROM win")
def r7_sections(spark, sf):
    return won(spark, sf)


@query("r7_chunks_of_sections", _SECTIONS + f""", cdf AS (SELECT tok, count(*) AS df FROM ctf GROUP BY 1),
cst AS (SELECT (SELECT count(*) FROM c)::DOUBLE AS n, (SELECT sum(tf) FROM ctf) / (SELECT count(*) FROM c) AS a),
h AS (SELECT win.query_id, chunk_id, {_BM} AS score FROM win JOIN q ON q.query_id = win.query_id JOIN ctf ON ctf.section_id = win.section_id AND ctf.tok = q.tok JOIN cdf ON cdf.tok = q.tok, cst GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h WHERE score > 0)
SELECT query_id, chunk_id, score, rank FROM hr WHERE rank <= 10""")
def r7_chunks(spark, sf):
    c, postings, _, _ = sections(spark, sf)
    return sx.search_chunks(postings, sx.index_of(postings, c.count()), won(spark, sf), questions(spark, sf), 10).withColumnRenamed("doc_id", "chunk_id")
