"""Queries of claim support: assistant turns that cite the user turns of their conversation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import support as sp
from ..operators.checks import UNIT_NAMES
from ..sources.tables import table
from .registry import query

#: What is added to an answer by turn modulo 4, and to a source by its number modulo 3.
_SAYS = [
    "\n1. The flow is 1 250,50 kg per hour [Source 1]; about two bar [Source 2].\n2. It stays at 80 degrees C [Source 3].",
    " It takes 007 tonnes / h, or 12 percent [Source 2] [Source 1]! No source; none here. Three kW [Source 9].",
    "\n3. 12 345 678 m3 per hour; 5 % [Source 1].\n\n4) Speed of 2.0 metres per second [Source 2][Source 3]",
    "",
]
_HOLDS = ["\nAt 80 °C and 2 bar, 2 m/s.", "\nFlow: 1250.5 kg/h and 12345678 m3/h, 5%.", "\nSome 7 t/h, 12%, two metre per sec."]


def _case(x: str, parts: list[str]) -> str:
    quoted = [p.replace("'", "''") for p in parts]
    return f"CASE {x} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(quoted)) + " END"


def _measured(x: str) -> str:
    """SQL of the measured text of x; without look-around, so neighbours that share a digit take a second turn."""
    x = rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '^\s*[0-9]+[.)]\s*', '')"
    x = f"translate({x}, '–—−³', '---3')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([0-9])\s*[.,]\s*([0-9])', '\1' || chr(3) || '\2', 'g')"
    x = f"replace({x}, chr(3), '.')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([0-9])\s+([0-9]{{3}})([^0-9]|$)', '\1\2\3', 'g')"
    for pattern, form in sp.UNIT_FORMS:
        x = rf"regexp_replace({x}, '{'' if '°' in pattern else chr(92) + 'b'}{pattern}\b', '{form}', 'g')"
    return rf"regexp_replace({x}, '([0-9])\s*%', '\1%', 'g')"


def _numbers(m: str) -> str:
    found = rf"list_transform(list_transform(regexp_extract_all({m}, '(?:^|[^\p{{L}}\p{{N}}_.])([0-9]+(?:\.[0-9]+)?)', 1), lambda x: regexp_replace(x, '^0+([0-9])', '\1')), lambda x: CASE WHEN contains(x, '.') THEN regexp_replace(x, '\.?0+$', '') ELSE x END)"
    said = ", ".join(rf"CASE WHEN regexp_matches({m}, '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])') THEN '{n}' END" for w, n in sp.NUMBER_WORDS.items())
    return f"list_sort(list_distinct(list_concat({found}, list_filter([{said}], lambda x: x IS NOT NULL))))"


def _units(m: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all({m}, '{UNIT_NAMES}(?:[^\p{{L}}\p{{N}}_]|$)', 1)))"


_CLAIMS = rf"""WITH a AS (SELECT conv_id, turn, text || {_case("turn % 4", _SAYS)} AS text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
l AS (SELECT conv_id, turn, i, regexp_replace(l, '^(\s*[0-9]+)\.\s+', '\1' || chr(2) || ' ') AS l FROM (SELECT conv_id, turn, unnest(range(len(ls))) AS i, unnest(list_transform(ls, lambda x: trim(x, ' ' || chr(9)))) AS l FROM (SELECT *, string_split_regex(text, '\r\n|\r|\n') AS ls FROM a)) WHERE l <> ''),
s AS (SELECT conv_id, turn, i, unnest(range(len(ss))) AS j, replace(unnest(ss), chr(2), '.') AS s FROM (SELECT *, string_split(regexp_replace(l, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM l)),
p AS (SELECT *, list_filter(list_transform(string_split(s, ';'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS ps FROM s WHERE trim(s, ' ' || chr(9)) <> ''),
k AS (SELECT conv_id, turn, i, j, CASE WHEN len(ps) > 1 AND len(list_filter(ps, lambda x: regexp_matches(x, '\[Source [1-9][0-9]*\]'))) = len(ps) THEN ps ELSE [trim(s, ' ' || chr(9))] END AS cs FROM p),
c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j, k) - 1 AS claim_no, claim FROM (SELECT conv_id, turn, i, j, unnest(range(len(cs))) AS k, unnest(cs) AS claim FROM k)) """


@query("t14_cited_claims", _CLAIMS + r"SELECT conv_id, turn, claim_no::BIGINT AS claim_no, sha256(claim) AS digest FROM c")
def t14(spark, sf):
    c = sp.claims(answers(spark, sf))
    return c.select("answer.*", F.col("claim_no").cast("long").alias("claim_no"), F.sha2("claim", 256).alias("digest"))


def answers(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select(F.struct("conv_id", "turn").alias("answer"), F.concat("text", F.element_at(F.array(*map(F.lit, _SAYS)), (F.col("turn") % 4 + 1).cast("int"))).alias("text"))


def sources(spark, sf):
    """User turns of a conversation, numbered in their order, for each answer of it."""
    c = table(spark, sf, "conversations")
    u = c.where("role = 'user'").select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("number"), "text")
    u = u.select("conv_id", "number", F.concat("text", F.element_at(F.array(*map(F.lit, _HOLDS)), F.col("number") % 3 + 1)).alias("text"))
    return u.where("number <= 3").join(c.where("role = 'assistant'").select("conv_id", "turn"), "conv_id").select(F.struct("conv_id", "turn").alias("answer"), "number", "text")


_SUPPORT = _CLAIMS + rf""", e0 AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
e1 AS (SELECT conv_id, n::VARCHAR AS n, {_measured("coalesce(text || " + _case("n % 3", _HOLDS) + ", '')")} AS m FROM e0 WHERE n <= 3),
e AS (SELECT conv_id, n, {_numbers("m")} AS hn, {_units("m")} AS hu FROM e1),
c1 AS (SELECT conv_id, turn, claim_no, list_distinct(regexp_extract_all(claim, '\[Source ([1-9][0-9]*)\]', 1)) AS cited, {_measured("regexp_replace(claim, '\\[Source ([1-9][0-9]*)\\]', '', 'g')")} AS m FROM c WHERE regexp_matches(claim, '\[Source [1-9][0-9]*\]')),
c2 AS (SELECT conv_id, turn, claim_no, len(cited) AS n_cited, {_numbers("m")} AS ns, {_units("m")} AS us, unnest(cited) AS n FROM c1),
j AS (SELECT c2.*, hn IS NOT NULL AS known, list_filter(ns, lambda x: NOT list_contains(coalesce(hn, []), x)) AS mn, list_filter(us, lambda x: NOT list_contains(coalesce(hu, []), x)) AS mu FROM c2 LEFT JOIN e ON e.conv_id = c2.conv_id AND e.n = c2.n),
o AS (SELECT *, count(*) FILTER (known) OVER (PARTITION BY conv_id, turn, claim_no) AS n_known, row_number() OVER (PARTITION BY conv_id, turn, claim_no ORDER BY known DESC, len(mn) + len(mu), n::BIGINT) AS r FROM j) """


@query("t17_claim_support", _SUPPORT + "SELECT conv_id, turn, claim_no::BIGINT AS claim_no, n_cited::BIGINT AS n_cited, n_known::BIGINT AS n_known, known AND len(mn) + len(mu) = 0 AS supported, array_to_string(mn, ' ') AS missing_numbers, array_to_string(mu, ' ') AS missing_units FROM o WHERE r = 1")
def t17(spark, sf):
    x = sp.support(answers(spark, sf), sources(spark, sf))
    return x.select("answer.*", F.col("claim_no").cast("long").alias("claim_no"), "n_cited", "n_known", "supported", F.array_join("missing_numbers", " ").alias("missing_numbers"), F.array_join("missing_units", " ").alias("missing_units"))


@query("t16_measured_quantities", f"WITH t AS (SELECT doc_id, {_measured('text || ' + _case('doc_id % 4', _SAYS))} AS m FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string({_numbers('m')}, ' ') AS numbers, sha256(m) AS digest FROM t")
def t16(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    m = sp.measured(F.concat("text", F.element_at(F.array(*map(F.lit, _SAYS)), (F.col("doc_id") % 4 + 1).cast("int"))))
    return d.select("doc_id", m.alias("m")).select("doc_id", F.array_join(sp.stated_numbers(F.col("m")), " ").alias("numbers"), F.sha2("m", 256).alias("digest"))
