"""Question planning: ordered rules, lexicon expansion, roles, source routing, follow-ups, formulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, folded


def first_match(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule (label, regex) that the text matches."""
    out = F.lit(default)
    for label, rx in reversed(rules):
        out = F.when(c.rlike(rx), label).otherwise(out)
    return out


def expand(queries: DataFrame, lexicon: DataFrame, most: int = 8) -> DataFrame:
    """Adds added (terms in lexicon order) and expanded. lexicon(phrase, term, ord): a term is added for each phrase that the
    query holds, if the query doesn't hold the term itself."""
    q = queries.select("query_id", "text", folded(F.col("text")).alias("_f"))
    hit = q.join(lexicon, F.col("_f").contains(F.col("phrase")) & ~F.col("_f").contains(F.col("term")))
    one = hit.groupBy("query_id", "term").agg(F.min("ord").alias("ord"))
    terms = F.slice(F.array_sort(F.collect_list(F.struct("ord", "term"))), 1, most)
    t = one.groupBy("query_id").agg(F.transform(terms, lambda x: x["term"]).alias("added"))
    out = queries.join(t, "query_id", "left").withColumn("added", F.coalesce("added", F.array().cast("array<string>")))
    return out.withColumn("expanded", F.concat_ws(" ", "text", F.array_join("added", " ")))


def plan_roles(queries: DataFrame, hints: DataFrame, kind: str = "kind") -> DataFrame:
    """(query_id, role_no, role, role_query): a query becomes one row for each role of its kind, or a `primary` role.
    hints(kind, role_no, role, hint)."""
    j = queries.join(hints.withColumnRenamed("kind", "_kind"), F.col(kind) == F.col("_kind"), "left")
    return j.select("query_id", F.coalesce("role_no", F.lit(1)).cast("long").alias("role_no"), F.coalesce("role", F.lit("primary")).alias("role"), collapse(F.concat_ws(" ", "text", "hint")).alias("role_query"))


def named(df: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """Rows of df with each row of aliases(alias, ...) whose alias stands in the text as whole words. The text's runs of words,
    as long as aliases are, meet the aliases in an equi-join. text: normalised, words parted by one space."""
    a = aliases.withColumn("_a", F.trim(F.regexp_replace(folded(F.col("alias")), r"[^\p{L}\p{N}]+", " "))).distinct()
    most = a.agg(F.max(F.size(F.split("_a", " ")))).first()[0] or 1  # words of the longest alias
    words = F.split(F.trim(text), " ")

    def grams(n: int) -> Column:
        g = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
        return F.when(F.size(words) >= n, g).otherwise(F.array().cast("array<string>"))

    return df.withColumn("_a", F.explode(F.array_distinct(F.concat(*(grams(n) for n in range(1, most + 1)))))).join(a, "_a")


def route(queries: DataFrame, aliases: DataFrame, trigger: str) -> DataFrame:
    """(query_id, source): the source that a query names after a trigger word, as a whole word, longest alias first; none if
    two sources are named. aliases(source, alias)."""
    f = folded(F.col("text"))
    q = queries.where(f.rlike(trigger)).select("query_id", F.concat(F.lit(" "), F.regexp_replace(f, r"[^\p{L}\p{N}]+", " "), F.lit(" ")).alias("_f"))
    m = named(q, aliases, "_f").select("query_id", "source")
    return m.groupBy("query_id").agg(F.countDistinct("source").alias("n"), F.min("source").alias("source")).where("n = 1").drop("n")


def follow_up(df: DataFrame, conv: str, turn: str, text: str, entity: Column, pronoun: str) -> DataFrame:
    """Adds resolved: in a turn with a pronoun and no entity of its own, the pronoun gives way to the last entity named before."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(entity, ignorenulls=True).over(w)
    d = df.withColumn("_known", known)
    again = F.col(text).rlike(pronoun) & entity.isNull() & F.col("_known").isNotNull()
    return d.withColumn("resolved", F.when(again, F.regexp_replace(F.col(text), F.lit(pronoun), F.col("_known"))).otherwise(F.col(text))).drop("_known")


def formulations(queries: DataFrame, forms: dict[str, Column], most: int = 3) -> DataFrame:
    """(query_id, form, text): the query's formulations in the order given, equal ones once, `most` at most."""
    parts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("form"), collapse(c).alias("t")) for i, (k, c) in enumerate(forms.items())))
    e = queries.select("query_id", F.explode(parts).alias("p")).select("query_id", "p.*").where("t <> ''")
    e = e.groupBy("query_id", "t").agg(F.min(F.struct("i", "form")).alias("f"))
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("f.i"))).where(F.col("_n") <= most)
    return e.select("query_id", "f.form", F.col("t").alias("text"))


def adjusted(hits: DataFrame, boosts: DataFrame, kind: str = "kind") -> DataFrame:
    """Ranks by score plus the boost of the hit's kind (a small table), then old rank, then id."""
    j = hits.join(boosts.select(F.col("kind").alias("_k"), "boost"), F.col(kind) == F.col("_k"), "left")
    j = j.withColumn("adjusted", F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("adjusted"), "rank", "doc_id")
    return j.withColumn("position", F.row_number().over(w).cast("long")).drop("_k", "boost")


def section_bonus(sections: DataFrame, members: DataFrame, section: str, step: float = 0.0005, top: float = 0.006) -> DataFrame:
    """(query_id, doc_id, bonus): the best bonus of the ranked sections(query_id, section, rank) that hold a document, by
    members(section, doc_id)."""
    b = F.greatest(F.lit(step), top - step * (F.col("rank") - 1))
    x = sections.select("query_id", section, b.alias("b")).join(members.select(section, "doc_id"), section)
    return x.groupBy("query_id", "doc_id").agg(F.round(F.max("b"), 6).alias("bonus"))


def first_success(attempts: DataFrame) -> DataFrame:
    """Of ranked attempts (query_id, place, n_found), the first that found something: all are computed at once."""
    w = Window.partitionBy("query_id").orderBy("place")
    return attempts.where("n_found > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
