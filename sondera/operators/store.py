"""Stores: snapshots and their differences, upserts, session listing, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): new, modified, unchanged, removed, or duplicate (another new key with the same content comes first)."""
    o = old.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    j = new.select(key, digest).join(o, F.col(key) == F.col("_k"), "full_outer")
    known = F.col("_k").isNotNull()
    first = F.row_number().over(Window.partitionBy(digest).orderBy(F.when(known, 0).otherwise(1), key))
    j = j.withColumn("_n", F.when(F.col(key).isNotNull(), first))
    state = F.when(F.col(key).isNull(), "removed").when(F.col("_n") > 1, "duplicate").when(~known, "new").when(F.col("_d") == F.col(digest), "unchanged").otherwise("modified")
    return j.select(F.coalesce(key, "_k").alias(key), state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new, which win."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def listing(sessions: DataFrame, messages: DataFrame, session: str, limit: int, offset: int = 0) -> DataFrame:
    """Sessions with their number of messages, newest first (updated, then created, then id)."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    n = messages.groupBy(session).agg(F.count("*").alias("n_messages"))
    j = sessions.join(n, session, "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
    return j.orderBy(F.desc("updated"), F.desc("created"), session).offset(offset).limit(limit)


def delete_cascade(sessions: DataFrame, messages: DataFrame, gone: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions in `gone`."""
    return sessions.join(gone, session, "left_anti"), messages.join(gone, session, "left_anti")


def cached(rows: DataFrame, cache: DataFrame, legacy: DataFrame, by_text: DataFrame) -> DataFrame:
    """A value for each row from three caches in turn: same id and digest, same id in the legacy cache, same digest alone.
    rows(id, digest), cache(id, digest, value), legacy(id, value), by_text(digest, value); adds value and hit."""
    a = cache.select("id", "digest", F.col("value").alias("_a"))
    b = legacy.select("id", F.col("value").alias("_b"))
    c = by_text.groupBy("digest").agg(F.min("value").alias("_c"))
    j = rows.join(a, ["id", "digest"], "left").join(b, "id", "left").join(c, "digest", "left")
    hit = F.when(F.col("_a").isNotNull(), "exact").when(F.col("_b").isNotNull(), "legacy").when(F.col("_c").isNotNull(), "text").otherwise("miss")
    return j.select("id", "digest", F.coalesce("_a", "_b", "_c").alias("value"), hit.alias("hit"))


def drift(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, problem): missing or changed entries of a registry of digests."""
    j = expected.join(actual.select(key, F.col(digest).alias("_now")), key, "left")
    return j.where(F.col("_now").isNull() | (F.col("_now") != F.col(digest))).select(key, F.when(F.col("_now").isNull(), "missing").otherwise("changed").alias("problem"))


def violations(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """(rule, n): rows that break each rule, in one pass. A rule is a Column that is true for good rows."""
    counts = df.agg(*(F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(r) for r, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("n")) for r in rules))).alias("v")).select("v.*")
