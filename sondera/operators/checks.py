"""Checks and assembly around chunks and pages: neighbours, extraction quality, catalogues, resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What marks a candidate as navigation or reference matter.
LOW_VALUE = ["table of contents", "list of figures", "list of tables", "bibliography", "references", "index"]
#: Words of an energy balance, and of a species balance.
ENERGY = ["energy", "heat", "enthalpy", "energie", "énergie", "thermique", "chaleur"]
SPECIES = ["species", "component", "constituent", "espèce", "espece", "composant", "constituant"]
FORMULA = r"\b[a-z]{1,3}\d+(?:[a-z]\d*)+\b"
#: Units of measurement.
UNIT_NAMES = r"(%|°c|k|pa|kpa|mpa|bar|mbar|torr|kg/s|kg/h|t/h|m3/h|m/s|kw|mw|w|kj/kg|kj/mol|j/mol|kg/m3)"
UNITS = UNIT_NAMES + r"(?:[^\p{L}\p{N}_]|$)"
#: Pages sampled of a file; visible characters from which shares are judged; least share of letters; least words.
SAMPLED, JUDGED, LETTERS, WORDS = 12, 500, 0.15, 10


def any_of(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def balance_kind(c: Column) -> Column:
    """energy, species or overall_mass, in this order, by words and by a chemical formula."""
    t = F.translate(F.lower(c), "₂₅", "25")
    return F.when(any_of(t, ENERGY), "energy").when(any_of(t, SPECIES) | t.rlike(FORMULA), "species").otherwise("overall_mass")


def neighbours(df: DataFrame, doc: str, at: str, same: list[str], window: int) -> DataFrame:
    """Adds `neighbours`: the sorted places of the chunks before and behind a chunk, at most `window` each way, up to the first
    that differs from it in one of the columns `same` (nulls are alike)."""
    w = Window.partitionBy(doc).orderBy(at)
    key = F.struct(*same)
    found = []
    for side in (F.lag, F.lead):
        reach = F.lit(True)
        for k in range(1, window + 1):
            place = side(at, k).over(w)
            reach = reach & place.isNotNull() & side(key, k).over(w).eqNullSafe(key)
            found.append(F.when(reach, place))
    return df.withColumn("neighbours", F.array_sort(F.array_compact(F.array(*found))))


def sample_positions(n: Column, most: int = SAMPLED) -> Column:
    """Evenly spread places, 0 to n - 1, at most so many (a half is rounded to the even neighbour)."""
    s = F.least(F.lit(most).cast("long"), n)
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), s - 1), lambda i: F.bround(i * (n - 1) / F.greatest(F.lit(1), s - 1), 0).cast("long")))


def text_layer(sampled: Column) -> Column:
    """Whether the sampled text of a file can be used: ok, no_text or unusable."""
    visible, letters = F.regexp_count(sampled, F.lit(r"\S")), F.regexp_count(sampled, F.lit(r"\p{L}"))
    words = F.regexp_count(sampled, F.lit(r"\p{L}{3,}"))
    poor = (visible >= JUDGED) & ((letters / visible < LETTERS) | (words < WORDS))
    return F.when(letters == 0, "no_text").when(poor, "unusable").otherwise("ok")


def verified(catalog: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Status of each catalogue row (key, sha256, n_pages) against the files (key, sha256, n_pages): missing, changed,
    page_count or ok."""
    f = files.select(key, F.col("sha256").alias("_sha"), F.col("n_pages").alias("_n"))
    status = F.when(F.col("_sha").isNull(), "missing").when(F.col("_sha") != F.col("sha256"), "changed").when(F.col("_n") != F.col("n_pages"), "page_count").otherwise("ok")
    return catalog.join(f, key, "left").select(key, status.alias("status"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both tables; where a key is in both, the new values, or the old ones where the new are null."""
    o = old.select(key, *(F.col(c).alias(f"_{c}") for c in old.columns if c != key))
    return new.join(o, key, "full").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in new.columns if c != key))


def renamed(old: DataFrame, new: DataFrame, n: int = 12) -> DataFrame:
    """Files of new(name, sha256) whose content an old file of another name has: name, source (the first such), and the id
    that its chunks get, from the new name."""
    source = old.groupBy("sha256").agg(F.min("name").alias("source"), F.collect_set("name").alias("_names"))
    j = new.join(source, "sha256").where(~F.array_contains("_names", F.col("name")))
    return j.select("name", "source", F.substring(F.sha2("name", 256), 1, n).alias("file_id"))


def section_texts(children: DataFrame, section: str, at: str, preferred: Column, budget: int) -> DataFrame:
    """A text for each section: its first child, the preferred ones, its last, then the rest, each in order, as many as fit in
    the budget of tokens (a quarter of the characters each). children(section, at, text)."""
    w = Window.partitionBy(section)
    first, last = F.min(at).over(w) == F.col(at), F.max(at).over(w) == F.col(at)
    c = children.withColumn("_t", F.when(first, 0).when(preferred, 1).when(last, 2).otherwise(3))
    tokens = F.ceil(F.length("text") / 4)
    c = c.withColumn("_upto", F.sum(tokens).over(w.orderBy("_t", at)))
    kept = F.array_sort(F.collect_list(F.struct("_t", at, "text")))
    return c.where(F.col("_upto") <= budget).groupBy(section).agg(F.count("*").alias("n"), F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text"))


def reranked(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank before) in the order of score, rank before and id: adds position, k at most."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "doc_id")
    return hits.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= k)
