"""The corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm import jaccard, langid, linededup, mixing, packing
from sondera.llm.common import Scratch, identity


# What holds for every stage: a stage works on rows, never on ids alone, so rows that share a doc_id, and rows of a null
# doc_id, are documents of their own; an empty table gives an empty table; other columns come through unchanged,
# but for names that begin with two underscores, which are reserved.


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those of no text, without letters or of no known language go. Repeated rows are
    judged alike; nothing is learned from a null lang, and then all documents go if no language is known."""
    return langid.keep_identified(docs, langid.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; n_chars follows. A document that loses its last word so goes.
    Rows equal in doc_id and text are one document here, so they keep or lose the same lines; a null text stays."""
    out = linededup.dedup_lines(docs, Scratch(spark)).where((F.col("__ld_removed") == 0) | F.col("text").rlike(linededup.WORD))
    return out.withColumn("n_chars", F.when(F.col("__ld_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) one row stays: that of the smallest doc_id (nulls last; of rows
    that tie, the one of the smallest hash). Of rows equal in every column one stays. Rows without words have no near
    duplicates and stay."""
    a, b = identity(docs)
    d = docs.withColumns({"__dd_a": a, "__dd_b": b})
    found = jaccard.join(d.select("doc_id", "text", "__dd_a", "__dd_b"), Scratch(spark), carry=["__dd_a", "__dd_b"])
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__dd_a", "__dd_b"))
    groups = found.where("component IS NOT NULL").groupBy("component").agg(best.alias("x")).select("x.__dd_a", "x.__dd_b")
    stay = groups.union(found.where("component IS NULL").select("__dd_a", "__dd_b"))
    return d.join(stay, ["__dd_a", "__dd_b"], "left_semi").dropDuplicates(["__dd_a", "__dd_b"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row for each copy that it takes: none to two of a row. A null source is a source; rows without words are
    never taken; rows equal in every column are taken each for itself."""
    return mixing.mixed_documents(docs, Scratch(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token sequences, in the order in which the mix stored them, so that a shard's shuffle
    holds in the sequences; a null text is empty, repeated rows are packed each for itself."""
    return packing.pack(docs, as_stored=True)


STAGES = [("language ID", identify), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents), ("mixing", mix_sources), ("packing", pack)]
#: Stages learn, draw and tokenise; SQL can't express them (tests/llm compares them with brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all of documents."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, f"stage-{k}")
    return docs
