"""Retrieval evaluation: gold evidence, ranking metrics, evidence sets, grids, paired comparison, agreement."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Passages whose automaton is held by each task at once.
PASSAGES = 100_000


def gold_by_containment(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents that contain a passage, by an automaton of the passages. Beyond PASSAGES of them each block of
    passages is a pass over the texts of its own."""
    import ahocorasick

    spark, schema = docs.sparkSession, pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64())])

    def found_in(by_text: dict[str, list[int]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(by_text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = ahocorasick.Automaton()
            for text, ids in shared.value.items():
                a.add_word(text, ids)
            a.make_automaton()
            for b in batches:
                found = [(q, d) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if t and len(a) for q in sorted({i for _, ids in a.iter(t) for i in ids})]
                q, d = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(q), pa.int64()), pa.array(list(d), pa.int64())], schema=schema)

        return docs.select("doc_id", "text").mapInArrow(run, "query_id long, doc_id long")

    parts: list[DataFrame] = []
    by_text: dict[str, list[int]] = {}
    for r in passages.select("query_id", "text").where("length(text) > 0").toLocalIterator():
        if r["text"] not in by_text and len(by_text) == PASSAGES:
            parts.append(found_in(by_text))
            by_text = {}
        by_text.setdefault(r["text"], []).append(r["query_id"])
    parts.append(found_in(by_text))
    if len(parts) == 1:
        return parts[0]
    return functools.reduce(DataFrame.union, parts).distinct()  # a question with passages in two blocks


def per_query(hits: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """For each query with gold: gold documents, first relevant rank, reciprocal rank, hit and recall at each cut-off."""
    g = gold.select("query_id", "doc_id").distinct()
    j = g.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    cols = [F.count("*").alias("n_gold"), F.min("rank").alias("first_rank"), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 9).alias("rr")]
    for k in cutoffs:
        got = F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))
        cols += [(got > 0).cast("long").alias(f"hit_{k}"), F.round(got / F.count("*"), 9).alias(f"recall_{k}")]
    return j.groupBy("query_id").agg(*cols)


def summary(per: DataFrame) -> DataFrame:
    """Macro means of the metrics of per_query()."""
    metrics = [c for c in per.columns if c.startswith(("rr", "hit_", "recall_"))]
    return per.agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in metrics))


def union_recall(long: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Recall of all retrievers' first k together: what a perfect fusion could reach."""
    seen = long.where(F.col("rank") <= k).select("query_id", "doc_id").distinct().withColumn("seen", F.lit(1))
    j = gold.select("query_id", "doc_id").distinct().join(seen, ["query_id", "doc_id"], "left")
    return j.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.count("seen").alias("n_seen"), F.round(F.count("seen") / F.count("*"), 9).alias("recall"))


def evidence_rank(sets: DataFrame, hits: DataFrame) -> DataFrame:
    """Best rank at which a set of evidence is complete: the least over sets of the greatest over groups of the least over
    documents. sets(query_id, set_id, group_id, doc_id); a set with a group that isn't found is not complete."""
    j = sets.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    g = j.groupBy("query_id", "set_id", "group_id").agg(F.min("rank").alias("r"))
    s = g.groupBy("query_id", "set_id").agg(F.when(F.count("r") == F.count("*"), F.max("r")).alias("r"), F.count("*").alias("n_groups"), F.count("r").alias("n_found"))
    return s.groupBy("query_id").agg(F.min("r").alias("best_rank"), F.round(F.max(F.col("n_found") / F.col("n_groups")), 9).alias("coverage"))


def failure_class(baseline: Column, window: Column, final: Column, top: int) -> Column:
    """Where a gold document is lost: not retrieved, outside the candidate window, dropped by ranking, or kept."""
    return F.when(baseline.isNull(), "not_retrieved").when(window.isNull(), "outside_window").when(final.isNull() | (final > top), "dropped").otherwise("kept")


def outcome(before: Column, after: Column) -> Column:
    """improved, regressed or unchanged, by a metric where more is better."""
    return F.when(after > before, "improved").when(after < before, "regressed").otherwise("unchanged")


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Mean difference b - a over common queries, and wins, ties and losses of b."""
    j = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id")
    d = F.col("y") - F.col("x")
    return j.agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_diff"), F.count(F.when(d > 0, 1)).alias("wins"), F.count(F.when(d == 0, 1)).alias("ties"), F.count(F.when(d < 0, 1)).alias("losses"))


def bootstrap(a: DataFrame, b: DataFrame, metric: str, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """95 % interval of the mean difference by a paired bootstrap over queries (a bounded table of one number a query)."""
    j = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id").select((F.col("y") - F.col("x")).alias("d"), F.lit(0).alias("_one"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        d, rng = np.sort(p["d"].to_numpy(float)), np.random.default_rng(seed)
        means = np.sort([rng.choice(d, len(d)).mean() for _ in range(draws)])
        return pd.DataFrame({"low": [means[int(draws * 0.025) - 1]], "high": [means[int(draws * 0.975) - 1]]})

    return j.groupBy("_one").applyInPandas(run, "low double, high double")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds no: 0, 1, ... in the order of the MD5 of the key, then the key; no task sees all rows."""
    h = F.md5(F.col(key).cast("string"))
    df = df.withColumns({"_h": h, "_b": F.substring(h, 1, 2)})
    before = df.groupBy("_b").agg(F.count("*").alias("_n"))  # 256 rows at most
    before = before.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return df.withColumn("no", own - 1).join(before, "_b").withColumn("no", (F.col("no") + F.col("_before")).cast("long")).drop("_h", "_b", "_before")


def bootstrap_interval(a: DataFrame, b: DataFrame, metric: str, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """(n, low, high): 95 % interval of the mean difference by a paired bootstrap over queries.

    Position p of draw r takes the question numbered by a hash of (seed, r, p), so any engine repeats the draws and any task
    can make its part of them; differences are summed as integers of 1e-9, draw by draw. No questions give no row; null metrics
    are left out.
    """
    j = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id").where("x IS NOT NULL AND y IS NOT NULL")
    d = numbered(j.select("query_id", F.round((F.col("y") - F.col("x")) * 1e9).cast("long").alias("d")), "query_id").select("no", "d")
    n = d.count()
    spark = d.sparkSession
    if not n:
        return spark.createDataFrame([], "n long, low double, high double")
    of = lambda *x: F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(y).cast("string") if isinstance(y, str) else y for y in x))), 1, 8), 16, 10).cast("long")
    drawn = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    drawn = drawn.select("draw", (of(F.lit(str(seed)), "draw", "pos") % n).alias("no"))
    means = drawn.join(d, "no").groupBy("draw").agg(F.sum("d").alias("s"))
    order = F.row_number().over(Window.orderBy("s", "draw"))  # a row for a draw
    at = means.withColumn("k", order).where(F.col("k").isin(int(draws * 0.025), int(draws * 0.975)))
    mean = lambda f: F.round(f("s") / F.lit(n) / 1e9, 6)
    return at.agg(F.lit(n).cast("long").alias("n"), mean(F.min).alias("low"), mean(F.max).alias("high"))


def pearson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Pearson correlation, null with fewer than two pairs or no variance."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    ok = df.where(a.isNotNull() & b.isNotNull())
    m = ok.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"))
    va, vb = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa"), F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    return m.select(*by, "n", F.when((F.col("n") >= 2) & (va > 0) & (vb > 0), F.round((F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb), 6)).alias("r"))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of labels."""
    return df.groupBy(F.col(a).cast("long").alias("label_a"), F.col(b).cast("long").alias("label_b")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of equal labels, and of labels one apart at most."""
    d = F.abs(F.col(a) - F.col(b))
    return df.agg(F.count("*").alias("n"), F.round(F.avg(F.when(d == 0, 1.0).otherwise(0.0)), 6).alias("exact"), F.round(F.avg(F.when(d <= 1, 1.0).otherwise(0.0)), 6).alias("within_one"))


def histogram(df: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """Cumulative bucket counts in one pass: (by, le, n)."""
    counts = [F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)]
    h = df.groupBy(*by).agg(*counts)
    return h.select(*by, F.explode(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))).alias("h")).select(*by, "h.le", "h.n")


def blind_order(pool: DataFrame, version: str) -> DataFrame:
    """Display order of a query's pool by a hash, so that judges can't tell systems by position."""
    h = F.sha2(F.concat_ws("|", F.lit(version), F.col("query_id").cast("string"), F.col("doc_id").cast("string")), 256)
    return pool.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(h)).cast("long"))


def pool(long: DataFrame, depth: int) -> DataFrame:
    """Annotation pool: documents in the first `depth` of any retriever, with the retrievers that found them."""
    p = long.where(F.col("rank") <= depth).groupBy("query_id", "doc_id")
    return p.agg(F.count("*").alias("n_systems"), F.min("rank").alias("best_rank"), F.array_join(F.sort_array(F.collect_set("retriever")), ",").alias("systems"))
