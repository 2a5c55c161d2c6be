"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks. Block quotas follow from the targets, exactly. A binary tree over
the output shards splits the quotas: at each node the left half's share of every source's blocks is one
multivariate-hypergeometric draw. Leaves hold exact block counts, filled with disjoint blocks of each source's
permutation, and each shard is shuffled locally.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, identity, rows, tasks, text_slices, texts_of

#: Weights, dealt to the sources in code point order (null last), repeating; the mix's size, and the most of a source.
WEIGHTS, TOTAL, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
SEED = 20240229
#: Documents in a block about, and most blocks of a source (beyond, blocks grow).
BLOCK_DOCS, MOST_BLOCKS = 64, 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0), id_a and id_b (identity of the row), row_key: a row for each
    row of docs. Rows alike in every column share an identity and are told apart by row_key, a hash of identity and number."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("id_a", pa.int64()), ("id_b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            yield rows(schema, size=[len(t.split()) for t in texts_of(b)], **{c: b.column(c) for c in ("doc_id", "source", "id_a", "id_b")})

    a, b = identity(docs)
    out = docs.select("doc_id", "source", a.alias("id_a"), b.alias("id_b"), "text").mapInArrow(run, "doc_id long, source string, size long, id_a long, id_b long")
    out = out.groupBy(*out.columns).agg(F.count("*").alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return out.withColumn("row_key", F.concat(F.hex(F.xxhash64("id_a", "id_b", "_k")), F.hex(F.xxhash64("id_b", "id_a", "_k")))).drop("_n", "_k")


def water_fill(size: np.ndarray, weight: np.ndarray, total: float = TOTAL, most: float = MOST) -> np.ndarray:
    """Targets in proportion to weight that add up to total * sum(size), none above most * size: the excess of
    sources at their most is dealt to the others by weight, until none is above."""
    size = size.astype(float)
    left, out, free = total * size.sum(), np.zeros(len(size)), np.ones(len(size), bool)
    while free.any():
        out[free] = left * weight[free] / weight[free].sum()
        over = free & (out > most * size)
        if not over.any():
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        free &= ~over
    return out


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, n_docs, source_size, target: a row for each source. A mix is made of sources that can be listed; the list is
    fitted in one task."""
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))

    def fill(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("source", key=lambda s: s.map(lambda x: (1, b"") if x is None else (0, x.encode())), kind="stable")
        w = np.resize(np.array(weights, float), len(p))
        return p.assign(target=water_fill(p["source_size"].to_numpy(), w, total, most))[["source", "n_docs", "source_size", "target"]]

    return per.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(fill, "source string, n_docs long, source_size long, target double")


def walk(quota: np.ndarray, shards: int, color: np.ndarray, ordinal: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Shard of each drawn block, given as (color, ordinal among its color's drawn blocks).

    The tree's root holds quota[c] blocks of each color. A node over s shards and n blocks sends
    n * (s // 2) // s blocks to its left half, a multivariate-hypergeometric draw seeded by the node's number; a
    block goes left if its ordinal is below its color's left count. Any task finds the same shards.
    """
    out = np.empty(len(color), np.int64)
    stack = [(1, 0, shards, quota.astype(np.int64), np.arange(len(color)), ordinal.astype(np.int64))]
    while stack:
        node, first, s, have, idx, o = stack.pop()
        if not len(idx):
            continue
        if s == 1:
            out[idx] = first
            continue
        half = s // 2
        n_left = int(have.sum()) * half // s
        left = draw(np.random.default_rng([seed, node]), have, n_left)
        go = o < left[color[idx]]
        stack.append((2 * node, first, half, left, idx[go], o[go]))
        stack.append((2 * node + 1, first + half, s - half, have - left, idx[~go], o[~go] - left[color[idx[~go]]]))
    return out


def draw(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """n blocks of the urn `have` without replacement, counted by color."""
    return rng.multivariate_hypergeometric(have, n, method="marginals") if n else np.zeros_like(have)


def mix(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, shards: int = 0, seed: int = SEED) -> DataFrame:
    """The mix, a row for each copy of a document in it: doc_id, row_key, source, size, source_size, target, block, epoch,
    shard, place. A shard's rows are in the order of place.

    sized: doc_id, source, size, and any row_key that tells rows apart. Copies come in epochs: an epoch takes a
    source's blocks in an order of its own, whole while the source's target allows, then of one block the
    documents that still fit, and the smallest left if that comes nearer. So a source's words miss its target by
    half of the smallest document left in that block at most, and a document is taken `most` times (rounded up) at most. A null source is a
    source; rows without words are never taken; an empty table gives an empty mix. Everything follows from the seed and row_key:
    reruns agree. The sources, their targets and the block counts of each are held in one place: sources can be listed.
    """
    spark, n_shards = sized.sparkSession, shards or tasks(sized.sparkSession)
    by = scratch.cut(targets(sized, weights, total, most), "targets")
    s = sized.join(by.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n_docs") / BLOCK_DOCS)))
    s = s.where("size > 0").withColumn("block", F.pmod(F.xxhash64("row_key", F.lit(seed)), n_blocks).cast("int"))
    blocks = scratch.cut(s.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size")), "blocks")
    epochs = int(np.ceil(most))
    b = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    # what the epoch may take of the source: all of it, until the target is met
    b = b.withColumn("want", F.least(F.greatest(F.col("target") - F.col("epoch") * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double")))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    b = b.withColumns({"ordinal": F.row_number().over(order) - 1, "_upto": F.sum("words").over(order)})
    b = b.where(F.col("_upto") - F.col("words") < F.col("want"))
    b = scratch.cut(b.withColumn("room", F.when(F.col("_upto") > F.col("want"), F.col("want") - (F.col("_upto") - F.col("words")))).select("source", "block", "epoch", "ordinal", "room"), "drawn")
    quota = b.groupBy("source", "epoch").agg(F.count("*").alias("n")).withColumn("color", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last(), "epoch")) - 1)
    quota = scratch.cut(quota, "quota")
    have = np.array([r["n"] for r in quota.orderBy("color").select("n").collect()], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = walk(have, n_shards, x.column("color").to_numpy(), x.column("ordinal").to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("source", "block", "epoch", "room")), pa.array(at)], ["source", "block", "epoch", "room", "shard"])

    q = quota.select(F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("color").cast("long"))
    b = b.withColumn("ordinal", F.col("ordinal").cast("long")).join(q, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e"))).drop("_s", "_e")
    b = scratch.cut(b.mapInArrow(place, "source string, block int, epoch int, room double, shard long"), "placed")
    drawn = b.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "epoch", "room", "shard")
    taken = s.join(drawn, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["_h", "row_key"], kind="stable")
        room, keep = float(p["room"].iloc[0]), []
        for size in p["size"]:
            keep.append(size <= room)
            room -= size if size <= room else 0
        keep = np.array(keep, bool)
        rest = np.where(keep, np.inf, p["size"].to_numpy(float))
        if len(rest) and room > rest.min() / 2:  # nearer with it than without
            keep[rest.argmin()] = True
        return p[keep]

    cols = ["doc_id", "row_key", "source", "size", "source_size", "target", "block", "epoch", "room", "shard"]
    part = taken.where("room IS NOT NULL").select(*cols, F.xxhash64("row_key", "epoch", F.lit(seed)).alias("_h"))
    part = part.groupBy("source", "epoch", "block").applyInPandas(fit, part.schema).select(cols)
    out = taken.where("room IS NULL").select(cols).unionByName(part)
    return out.withColumn("place", F.xxhash64("row_key", "epoch", "shard", F.lit(seed + 1))).drop("room")


def shuffled(mixed: DataFrame, n_shards: int, prefix: str = "") -> DataFrame:
    """The mix in its shards' order: one partition for each shard, shuffled by the seeded place."""
    shard, place, key, epoch = (f"{prefix}{c}" for c in ("shard", "place", "row_key", "epoch"))
    return mixed.repartition(n_shards, shard).sortWithinPartitions(shard, place, key, epoch)


def mixed_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs as the mix takes them: a row for each copy, in the order of the output shards.

    Columns are those of docs, other than __mx_a, __mx_b, __mx_epoch, __mx_shard, __mx_place and __mx_row_key, which are
    reserved. Rows are told apart by all their columns; rows alike in all are taken as often as there are rows.
    Null texts and texts without words are never taken; an empty table gives none.
    """
    n = tasks(docs.sparkSession)
    sized = scratch.cut(sizes(docs), "sizes")
    mixed = mix(sized, scratch, shards=n)
    copies = mixed.join(sized.select("row_key", F.col("id_a").alias("__mx_a"), F.col("id_b").alias("__mx_b")), "row_key")
    copies = copies.select("__mx_a", "__mx_b", *(F.col(c).alias(f"__mx_{c}") for c in ("epoch", "shard", "place", "row_key")))
    a, b = identity(docs)
    d = docs.withColumns({"__mx_a": a, "__mx_b": b}).dropDuplicates(["__mx_a", "__mx_b"])
    return shuffled(d.join(copies, ["__mx_a", "__mx_b"]), n, "__mx_").select(*(F.col(f"`{c}`") for c in docs.columns))


#: Output shards of the query's mix.
SHARDS = 64


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    sized = scratch.cut(sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    mixed = mix(sized, scratch, shards=SHARDS)
    at = F.transform(F.array_sort(F.collect_list(F.struct("epoch", "shard", "place"))), lambda x: F.concat_ws(":", x["shard"].cast("string"), x["place"].cast("string")))
    times = mixed.groupBy("row_key").agg(F.sum("size").alias("taken"), F.array_join(at, ",").alias("places"))
    by = scratch.spark.read.parquet(scratch.path("targets")).select(F.col("source").alias("_s"), "source_size", "target")
    out = sized.join(by, F.col("source").eqNullSafe(F.col("_s"))).join(times, "row_key", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source", F.coalesce("places", F.lit("")).alias("places"))
