"""Embedding near-dedup by collision counting on one-dimensional projections.

Unit vectors are projected on orthonormal directions. Two vectors collide in a projection if one lies in the window
centred on the other. A pair is a candidate if it collides in all windows of one of a few groups of projections, and
is verified if it collides in a recall-calibrated number of all of them. The projections of a group are sorted and
cut at medians, one after the other, so that a query meets only the stretches that its windows reach. A crowd that no
cut can part is dealt in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log2
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, connected, identity, rows

COSINE = 0.95
#: Half-width of a window, in standard deviations of the projected difference of a pair at the least cosine.
WIDTH = 2.5
#: Steps of a quantised projection in such a deviation; projections are bytes about 128.
STEP = 10
#: Groups of projections, projections in a group at most, projections that are counted.
GROUPS, GROUP, COUNTED = 4, 16, 64
#: Vectors of fewer dimensions have one group, with windows that no linked pair leaves.
FEW = 48
#: Chance at most that a pair at the least cosine fails the count.
MISS = 1e-4
#: Vectors of a cell about, and of a leaf within it; pairs that are compared at once.
CELL, LEAF, TILE = 8192, 48, 1 << 21
#: A cell of more than twice CELL home vectors, or so many times CELL queries, is dealt in tiles.
CROWD = 8
#: Cells to be dealt in tiles that are broadcast at most (32 bytes each); more are joined.
TILED = 200_000


@lru_cache
def plan(dim: int, cosine: float = COSINE) -> tuple[np.ndarray, int, list[list[int]], int]:
    """(directions scaled to quantisation steps, window in steps, groups of projections, least count) for vectors of a dimension.

    With few dimensions there is one group, whose windows are as wide as the distance of a pair can be.
    """
    q, _ = np.linalg.qr(np.random.default_rng([7, dim]).standard_normal((dim, dim)))
    far = (2 - 2 * cosine) ** 0.5
    m = min(dim, COUNTED)
    scale = STEP * dim**0.5 / far
    if dim < FEW:
        wide = ceil(STEP * dim**0.5) + 1
        if wide > 100:
            scale, wide = scale * 100 / wide, 101
        return q[:m].T * scale, wide, [list(range(min(m, GROUP)))], m
    p = 2 * NormalDist().cdf(WIDTH) - 1
    least, tail = m, 0.0
    while least and (tail := tail + comb(m, least) * p**least * (1 - p) ** (m - least)) < 1 - MISS:
        least -= 1
    return q[:m].T * scale, ceil(WIDTH * STEP) + 1, [list(range(g * (m // GROUPS), g * (m // GROUPS) + min(GROUP, m // GROUPS))) for g in range(GROUPS)], least


def project(x: np.ndarray, dim: int, cosine: float = COSINE) -> np.ndarray:
    """Quantised projections of unit vectors."""
    return np.clip(np.rint(x @ plan(dim, cosine)[0]) + 128, 0, 255).astype(np.uint8)


def unit(b: pa.RecordBatch, dim: int) -> np.ndarray:
    x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def close(a: np.ndarray, b: np.ndarray, w: int) -> np.ndarray:
    """Whether quantised projections collide (bytes may wrap for the farthest, which verification sorts out)."""
    return (a + np.uint8(w)) - b <= np.uint8(2 * w)


def medians(classes: DataFrame, cosine: float = COSINE) -> dict[int, np.ndarray]:
    """Median of each projection by dimension, from histograms of all vectors (256 bins a projection)."""
    schema = pa.schema([("dim", pa.int32()), ("p", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in by_dim(b):
                q = project(unit(part, dim), dim, cosine)
                total.setdefault(dim, np.zeros((q.shape[1], 256), np.int64))
                for i in range(q.shape[1]):
                    total[dim][i] += np.bincount(q[:, i], minlength=256)
        for dim, h in total.items():
            p, x = np.nonzero(h)
            yield rows(schema, dim=np.full(len(p), dim, np.int32), p=p.astype(np.int32), bin=x.astype(np.int32), n=h[p, x])

    h = classes.select("v").mapInArrow(run, "dim int, p int, bin int, n long").groupBy("dim", "p", "bin").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in h.collect():  # at most 64 * 256 counts for each dimension
        out.setdefault(r["dim"], {}).setdefault(r["p"], np.zeros(256, np.int64))[r["bin"]] = r["n"]
    return {d: np.array([np.searchsorted(np.cumsum(x[i]), x[i].sum() / 2) for i in sorted(x)]) for d, x in out.items()}


def by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    import pyarrow.compute as pc

    n = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False) if b.num_rows else np.empty(0, int)
    for dim in np.unique(n):
        yield int(dim), b.filter(pa.array(n == dim)) if (n != dim).any() else b


def cells(classes: DataFrame, cuts: int, mid: dict[int, np.ndarray], cosine: float = COSINE, vectors: bool = True) -> DataFrame:
    """Each vector in its home cell of each group, and as a query in the cells that its windows reach. The first `cuts`
    projections of a group are cut at their medians; a cell is the pattern of sides. Without vectors: the home
    vectors and queries of each cell."""
    kind = classes.schema["v"].dataType.elementType.simpleString()
    value = pa.float32() if kind == "float" else pa.float64()
    schema = pa.schema([("dim", pa.int32()), ("grp", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_()), ("node", pa.int64()), ("mult", pa.int64()), ("v", pa.list_(value))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                for dim, b in by_dim(whole.slice(at, 1024)):
                    _, w, groups, _ = plan(dim, cosine)
                    q = project(unit(b, dim), dim, cosine).astype(np.int64)
                    for g, dims in enumerate(groups):
                        who, cell, home = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), np.ones(b.num_rows, bool)
                        for i in dims[:cuts]:
                            x, t = q[who, i], int(mid[dim][i])
                            right = x > t
                            low, high = x <= t + w, x > t - w
                            who, cell, home = (np.concatenate([a[low], c[high]]) for a, c in ((who, who), (2 * cell, 2 * cell + 1), (home & ~right, home & right)))
                        if vectors:
                            part = b.take(pa.array(who))
                            yield rows(schema, dim=np.full(len(who), dim, np.int32), grp=np.full(len(who), g, np.int32), cell=cell, home=home, node=part.column("node"), mult=part.column("mult"), v=part.column("v").cast(pa.list_(value)))
                        else:
                            c, inv = np.unique(cell, return_inverse=True)
                            yield rows(counted, dim=np.full(len(c), dim, np.int32), grp=np.full(len(c), g, np.int32), cell=c, homes=np.bincount(inv, home).astype(np.int64), queries=np.bincount(inv))

    counted = pa.schema([("dim", pa.int32()), ("grp", pa.int32()), ("cell", pa.int64()), ("homes", pa.int64()), ("queries", pa.int64())])
    if vectors:
        return classes.select("node", "mult", "v").mapInArrow(run, f"dim int, grp int, cell long, home boolean, node long, mult long, v array<{kind}>")
    n = classes.select("v").mapInArrow(run, "dim int, grp int, cell long, homes long, queries long")
    return n.groupBy("dim", "grp", "cell").agg(F.sum("homes").alias("homes"), F.sum("queries").alias("queries"))


def tiles(placed: DataFrame, counts: DataFrame, cell: int, scratch: Scratch) -> DataFrame:
    """Adds h, q, query: a cell with a crowd is dealt in tiles of home vectors (h) by queries (q), so that no task holds it
    whole; each home vector meets each query in one tile. Other cells are one tile."""
    full = (F.col("homes") > 2 * cell) | (F.col("queries") > CROWD * cell)
    big = counts.where(full).select("dim", "grp", "cell", F.greatest(F.lit(1), F.ceil(F.col("homes") / cell)).cast("int").alias("hp"), F.ceil(F.col("queries") / (CROWD * cell // 2)).cast("int").alias("qp"))
    big = scratch.cut(big, "crowds")
    p = placed.join(F.broadcast(big) if big.count() <= TILED else big, ["dim", "grp", "cell"], "left").na.fill(1, ["hp", "qp"])
    p = p.withColumns({"_h": F.pmod(F.xxhash64("node"), "hp").cast("int"), "_q": F.pmod(F.xxhash64("node", F.lit(1)), "qp").cast("int")})
    as_home = F.transform(F.sequence(F.lit(0), F.col("qp") - 1), lambda q: F.struct(F.col("_h").alias("h"), q.alias("q")))
    as_query = F.transform(F.sequence(F.lit(0), F.col("hp") - 1), lambda h: F.struct(h.alias("h"), F.col("_q").alias("q")))
    at = F.when((F.col("hp") == 1) & (F.col("qp") == 1), F.array(F.struct(F.lit(0).alias("h"), F.lit(0).alias("q")))).when(F.col("home"), F.array_union(as_home, as_query)).otherwise(as_query)
    p = p.withColumn("_t", F.explode(at))
    return p.select("dim", "grp", "cell", "_t.h", "_t.q", (F.col("home") & (F.col("_h") == F.col("_t.h"))).alias("home"), (F.col("_q") == F.col("_t.q")).alias("query"), "node", "mult", "v")


def leaves(q: np.ndarray, home: np.ndarray, every: np.ndarray, dims: list[int], w: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(home, queries) of each leaf: the homes are cut at the median of one projection after the other, and queries
    follow into each part that their window reaches."""
    stack = [(home, every, dims)]
    while stack:
        h, v, d = stack.pop()
        if len(h) <= LEAF or not d:
            yield h, v
            continue
        x = q[h, d[0]]
        t = int(np.median(x))
        if (x <= t).all():
            t -= 1
        left = x <= t
        if not left.any():
            stack.append((h, v, d[1:]))
            continue
        y = q[v, d[0]]
        stack.append((h[left], v[y <= t + w], d[1:]))
        stack.append((h[~left], v[y > t - w], d[1:]))


_FOUND = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def count_cell(cosine: float, cuts: int):
    def run(t: pa.Table) -> pa.Table:
        dim, g = t.column("dim")[0].as_py(), t.column("grp")[0].as_py()
        b = t.combine_chunks().to_batches()[0]
        x = unit(b, dim)
        q = project(x, dim, cosine)
        _, w, groups, least = plan(dim, cosine)
        wide = q.astype(np.int64)
        home = np.flatnonzero(b.column("home").to_numpy(zero_copy_only=False))
        query = np.flatnonzero(b.column("query").to_numpy(zero_copy_only=False))
        mult, node = b.column("mult").to_numpy(), b.column("node").to_numpy()
        links, ea, eb = np.zeros(len(x), np.int64), [], []
        for h, v in leaves(wide, home, query, groups[g][cuts:], w):
            step = max(1, TILE // max(1, len(v)))
            for k in range(0, len(h), step):
                hh = h[k : k + step]
                ok = None
                for i in groups[g][::-1][:6]:  # those that no cut has used come first
                    c = close(q[hh, i][:, None], q[v, i][None, :], w)
                    ok = c if ok is None else ok & c
                a, z = np.nonzero(ok)
                a, z = hh[a], v[z]
                keep = a != z
                a, z = a[keep], z[keep]
                for i in groups[g][::-1][6:]:
                    keep = close(q[a, i], q[z, i], w)
                    a, z = a[keep], z[keep]
                for earlier in groups[:g]:  # a pair counts in the first group that finds it
                    keep = np.zeros(len(a), bool)
                    for i in earlier:
                        keep |= ~close(q[a, i], q[z, i], w)
                    a, z = a[keep], z[keep]
                for s in range(0, len(a), 1 << 16):
                    aa, zz = a[s : s + (1 << 16)], z[s : s + (1 << 16)]
                    keep = close(q[aa], q[zz], w).sum(1) >= least
                    aa, zz = aa[keep], zz[keep]
                    keep = np.einsum("ij,ij->i", x[aa], x[zz]) >= cosine
                    aa, zz = aa[keep], zz[keep]
                    np.add.at(links, aa, mult[zz])
                    if len(aa):  # what connects, not all pairs
                        ids, inv = np.unique(np.concatenate([aa, zz]), return_inverse=True)
                        root = components(inv[: len(aa)], inv[len(aa) :], len(ids))
                        ea.append(ids[root != np.arange(len(ids))]), eb.append(ids[root[root != np.arange(len(ids))]])
        root = components(np.concatenate(ea), np.concatenate(eb), len(x)) if ea else np.arange(len(x))
        out = np.flatnonzero((links > 0) | (root != np.arange(len(x))))
        return pa.Table.from_batches([rows(_FOUND, node=node[out], n=links[out], root=node[root[out]])], _FOUND)

    return run


def dedup_embeddings(emb: DataFrame, scratch: Scratch, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of emb(vec_id, embedding).

    Equal vectors (by 128 bits of hash) are one class, compared once and counted as many. Links are verified in double precision; none
    is below `cosine`. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different dimensions. Rows that share a vec_id are vectors of their own. An
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    v = emb.select("vec_id", F.col("embedding").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    key = ["_a", "_b"]
    v = v.select("vec_id", "v", *(F.when(fine, h).alias(k) for k, h in zip(key, identity(v, "v"), strict=True)))
    classes = v.where("_a IS NOT NULL").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("v").alias("v"))
    classes = scratch.cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so a class keeps its number
    cuts = min(GROUP, max(0, ceil(log2(max(1, classes.count()) / cell))))
    mid = medians(classes, cosine)
    placed = tiles(cells(classes, cuts, mid, cosine), cells(classes, cuts, mid, cosine, vectors=False), cell, scratch)
    found = placed.groupBy("dim", "grp", "cell", "h", "q").applyInArrow(count_cell(cosine, cuts), "node long, n long, root long")
    found = scratch.cut(found, "found")
    comp = connected(emb.sparkSession, found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "links")
    n = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.select("node", "rep", "mult", *key).join(n, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("rep").alias("low"))
    named = named.join(low, "component").select(*(F.col(k).alias(f"_{k}") for k in key), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "low")
    out = v.select("vec_id", *key).join(named, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))
