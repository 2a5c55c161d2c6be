"""A stored index of vectors in blocks by direction, exact search that passes over blocks by bound, late interaction on candidates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Derived
from .search import QUERY_BLOCK, ranked

#: Coarse directions: vectors drawn by hash, at most so many, whatever the size of the table.
DIRECTIONS = 256
#: Vectors of a block at most.
BLOCK = 512
#: Rounded scores may lie so far above an exact product, and products in doubles above their bounds.
SLACK = 1e-6

_BLOCKS = pa.schema([("cell", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64()), ("least", pa.float64()), ("most", pa.float64())])
_BLOCKS_DDL = "cell int, n int, ids binary, vectors binary, centre binary, radius double, least double, most double"


def _matrix(b: pa.RecordBatch, column: str = "v") -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@dataclass
class DenseIndex:
    """blocks: a row for up to BLOCK vectors of one coarse direction, with their ids, the unit centre, the cosine of the widest
    angle to it (radius) and the least and greatest norm. dim: length of the vectors (0: there are none)."""

    blocks: DataFrame
    dim: int

    @classmethod
    def build(cls, corpus: DataFrame, derived: Derived) -> DenseIndex:
        """Of corpus(doc_id long, v array of floats): null vectors are left out. Made once a session and source.

        Vectors go to their nearest coarse direction in the scan; a cell's vectors lie together, sorted by their angle to it,
        and a task cuts them in blocks as they stream by, so a hot cell is only more blocks. The directions are a bounded
        draw; they shape the blocks, never the results.
        """
        if not derived.known:
            x = corpus.select("doc_id", F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL")
            spark = corpus.sparkSession
            drawn = [r["v"] for r in x.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(DIRECTIONS).select("v").collect()]
            cells = spark.sparkContext.broadcast(_unit(np.array(drawn, np.float64)) if drawn else np.empty((0, 0)))

            def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        c = _unit(_matrix(b)) @ cells.value.T
                        at = c.argmax(1)
                        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c.max(1)), b.column("doc_id"), b.column("v")], names=["cell", "near", "doc_id", "v"])

            def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held: list[tuple[int, np.ndarray, np.ndarray]] = []

                def block() -> pa.RecordBatch:
                    ids, v = (np.concatenate([h[k] for h in held]) for k in (1, 2))
                    u, norm = _unit(v), np.linalg.norm(v, axis=1)
                    centre = _unit(u.sum(0))
                    radius = float((u @ centre).min()) if norm.min() > 0 and centre.any() else -1.0
                    cols = {"cell": held[0][0], "n": len(ids), "ids": ids.tobytes(), "vectors": v.tobytes(), "centre": centre.tobytes(), "radius": radius, "least": norm.min(), "most": norm.max()}
                    held.clear()
                    return pa.RecordBatch.from_arrays([pa.array([cols[f.name]], f.type) for f in _BLOCKS], schema=_BLOCKS)

                for b in batches:
                    if not b.num_rows:
                        continue
                    cell, ids, v, at = b.column("cell").to_numpy(), b.column("doc_id").to_numpy(), _matrix(b), 0
                    while at < len(cell):
                        have = sum(len(h[1]) for h in held)
                        if held and (held[0][0] != cell[at] or have == BLOCK):
                            yield block()
                            have = 0
                        to = min(at + BLOCK - have, int(np.searchsorted(cell, cell[at], "right")))
                        held.append((int(cell[at]), ids[at:to], v[at:to]))
                        at = to
                if held:
                    yield block()

            near = x.mapInArrow(assign, "cell int, near double, doc_id long, v array<double>")
            # a range of (cell, near) rather than a hash of cell: a cell of a third of all vectors spreads over tasks
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            near = near.repartitionByRange(n, "cell", "near", "doc_id").sortWithinPartitions("cell", "near", "doc_id")
            derived.write("blocks", near.mapInArrow(cut, _BLOCKS_DDL))
            derived.keep()
        blocks = derived.read("blocks")
        r = blocks.selectExpr("octet_length(centre) div 8 AS d").limit(1).collect()
        return cls(blocks, r[0]["d"] if r else 0)

    def members(self) -> DataFrame:
        """(doc_id, v) of what the index holds, unpacked."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, v in zip(b.column("ids").to_pylist(), b.column("vectors").to_pylist(), strict=True):
                    ids = np.frombuffer(ids, np.int64)
                    flat = pa.array(np.frombuffer(v, np.float64))
                    at = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (len(flat) // len(ids)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(at, flat)], names=["doc_id", "v"])

        return self.blocks.select("ids", "vectors").mapInArrow(run, "doc_id long, v array<double>")

    def manifest(self) -> DataFrame:
        """One row: vectors, length, least and greatest norm, vectors of norm 0."""
        return self.blocks.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_vectors"), F.lit(self.dim).cast("long").alias("dim"), F.round(F.min("least"), 6).alias("min_norm"), F.round(F.max("most"), 6).alias("max_norm"),
        )

    def misaligned(self, corpus: DataFrame) -> DataFrame:
        """(doc_id, in_corpus, in_index) of ids that corpus and index don't hold equally often."""
        both = corpus.where("v IS NOT NULL").select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("b")).union(self.members().select("doc_id", F.lit(0), F.lit(1)))
        return both.groupBy("doc_id").agg(F.sum("a").alias("in_corpus"), F.sum("b").alias("in_index")).where("in_corpus <> in_index")

    def search(self, queries: DataFrame, k: int | None, minimum: float = -1.0) -> DataFrame:
        """Exact top k (all where k is None) of queries(query_id long, v) by inner product, score >= minimum.

        A product is at most |q| times the block's greatest norm times the cosine of the angle between q and the centre,
        less the block's widest angle. A task takes its blocks in the order of their bounds and keeps for each query the k-th best
        score so far; what cannot reach it, or the minimum, is passed over unread by products. Queries go out in blocks.
        """
        if k is not None and k <= 0:
            raise ValueError("k must be positive")
        spark, schema = self.blocks.sparkSession, pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

        def hits(block: list) -> DataFrame:
            shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in block], np.int64), np.array([r["v"] for r in block], np.float64)))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, q = shared.value
                norm, u = np.linalg.norm(q, axis=1), _unit(q)
                best = np.full((len(ids), k), -np.inf) if k else None
                for b in batches:
                    if not b.num_rows:
                        continue
                    centre = np.stack([np.frombuffer(x, np.float64) for x in b.column("centre").to_pylist()])
                    cos, rad = np.clip(u @ centre.T, -1, 1), np.clip(b.column("radius").to_numpy(), -1, 1)
                    inside = cos >= rad
                    top = np.where(inside, 1.0, cos * rad + np.sqrt((1 - cos**2) * (1 - rad**2)))
                    bound = norm[:, None] * np.where(top > 0, b.column("most").to_numpy(), b.column("least").to_numpy()) * top + SLACK
                    out_q, out_d, out_s = [], [], []
                    for j in np.argsort(-bound.max(0)):
                        live = np.flatnonzero(bound[:, j] >= (np.maximum(best[:, 0], minimum) if k else minimum))
                        if not len(live):
                            continue
                        doc, v = np.frombuffer(b.column("ids")[j].as_py(), np.int64), np.frombuffer(b.column("vectors")[j].as_py(), np.float64)
                        s = np.round(q[live] @ v.reshape(len(doc), -1).T, 6)
                        r, c = np.nonzero(s >= (np.maximum(best[live, 0], minimum)[:, None] if k else minimum))
                        out_q.append(live[r])
                        out_d.append(doc[c])
                        out_s.append(s[r, c])
                        if k:
                            best[live] = np.sort(np.concatenate([best[live], np.partition(s, max(0, s.shape[1] - k), axis=1)[:, -k:]], 1), axis=1)[:, -k:]
                    if out_q:
                        at, d, s = (np.concatenate(x) for x in (out_q, out_d, out_s))
                        if k:  # what later blocks of the batch overtook goes
                            some = s >= best[at, 0]
                            at, d, s = at[some], d[some], s[some]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(d), pa.array(s)], schema=schema)

            return self.blocks.mapInArrow(run, "query_id long, doc_id long, score double")

        out, block = None, []
        for r in queries.select("query_id", "v").where("v IS NOT NULL").toLocalIterator():
            block.append(r)
            if len(block) == QUERY_BLOCK:
                out, block = hits(block) if out is None else out.union(hits(block)), []
        if block:
            out = hits(block) if out is None else out.union(hits(block))
        return ranked(spark.createDataFrame([], "query_id long, doc_id long, score double") if out is None else out, k)


def late_interaction(candidates: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of candidate pairs: the mean over the query's vectors of the greatest product with one of the
    document's. candidates(query_id, doc_id), query_vectors(query_id, pos, v), doc_vectors(doc_id, v).

    Only the candidates' vectors are joined: a document's vectors meet a pair one row each, products are reduced to their
    maximum before the shuffle by (pair, pos), and no pair beyond the first stage is ever formed. Pairs without vectors on
    a side have no row; repeated candidates count once.
    """
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("best", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = np.array([len(x) for x in b.column("qs")])
            q = np.array([x["v"] for y in b.column("qs").to_pylist() for x in y], np.float64)
            s = np.einsum("ij,ij->i", q, np.repeat(_matrix(b, "dv"), n, axis=0))
            pos = np.array([x["pos"] for y in b.column("qs").to_pylist() for x in y], np.int64)
            keys = [np.repeat(b.column(c).to_numpy(), n) for c in ("query_id", "doc_id")]
            order = np.lexsort((pos, keys[1], keys[0]))
            head = np.concatenate([[True], np.any([np.diff(x[order]) != 0 for x in (*keys, pos)], axis=0)]) if len(order) else np.empty(0, bool)
            start = np.flatnonzero(head)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[order][start]) for x in (*keys, pos)), pa.array(np.maximum.reduceat(s[order], start))], schema=schema)

    # a query's vectors are few (its tokens); a document's stay rows
    q = query_vectors.where("v IS NOT NULL").groupBy("query_id").agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("v").cast("array<double>").alias("v"))).alias("qs"))
    pairs = candidates.select("query_id", "doc_id").distinct()
    d = doc_vectors.where("v IS NOT NULL").select("doc_id", F.col("v").cast("array<double>").alias("dv"))
    j = d.join(pairs, "doc_id").join(q, "query_id").select("query_id", "doc_id", "dv", "qs")
    best = j.mapInArrow(run, "query_id long, doc_id long, pos long, best double").groupBy("query_id", "doc_id", "pos").agg(F.max("best").alias("best"))
    return best.groupBy("query_id", "doc_id").agg(F.round(F.avg("best"), 6).alias("score"))
