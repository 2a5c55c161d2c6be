"""What the corpus operators share: text batches, word hashes, block exchange, shared scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Words kept in a worker's table of word codes; the table starts anew beyond it, so its memory is bounded.
WORD_TABLE = 400_000
#: UTF-8 bytes of text handled at once in a worker (one longer document is handled alone).
SLICE_BYTES = 4 << 20


class Scratch:
    """Intermediate tables as Parquet in the folder that the cluster shares.

    The folder is spark.checkpoint.dir; where that is unset, as in tests, a folder in the warehouse.
    A table outlives lost executors and cuts the lineage. drop() removes one that is no longer read, close() the
    folder; it is called when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        self.spark, self.dir = spark, f"{base.rstrip('/')}/sondera-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            self.drop("")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session is set for its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of input that a task of a grouped step is meant for.
PIECE_BYTES = 32 << 20


def pieces(df: DataFrame) -> int:
    """Groups to deal the rows of a stored table in: the session's shuffle partitions, more if the table's files say so. It
    only sizes work; results don't depend on it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = tasks(df.sparkSession)
    return max(n, min(-(-size // PIECE_BYTES), 4096 * n))


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """df dealt by a key over n partitions, if that is more than the session's; the grouping that follows keeps it."""
    return df.repartition(n, key) if n > tasks(df.sparkSession) else df


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most `limit` bytes of text, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


class WordHash(dict):
    """64-bit hash of a word, as a signed integer, computed once for each word in the table."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self) > WORD_TABLE:
            self.clear()
        return out


class WordCode(dict):
    """Small integers for the words met since the last reset, with the words behind them."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def reset(self) -> None:
        self.clear()
        self.words = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True) if x.dtype != np.uint64 else x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the rolling word-sequence hash.
ROLL = 0x9E3779B97F4A7C15


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n consecutive word hashes; position i holds the run that starts at i."""
    h = mix(h.view(np.uint64))
    if len(h) < n:
        return np.empty(0, np.uint64)
    acc, have, done, block, width = None, 0, n, h, 1
    while done:  # binary doubling: log2(n) vector steps instead of n
        if done & 1:
            if acc is None:
                acc, have = block, width
            else:
                m = len(h) - have - width + 1
                acc = acc[:m] * np.uint64(pow(ROLL, width, 1 << 64)) + block[have : have + m]
                have += width
        done >>= 1
        if done:
            m = len(h) - 2 * width + 1
            if m <= 0:
                break
            block = block[:m] * np.uint64(pow(ROLL, width, 1 << 64)) + block[width : width + m]
            width *= 2
    return mix(acc[: len(h) - n + 1])


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def rows(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the undirected edges a-b (in memory, for one block)."""
    root = np.arange(n)
    while len(a):
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = lo < hi
        a, b, lo, hi = a[live], b[live], lo[live], hi[live]
        if not len(a):
            break
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    return root


#: Edges that a task reduces to a forest at once (16 bytes each).
FOREST_EDGES = 1 << 20


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges (a, b) with the same components: each node of a stretch of edges with the smallest that it reaches there."""
    held: list[pa.RecordBatch] = []

    def reduced() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b"))
        ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = components(inv[: len(a)], inv[len(a) :], len(ids))
        other = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[root[other]])], ["a", "b"])

    for x in batches:
        held.append(x)
        if sum(y.num_rows for y in held) >= FOREST_EDGES:
            held = [reduced()]
            if held[0].num_rows >= FOREST_EDGES // 2:
                yield held.pop()
    if held:
        yield reduced()


def connected(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Connected components of edges(a, b) over distributed rows: (node, component), component the smallest node.

    Each task first reduces its edges to a forest. Then alternating large-star and small-star steps: each is a grouped
    minimum, so hot nodes are pre-aggregated and no component is gathered in one place; they stop when a round changes
    nothing. Nodes without an edge to another are missing.
    """
    from pyspark.sql import functions as F

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select("a", "b").union(e.select(e.b.alias("a"), e.a.alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        j = e.join(low, "a")
        out = j.where(F.col("b") > F.col("a")) if large else j
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def marked(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(forest, "a long, b long").distinct()
    e, k = scratch.cut(e, f"{tag}-0"), 0
    mark = marked(e)
    while mark[0]:
        k += 1
        e = scratch.cut(star(star(e, True), False), f"{tag}-{k}")
        now = marked(e)
        scratch.drop(f"{tag}-{k - 1}")
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def identity(df: DataFrame, *cols: str) -> list:
    """Two 64-bit hashes that tell rows of different values in the columns apart (nulls count as values)."""
    from pyspark.sql import functions as F

    parts = [x for c in cols or df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


#: Documents of a block: ids that share doc_id div BLOCK. Blocks are what the key exchange answers to.
BLOCK = 512


def block_of(doc_id):
    from pyspark.sql import functions as F

    return F.coalesce(F.floor(doc_id / BLOCK), F.lit(-1)).cast("long")


def place(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and the 32-bit key in it, of 64-bit hashes."""
    return (h >> np.uint64(32)) % np.uint64(buckets), h.astype(np.uint32)


class KeyRows:
    """Rows for repeated_keys(): a row for each bucket holds the keys of several blocks, block by block."""

    SCHEMA = pa.schema([("bucket", pa.int32()), ("ks", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
    DDL = "bucket int, ks binary, sizes binary, keys binary, counts binary"

    def __init__(self, buckets: int):
        self.buckets = buckets

    def rows(self, blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """blocks: (block, its distinct hashes, how often it holds each)."""
        k = np.repeat(np.array([x[0] for x in blocks], np.int64), [len(x[1]) for x in blocks])
        b, key = place(np.concatenate([np.empty(0, np.uint64), *(x[1] for x in blocks)]), self.buckets)
        times = np.concatenate([np.empty(0, np.int64), *(x[2] for x in blocks)])
        times = times.astype(np.uint8 if times.max(initial=0) < 256 else np.uint32)
        order = np.lexsort((k, b))
        b, k, key, times = b[order], k[order], key[order], times[order]
        out: dict[str, list] = {c: [] for c in self.SCHEMA.names}
        for x, y in runs(b):
            at = list(runs(k[x:y]))
            for c, v in zip(out, (int(b[x]), blob(k[x:y][[i for i, _ in at]]), blob(np.array([j - i for i, j in at], np.uint32)), blob(key[x:y]), blob(times[x:y])), strict=True):
                out[c].append(v)
        return rows(self.SCHEMA, **out)


def repeated_keys(sent: DataFrame, n: int = 0) -> DataFrame:
    """(k, bucket, keys, level): of the keys that each block sent, those that all blocks together hold twice or more.

    level is the rounded-down binary logarithm of the total. A key comes once from each block and task at most, however
    often the block holds it, so a key that a third of all documents share is pre-aggregated. A bucket answers
    each block in one row, wherever the block's documents were read. n: partitions, if more than the session's.
    """
    schema = pa.schema([("k", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("level", pa.binary())])

    def join(column: pa.ChunkedArray, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()])

    def count(t: pa.Table) -> pa.Table:
        k = np.repeat(join(t.column("ks"), np.int64), join(t.column("sizes"), np.uint32))
        key = join(t.column("keys"), np.uint32)
        _, inv = np.unique(key, return_inverse=True)
        wide = [len(c) > len(x) // 4 for c, x in zip(t.column("counts").to_pylist(), t.column("keys").to_pylist(), strict=True)]  # four bytes a count, or one
        times = np.concatenate([np.frombuffer(c, np.uint32 if w else np.uint8).astype(np.int64) for c, w in zip(t.column("counts").to_pylist(), wide, strict=True)])
        total = np.bincount(inv, times)[inv].astype(np.int64)
        hit = np.flatnonzero(total > 1)
        hit = hit[np.argsort(k[hit], kind="stable")]
        k, key, level = k[hit], key[hit], np.minimum(np.frexp(total[hit])[1] - 1, 60).astype(np.uint8)
        at, bucket = list(runs(k)), t.column("bucket")[0].as_py()
        return pa.Table.from_batches([rows(schema, k=[int(k[x]) for x, _ in at], bucket=[bucket] * len(at), keys=[blob(key[x:y]) for x, y in at], level=[blob(level[x:y]) for x, y in at])], schema)

    return dealt(sent, n, "bucket").groupBy("bucket").applyInArrow(count, "k long, bucket int, keys binary, level binary")


class Repeated:
    """The answer of repeated_keys() to one block: level of each hash (0: it is alone)."""

    def __init__(self, flags: pa.Table, buckets: int):
        self.buckets = buckets
        key = [np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, x in zip(flags.column("bucket").to_pylist(), flags.column("keys").to_pylist(), strict=True)]
        lev = [np.frombuffer(x, np.uint8) for x in flags.column("level").to_pylist()]
        self.key = np.concatenate(key) if key else np.empty(0, np.uint64)
        self.lev = np.concatenate(lev) if lev else np.empty(0, np.uint8)
        order = np.argsort(self.key, kind="stable")
        self.key, self.lev = self.key[order], self.lev[order]

    def levels(self, h: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(h), np.uint8)
        b, key = place(h, self.buckets)
        want = (b << np.uint64(32)) | key
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.lev[at], 0).astype(np.uint8)


def runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of the runs of equal values."""
    if len(x):
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        yield from zip(at, [*at[1:], len(x)], strict=True)
