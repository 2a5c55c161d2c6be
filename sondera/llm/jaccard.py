"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's shingles are put in one global order: rare ones first (by the binary logarithm of their document
frequency, counted over all documents), then by hash. Two sets can only reach the similarity if they share a
shingle among their first n - ceil(t * n) + 1. Shingles that no other document holds have no partner, so only the
shared ones are posted. Pairs that pass the filters are verified once each on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK, KeyRows, Repeated, Scratch, WordHash, blob, block_of, connected, dealt, gram_hashes, pieces, repeated_keys, rows, runs, text_slices, texts_of

#: A posting list up to this length gives all its pairs at once; a longer one first pairs its documents with a leader.
SMALL = 6
#: Pairs of long lists that one task builds at once.
TILE = 1 << 20
#: Classes about, and shingles about, of a side of a tile in which links are counted; columns of its matrices at once.
SIDE, SIDE_SHINGLES, COLUMNS = 512, 1 << 19, 4096
_POST = np.dtype([("key", "<u8"), ("level", "u1"), ("d", "<i8"), ("n", "<u4"), ("p", "<u4"), ("alone", "<u4")])


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; a shorter text is one shingle."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(h, min(n, len(h))))


def sets_of(texts: list[bytes], words: WordHash, n: int) -> Iterator[np.ndarray]:
    for t in texts:
        yield shingles(words.of(t.lower().split()), n)


def need(nx: np.ndarray, ny: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Least overlap of sets of these sizes with den * overlap >= num * union."""
    num, den = t
    return -(-num * (nx + ny) // (den + num))


def prefix(n: int, t: tuple[int, int]) -> int:
    return n - -(-t[0] * n // t[1]) + 1


def blocks_sent(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Each block's distinct shingles with their document counts, for the frequency count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, send = WordHash(), KeyRows(buckets)
        for b in text_slices(batches):
            k, sets = b.column("k").to_numpy(), list(sets_of(texts_of(b), words, n))
            order = np.argsort(k, kind="stable").tolist()
            blocks = [(int(k[order[x]]), *np.unique(np.concatenate([sets[i] for i in order[x:y]]), return_counts=True)) for x, y in runs(k[order])]
            yield send.rows(blocks)

    return docs.mapInArrow(run, KeyRows.DDL)


_SETS = "doc_id long, n long, sig_a long, sig_b long, alone long, post binary, shingles binary"


def sets_table(docs: DataFrame, flags: DataFrame, n: int, t: tuple[int, int], buckets: int, carry: list[str]) -> DataFrame:
    """A row for each document: set size, 128-bit signature of the set, shingles that it holds alone, and, where its
    prefix has shared shingles, these as postings and the whole set; and the long columns `carry` of docs."""
    schema = pa.schema([*((c, pa.int64()) for c in carry), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("alone", pa.int64()), ("post", pa.binary()), ("shingles", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rep, words, out = Repeated(right, buckets), WordHash(), []
        for b in text_slices(left.to_batches()):
            kept = {c: b.column(c) for c in ("doc_id", *carry)}
            out_b: dict[str, list] = {f.name: [] for f in schema if f.name not in kept}
            for s in sets_of(texts_of(b), words, n):
                lev = rep.levels(s)
                order = np.argsort(lev, kind="stable")[: prefix(len(s), t)] if len(s) else np.empty(0, np.int64)
                order = order[np.argsort(lev[order], kind="stable")]
                alone = int((lev == 0).sum())
                shared = np.flatnonzero(lev[order] > 0)
                post = np.zeros(len(shared), _POST)
                post["key"], post["level"], post["n"], post["p"], post["alone"] = s[order[shared]], lev[order[shared]], len(s), shared, alone
                sig = (int(s.sum(dtype=np.uint64)), int((s * (s | np.uint64(1))).sum(dtype=np.uint64))) if len(s) else (0, 0)
                for name, x in zip(out_b, (len(s), *(x - (1 << 64) if x >> 63 else x for x in sig), alone, blob(post) if len(post) else None, blob(s) if len(post) else None), strict=True):
                    out_b[name].append(x)
            out.append(rows(schema, **kept, **out_b))
        return pa.Table.from_batches(out, schema)

    return docs.groupBy("k").cogroup(flags.groupBy("k")).applyInArrow(run, ", ".join([*(f"{c} long" for c in carry), _SETS]))


def postings(sets: DataFrame, buckets: int) -> DataFrame:
    """(bucket, post): the postings by bucket of their shingle, in large rows."""
    schema = pa.schema([("bucket", pa.int32()), ("post", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "post"):
            parts = [np.frombuffer(x, _POST).copy() for x in b.column("post").to_pylist()]
            for d, x in zip(b.column("doc_id").to_pylist(), parts, strict=True):
                x["d"] = d
            p = np.concatenate(parts)
            at = (p["key"] >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            p, at = p[order], at[order]
            cut = list(runs(at))
            yield rows(schema, bucket=[int(at[x]) for x, _ in cut], post=[p[x:y].tobytes() for x, y in cut])

    return sets.select("doc_id", "post").mapInArrow(run, "bucket int, post binary")


def lists(t: pa.Table) -> Iterator[np.ndarray]:
    """Posting lists of two documents or more, each by size, then id."""
    p = np.concatenate([np.frombuffer(x, _POST) for x in t.column("post").to_pylist()])
    p = p[np.lexsort((p["d"], p["n"], p["key"]))]
    for x, y in runs(p["key"]):
        if y - x > 1:
            yield p[x:y]


def passes(a: np.ndarray, b: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Length and positional filters for pairs of postings of one shingle."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    left = np.minimum(na - np.maximum(a["p"], a["alone"]), nb - np.maximum(b["p"], b["alone"]))  # tokens from here on that can be shared
    return (t[1] * np.minimum(na, nb) >= t[0] * np.maximum(na, nb)) & (np.minimum(left, np.minimum(na, nb)) >= need(na, nb, t)) & (a["d"] != b["d"])


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pair_table(found: list[np.ndarray]) -> pa.Table:
    u = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    return pa.Table.from_batches([rows(_PAIR, a=u[:, 0], b=u[:, 1])], _PAIR)


def first_pairs(t: tuple[int, int]):
    """All pairs of a short list; in a long one each document with its leader, the one that holds fewest shingles alone."""

    def run(table: pa.Table) -> pa.Table:
        found = []
        for p in lists(table):
            if len(p) <= SMALL:
                i, j = np.triu_indices(len(p), 1)
            else:
                j = np.arange(len(p))
                i = np.empty(len(p), np.int64)
                at = 0
                while at < len(p):  # a stretch of sizes that one leader can reach
                    to = int(np.searchsorted(p["n"], p["n"][at] * t[1] // t[0], "right"))
                    i[at:to] = at + np.lexsort((p["d"][at:to], p["alone"][at:to]))[0]
                    at = to
            ok = passes(p[i], p[j], t)
            if ok.any():
                found.append(np.sort(np.stack([p["d"][i[ok]], p["d"][j[ok]]], 1), axis=1))
        return pair_table(found)

    return run


def rest_pairs(t: tuple[int, int]):
    """Pairs of long lists whose documents aren't connected yet, from rows (key, d, n, p, alone, component)."""

    def run(table: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        c = {f: table.column(f).to_numpy() for f in ("key", "d", "n", "p", "alone", "component")}
        order = np.lexsort((c["d"], c["n"], c["key"]))
        c = {f: x[order] for f, x in c.items()}
        for x, y in runs(c["key"]):
            comp = c["component"][x:y]
            if (comp == comp[0]).all():
                continue
            p = np.zeros(y - x, _POST)
            for f in ("d", "n", "p", "alone"):
                p[f] = c[f][x:y]
            _, size = np.unique(comp, return_counts=True)
            reach = np.searchsorted(p["n"], p["n"].astype(np.int64) * t[1] // t[0], "right")
            i = 0
            while i < len(p):  # tiles of pairs (i, j > i) within reach by length
                total = np.cumsum(reach[i:] - np.arange(i + 1, len(p) + 1))
                k = i + max(1, int(np.searchsorted(total, TILE, "right")))
                width = reach[i:k] - np.arange(i + 1, k + 1)
                a = np.repeat(np.arange(i, k), width)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)
                ok = comp[a] != comp[b]
                a, b = a[ok], b[ok]
                ok = passes(p[a], p[b], t)
                if ok.any():
                    found.append(np.sort(np.stack([p["d"][a[ok]], p["d"][b[ok]]], 1), axis=1))
                i = k
        return pair_table(found)

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Upper bound of the overlap: both sets are split by the same pivots, and parts share no more than the smaller has."""
    pivots = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    a, b = np.diff(np.searchsorted(x, pivots), prepend=0, append=len(x)), np.diff(np.searchsorted(y, pivots), prepend=0, append=len(y))
    return int(np.minimum(a, b).sum())


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def verified(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "sb"):
            ok = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                least = need(len(x), len(y), t)
                ok.append(suffix_bound(x, y) >= least and overlap(x, y) >= least)
            yield rows(schema, a=b.column("a").filter(pa.array(ok)), b=b.column("b").filter(pa.array(ok)))

    s = sets.select(F.col("doc_id").alias("_d"), "shingles")
    p = pairs.join(s.withColumnsRenamed({"_d": "b", "shingles": "sb"}), "b").join(s.withColumnsRenamed({"_d": "a", "shingles": "sa"}), "a")
    return p.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def overlaps(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the overlaps of all sets of x with all of y (with those of x itself where y is missing)."""
    kx, rx = np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])
    if y is None:
        u, c = np.unique(kx, return_counts=True)
        ky, ry, ny, common = kx, rx, len(x), u[c > 1]
    else:
        ky, ry, ny = np.concatenate(y), np.repeat(np.arange(len(y)), [len(s) for s in y]), len(y)
        common = np.intersect1d(kx, ky)
    out = np.zeros((len(x), ny), np.int64)
    if not len(common):
        return out

    def by_column(k: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, k), len(common) - 1)
        hit = common[at] == k
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], r[hit][order]

    cx, rx = by_column(kx, rx)
    cy, ry = (cx, rx) if y is None else by_column(ky, ry)
    for s in range(0, len(common), COLUMNS):
        w = min(COLUMNS, len(common) - s)
        sides = []
        for c, r, m in ((cx, rx, len(x)), (cy, ry, ny))[: 1 if y is None else 2]:
            i, j = np.searchsorted(c, [s, s + w])
            a = np.zeros((m, w), np.float32)  # sums up to COLUMNS are exact
            a[r[i:j], c[i:j] - s] = 1
            sides.append(a)
        out += (sides[0] @ sides[-1].T).astype(np.int64)
    return out


_COUNT = pa.schema([("node", pa.int64()), ("n", pa.int64())])


def count_tile(t: tuple[int, int]):
    """Links between the two parts of a component that meet in a tile, from rows (lo, hi, part, node, mult, shingles)."""

    def run(table: pa.Table) -> pa.Table:
        part, node, mult = (table.column(c).to_numpy() for c in ("part", "node", "mult"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        a, b = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        n = np.zeros(len(node), np.int64)
        if len(a) and len(b):
            size = np.array([len(s) for s in sets], np.int64)
            k = overlaps([sets[i] for i in a], None if lo == hi else [sets[i] for i in b])
            link = k >= need(size[a][:, None], size[b][None, :], t)
            if lo == hi:
                np.fill_diagonal(link, False)
            else:
                n[b] = mult[a] @ link
            n[a] = link @ mult[b]
        out = np.flatnonzero(n)
        return pa.Table.from_batches([rows(_COUNT, node=node[out], n=n[out])], _COUNT)

    return run


def link_counts(found: DataFrame, comp: DataFrame, classes: DataFrame, reps: DataFrame, scratch: Scratch, t: tuple[int, int], side: int) -> DataFrame:
    """(node, n): documents of other classes that a class links with.

    All links lie within components. A component whose pairs of classes are all among the links found has no more to
    verify. In the others each pair of classes is verified in a tile of two parts of the component; pairs never are rows.
    """
    c = comp.where("node <> component").select("node", "component")
    member = c.union(c.select(F.col("component").alias("node"), "component").distinct())
    member = scratch.cut(member.join(classes.select("node", "n", "mult"), "node"), "members")
    have = found.join(member.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.count("*").alias("have"))
    size = member.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("words"), F.sum("mult").alias("total")).join(have, "component")
    size = scratch.cut(size.withColumn("all", 2 * F.col("have") == F.col("k") * (F.col("k") - 1)), "component-sizes")
    known = member.join(size.where("all").select("component", "total"), "component").select("node", (F.col("total") - F.col("mult")).alias("n"))
    parts = F.greatest(F.ceil(F.col("k") / side), F.ceil(F.col("words") / SIDE_SHINGLES)).cast("long")
    rest = member.select("node", "component", "mult").join(size.where("NOT all").select("component", parts.alias("parts")), "component")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("node"), "parts")).join(reps.select(F.col("doc_id").alias("node"), "shingles"), "node")
    rest = rest.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rest = rest.select("component", F.least("part", "_o").alias("lo"), F.greatest("part", "_o").alias("hi"), "part", "node", "mult", "shingles")
    tiles = rest.groupBy("component", "lo", "hi").applyInArrow(count_tile(t), "node long, n long")
    return scratch.cut(known.union(tiles.groupBy("node").agg(F.sum("n").alias("n"))), "link-counts")


def join(docs: DataFrame, scratch: Scratch, n: int = 5, t: tuple[int, int] = (80, 100), links: bool = False, side: int = SIDE, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links where links are asked for, and the long columns `carry` with `component`:
    a row for each row of docs(doc_id, text).

    Documents link if den * overlap >= num * union of their sets of n-word shingles (A-Z lower-cased); component_id is
    the smallest doc_id reachable by links. Equal sets (by a signature of 128 bits) are one class, and only classes are
    joined; `component` is a number that tells components apart (null without words). n_links is the number of other
    documents that a document links with, all pairs verified. A text without words has an empty set and links with
    nothing. Rows that share a doc_id are documents of their own; a null doc_id is never the smallest (a component of
    nulls alone has a null). Empty tables give no rows; other columns, whatever their names, are not read.
    """
    spark, carry = docs.sparkSession, carry or []
    p = pieces(docs)
    buckets = 4 * p
    d = docs.select("doc_id", "text", *carry, block_of(F.col("doc_id")).alias("k"))
    flags = repeated_keys(blocks_sent(d.select("text", "k"), n, buckets), p)
    table = scratch.cut(sets_table(d, flags, n, t, buckets, carry), "sets")
    sig = ["sig_a", "sig_b", "n"]
    classes = table.where("n > 0").groupBy(*sig).agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.first("post", True).alias("post"), F.first("shingles", True).alias("shingles"))
    classes = scratch.cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so a class keeps its number
    reps = classes.where("post IS NOT NULL").select(F.col("node").alias("doc_id"), "post", "shingles")
    posts = dealt(scratch.cut(postings(reps, buckets), "postings"), p, "bucket")
    pairs = posts.groupBy("bucket").applyInArrow(first_pairs(t), "a long, b long").distinct()
    pairs = scratch.cut(pairs, "pairs")
    found = scratch.cut(verified(pairs, reps, t), "links")
    comp = connected(spark, found, scratch, "first")
    long = posts.groupBy("bucket").applyInArrow(long_lists, "bucket int, key long, d long, n long, p long, alone long")
    long = long.join(comp.withColumnsRenamed({"node": "d", "component": "_c"}), "d", "left").withColumn("component", F.coalesce("_c", "d")).drop("_c")
    rest = long.groupBy("bucket").applyInArrow(rest_pairs(t), "a long, b long").distinct()
    rest = rest.join(pairs, ["a", "b"], "left_anti")
    more = scratch.cut(verified(rest, reps, t), "more-links")
    if not more.isEmpty():
        found = found.union(more)
        comp = connected(spark, found, scratch, "last")
    scratch.drop("pairs", "postings")
    named = classes.select("node", "rep", "mult", *sig).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    more_cols = []
    if links:
        counts = link_counts(found, comp, classes, reps, scratch, t, side).withColumnRenamed("n", "_links")
        named = named.join(counts, "node", "left").withColumn("n_links", F.coalesce("_links", F.lit(0)) + F.col("mult") - 1)
        more_cols = ["n_links"]
    named = named.join(low, "component").select(*(F.col(c).alias(f"_{c}") for c in sig), "component_id", "component", *more_cols)
    out = table.select("doc_id", *carry, *sig).join(named, [F.col(c) == F.col(f"_{c}") for c in sig], "left")
    more_cols = [F.coalesce(c, F.lit(0)).alias(c) for c in more_cols] + ([*carry, "component"] if carry else [])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more_cols)


def long_lists(t: pa.Table) -> pa.Table:
    """Rows of the posting lists that are longer than SMALL."""
    names = ("key", "d", "n", "p", "alone")
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.int64()) for c in names)])
    found = [p for p in lists(t) if len(p) > SMALL]
    p = np.concatenate(found) if found else np.zeros(0, _POST)
    bucket = t.column("bucket")[0].as_py()
    return pa.Table.from_batches([rows(schema, bucket=np.full(len(p), bucket, np.int32), **{c: p[c].astype(np.uint64).view(np.int64) for c in names})], schema)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), 4, (85, 100), links=True)
