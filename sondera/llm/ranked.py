"""Ranked lexical search over inverted treaps.

Each part of the documents has, for each term that a query holds, a treap of its postings: a search tree by document and a
heap by impact, so the root of a subtree has the highest impact of all its documents. A query goes through its terms'
treaps at once, by intervals of documents: the roots of an interval bound every score in it, so an interval whose
summed maxima cannot enter the best k is left alone with all its subtrees; any other is split at the document of its
highest root. Impacts are exact integers of corpus-wide counts, so parts are searched apart and only their best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, blob, rows, text_slices, texts_of

#: Queries that are searched together: so many, or of so many bytes of text. Further ones are searched in further rounds.
QUERIES, QUERY_BYTES = 1024, 4 << 20
#: Bytes of text in a part.
PART_BYTES = 16 << 20
#: Roots of intervals that are handled at once.
CELLS = 1 << 20
#: Levels of each treap that are looked at for a first score to reach.
DEPTH = 3
#: Letters of either case, and the signs that part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all signs beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split(b" ") if b"\0" in text else text.translate(_FOLD).split()


_PARTS = pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("df", pa.binary()), ("at", pa.binary()), ("tf", pa.binary())])
_PARTS_DDL = "part long, n_docs long, n_terms long, docs array<long>, sizes binary, df binary, at binary, tf binary"


def parts(docs: DataFrame, wanted: list[bytes]) -> DataFrame:
    """Postings of the wanted terms by parts of the documents: documents in order of id, their numbers of terms, and for each
    term its df documents (places in the part, ascending) with their occurrences."""

    code = {t: k for k, t in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        size: list[int] = []
        found: list[np.ndarray] = []
        counted: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, size, found, counted, held
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
            n = np.array([len(found[k]) for k in order], np.int64)
            doc = np.repeat(np.arange(len(order), dtype=np.uint32), n)
            term, tf = np.concatenate([found[k] for k in order]), np.concatenate([counted[k] for k in order])
            by = np.argsort(term, kind="stable")
            out = rows(
                _PARTS, part=[0], n_docs=[sum(s > 0 for s in size)], n_terms=[sum(size)], docs=[[ids[k] for k in order]], sizes=[blob(np.array([size[k] for k in order], np.int64))],
                df=[blob(np.bincount(term, minlength=len(wanted)).astype(np.int64))], at=[blob(doc[by])], tf=[blob(tf[by].astype(np.uint32))],
            )
            ids, size, found, counted, held = [], [], [], [], 0
            return out

        get = code.get
        for b in text_slices(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
                words = [w for w in terms(t) if w]
                t_, c = np.unique(np.array([k for k in map(get, words) if k is not None], np.int32), return_counts=True)
                ids.append(i)
                size.append(len(words))
                found.append(t_)
                counted.append(c)
                held += len(t)
                if held >= PART_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _PARTS_DDL)


class Treaps:
    """Treaps of a part, all in the same arrays: postings of a term lie together, in order of documents. A node is a posting;
    left and right are its children (-1: none), of smaller and larger documents and of impacts that are not higher."""

    def __init__(self, start: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        self.doc, self.impact, self.n_docs = doc, impact, n_docs
        self.base = np.repeat(np.arange(len(start) - 1) * n_docs, np.diff(start))
        self.key = self.base + doc  # ascending: a term's posting of a document is found by it
        root, height = np.full(len(start) - 1, -1, np.int32), impact.tolist()
        left, right = [-1] * len(doc), [-1] * len(doc)
        for t, (a, z) in enumerate(zip(start[:-1].tolist(), start[1:].tolist(), strict=True)):
            spine: list[int] = []  # from the root along right children
            for k in range(a, z):
                last, h = -1, height[k]
                while spine and height[spine[-1]] < h:
                    last = spine.pop()
                left[k] = last
                if spine:
                    right[spine[-1]] = k
                spine.append(k)
            if spine:
                root[t] = spine[0]
        self.left, self.right, self.root = np.array(left, np.int32), np.array(right, np.int32), root

    def impacts(self, key: np.ndarray) -> np.ndarray:
        """Impacts of (term, document) keys, 0 where there is no posting."""
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.impact[at], 0)

    def reached(self, term: np.ndarray, k: int) -> int:
        """A score that k documents reach, 0 if fewer are seen: those at the tops of the query's treaps."""
        top = self.root[term]
        seen = [top]
        for _ in range(DEPTH):
            top = np.concatenate([self.left[top], self.right[top]])
            top = top[top >= 0]
            seen.append(top)
        docs = np.unique(self.doc[np.concatenate(seen)])
        if len(docs) < k:
            return 0
        scores = self.impacts(term[:, None] * self.n_docs + docs).sum(0)
        return int(np.partition(scores, len(scores) - k)[len(scores) - k])

    def search(self, term: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all of the part that may be among the best k, given that `least` is known to be reached by k
        documents elsewhere (0: not known). Ties at the border are all returned.

        A cell is the root of a term's postings in an interval; the cells of an interval lie together.
        """
        docs = scores = np.empty(0, np.int64)
        term = term[self.root[term] >= 0]
        if not len(term):
            return docs, scores
        least = max(least, self.reached(term, k), 1)
        todo = [(self.root[term].astype(np.int64), np.array([0]), np.array([0]), np.array([self.n_docs]))]  # nodes, begins of intervals in them, borders
        while todo:
            node, begin, low, high = todo.pop()
            height, size = self.impact[node], np.diff(np.append(begin, len(node)))
            bound = np.add.reduceat(height, begin)
            if not (live := bound >= least).all():
                cell = np.repeat(live, size)
                node, height, low, high, bound, size = node[cell], height[cell], low[live], high[live], bound[live], size[live]
                if not len(node):
                    continue
                begin = np.cumsum(size) - size
            if len(node) > CELLS and len(low) > 1:  # intervals of high bounds first: they raise what the others must reach
                high_bound = bound > np.median(bound)
                half = high_bound if high_bound.any() else np.arange(len(low)) < len(low) // 2
                for part in (~half, half):
                    cell, n = np.repeat(part, size), size[part]
                    todo.append((node[cell], np.cumsum(n) - n, low[part], high[part]))
                continue
            of = np.repeat(np.arange(len(low)), size)
            tops = np.flatnonzero(height == np.maximum.reduceat(height, begin)[of])
            at = self.doc[node[tops[np.searchsorted(of[tops], np.arange(len(low)))]]]
            exact = np.add.reduceat(self.impacts(self.base[node] + at[of]), begin)
            good = exact >= least
            docs, scores = np.concatenate([docs, at[good]]), np.concatenate([scores, exact[good]])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= least
                docs, scores = docs[keep], scores[keep]
            node, of = np.concatenate([node, node]), np.concatenate([of, of + len(low)])
            low, high = np.concatenate([low, at + 1]), np.concatenate([at, high])
            moving = np.arange(len(node))
            while len(moving):  # down to the root of what lies within the interval's borders
                x = node[moving]
                d, i = self.doc[x], of[moving]
                under, over = d < low[i], d >= high[i]
                out = under | over
                moving = moving[out]
                node[moving] = np.where(under[out], self.right[x[out]], self.left[x[out]])
                moving = moving[node[moving] >= 0]
            some = node >= 0
            node, of = node[some], of[some]
            if len(node):
                have, begin = np.unique(of, return_index=True)
                todo.append((node, begin, low[have], high[have]))
        return docs, scores


_HITS = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("score", pa.int64())])


def _round(queries: list[list[bytes]], docs: DataFrame, scratch: Scratch, k: int, tag: str) -> DataFrame:
    """(query, doc_id, score, rank) for queries given as their distinct terms."""
    spark = docs.sparkSession
    wanted = sorted({t for q in queries for t in q})
    place = {t: i for i, t in enumerate(wanted)}
    asked = [np.array([place[t] for t in q], np.int64) for q in queries]
    stored = scratch.cut(parts(docs, wanted), tag)
    counts = stored.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = int(counts["n"]), int(counts["l"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's document frequencies, so that one row for a term leaves it."""
        df = np.zeros(len(wanted), np.int64)
        for b in batches:
            for x in b.column("df").to_pylist():
                df += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df), dtype=np.int32)), pa.array(df)], ["term", "df"])

    df = np.zeros(len(wanted), np.int64)  # one number for a term of the queries
    for r in stored.select("df").mapInArrow(totals, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 4 for _ in asked]  # score, is null, id, place
        number = 0
        for b in batches:
            for r in range(b.num_rows):
                ids = b.column("docs")[r].as_py()
                size, own, doc, tf = (np.frombuffer(b.column(c)[r].as_py(), t) for c, t in (("sizes", np.int64), ("df", np.int64), ("at", np.uint32), ("tf", np.uint32)))
                m = 100 - 50 + (50 * size * n_docs) // max(n_terms, 1)
                tf = tf.astype(np.int64)
                impact = np.repeat(weight, own) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                t = Treaps(np.concatenate([[0], np.cumsum(own)]), doc.astype(np.int64), impact, len(ids))
                null = np.array([i is None for i in ids], np.int64)
                ident = np.array([i or 0 for i in ids], np.int64)
                for q, term in enumerate(asked):
                    old = best[q]
                    d, s = t.search(term, k, int(old[0][k - 1]) if len(old[0]) >= k else 0)
                    if len(d):
                        new = tuple(np.concatenate(x) for x in zip(old, (s, null[d], ident[d], number + d), strict=True))
                        order = np.lexsort((new[3], new[2], new[1], -new[0]))[:k]
                        best[q] = tuple(x[order] for x in new)
                number += len(ids)
        n = [len(x[0]) for x in best]
        if sum(n):
            s, null, ident, at = (np.concatenate(x) for x in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), pa.array(ident, mask=null.astype(bool)), pa.array(at), pa.array(s)], schema=_HITS)

    hits = stored.mapInArrow(run, "query int, doc_id long, place long, score long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "place")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "doc_id", "score", "rank")


def search(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents of the highest scores above 0, ties by doc_id, nulls last.

    Rows are documents, and items, each for itself, also if they repeat or share an id; null texts have no terms, and such
    items no hits; other columns are left aside; empty tables give no rows. Items are read in blocks of bounded number and
    size; each block is a round over all documents. A text is counted whole, however long. A part is searched where it was
    written; of each task at most k hits an item are shuffled.
    """
    spark = docs.sparkSession
    rounds: list[tuple[list[int], list[list[bytes]]]] = []
    room = held = 0
    for r in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        text = bytes(r["text"] or b"")
        if not rounds or room == 0 or held + len(text) > QUERY_BYTES:
            rounds.append(([], []))
            room, held = QUERIES, 0
        room, held = room - 1, held + len(text)
        rounds[-1][0].append(r["item_id"])
        rounds[-1][1].append(sorted({w for w in terms(text) if w}))
    out = None
    for n, (ids, queries) in enumerate(rounds):
        names = spark.createDataFrame(list(enumerate(ids)), "query int, item_id long")
        got = _round(queries, docs, scratch, k, f"ranked-{n}").join(F.broadcast(names), "query")
        got = got.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        if n < len(rounds) - 1:  # a round's parts go when its hits are stored
            got = scratch.cut(got, f"hits-{n}")
            scratch.drop(f"ranked-{n}")
        out = got if out is None else out.union(got)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w
  FROM documents),
q AS (
  SELECT row_number() OVER () q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) w
  FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
p AS (SELECT r, doc_id, t, count(*) tf, any_value(size) size FROM (SELECT r, doc_id, len(w) size, unnest(w) t FROM d) GROUP BY r, doc_id, t),
f AS (SELECT t, count(*) df FROM p GROUP BY t),
s AS (
  SELECT q.q, q.item_id, p.r, p.doc_id,
    sum(floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * size * n) // l))))::BIGINT score
  FROM (SELECT q, item_id, unnest(w) t FROM q) q JOIN p ON p.t = q.t JOIN f ON f.t = q.t CROSS JOIN c
  GROUP BY q.q, q.item_id, p.r, p.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER rank, doc_id, score FROM k WHERE rank <= 50
"""
