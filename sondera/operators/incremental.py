"""An inverted index that follows its corpus: only new contents are tokenised, everything else is counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import VersionedTables
from .search import Index, bm25, counted, postings_of, query_terms, ranked, rows_of


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text; a null text has the empty digest."""
    return docs.select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"))


class IncrementalIndex:
    """A BM25 index in versions of linked tables.

    names(doc_id, digest) says which content each document has, and is replaced by each sync. postings are kept by
    content, written once however many documents share it, and only ever added to. frequencies(tok, df) and
    totals(n, with_text, tokens) are added to as signed differences, and sums of them are the corpus's. So a rename or a
    copy changes names alone, a removed document leaves postings that no name leads to, and no sync reads the texts of
    contents that are known. compact() rewrites what has piled up. A failed sync leaves readers on the version
    before; the store's rollback() goes back to any earlier one.
    """

    def __init__(self, store: VersionedTables):
        self.store = store

    def states(self, docs: DataFrame) -> DataFrame:
        """(doc_id, state) of a snapshot against the version that readers see: unchanged, modified, renamed (a new id
        whose content the index holds under some id), new or removed."""
        new, old = digests(docs), self._names()
        o = old.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        held = old.select("digest").distinct().withColumn("_held", F.lit(True))
        j = new.join(o, F.col("doc_id") == F.col("_id"), "full").join(held, "digest", "left")
        state = (
            F.when(F.col("doc_id").isNull(), "removed").when(F.col("digest") == F.col("_digest"), "unchanged").when(F.col("_id").isNotNull(), "modified")
            .when(F.col("_held"), "renamed").otherwise("new")
        )
        return j.select(F.coalesce("doc_id", "_id").alias("doc_id"), state.alias("state"))

    def _names(self) -> DataFrame:
        if self.store.version:
            return self.store.read("names")
        return self.store.spark.createDataFrame([], "doc_id long, digest string")

    def sync(self, docs: DataFrame, version: str) -> None:
        """Publish docs(doc_id, text), the whole corpus as it is now, as a version. Ids must be unique and not null. An
        empty corpus is one without hits; other columns are not read."""
        old = self._names()
        with self.store.change(version) as c:
            names = c.replace("names", digests(docs))
            n = names.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
            if n["n"] != n["d"]:
                raise ValueError("document ids must be unique and not null")
            before = old.groupBy("digest").agg(F.count("*").alias("_before"))
            now = names.groupBy("digest").agg(F.count("*").alias("_now"), F.min("doc_id").alias("doc_id"))
            j = now.join(before, "digest", "full").withColumn("more", F.coalesce("_now", F.lit(0)) - F.coalesce("_before", F.lit(0)))
            changes = c.replace("changes", j.where("more <> 0").select("digest", "doc_id", "more"))
            fresh = changes.where("more > 0 AND digest <> ''")
            if c.has("contents"):
                fresh = fresh.join(c.read("contents"), "digest", "left_anti")
            fresh = c.add("contents", fresh.select("digest", "doc_id"))
            texts = docs.select("doc_id", "text").join(fresh.join(changes.select("digest", "more"), "digest"), "doc_id")  # one document of each content
            held = c.read("postings").drop("more") if c.has("postings") else None
            new = c.add("postings", postings_of(counted(texts.select(F.col("digest").alias("doc_id"), "more", "text"), "more", deal=False), "more"))
            p = new.groupBy("tok").agg(F.sum("more").alias("df"), F.sum(F.col("more") * F.col("tf")).alias("tokens"))
            if held is not None:
                known = changes.join(fresh, "digest", "left_anti").select(F.col("digest").alias("doc_id"), "more")
                p = p.union(held.join(known, "doc_id").groupBy("tok").agg(F.sum("more").alias("df"), F.sum(F.col("more") * F.col("tf")).alias("tokens")))
            df = c.add("frequencies", p)
            rows = changes.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("digest") != "", F.col("more"))), F.lit(0)).alias("with_text"))
            c.add("totals", rows.join(df.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))))

    def compact(self, version: str) -> None:
        """The same corpus as one folder a table: postings without contents that no name leads to, sums in place of differences."""
        with self.store.change(version) as c:
            live = c.read("names").select("digest").distinct()
            for name, key in (("postings", "doc_id"), ("contents", "digest")):
                kept = c.read(name).join(live.withColumnRenamed("digest", key), key, "left_semi")
                c.replace(name, kept.sortWithinPartitions("doc_id") if name == "postings" else kept)
            f = c.read("frequencies").groupBy("tok").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))
            c.replace("frequencies", f.where("df <> 0"))
            c.replace("totals", c.read("totals").agg(*(F.sum(x).alias(x) for x in ("n", "with_text", "tokens"))))

    def index(self) -> Index:
        """The merged index, by content: its postings' doc_id is the digest, its statistics are those of all documents."""
        s = self.store
        t = s.read("totals").agg(*(F.sum(x).alias(x) for x in ("n", "with_text", "tokens"))).first()
        df = s.read("frequencies").groupBy("tok").agg(F.sum("df").alias("df")).where("df > 0")
        return Index(rows_of(s.read("postings")), df, float(t["n"]), t["tokens"] / max(1, t["with_text"]) or 1.0)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Top k documents of each query, as bm25 over a fresh index. A content is scored once, under the smallest id that has
        it: the k best documents are among those of the k best such ids, and of each content the k smallest ids suffice."""
        names = self.store.read("names").where("digest <> ''")
        first = names.groupBy("digest").agg(F.min("doc_id").alias("_first"))
        asked = self.store.read("postings").join(F.broadcast(query_terms(queries).select("tok").distinct()), "tok", "left_semi")
        rows = rows_of(asked).withColumnRenamed("doc_id", "digest").join(first, "digest").drop("digest").withColumnRenamed("_first", "doc_id")
        x = self.index()
        best = bm25(Index(rows, x.frequencies, x.n_docs, x.avgdl), queries, k).select("query_id", "score", F.col("doc_id").alias("_first")).join(first, "_first")
        same = ranked(names.join(best.select("digest").distinct(), "digest", "left_semi").withColumnRenamed("digest", "query_id"), k, ["doc_id"])
        same = same.select(F.col("query_id").alias("digest"), "doc_id")
        return ranked(best.join(same, "digest").select("query_id", "doc_id", "score"), k)
