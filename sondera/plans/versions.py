"""Queries over tables in versions: the index that follows its corpus, and the chat store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chat import ChatStore
from ..operators.incremental import IncrementalIndex
from ..sources.tables import Derived, VersionedTables, table
from .registry import query
from .retrieval import BM25, questions

#: Two snapshots of documents: later, some are gone, some have another text, some another id with the same text.
_OLD = "SELECT doc_id, text FROM documents WHERE doc_id >= 20"
_NEW = "SELECT CASE WHEN doc_id % 10 = 3 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' revised edition' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0"


def snapshots(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    text = F.when(i % 7 == 0, F.concat("text", F.lit(" revised edition"))).otherwise(F.col("text"))
    return d.where(i >= 20).select("doc_id", "text"), d.where(i % 11 != 0).select(F.when(i % 10 == 3, i + 1_000_000_000).otherwise(i).alias("doc_id"), text.alias("text"))


def followed(spark, sf) -> IncrementalIndex:
    """An index of the old snapshot that has followed to the new one; made once in a session."""
    at = Derived(spark, f"{sf}/documents.parquet", "incremental")
    x = IncrementalIndex(VersionedTables(spark, at.dir))
    if not at.known:
        old, new = snapshots(spark, sf)
        x.sync(old, "v1")
        x.sync(new, "v2")
        at.keep()
    return x


_BM25 = "WITH docs2 AS (" + _NEW + "), " + BM25.replace("FROM documents)", "FROM docs2)", 1).lstrip()


@query("st7_incremental_search", _BM25 + " SELECT query_id, doc_id, score, rank FROM bmr WHERE rank <= 10")
def st7_search(spark, sf):
    return followed(spark, sf).search(questions(spark, sf), 10).select("query_id", "doc_id", "score", "rank")


@query("st7_incremental_statistics", _BM25 + " SELECT count(*) AS n_tokens, sum(df)::BIGINT AS n_postings, max(df) AS max_df, (SELECT n::BIGINT FROM st) AS n_docs, (SELECT round(a, 6) FROM st) AS avgdl FROM df")
def st7_statistics(spark, sf):
    x = followed(spark, sf).index()
    out = x.frequencies.agg(F.count("*").alias("n_tokens"), F.sum("df").alias("n_postings"), F.max("df").alias("max_df"))
    return out.withColumns({"n_docs": F.lit(int(x.n_docs)), "avgdl": F.round(F.lit(x.avgdl), 6)})


@query("st7_sync_states", f"WITH o0 AS ({_OLD}), n0 AS ({_NEW}), o AS (SELECT doc_id, coalesce(sha256(text), '') AS d FROM o0), n AS (SELECT doc_id, coalesce(sha256(text), '') AS d FROM n0) SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN n.d = o.d THEN 'unchanged' WHEN o.doc_id IS NOT NULL THEN 'modified' WHEN n.d IN (SELECT d FROM o) THEN 'renamed' ELSE 'new' END AS state FROM n FULL JOIN o ON n.doc_id = o.doc_id")
def st7_states(spark, sf):
    old, new = snapshots(spark, sf)
    at = Derived(spark, f"{sf}/documents.parquet", "followed-from")
    x = IncrementalIndex(VersionedTables(spark, at.dir))
    if not at.known:
        x.sync(old, "v1")
        at.keep()
    return x.states(new)


@query("s14_chat_transactions", """WITH s AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 <> 0), m AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN role = 'assistant' THEN len(string_split(text, chr(10))) ELSE 0 END)::BIGINT AS k FROM conversations GROUP BY 1)
SELECT conv_id AS session, CASE WHEN conv_id % 3 = 1 THEN 'renamed ' ELSE 'session ' END || conv_id AS title, n AS n_messages, coalesce(k, 0) AS n_citations FROM s JOIN m USING (conv_id)""")
def s14(spark, sf):
    """Conversations as a chat store, an assistant's lines as its citations; then a third gets new titles and a fourth goes."""
    at = Derived(spark, f"{sf}/conversations.parquet", "chat")
    chat = ChatStore(VersionedTables(spark, at.dir))
    if not at.known:
        c = table(spark, sf, "conversations").withColumnsRenamed({"conv_id": "session", "turn": "message"})
        sessions = c.select("session").distinct()
        titled = lambda word: F.concat(F.lit(f"{word} "), F.col("session").cast("string")).alias("title")
        cited = c.where("role = 'assistant'").select("session", "message", F.posexplode(F.split("text", "\n", -1)).alias("number", "line"))
        chat.create(sessions.select("session", titled("session")), c.select("session", "message", "role", "text"), cited, "v1")
        chat.rename(sessions.where("session % 3 = 1").select("session", titled("renamed")), "v2")
        chat.delete(sessions.where("session % 4 = 0"), "v3")
        at.keep()
    return chat.overview()
