"""Sessions, messages and citations of a chat, which change together or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import VersionedTables
from .store import delete_cascade


class ChatStore:
    """sessions(session, title, ...), messages(session, message, ...) and citations(session, message, ...) under one
    pointer. Every call is one version: readers see a session with all its messages and citations, or none of them."""

    def __init__(self, store: VersionedTables):
        self.store = store

    def create(self, sessions: DataFrame, messages: DataFrame, citations: DataFrame, version: str) -> None:
        """The first version. Messages without a session, or citations without a message, are refused."""
        with self.store.change(version) as c:
            s, m, t = c.replace("sessions", sessions), c.replace("messages", messages), c.replace("citations", citations)
            lost = m.join(s, "session", "left_anti").limit(1).count() + t.join(m, ["session", "message"], "left_anti").limit(1).count()
            if lost:
                raise ValueError("messages need a session, citations need a message")

    def rename(self, titles: DataFrame, version: str) -> None:
        """titles(session, title): new titles of sessions, one a session; unknown sessions and blank or null titles change nothing."""
        t = titles.where(F.trim("title") != "").groupBy("session").agg(F.max("title").alias("_title"))
        with self.store.change(version) as c:
            s = c.read("sessions")
            c.replace("sessions", s.join(t, "session", "left").withColumn("title", F.coalesce("_title", "title")).select(*s.columns))

    def delete(self, gone: DataFrame, version: str) -> None:
        """Deletes the sessions of gone(session), with their messages and citations."""
        ids = gone.select("session").distinct()
        with self.store.change(version) as c:
            s, m = delete_cascade(c.read("sessions"), c.read("messages"), ids, "session")
            t = c.read("citations").join(ids, "session", "left_anti")
            for name, df in (("sessions", s), ("messages", m), ("citations", t)):
                c.replace(name, df)

    def overview(self) -> DataFrame:
        """Each session with its title and its numbers of messages and citations."""
        n = lambda name, to: self.store.read(name).groupBy("session").agg(F.count("*").alias(to))
        s = self.store.read("sessions").join(n("messages", "n_messages"), "session", "left").join(n("citations", "n_citations"), "session", "left")
        return s.select("session", "title", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_messages", "n_citations")))
