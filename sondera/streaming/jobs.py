"""Streaming forms: conversation memory with keyed state, lines of arriving pieces, incremental ingest in micro-batches, late-data windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import upsert
from ..sources.tables import VersionedTable


def running_memory(turns: DataFrame, keep: int = 2) -> DataFrame:
    """For each arriving batch of a conversation's turns: (conv_id, turn, n_turns, recent), recent the last `keep` turn numbers.
    State is one small row a conversation; turns of one batch are taken in order."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, recent = state.get if state.exists else (0, "")
        last = [int(x) for x in recent.split(",") if x]
        out = []
        for t in sorted(int(t) for p in parts for t in p["turn"]):
            n, last = n + 1, [*last, t][-keep:]
            out.append((key[0], t, n, ",".join(map(str, last))))
        state.update((n, ",".join(map(str, last))))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "n_turns", "recent"])

    return turns.select("conv_id", "turn").groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, n_turns long, recent string", "n long, recent string", "append", GroupStateTimeout.NoTimeout)


def line_stream(pieces: DataFrame, silent_ms: int | None = None) -> DataFrame:
    """(stream, at, line, closed) as pieces(stream, at, data) arrive: each line as soon as its end is there, at the piece that
    completed it; lines that are not UTF-8 are null. State is what follows a stream's last line end and its last piece's
    number; pieces at or below that number are deliveries again and left out. With `silent_ms`, a stream that stays silent
    for so long in processing time gives its rest as a line that is not closed, and its state goes (Spark then never comes to
    an end of what is available, so such a query needs a trigger by time). Pieces of one stream arrive in order across
    batches; within a batch they are ordered here."""

    def text(b: bytes) -> str | None:
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            return None

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, seen = state.get if state.exists else (b"", -1)
        out = []
        if state.hasTimedOut:
            if rest:
                out.append((key[0], seen, text(bytes(rest)), False))
            state.remove()
        else:
            for at, data in sorted((int(a), bytes(d)) for p in parts for a, d in zip(p["at"], p["data"], strict=True) if d is not None):
                if at > seen:
                    *whole, rest = (bytes(rest) + data).split(b"\n")
                    out += [(key[0], at, text(x), True) for x in whole]
                    seen = at
            state.update((bytes(rest), seen))
            if silent_ms:
                state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame(out, columns=["stream", "at", "line", "closed"])

    p = pieces.where("stream IS NOT NULL AND at IS NOT NULL").select("stream", "at", "data")
    return p.groupBy("stream").applyInPandasWithState(step, "stream string, at long, line string, closed boolean", "rest binary, seen long", "append", GroupStateTimeout.ProcessingTimeTimeout if silent_ms else GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, store: VersionedTable, key: str, checkpoint: str):
    """Each micro-batch is merged into the store as a new immutable version; a replayed batch is recognised by its number."""

    def merge(batch: DataFrame, number: int) -> None:
        name = f"v{number:08d}"
        if store.version and store.version >= name:
            return
        new = batch.dropDuplicates([key])
        store.publish(upsert(store.read(), new, key) if store.version else new, name)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
