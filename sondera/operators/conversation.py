"""Conversation state as windows over turns: slots, source locks, bounded memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def so_far(conv: str, turn: str):
    return Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)


def last_mention(df: DataFrame, conv: str, turn: str, slots: dict[str, Column]) -> DataFrame:
    """Adds, for each slot, the last value that was not null up to this turn."""
    w = so_far(conv, turn)
    return df.withColumns({k: F.last(v, ignorenulls=True).over(w) for k, v in slots.items()})


def locked_source(df: DataFrame, conv: str, turn: str, event: Column) -> DataFrame:
    """Adds lock: the source named by the last event; an event `auto` releases it."""
    last = F.last(event, ignorenulls=True).over(so_far(conv, turn))
    return df.withColumn("lock", F.when(last != "auto", last))


def memory(df: DataFrame, conv: str, turn: str, tokens: str, recent: int = 500, summary: int = 300, keep: int = 2) -> DataFrame:
    """Adds place: recent (among the last `keep` turns and within the budget), summary (older, newest first while they fit)
    or dropped. Reverse running sums; the state of the conversation at its last turn."""
    back = Window.partitionBy(conv).orderBy(F.desc(turn))
    run = back.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({"_n": F.row_number().over(back), "_r": F.sum(F.col(tokens)).over(run)})
    in_recent = (F.col("_n") <= keep) & (F.col("_r") <= recent)
    d = d.withColumn("_old", F.when(in_recent, 0).otherwise(F.col(tokens)))
    d = d.withColumn("_s", F.sum("_old").over(run))
    return d.withColumn("place", F.when(in_recent, "recent").when(F.col("_s") <= summary, "summary").otherwise("dropped")).drop("_n", "_r", "_old", "_s")
