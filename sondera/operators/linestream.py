"""Streams of lines that arrive as pieces of bytes: lines put together across pieces, typed events, the outcome of a stream.

A piece may end inside a line and inside a character. Lines that lie within one piece stay where they are; only the first
and last part of a piece meet others, by the piece in which their line began. That piece is the latest one before with a line
end: a prefix maximum, taken within blocks of pieces and then over blocks, so no task holds a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Piece numbers of a block of the prefix maximum.
BLOCK = 1024


def cut(texts: DataFrame, size: int) -> DataFrame:
    """(stream, at, data): the UTF-8 bytes of texts(stream, text) in pieces of `size` bytes, numbered from 0; null or empty: none."""
    b = F.encode("text", "UTF-8")
    n = F.ceil(F.length(b) / size).cast("int")
    x = texts.select("stream", b.alias("b"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("at"))
    return x.select("stream", F.col("at").cast("long").alias("at"), F.expr(f"substring(b, at * {size} + 1, {size})").alias("data"))


def _bytes(c: Column) -> Column:
    return F.encode(c, "ISO-8859-1")


def lines(pieces: DataFrame) -> DataFrame:
    """(stream, at, part, line, ended_at, closed) of pieces(stream, at, data): every line without its line end, null if it is not
    UTF-8. Lines of a stream are in order of (at, part), the piece in which they begin and their number there; ended_at is
    the piece that completed them, closed whether a line end did (false only for what follows the last one, unless empty).
    Pieces are in order of at, gaps don't matter; each (stream, at) comes once, so pieces delivered again are dropped
    before. Null or empty pieces add nothing; pieces with a null stream or at are left out."""
    # One character a byte, so that splitting and joining can't break characters.
    p = pieces.where("stream IS NOT NULL AND at IS NOT NULL AND length(data) > 0")
    p = p.select("stream", F.col("at").cast("long").alias("at"), F.split(F.decode("data", "ISO-8859-1"), "\n", -1).alias("x"))
    n = F.size("x") - 1
    inner = p.where(n > 1).select("stream", "at", F.posexplode(F.slice("x", 2, n - 1)).alias("part", "line"))
    inner = inner.select("stream", "at", (F.col("part") + 1).alias("part"), _bytes(F.col("line")).alias("b"), F.col("at").alias("ended_at"), F.lit(True).alias("closed"))

    e = p.select("stream", "at", F.floor(F.col("at") / BLOCK).alias("block"), n.alias("n"), F.col("x")[0].alias("head"), F.when(n > 0, F.element_at("x", -1)).alias("tail"))
    begun = F.when(F.col("n") > 0, F.struct("at", "n"))
    before = lambda by, o: Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    block = e.groupBy("stream", "block").agg(F.max(begun).alias("m")).select("stream", "block", F.max("m").over(before(["stream"], "block")).alias("given"))
    e = e.withColumn("own", F.max(begun).over(before(["stream", "block"], "at"))).join(block, ["stream", "block"])
    head = F.struct(F.coalesce("own", "given").alias("start"), F.col("head").alias("b"), (F.col("n") > 0).alias("closed"))
    tail = F.struct(F.struct("at", "n").alias("start"), F.col("tail").alias("b"), F.lit(False).alias("closed"))
    parts = e.select("stream", "at", F.explode(F.when(F.col("n") > 0, F.array(head, tail)).otherwise(F.array(head))).alias("q")).select("stream", "at", "q.*")
    whole = parts.groupBy("stream", "start").agg(F.sort_array(F.collect_list(F.struct("at", "b"))).alias("ps"), F.max("closed").alias("closed"))
    text = F.array_join(F.transform("ps", lambda s: s["b"]), "")
    begins = F.coalesce("start.at", F.col("ps")[0]["at"])
    edge = whole.select("stream", begins.alias("at"), F.coalesce("start.n", F.lit(0)).alias("part"), _bytes(text).alias("b"), F.element_at("ps", -1)["at"].alias("ended_at"), "closed")
    out = inner.unionByName(edge.where(F.col("closed") | (F.length("b") > 0)))
    return out.select("stream", "at", "part", F.try_validate_utf8(F.col("b").cast("string")).alias("line"), "ended_at", "closed")


def events(lines: DataFrame, token: str = "response", done: str = "done", error: str = "error") -> DataFrame:
    """(stream, at, part, ended_at, kind, token) of every line that is not blank: kind invalid (not a JSON object, or not UTF-8),
    error (the error field is there and not null), completed (done is true; its token counts too) or token."""
    x = lines.where(F.col("line").isNull() | F.col("line").rlike(r"\S")).withColumn("v", F.try_parse_json(F.regexp_replace("line", r"^\s+|\s+$", "")))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    get = lambda name, t: F.try_variant_get("v", f"$.{name}", t)
    kind = F.when(~is_object, "invalid").when(get(error, "string").isNotNull(), "error").when(get(done, "boolean"), "completed").otherwise("token")
    text = F.when(is_object, F.coalesce(get(token, "string"), F.lit("")))
    return x.select("stream", "at", "part", "ended_at", kind.alias("kind"), text.alias("token"))


def outcomes(events: DataFrame) -> DataFrame:
    """(stream, status, n_tokens, text, first_token_at, ended_at), one row a stream with an event: the first completed, error or
    invalid event ends it and gives the status, what follows is ignored; without one it is truncated. n_tokens counts the
    non-empty tokens up to there, text joins them, first_token_at is the piece that completed the first (null: none)."""
    place = F.struct("at", "part")
    over = Window.partitionBy("stream")
    ends = F.min(F.when(F.col("kind") != "token", F.struct("at", "part", "kind"))).over(over)
    e = events.withColumn("end", ends).where(F.col("end").isNull() | (place <= F.struct("end.at", "end.part")))
    says = F.col("kind").isin("token", "completed") & (F.col("token") != "")
    g = e.groupBy("stream").agg(
        F.first("end.kind").alias("status"), F.count(F.when(says, 1)).alias("n_tokens"), F.min(F.when(says, F.col("ended_at"))).alias("first_token_at"),
        F.max("ended_at").alias("ended_at"), F.sort_array(F.collect_list(F.when(says, F.struct("at", "part", "token")))).alias("ts"),
    )
    text = F.array_join(F.transform("ts", lambda t: t["token"]), "")
    return g.select("stream", F.coalesce("status", F.lit("truncated")).alias("status"), "n_tokens", text.alias("text"), "first_token_at", "ended_at")
