"""Queries over streams of lines: every turn of the conversations as a stream of tokens in pieces of bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linestream as ls
from ..sources.tables import table
from .registry import query

#: Bytes of a piece: odd, so that pieces end inside characters too.
PIECE = 61
#: How a turn's stream ends, by (conv_id + turn) modulo 4: done, done, with an error, with an invalid line; every ninth turn breaks off.
_ENDS = ['{"done":true}\n', ' {"response":"\\nend","done":true}\r\n{"response":"late"}\n', '{"error":"out of memory"}\n{"done":true}\n', '{"response": \n{"done":true}']
_STREAMS = (
    "WITH x AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l, (conv_id + turn) % 4 AS e, (conv_id + 2 * turn) % 9 = 0 AS cut FROM conversations WHERE text IS NOT NULL), "
    "s AS (SELECT *, CASE WHEN NOT cut AND e = 1 THEN list_append(list_filter(l, lambda x: x <> ''), chr(10) || 'end') ELSE list_filter(l, lambda x: x <> '') END AS k FROM x) "
)


def pieces(spark, sf):
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.to_json(F.struct(x.alias("response")))), "\n")
    e = (F.col("conv_id") + F.col("turn")) % 4
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (e + 1).cast("int"))
    end = F.when((F.col("conv_id") + 2 * F.col("turn")) % 9 == 0, "").otherwise(F.concat(F.lit("\n"), end))
    return ls.cut(c.select(F.concat_ws(":", "conv_id", "turn").alias("stream"), F.concat(body, end).alias("text")), PIECE)


@query("s16_stream_lines", r"""WITH x AS (SELECT conv_id, turn, text, (conv_id + turn) % 4 AS e, (conv_id + 2 * turn) % 9 = 0 AS cut FROM conversations WHERE text IS NOT NULL) SELECT conv_id || ':' || turn AS stream, (len(string_split(text, chr(10))) + CASE WHEN cut THEN 0 WHEN e = 0 THEN 1 ELSE 2 END)::BIGINT AS n_lines, CASE WHEN cut OR e = 3 THEN 1 ELSE 0 END::BIGINT AS n_open FROM x""")
def s16(spark, sf):
    x = ls.lines(pieces(spark, sf))
    return x.groupBy("stream").agg(F.count("line").alias("n_lines"), F.count(F.when(~F.col("closed"), 1)).alias("n_open"))


@query("st5_stream_outcomes", _STREAMS + r"""SELECT conv_id || ':' || turn AS stream, CASE WHEN cut THEN 'truncated' WHEN e < 2 THEN 'completed' WHEN e = 2 THEN 'error' ELSE 'invalid' END AS status, len(k)::BIGINT AS n_tokens, sha256(array_to_string(k, '')) AS digest FROM s""")
def st5(spark, sf):
    o = ls.outcomes(ls.events(ls.lines(pieces(spark, sf))))
    return o.select("stream", "status", "n_tokens", F.sha2("text", 256).alias("digest"))


@query("st4_event_kinds", _STREAMS + r"""SELECT conv_id || ':' || turn AS stream, (len(l) + (NOT cut AND e = 1)::INT)::BIGINT AS n_token, (NOT cut)::BIGINT AS n_completed, (NOT cut AND e = 2)::BIGINT AS n_error, (NOT cut AND e = 3)::BIGINT AS n_invalid FROM s""")
def st4(spark, sf):
    e = ls.events(ls.lines(pieces(spark, sf)))
    return e.groupBy("stream").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("token", "completed", "error", "invalid")))


@query("st5_first_tokens", _STREAMS + r"""SELECT conv_id || ':' || turn AS stream, CAST(floor((octet_length(encode(array_to_string(list_transform(l[1:list_position(l, k[1])], lambda x: '{"response":' || to_json(x) || '}'), chr(10)))) - (cut AND k[1] = l[-1] AND list_position(l, k[1]) = len(l))::INT) / 61) AS BIGINT) AS first_token_at FROM s WHERE len(list_filter(l, lambda x: x <> '')) > 0""")
def st5_first(spark, sf):
    o = ls.outcomes(ls.events(ls.lines(pieces(spark, sf))))
    return o.where("first_token_at IS NOT NULL").select("stream", "first_token_at")
