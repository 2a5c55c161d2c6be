"""Lines and events of streams that arrive in pieces, against plain Python on the same bytes."""

import random
import time

import pytest

from sondera.operators import linestream as ls
from sondera.streaming.jobs import line_stream

SCHEMA = "stream string, at long, data binary"


def expected(pieces):
    """{stream: [(line or None, closed)]} by joining each stream's bytes."""
    out = {}
    for s in {p[0] for p in pieces if p[0] is not None and p[1] is not None and p[2]}:
        data = b"".join(d for k, a, d in sorted((p for p in pieces if p[0] == s and p[1] is not None and p[2]), key=lambda p: p[1]))
        *whole, rest = data.split(b"\n")
        every = [(x, True) for x in whole] + ([(rest, False)] if rest else [])
        ok = lambda b: b.decode("utf-8") if b.decode("utf-8", "ignore").encode() == b else None
        out[s] = [(ok(b), c) for b, c in every]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["stream"], r["at"], r["part"])):
        out.setdefault(r["stream"], []).append((r["line"], r["closed"]))
    return out


def random_pieces(seed):
    r, out = random.Random(seed), []
    for s in "abcd":
        data = b"".join(r.choice(["é", "x", "\n", "\n\n", "日本", "\r\n", "𝄞", "word "]).encode() for _ in range(r.randrange(60)))
        at = 0
        while data:
            k = r.choice([1, 1, 2, 3, 7, 20])
            out.append((s, at, data[:k]))
            data, at = data[k:], at + r.choice([1, 1, 1, 5])
            if r.random() < 0.1:
                out.append((s, at, r.choice([b"", None])))
                at += 1
    return out


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_lines_as_joined_bytes(spark, monkeypatch, block):
    monkeypatch.setattr(ls, "BLOCK", block)
    p = random_pieces(block) + [(None, 1, b"lost\n"), ("a", None, b"lost\n"), ("bad", 1, b"a\xff\nb\n"), ("bad", 0, b""), ("far", 5000, b"one "), ("far", 9000, b"line\ntwo")]
    assert found(ls.lines(spark.createDataFrame(p, SCHEMA))) == expected(p)


def test_place_and_completion_of_lines(spark):
    p = [("s", 3, b"a"), ("s", 4, b"b\nc\nd"), ("s", 7, b"e"), ("s", 8, b"\n")]
    rows = ls.lines(spark.createDataFrame(p, SCHEMA)).orderBy("at", "part").collect()
    assert [tuple(r) for r in rows] == [("s", 3, 0, "ab", 4, True), ("s", 4, 1, "c", 4, True), ("s", 4, 2, "de", 8, True)]


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA + ", line string, block long, n int")
    assert ls.outcomes(ls.events(ls.lines(none))).collect() == []
    one = spark.createDataFrame([("s", 0, b'{"done":true}', "x", 1, 2)], SCHEMA + ", line string, block long, n int")
    assert [tuple(r) for r in ls.outcomes(ls.events(ls.lines(one))).collect()] == [("s", "completed", 0, "", None, 0)]


def test_cut_gives_the_bytes_back(spark):
    texts = [("s", "é" * 50 + "\nend"), ("null", None), ("empty", ""), ("exact", "x" * 7)]
    rows = ls.cut(spark.createDataFrame(texts, "stream string, text string"), 7).orderBy("stream", "at").collect()
    assert all(0 < len(r["data"]) <= 7 for r in rows)
    got = {s: b"".join(bytes(r["data"]) for r in rows if r["stream"] == s) for s in {r["stream"] for r in rows}}
    assert got == {"s": texts[0][1].encode(), "exact": b"x" * 7}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"response":"a"}\n\n  \r\n{"response":"b","done":false}\n{"response":"!","done":true}\n{"response":"late"}\n', ("completed", 3, "ab!")),
        ('{"response":"a"}\n{"error":"no memory"}\n{"done":true}\n', ("error", 1, "a")),
        ('{"response":"a","error":null}\n', ("truncated", 1, "a")),
        ('{"response":"a"}\n[1]\n', ("invalid", 1, "a")),
        ('{"response":"a"}\n"text"\n', ("invalid", 1, "a")),
        ('{"response":"a"}\n{"response":"b', ("invalid", 1, "a")),
        ('{"response":""}\n{"other":1}\n{"done":"soon"}\n', ("truncated", 0, "")),
        ('{"response":"a\\nb \\u00e9"}\n{"done":true}', ("completed", 1, "a\nb é")),
    ],
)
def test_outcome_of_a_stream(spark, text, want):
    x = ls.cut(spark.createDataFrame([("s", text)], "stream string, text string"), 5)
    r = ls.outcomes(ls.events(ls.lines(x))).collect()
    assert [(o["status"], o["n_tokens"], o["text"]) for o in r] == [want]


def test_streaming_carries_what_has_no_end(spark, tmp_path):
    p = [x for x in random_pieces(99) if x[2]] + [("bad", 0, b"\xff\n\xc3"), ("bad", 1, b"\xa9\n")]
    files = [sorted(p, key=lambda x: x[1])[: len(p) // 2], sorted(p, key=lambda x: x[1])[len(p) // 2 - 3 :]]  # three pieces are delivered again
    for i, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = (
            line_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        )
        assert q.awaitTermination(120), i
    got, want = {}, {s: sorted([x for x, closed in e if closed], key=str) for s, e in expected(p).items()}
    for r in spark.read.parquet(str(tmp_path / "out")).where("closed").collect():
        got.setdefault(r["stream"], []).append(r["line"])
    assert {s: sorted(x, key=str) for s, x in got.items()} == {s: x for s, x in want.items() if x}


def test_a_silent_stream_gives_its_rest(spark, tmp_path):
    spark.createDataFrame([("s", 0, b"whole\nhalf"), ("t", 0, b"done\n")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = line_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 500).writeStream.format("memory").queryName("silent_lines").outputMode("append").trigger(processingTime="1 second").start()
    rows, end = [], time.monotonic() + 60
    while len(rows) < 3 and time.monotonic() < end:
        time.sleep(1)
        rows = sorted(tuple(r) for r in spark.table("silent_lines").collect())
    q.stop()
    assert rows == [("s", 0, "half", False), ("s", 0, "whole", True), ("t", 0, "done", True)]
