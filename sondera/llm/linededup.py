"""Line dedup: suffixes of line-ID sequences are sorted by distributed prefix doubling.

A position's rank at depth h is the rank of its next h lines among all such sequences. Doubling pairs the ranks of
positions h apart and ranks the pairs anew, by a range sort of the distinct pairs, until no sequence occurs twice.
Positions whose sequence is alone have no repeat at any greater depth and drop out of the next rounds. Positions of
equal rank at depth h form an LCP interval of at least h. The longest common prefix of a position with an earlier one
lies between two powers of two and is found bit by bit: a sequence of h + s lines is named by the ranks, at depth h, of
its first and of its last h lines. Prefixes that aren't the tail of the one before are the maximal repeated runs; later
copies are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, tasks

#: A repeated run is deleted from later copies if it has so many lines, or a line of so many characters.
MIN_LINES, MIN_CHARS = 2, 100
#: A line with a word.
WORD = r"[^\x20\x09-\x0D]"
DOC = ("doc_id", "__ld_th")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, __ld_th (hash of the text), pos (number among the lines with a word), at (number among all lines), a 128-bit line
    ID, chars, and left, the lines with a word from here to the end."""
    numbered = F.transform(F.split("text", "\n"), lambda x, j: F.struct(x.alias("x"), j.alias("j")))
    words = F.transform(F.filter(numbered, lambda y: y["x"].rlike(WORD)), lambda y, i: F.struct(i.alias("pos"), y["j"].alias("at"), F.xxhash64(y["x"]).alias("a"), F.xxhash64(F.lit("line"), y["x"]).alias("b"), F.length(y["x"]).alias("chars")))
    return docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("__ld_th"), words.alias("w")).select(*DOC, F.size("w").alias("_k"), F.explode("w").alias("l")).select(*DOC, "l.*", (F.col("_k") - F.col("l.pos")).alias("left"))


def ranked(rows: DataFrame, key: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """Distinct keys that occur at least twice, with their rank r in key order, and how many there are: partial counts, a range
    sort, and offsets by partition."""
    n = tasks(rows.sparkSession)
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    placed = twice.repartitionByRange(n, *key).sortWithinPartitions(*key).select(*key, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_k"))
    placed = scratch.cut(placed, name)
    size, total, offset = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}, 0, []
    for p in range(n):  # a number for each partition
        offset.append(total)
        total += size.get(p, 0)
    return placed.select(*key, (F.element_at(F.lit(offset), F.col("_p") + 1) + F.col("_k")).alias("r")), total


def doubled(a: DataFrame, step: int, scratch: Scratch, name: str) -> DataFrame | None:
    """Ranks at the depth of `a` plus `step`: each position is paired with that `step` lines on in its document. None if no
    pair occurs twice."""
    ahead = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(step, step)
    p = a.withColumn("r2", F.first("r").over(ahead)).where("r2 IS NOT NULL").withColumnRenamed("r", "r1")
    names, n = ranked(p, ["r1", "r2"], scratch, f"{name}-names")
    return scratch.cut(p.join(names, ["r1", "r2"]).select(*DOC, "pos", "r"), name) if n else None


def me():
    return F.struct(*DOC, "pos")


def levels(one: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(h, doc_id, __ld_th, pos, r) at the depths h = 1, 2, 4, ... until no sequence occurs twice, and the greatest depth."""
    a, h = one.select(*DOC, "pos", "r"), 1
    parts = []
    while a is not None:
        parts.append(a.select(F.lit(h).alias("h"), *DOC, "pos", "r"))
        a = doubled(a, h, scratch, f"lines-{2 * h}")
        h *= 2
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out, h // 2


def same_place(a: str, b: str):
    """Equality of places under two prefixes (a null doc_id is a doc_id)."""
    return F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}__ld_th") == F.col(f"{b}__ld_th")) & (F.col(f"{a}pos") == F.col(f"{b}pos"))


def prefixes(one: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, __ld_th, pos, n: the lines that the sequence at a position shares at most with one that starts earlier (smaller
    doc_id, then text hash, then place); positions that share none are missing."""
    ranks, top = levels(one, scratch)
    first = ranks.groupBy("h", "r").agg(F.min(me()).alias("_first"))
    later = ranks.join(first, ["h", "r"]).where(~me().eqNullSafe(F.col("_first")))
    p = later.groupBy(*DOC, "pos").agg(F.max(F.struct("h", "r")).alias("x")).select(*DOC, "pos", "x.h", "x.r", F.lit(0).alias("s"))
    p, rest = scratch.cut(p, "prefix-0"), top.bit_length() - 1
    other = ranks.select(F.col("h").alias("_h"), *(F.col(c).alias(f"_{c}") for c in (*DOC, "pos")), F.col("r").alias("r2"))
    while rest:  # two bits a round: of the longer sequences that are tried, each holds the ones before
        bits = 1 if rest % 2 else 2
        rest -= bits
        tried = F.array(*(F.col("s") + (k << rest) for k in range(1, 1 << bits)))
        asked = p.select("h", "r", F.explode(tried).alias("t")).where("t < h").distinct()
        x = ranks.where(F.col("h") > (1 << rest)).join(asked, ["h", "r"]).withColumn("_at", F.col("pos") + F.col("t"))
        x = x.join(other, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("__ld_th") == F.col("___ld_th")) & (F.col("_at") == F.col("_pos")))
        x = x.select("h", "r", "t", "r2", *DOC, "pos")
        first = x.groupBy("h", "r", "t", "r2").agg(F.min(me()).alias("_first"))
        longer = x.join(first, ["h", "r", "t", "r2"]).where(~me().eqNullSafe(F.col("_first"))).select("h", "t", *DOC, "pos")
        near = p.select(F.col("h").alias("_h"), F.col("s").alias("_s"), *(F.col(c).alias(f"_{c}") for c in (*DOC, "pos")))
        mine = longer.join(near, same_place("", "_") & (F.col("h") == F.col("_h")) & (F.col("t") > F.col("_s")) & (F.col("t") < F.col("_s") + (1 << (rest + bits))))
        mine = mine.groupBy(*DOC, "pos").agg(F.max("t").alias("_t")).select(*(F.col(c).alias(f"_{c}") for c in (*DOC, "pos")), "_t")
        p = p.join(mine, same_place("", "_"), "left")
        p = scratch.cut(p.select(*DOC, "pos", "h", "r", F.coalesce("_t", "s").alias("s")), f"prefix-{1 << rest}")
    return p.select(*DOC, "pos", (F.col("h") + F.col("s")).alias("n"))


def copies(docs: DataFrame) -> DataFrame:
    """_doc_id, ___ld_th: documents whose whole text an earlier document (smaller doc_id) has too."""
    key = ["__ld_th", "_t2"]
    d = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("__ld_th"), F.xxhash64(F.lit("text"), "text").alias("_t2")).distinct()
    first = d.groupBy(*key).agg(F.min(F.struct("doc_id")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = d.join(first, key).where(~F.struct("doc_id").eqNullSafe(F.col("_first")))
    return later.select(F.col("doc_id").alias("_doc_id"), F.col("__ld_th").alias("___ld_th"))


def repeated_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, __ld_th, pos, at, chars, n: lines with a word that occur twice or more, with the greatest common prefix n of their
    sequence with an earlier one (0: none).

    A copy of a whole text shares all that is left of it with the first; only first copies have their suffixes sorted.
    """
    lines = lines_of(docs)
    names, _ = ranked(lines, ["a", "b"], scratch, "lines-1-names")
    again = scratch.cut(copies(docs), "copies")
    one = lines.join(names, ["a", "b"]).select(*DOC, "pos", "at", "chars", "left", "r").distinct()
    of_doc = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("__ld_th") == F.col("___ld_th"))
    one = scratch.cut(one.join(again, of_doc, "left").withColumn("copy", F.col("___ld_th").isNotNull()).drop(*again.columns), "lines-1")
    n = prefixes(one.where("NOT copy"), scratch).select(*(F.col(c).alias(f"_{c}") for c in (*DOC, "pos")), "n")
    out = one.join(n, same_place("", "_"), "left").select(*DOC, "pos", "at", "chars", F.when(F.col("copy"), F.col("left")).otherwise(F.coalesce("n", F.lit(0))).alias("n"))
    return scratch.cut(out, "prefixes")


def maximal_runs(found: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, __ld_th, pos, n: the maximal repeated runs of min_lines lines or more, those that don't continue the run of the
    line before."""
    before = F.lag("n").over(Window.partitionBy(*DOC).orderBy("pos"))
    last = F.lag("pos").over(Window.partitionBy(*DOC).orderBy("pos"))
    tail = F.coalesce((last == F.col("pos") - 1) & (before == F.col("n") + 1), F.lit(False))
    return found.withColumn("_tail", tail).where(~F.col("_tail") & (F.col("n") >= min_lines)).select(*DOC, "pos", "n")


def repeats(found: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, __ld_th, at: the lines that a later copy of a repeated run covers.

    A run is of consecutive lines with a word; lines without one are passed over and stay. It counts if it has
    min_lines lines or a line of min_chars characters, and is deleted wherever the same sequence also starts
    earlier, in another document or the same. What counts is the input, not what is left of it. Rows equal in
    doc_id and text are one document.
    """
    ends = F.when(F.col("n") >= min_lines, F.col("pos") + F.col("n")).otherwise(0)
    covered = F.max(ends).over(Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) > F.col("pos")
    long = (F.col("chars") >= min_chars) & (F.col("n") > 0)
    return found.withColumn("_gone", covered | long).where("_gone").select(*DOC, "at")


def dedup_lines(docs: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with later copies of repeated line runs deleted from `text`, and __ld_lines, __ld_removed, and __ld_runs and
    __ld_longest, the maximal runs deleted and the lines of the longest.

    Other columns are unchanged; names that begin with __ld_ are reserved. A null text stays null (0 lines); a text that
    loses all lines becomes empty. Of copies that tie in doc_id the smaller text hash is the earlier. Long texts are
    handled whole; an empty table gives no rows. Rows of a null doc_id are documents of their own by their texts.
    """
    found = repeated_lines(docs, scratch)
    gone = repeats(found, min_lines, min_chars).groupBy(*DOC).agg(F.sort_array(F.collect_set("at")).alias("__ld_gone"))
    runs = maximal_runs(found, min_lines).groupBy(*DOC).agg(F.count("*").alias("__ld_runs"), F.max("n").cast("long").alias("__ld_longest"))
    runs = runs.select(F.col("doc_id").alias("_d"), F.col("__ld_th").alias("_t"), "__ld_runs", "__ld_longest")
    gone = gone.join(runs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("__ld_th") == F.col("_t")), "left")
    gone = gone.select(F.col("doc_id").alias("__ld_d"), F.col("__ld_th").alias("__ld_t"), "__ld_gone", "__ld_runs", "__ld_longest")
    d = docs.withColumn("__ld_th", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__ld_d")) & (F.col("__ld_th") == F.col("__ld_t")), "left")
    lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__ld_gone")), lambda j: F.get(lines, j))
    d = d.withColumns({
        "__ld_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), "__ld_removed": F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long"),
        "__ld_runs": F.coalesce("__ld_runs", F.lit(0)), "__ld_longest": F.coalesce("__ld_longest", F.lit(0)),
        "text": F.when(F.col("__ld_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
    })
    return d.select(*(F.col(f"`{c}`") for c in docs.columns), "__ld_lines", "__ld_removed", "__ld_runs", "__ld_longest")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return out.select("doc_id", F.col("__ld_lines").alias("n_lines"), F.col("__ld_removed").alias("n_removed"), F.col("__ld_runs").alias("n_runs"), F.col("__ld_longest").alias("longest_run"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same by growing all repeated sequences line by line.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n FROM documents),
l AS (SELECT doc_id, unnest(generate_series(0, len(string_split(t, chr(10))) - 1)) AS j, unnest(string_split(t, chr(10))) AS x FROM d),
p AS (SELECT doc_id, j, x, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, dense_rank() OVER (ORDER BY x) AS id FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
s AS (SELECT 1 AS n, doc_id, i, id AS g FROM p WHERE id IN (SELECT id FROM p GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT n, doc_id, i, g FROM (SELECT s.n + 1 AS n, s.doc_id, s.i, dense_rank() OVER (ORDER BY s.g, p.id) AS g, count(*) OVER (PARTITION BY s.g, p.id) AS c FROM s JOIN p ON p.doc_id = s.doc_id AND p.i = s.i + s.n) WHERE c > 1),
later AS (SELECT n, doc_id, i, row_number() OVER (PARTITION BY n, g ORDER BY doc_id, i) AS k FROM s),
lcp AS (SELECT doc_id, i, max(n) AS n FROM later WHERE k > 1 GROUP BY ALL),
run AS (SELECT a.* FROM lcp a LEFT JOIN lcp b ON b.doc_id = a.doc_id AND b.i = a.i - 1 AND b.n = a.n + 1 WHERE b.n IS NULL AND a.n >= 2),
runs AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest FROM run GROUP BY 1),
hit AS (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS i FROM run UNION SELECT doc_id, i FROM lcp JOIN p USING (doc_id, i) WHERE length(x) >= 100),
gone AS (SELECT doc_id, j FROM hit JOIN p USING (doc_id, i)),
kept AS (SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.j) FILTER (g.j IS NULL) AS t, count(g.j) AS r FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.j = g.j GROUP BY l.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_lines, r::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(longest, 0)::BIGINT AS longest_run, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN runs ON runs.doc_id = d.doc_id
"""
