"""Corpus hygiene and structure: page quality, boilerplate, exact dedup, chunks, links, hierarchy checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import estimated_tokens, folded, stable_id, strip

#: Fixed values of page quality: visible characters and words of an empty and a short page; least share of letters,
#: greatest shares of replacement and control characters.
EMPTY_CHARS, SHORT_CHARS, EMPTY_WORDS, SHORT_WORDS = 80, 200, 5, 10
LEAST_LETTERS, MOST_REPLACED, MOST_CONTROL = 0.15, 0.05, 0.08


def page_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds visible, words, letter_ratio and status (empty, short, corrupted, usable)."""
    c = F.coalesce(F.col(text), F.lit(""))
    visible = F.length(F.regexp_replace(c, r"\s", "")).cast("long")
    words = F.regexp_count(c, F.lit(r"[^\s]+")).cast("long")
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    control = F.regexp_count(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    at_least_one = F.greatest(F.lit(1), visible)
    df = df.withColumns({"visible": visible, "words": words, "letter_ratio": F.round(letters / at_least_one, 6), "_r": F.regexp_count(c, F.lit("�")) / at_least_one, "_c": control / at_least_one})
    status = (
        F.when((F.col("visible") < EMPTY_CHARS) & (F.col("words") < EMPTY_WORDS), "empty")
        .when((F.col("letter_ratio") < LEAST_LETTERS) | (F.col("_r") > MOST_REPLACED) | (F.col("_c") > MOST_CONTROL), "corrupted")
        .when((F.col("visible") < SHORT_CHARS) | (F.col("words") < SHORT_WORDS), "short")
        .otherwise("usable")
    )
    return df.withColumn("status", status).drop("_r", "_c")


#: Page numbers of a block, within which page_ranges() finds runs.
PAGE_BLOCK = 1024


def page_ranges(df: DataFrame, *by: str, page: str = "page") -> DataFrame:
    """(*by, pages): the distinct page numbers of each group as compact ranges in order, such as 1-3, 5; null where it has none.

    Runs are found in blocks of page numbers; the window over a group, and its row, see a run a block instead of pages.
    """
    p = df.select(*by, F.col(page).alias("_p")).distinct().withColumn("_b", F.floor(F.col("_p") / PAGE_BLOCK))
    p = p.withColumn("_run", F.col("_p") - F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_p")))
    runs = p.groupBy(*by, "_b", "_run").agg(F.min("_p").alias("_a"), F.max("_p").alias("_z"))
    w = Window.partitionBy(*by).orderBy("_a")
    begins = F.when(F.col("_a") - 1 == F.lag("_z").over(w), 0).otherwise(1)
    runs = runs.withColumn("_new", begins).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*by, "_run").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    text = F.when(F.col("_a") == F.col("_z"), F.col("_a").cast("string")).otherwise(F.concat(F.col("_a").cast("string"), F.lit("-"), F.col("_z").cast("string")))
    in_order = F.sort_array(F.collect_list(F.when(F.col("_a").isNotNull(), F.struct("_a", text.alias("t")))))
    return runs.groupBy(*by).agg(F.nullif(F.array_join(in_order["t"], ", "), F.lit("")).alias("pages"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): all lines of the texts."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def boilerplate(docs: DataFrame, least: int = 4, share: float = 0.2, most_words: int = 10, most_chars: int = 160) -> DataFrame:
    """Folded lines that stand in many documents: (line, n_docs). A line counts once a document; the threshold is
    max(least, ceil(share * documents)); long lines are content."""
    n = docs.count()
    key = folded(strip(F.col("line")))
    c = lines(docs).select("doc_id", key.alias("line")).where((F.length("line") > 0) & (F.length("line") <= most_chars))
    c = c.distinct().groupBy("line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= max(least, -(-int(share * n * 1000) // 1000)))
    return c.where(F.size(F.split("line", r"\s+")) <= most_words)


def without_lines(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs(doc_id, text) without the given folded lines; a text whose lines are all bad keeps them."""
    l = lines(docs).withColumn("_k", folded(strip(F.col("line"))))
    l = l.join(bad.select(F.col("line").alias("_k"), F.lit(True).alias("_bad")), "_k", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("_bad").isNull(), F.struct("pos", "line"))))
    every = F.array_sort(F.collect_list(F.struct("pos", "line")))
    g = l.groupBy("doc_id").agg(kept.alias("k"), every.alias("e"), F.count("_bad").alias("n_removed"))
    use = F.when(F.size("k") > 0, F.col("k")).otherwise(F.col("e"))
    return g.select("doc_id", F.array_join(F.transform(use, lambda x: x["line"]), "\n").alias("text"), F.when(F.size("k") > 0, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of equal folded texts: (kept, n, ids), kept the smallest id. Texts go as hashes."""
    k = docs.select("doc_id", F.sha2(folded(strip(F.regexp_replace("text", r"\s+", " "))), 256).alias("sig"))
    return k.groupBy("sig").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids")).drop("sig")


def linked(df: DataFrame, doc: str, pos: str, *same: str) -> DataFrame:
    """Adds prev_pos and next_pos: the neighbours in document order, if they agree in the columns `same`."""
    w = Window.partitionBy(doc).orderBy(pos)

    def side(f) -> Column:
        ok = F.lit(True)
        for c in same:
            ok = ok & f(c).over(w).eqNullSafe(F.col(c))
        return F.when(ok, f(pos).over(w))

    return df.withColumns({"prev_pos": side(F.lag), "next_pos": side(F.lead)})


def consecutive_groups(df: DataFrame, doc: str, pos: str, key: str) -> DataFrame:
    """Adds group_no: a new group begins where the key differs from the row before (A, B, A are three groups)."""
    w = Window.partitionBy(doc).orderBy(pos)
    new = (F.lag(pos).over(w).isNull() | ~F.lag(key).over(w).eqNullSafe(F.col(key))).cast("long")
    return df.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def token_windows(docs: DataFrame, size: int, overlap: int, stop_early: bool = False) -> DataFrame:
    """(doc_id, window_no, n_words): overlapping word windows. Pieces at the end may lie within the one before; stop_early
    ends with the first window that reaches the end."""
    step = size - overlap
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    d = docs.select("doc_id", w.alias("w")).withColumn("n", F.size("w")).where("n > 0")
    last = F.when(F.lit(stop_early) & (F.col("n") <= size), 0).when(F.lit(stop_early), F.ceil((F.col("n") - size) / step) * step).otherwise(F.col("n") - 1)
    d = d.select("doc_id", "n", "w", F.explode(F.sequence(F.lit(0), last.cast("int"), F.lit(step))).alias("start"))
    return d.select("doc_id", (F.col("start") / step).cast("long").alias("window_no"), F.least(F.lit(size), F.col("n") - F.col("start")).cast("long").alias("n_words"), F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("text"))


def parent_groups(df: DataFrame, target: int = 1250, most: int = 1700) -> DataFrame:
    """(doc_id, pos, parent_no): children in order fill a parent; a new one begins when the key changes, when the child would
    push it over `most` tokens, or when it has reached `target`. A fold with resets, so a document is handled whole.
    df(doc_id, pos, key, tokens)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos", kind="stable")
        out, no, have, key = [], -1, 0, object()
        for k, n in zip(p["key"], p["tokens"], strict=True):
            if no < 0 or k != key or have + n > most or have >= target:
                no, have, key = no + 1, 0, k
            have += n
            out.append(no)
        return p.assign(parent_no=out)[["doc_id", "pos", "parent_no"]]

    return df.select("doc_id", "pos", "key", "tokens").groupBy("doc_id").applyInPandas(run, "doc_id long, pos long, parent_no long")


def chunks(docs: DataFrame, target: int = 500, overlap: int = 80, least: int = 80) -> DataFrame:
    """Structure-aware chunks: (doc_id, chunk_no, text, n_tokens, chunk_id). Lines are filled up to `target` estimated tokens;
    a longer line is cut at sentences, then words; a chunk begins with a tail of up to `overlap` tokens of the one before;
    a last chunk under `least` joins the one before. Handled a document at a time."""
    import re

    def run(p: pd.DataFrame) -> pd.DataFrame:
        size = lambda s: -(-len(s) // 4)
        out = []
        for d, text in zip(p["doc_id"], p["text"], strict=True):
            units = []
            for line in (text or "").split("\n"):
                if size(line) <= target:
                    units += [line] if line.strip() else []
                    continue
                for s in re.split(r"(?<=[.!?])\s+", line):
                    words = s.split()
                    while words:
                        n, k = 0, 0
                        while k < len(words) and (k == 0 or n + len(words[k]) + 1 <= 4 * target):
                            n += len(words[k]) + 1
                            k += 1
                        units.append(" ".join(words[:k]))
                        words = words[k:]
            made, have, again = [], [], 0
            for u in units:
                if have and size("\n".join([*have, u])) > target:
                    made.append(have)
                    tail = have[-1] if size(have[-1]) <= overlap else ""
                    have = [tail] if tail and size(tail) + size(u) <= target else []
                    again = len(have)
                have.append(u)
            if have:
                made.append(have)
            if len(made) > 1 and size("\n".join(made[-1])) < least:
                made[-2:] = [made[-2] + made[-1][again:]]  # its tail is there already
            out += [(d, i, "\n".join(t)) for i, t in enumerate(made)]
        return pd.DataFrame(out, columns=["doc_id", "chunk_no", "text"])

    c = docs.select("doc_id", "text").mapInPandas(lambda parts: map(run, parts), "doc_id long, chunk_no long, text string")
    return c.withColumns({"n_tokens": estimated_tokens(F.col("text")), "chunk_id": stable_id(F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"), F.col("text"))})


def link_violations(df: DataFrame, doc: str, pos: str, *same: str) -> DataFrame:
    """Rows whose stored prev_pos or next_pos differs from the expected neighbour."""
    want = linked(df.drop("prev_pos", "next_pos"), doc, pos, *same).select(F.col(doc).alias("_d"), F.col(pos).alias("_p"), F.col("prev_pos").alias("_a"), F.col("next_pos").alias("_b"))
    j = df.join(want, (F.col(doc) == F.col("_d")) & (F.col(pos) == F.col("_p")))
    return j.where(~(F.col("prev_pos").eqNullSafe(F.col("_a")) & F.col("next_pos").eqNullSafe(F.col("_b")))).select(*df.columns)


def missing_numbers(df: DataFrame, doc: str, no: str, first: int = 0) -> DataFrame:
    """(doc, missing): numbers of first..max that a document lacks."""
    m = df.groupBy(doc).agg(F.max(no).alias("m"))
    want = m.select(doc, F.explode(F.sequence(F.lit(first).cast("long"), F.col("m").cast("long"))).alias("missing"))
    return want.join(df.select(doc, F.col(no).cast("long").alias("missing")), [doc, "missing"], "left_anti")


def group_centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, value): the unit-length mean of each group's vectors, by dimension."""
    e = df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    n = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(group)))
    return e.select(group, F.col("dim").cast("long").alias("dim"), F.round(F.col("m") / n, 6).alias("value"))
