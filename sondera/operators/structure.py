"""Structure of paged documents: heading stack carried across pages, text units under it, linked children, parents and sections.

The heading in force at a level is the latest heading of that level, unless a higher one came later. "Latest" is a maximum
of positions, which combines in any grouping: pages are reduced apart, then blocks of pages, and what a page inherits is a
prefix maximum over those few rows. So no task holds a document, however many pages it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import estimated_tokens

#: Page numbers of a block: pages are combined within blocks, then blocks within a document.
PAGES = 1024
LEVELS = 6
#: Token sizes of a parent (aim, most).
PARENT_TARGET, PARENT_MOST = 1250, 1700


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: Stands for a heading between two replacements; markup that holds it takes the longer way.
_MARK = "\x01"


def markup_lines(html: Column) -> Column:
    """Markup as lines: headings with as many # as their level, list items with a dash, blocks apart by blank lines."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->", "")
    marked = F.regexp_replace(x, r"(?i)<h([1-6])(?:\s[^>]*)?>", f"{_MARK}$1")
    plain = x
    for k in range(1, LEVELS + 1):
        marked = F.replace(marked, F.lit(f"{_MARK}{k}"), F.lit(f"\n\n{'#' * k} "))
        plain = F.regexp_replace(plain, rf"(?i)<h{k}(?:\s[^>]*)?>", f"\n\n{'#' * k} ")
    x = F.when(F.contains(x, F.lit(_MARK)), plain).otherwise(marked)
    x = F.regexp_replace(x, r"(?i)<li(?:\s[^>]*)?>", "\n- ")
    x = F.regexp_replace(x, r"(?i)</?(?:p|br|div|ul|ol|footer|article|nav|h[1-6])(?:\s[^>]*)?/?>", "\n\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def lines(pages: DataFrame, *carried: str) -> DataFrame:
    """(doc, page, at, line, level, title, kind) of pages(doc, page, text): trimmed lines; level and title of headings (marked by
    #, or short lines in capitals); kind heading, table, text or blank. Image marks go, their captions stay. A null text
    is empty; pages are told apart by (doc, page)."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)<!--\s*image\s*-->", "")
    t = strip(F.regexp_replace(t, r"!\[([^\]]*)\]\([^)]*\)", "$1"))
    x = pages.select("doc", "page", *carried, F.posexplode(F.split(t, "\r\n|\r|\n")).alias("at", "line")).withColumn("line", strip(F.col("line")))
    line = F.col("line")
    marks = F.when(line.startswith("#"), F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))).otherwise(0)
    words = F.regexp_count(line, F.lit(r"\S+"))
    plain = (F.length(line) <= 100) & (line == F.upper(line)) & ~line.endswith(".") & words.between(1, 12) & (F.regexp_count(line, F.lit(r"\p{L}")) >= 4)
    level = F.when(marks > 0, marks).when(plain, F.when(line.startswith("CHAPTER "), 1).otherwise(2)).cast("int")
    x = x.withColumn("level", level)
    title = F.when(marks > 0, F.regexp_replace(line, r"^#{1,6}\s+", "")).when(F.col("level").isNotNull(), line)
    kind = F.when(line == "", "blank").when(F.col("level").isNotNull(), "heading").when(line.startswith("|") & line.rlike(r"^\|.*\|$"), "table").otherwise("text")
    return x.withColumns({"title": title, "kind": kind})


_S = [f"s{k}" for k in range(1, LEVELS + 1)]


def _latest(found: bool = True) -> list[Column]:
    """For each level the latest heading of a group of lines."""
    return [F.max(F.when(F.col("level") == k, F.struct("page", "at", "title"))).alias(s) if found else F.max(s).alias(s) for k, s in enumerate(_S, 1)]


def path_of(states: list[Column]) -> Column:
    """The path of headings in force, given the latest heading (page, at, title) of each level; levels passed over are empty."""
    place = lambda s: F.struct(s["page"], s["at"])
    last = F.greatest(*(F.when(s.isNotNull(), F.struct(s["page"], s["at"], F.lit(k).alias("k"))) for k, s in enumerate(states, 1)))
    titles = []
    for k, s in enumerate(states):
        over = F.greatest(*(F.when(x.isNotNull(), place(x)) for x in states[:k])) if k > 1 else F.when(states[0].isNotNull(), place(states[0])) if k else None
        shown = s.isNotNull() if over is None else s.isNotNull() & (over.isNull() | (place(s) > over))
        titles.append(F.when(shown, s["title"]).otherwise(""))
    return F.when(last.isNull(), F.array().cast("array<string>")).otherwise(F.slice(F.array(*titles), F.lit(1), F.coalesce(last["k"], F.lit(1))))


#: Stores a table that is read more than once, and reads it back; by default nothing is stored.
Keep = Callable[[DataFrame, str], DataFrame]


def _plain(df: DataFrame, name: str) -> DataFrame:
    return df


def _block(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("page") / PAGES))


def heading_paths(pages: DataFrame, keep: Keep = _plain) -> DataFrame:
    """(doc, page, before, paths): of each page the path that it inherits, and (at, path) of its headings in order. Only headings
    are rows here, and what blocks and pages inherit goes by rows of latest headings."""
    h = keep(lines(pages).where("level IS NOT NULL").select("doc", "page", "at", "level", "title"), "headings")
    page = _block(pages.select("doc", "page")).join(h.groupBy("doc", "page").agg(*_latest()), ["doc", "page"], "left")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    block = page.groupBy("doc", "block").agg(*_latest(False))
    block = block.select("doc", "block", *(F.max(s).over(before("doc", "block")).alias(f"b_{s}") for s in _S))
    given = page.select("doc", "block", "page", *(F.max(s).over(before("doc", "block", "page")).alias(f"p_{s}") for s in _S)).join(block, ["doc", "block"])
    given = given.select("doc", "page", *(F.greatest(f"p_{s}", f"b_{s}").alias(f"g_{s}") for s in _S))
    here = Window.partitionBy("doc", "page").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = h.select("doc", "page", "at", *(F.max(F.when(F.col("level") == k, F.struct("page", "at", "title"))).over(here).alias(s) for k, s in enumerate(_S, 1)))
    x = given.join(own, ["doc", "page"], "left")
    path = F.when(F.col("at").isNotNull(), F.struct("at", path_of([F.greatest(s, f"g_{s}") for s in _S]).alias("path")))
    x = x.select("doc", "page", path_of([F.col(f"g_{s}") for s in _S]).alias("before"), path.alias("p"))
    return x.groupBy("doc", "page").agg(F.first("before").alias("before"), F.array_sort(F.collect_list("p")).alias("paths"))


def headings(pages: DataFrame) -> DataFrame:
    """(doc, page, at, path): each heading with the path in force from it on."""
    return heading_paths(pages).select("doc", "page", F.explode("paths").alias("p")).select("doc", "page", "p.at", "p.path")


def units(pages: DataFrame, keep: Keep = _plain) -> DataFrame:
    """(doc, page, unit_no, kind, path, text) of pages(doc, page, text): tables, captions and paragraphs under their headings.

    Lines that follow each other make a unit; blank lines, headings, and a change between table and text end it, as a page
    does. A paragraph's lines are joined by spaces, lists and tables keep their lines. Pages without text have no units.
    Texts are shuffled once: to their page's paths, by which they then stay dealt.
    """
    x = lines(pages.join(heading_paths(pages, keep), ["doc", "page"]), "before", "paths")
    here = Window.partitionBy("doc", "page").orderBy("at")
    x = x.withColumns({"_new": (~F.lag("kind").over(here).eqNullSafe(F.col("kind"))).cast("int"), "_h": F.sum((F.col("kind") == "heading").cast("int")).over(here)})
    x = x.withColumn("_no", F.sum("_new").over(here)).where("kind IN ('table', 'text')")
    path = F.when(F.col("_h") == 0, F.col("before")).otherwise(F.get("paths", F.col("_h") - 1)["path"])
    u = x.select("doc", "page", "_no", "kind", path.alias("path"), "at", "line").groupBy("doc", "page", "_no").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"), F.first("kind").alias("kind"), F.first("path").alias("path"))
    u = u.withColumn("l", F.transform("l", lambda y: y["line"]))
    as_lines = (F.col("kind") == "table") | F.exists("l", lambda y: y.rlike(r"^([-*+]|\d+[.)])\s+"))
    u = u.withColumn("text", F.when(as_lines, F.array_join("l", "\n")).otherwise(F.array_join("l", " ")))
    kind = F.when(F.col("kind") == "table", "table").when(F.lower("text").rlike(r"^(fig\.|figure |table |diagram )"), "caption").otherwise("paragraph")
    return u.select("doc", "page", F.row_number().over(Window.partitionBy("doc", "page").orderBy("_no")).cast("long").alias("unit_no"), kind.alias("kind"), "path", "text")


def _digest(n: int, *parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, n)


def heading_fields(u: DataFrame) -> DataFrame:
    """units() with h (headings that are not empty), chapter, section, subsection and hierarchy_path; units without headings
    belong to sections of five pages."""
    u = u.withColumn("h", F.filter("path", lambda p: p != "")).withColumn("n", F.size("h"))
    at = lambda k: F.get("h", k)
    u = u.withColumns({
        "chapter": F.when(F.col("n") == 2, at(F.lit(0))).when(F.col("n") > 2, at(F.col("n") - 3)),
        "section": F.when(F.col("n") == 1, at(F.lit(0))).when(F.col("n") == 2, at(F.lit(1))).when(F.col("n") > 2, at(F.col("n") - 2)),
        "subsection": F.when(F.col("n") > 2, at(F.col("n") - 1)),
    })
    first = (F.floor((F.col("page") - 1) / 5) * 5 + 1).cast("long")
    bare = F.concat(F.lit("Unlabelled pages "), first.cast("string"), F.lit("-"), (first + 4).cast("string"))
    return u.withColumn("hierarchy_path", F.concat_ws(" > ", "doc", "chapter", "section", "subsection", F.when(F.col("n") == 0, bare)))


def linked(u: DataFrame, excluded: str | None = None, keep: Keep = _plain) -> DataFrame:
    """The units that are children, without their texts: (doc, page, unit_no, kind, tokens, chunk_id, part, run_page, run_unit,
    previous_chunk_id, next_chunk_id). part is the digest of the section; a run is a stretch of one section, named by its first unit.

    excluded: a pattern; units that hold it in their first 500 characters on the first five pages go. Units that repeat on
    a page share a digest; the later ones' ids are numbered. Neighbours and runs go by blocks of pages: only a block's
    first and last unit, and the run that it inherits, look at other blocks.
    """
    if excluded:
        u = u.where(~(F.substring("text", 1, 500).rlike(excluded) & (F.col("page") <= 5)))
    u, p = heading_fields(u), F.col("page").cast("string")
    u = _block(u).select(
        "doc", "block", "page", "unit_no", "kind", estimated_tokens(F.col("text")).alias("tokens"), _digest(16, "doc", "hierarchy_path").alias("part"),
        F.xxhash64("chapter", F.col("chapter").isNull(), "section", F.col("section").isNull()).alias("near"), _digest(16, F.col("doc"), p, p, F.array_join("h", " > "), F.col("text")).alias("d"),
    )
    u = u.withColumn("_again", F.row_number().over(Window.partitionBy("doc", "block", "page", "d").orderBy("unit_no")))
    u = u.withColumn("d", F.concat("d", F.when(F.col("_again") > 1, F.concat(F.lit("_"), F.col("_again").cast("string"))).otherwise(""))).drop("_again")
    row = F.struct("page", "unit_no", "part", "near", "d")
    within, between = (Window.partitionBy(*by).orderBy(*o) for by, o in ((("doc", "block"), ("page", "unit_no")), (("doc",), ("block",))))
    u = u.withColumns({"_lag": F.lag(row).over(within), "_lead": F.lead(row).over(within)})
    begins = F.when(F.col("_lag").isNotNull() & (F.col("_lag")["part"] != F.col("part")), F.struct("page", "unit_no"))
    u = keep(u.withColumn("_run", F.max(begins).over(within.rowsBetween(Window.unboundedPreceding, 0))), "linked")
    edge = u.groupBy("doc", "block").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.max("_run").alias("_run"))
    edge = edge.withColumns({"_before": F.lag("last").over(between), "_after": F.lead("first").over(between)})
    head = F.when(F.col("_before").isNull() | (F.col("_before")["part"] != F.col("first")["part"]), F.struct(F.col("first")["page"].alias("page"), F.col("first")["unit_no"].alias("unit_no")))
    edge = edge.withColumn("_head", head)  # the run that the block's first unit begins, if it does
    upto = between.rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select("doc", "block", "_before", "_after", F.coalesce("_head", F.max(F.greatest("_head", "_run")).over(upto)).alias("_given"))
    u = u.join(edge, ["doc", "block"]).withColumn("_run", F.coalesce("_run", "_given"))
    name = lambda d: F.concat("doc", F.lit("_"), d)
    beside = lambda x: F.when(x["near"] == F.col("near"), name(x["d"]))
    return u.select(
        "doc", "page", "unit_no", "kind", "tokens", name(F.col("d")).alias("chunk_id"), "part", F.col("_run")["page"].alias("run_page"), F.col("_run")["unit_no"].alias("run_unit"),
        beside(F.coalesce("_lag", "_before")).alias("previous_chunk_id"), beside(F.coalesce("_lead", "_after")).alias("next_chunk_id"),
    )


def with_parents(c: DataFrame, target: int = PARENT_TARGET, most: int = PARENT_MOST) -> DataFrame:
    """linked() with texts as (..., parent_id), without the texts: children of a run fill a parent until it has `target` tokens or
    would pass `most`. A run's rows stream in order through one task, which holds one parent; the id is a digest of
    the document, the first and last child and the joined text."""
    kinds = [(n, t) for n, t in c.dtypes if n != "text"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, have = None, 0
        ids: list[str] = []
        texts: list[str] = []
        rows: list[pa.RecordBatch] = []  # of the open parent

        def close(k: list) -> Iterator[pa.RecordBatch]:
            if ids:
                name = "\x1f".join([k[0], ids[0], ids[-1], "\n\n".join(texts)])
                parent = f"{k[0]}_parent_{hashlib.sha256(name.encode()).hexdigest()[:16]}"
                for r in rows:
                    yield pa.RecordBatch.from_arrays([*r.columns, pa.array([parent] * r.num_rows)], names=[*r.schema.names, "parent_id"])
                ids.clear(), texts.clear(), rows.clear()

        for b in batches:
            plain, first = b.select([n for n, _ in kinds]), 0
            done: list[pa.RecordBatch] = []
            for at, (*k, n, i, t) in enumerate(zip(*(b.column(x).to_pylist() for x in ("doc", "run_page", "run_unit", "tokens", "chunk_id", "text")), strict=True)):
                if k != key or have + n > most or have >= target:
                    if at > first:
                        rows.append(plain.slice(first, at - first))
                    done += close(key)
                    key, have, first = k, 0, at
                have += n
                ids.append(i)
                texts.append(t)
            if b.num_rows > first:
                rows.append(plain.slice(first))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        yield from close(key)

    run = ["doc", "run_page", "run_unit"]
    return c.repartition(*run).sortWithinPartitions(*run, "page", "unit_no").mapInArrow(fill, ", ".join(f"{n} {t}" for n, t in kinds) + ", parent_id string")


def parent_texts(u: DataFrame, c: DataFrame) -> DataFrame:
    """(parent_id, text): the joined texts of each parent's children."""
    t = u.select("doc", "page", "unit_no", "text").join(c.select("doc", "page", "unit_no", "parent_id"), ["doc", "page", "unit_no"])
    l = F.array_sort(F.collect_list(F.struct("page", "unit_no", "text")))
    return t.groupBy("parent_id").agg(F.array_join(F.transform(l, lambda x: x["text"]), "\n\n").alias("text"))


def hierarchy(pages: DataFrame, excluded: str | None = None, keep: Keep = _plain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(children, parents, sections) of the units of pages(doc, page, text), with each other's ids.

    Each child is in one parent and one section, each parent in one section. A parent holds its children's ids in order
    (parent_texts() joins their texts); a section holds counts, pages and its first child, as its children can be many.
    """
    u = keep(units(pages, keep), "units")
    c = linked(u, excluded, keep).join(u.select("doc", "page", "unit_no", "text"), ["doc", "page", "unit_no"])
    c = keep(with_parents(c), "children")
    section = F.concat("doc", F.lit("_section_"), "part").alias("section_id")
    p = c.groupBy("doc", "part", "parent_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "unit_no", "chunk_id"))).alias("l"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum("tokens").alias("tokens"),
    )
    p = p.select("doc", "parent_id", section, "page_start", "page_end", "tokens", F.transform("l", lambda x: x["chunk_id"]).alias("child_chunk_ids"))
    fields = ["hierarchy_path", "chapter", "section", "subsection"]
    names = heading_fields(u.select("doc", "page", "path").distinct()).withColumn("part", _digest(16, "doc", "hierarchy_path"))
    names = names.groupBy("doc", "part").agg(F.min(F.struct(*fields)).alias("f")).select("doc", "part", "f.*")
    s = c.groupBy("doc", "part").agg(
        F.count("*").alias("n_children"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum("tokens").alias("tokens"),
        F.min(F.struct("page", "unit_no", "chunk_id"))["chunk_id"].alias("first_chunk_id"), F.collect_set("kind").alias("kinds"),
    )
    s = keep(s.join(names, ["doc", "part"]).select("doc", section, "hierarchy_path", "chapter", "section", "subsection", "n_children", "page_start", "page_end", "tokens", "first_chunk_id", "kinds"), "sections")
    return c.select("doc", "page", "unit_no", "kind", "tokens", "chunk_id", "parent_id", section, "previous_chunk_id", "next_chunk_id"), p, s
