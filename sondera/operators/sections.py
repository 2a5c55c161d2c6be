"""Search of sections before chunks: candidates by section, boosts, a cap by document, then only the winners' chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from . import fusion
from .search import K1, B, Index, bm25, query_terms, ranked, rows_of, sparse, sparse_vectors

#: Times that the tokens of a section's path count.
PATH = 3
#: Boosts of preferred and penalised content, of a term in the path and all such terms, sections of a document.
PREFERRED, PENALISED, TERM, TERMS, PER_DOCUMENT = 0.045, -0.06, 0.02, 0.06, 3


def chunk_postings(chunks: DataFrame) -> DataFrame:
    """Postings of chunks(chunk_id, section_id, text) that carry their section: (doc_id, section_id, dl, tok, tf)."""
    t = chunks.select(F.col("chunk_id").alias("doc_id"), "section_id", tokens(F.col("text")).alias("toks"))
    return t.select("doc_id", "section_id", F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("tok")).groupBy("doc_id", "section_id", "dl", "tok").agg(F.count("*").alias("tf"))


def index_of(postings: DataFrame, n_docs: int) -> Index:
    """An index over stored postings(doc_id, dl, tok, tf)."""
    total = postings.agg(F.sum("tf").alias("n")).first()["n"] or 0
    return Index(rows_of(postings), postings.groupBy("tok").agg(F.count("*").alias("df")), float(n_docs), total / max(1, n_docs) or 1.0)


def section_postings(postings: DataFrame, sections: DataFrame) -> DataFrame:
    """Postings of sections (doc_id = section_id): sums over their chunks, and the path's tokens PATH times. No text of a section
    is ever joined: counts are summed before they are shuffled."""
    path = sections.select("section_id", F.explode(tokens(F.col("hierarchy_path"))).alias("tok"), F.lit(PATH).cast("long").alias("tf"))
    s = postings.select("section_id", "tok", "tf").union(path).groupBy("section_id", "tok").agg(F.sum("tf").alias("tf"))
    return s.select(F.col("section_id").alias("doc_id"), F.sum("tf").over(Window.partitionBy("section_id")).alias("dl"), "tok", "tf")


def search_sections(index: Index, sections: DataFrame, questions: DataFrame, k: int = 8, candidates: int = 30, low_value: str | None = None) -> DataFrame:
    """(query_id, section_id, doc, score, rank): fused BM25 and sparse candidates with boosts, at most PER_DOCUMENT a document.

    sections(section_id, doc, hierarchy_path, page_start, kinds); questions(query_id, text, preferred, penalised), the last two
    arrays of kinds (null: none). low_value: a pattern of paths that are no candidates. Boosts are of the candidates alone.
    """
    q = questions.select("query_id", "text")
    runs = fusion.runs(bm25=bm25(index, q, candidates), sparse=sparse(index, sparse_vectors(q, "query_id"), candidates))
    score = F.round(F.sum(1.0 / (fusion.RRF_K + F.col("rank"))), 9)
    c = runs.groupBy("query_id", "doc_id").agg(score.alias("rrf"), F.max(F.when(F.col("retriever") == "sparse", F.col("score"))).alias("sparse_score")).withColumnRenamed("doc_id", "section_id")
    c = c.join(sections.select("section_id", "doc", "hierarchy_path", "page_start", "kinds"), "section_id")
    if low_value:
        c = c.where(~F.col("hierarchy_path").rlike(low_value))
    c = c.join(questions.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms"), "preferred", "penalised"), "query_id")
    titles = F.size(F.array_intersect("terms", tokens(F.col("hierarchy_path"))))
    boost = (
        F.when(F.arrays_overlap("kinds", "preferred"), PREFERRED).otherwise(0.0) + F.when(F.arrays_overlap("kinds", "penalised"), PENALISED).otherwise(0.0)
        + F.least(F.lit(TERMS), titles * TERM)
    )
    c = c.withColumn("score", F.round(F.col("rrf") + boost, 9))
    order = [F.desc("score"), F.desc(F.coalesce("sparse_score", F.lit(-1.0))), F.asc("doc"), F.asc("page_start"), F.asc("section_id")]
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc").orderBy(*order))).where(F.col("_n") <= PER_DOCUMENT)
    return ranked(c, k, order).select("query_id", "section_id", "doc", "score", "rank")


def search_chunks(postings: DataFrame, index: Index, winners: DataFrame, questions: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 of chunks in each question's own winning sections(query_id, section_id).

    Statistics are of all chunks (index); postings are met by (section, token) of the winners, so those of other sections
    never leave the scan's partial join.
    """
    idf = F.log(1 + (index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = query_terms(questions).join(index.frequencies, "tok").select("query_id", "tok", "qtf", idf.alias("idf"))
    ask = winners.select("query_id", "section_id").join(terms, "query_id")
    weight = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / index.avgdl)) * F.col("qtf")
    hits = postings.join(ask, ["section_id", "tok"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return ranked(hits.where("score > 0"), k)
