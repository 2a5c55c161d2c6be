"""Rank fusion over long tables of runs: (query_id, retriever, doc_id, rank, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60


def runs(**by_name: DataFrame) -> DataFrame:
    """One long table of several searches."""
    out = None
    for name, df in by_name.items():
        part = df.select("query_id", F.lit(name).alias("retriever"), "doc_id", F.col("rank").cast("long").alias("rank"), F.col("score").cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def weight(weights: dict[str, float] | None) -> Column:
    out = F.lit(1.0)
    for name, w in (weights or {}).items():
        out = F.when(F.col("retriever") == name, F.lit(float(w))).otherwise(out)
    return out


def first_ranks(ranked: DataFrame, k: int | None) -> DataFrame:
    """Ranks 1 to k, all where k is None."""
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def rrf(long: DataFrame, k: int | None, weights: dict[str, float] | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (rrf_k + rank) over the retrievers that hit; a retriever that misses adds nothing.

    Order: score, number of retrievers, best rank, id. One shuffle: the full outer merge of the runs is a union with a
    grouped sum.
    """
    s = long.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight(weights) / (rrf_k + F.col("rank"))), 9).alias("score"), F.count("*").alias("n_retrievers"), F.min("rank").alias("best_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("n_retrievers"), "best_rank", "doc_id")
    return first_ranks(s.withColumn("rank", F.row_number().over(w).cast("long")), k)


def min_max(long: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Sum of weighted scores scaled to 0..1 within each query and retriever (0 where all are equal)."""
    w = Window.partitionBy("query_id", "retriever")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    s = long.withColumn("_s", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0) * weight(weights))
    s = s.groupBy("query_id", "doc_id").agg(F.round(F.sum("_s"), 6).alias("score"), F.countDistinct("retriever").alias("n_retrievers"))
    o = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("n_retrievers"), "doc_id")
    return s.withColumn("rank", F.row_number().over(o).cast("long")).where(F.col("rank") <= k)


def planned(long: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Fusion of several roles' runs (query_id, role, retriever, doc_id, rank, score): contributions add up over roles and
    retrievers. Order: score, number of roles, id. Carries each retriever's best rank."""
    s = long.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"), F.countDistinct("role").alias("n_roles"),
        F.min("rank").alias("best_rank"), F.min_by("score", "rank").alias("score_at_best"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("n_roles"), "doc_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def multi_query(long: DataFrame) -> DataFrame:
    """Over several formulations of a query: least rank and number of supporting runs for each retriever and document."""
    return long.groupBy("query_id", "retriever", "doc_id").agg(F.min("rank").alias("rank"), F.count("*").alias("support"))


def round_robin(long: DataFrame, order: list[str], k: int) -> DataFrame:
    """Rank 1 of each retriever in the given order, then rank 2, and so on; a document counts where it first appears."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("retriever"))
    first = long.withColumn("_o", F.struct("rank", at.alias("at"))).groupBy("query_id", "doc_id").agg(F.min("_o").alias("_o"))
    w = Window.partitionBy("query_id").orderBy("_o", "doc_id")
    return first.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("_o")


def reserve_then_fill(reserved: DataFrame, fused: DataFrame, k: int | None) -> DataFrame:
    """Reserved documents in their order, then fused ones in theirs, each once, k in all."""
    both = reserved.select("query_id", "doc_id", F.lit(1).alias("tier"), "rank").union(fused.select("query_id", "doc_id", F.lit(2).alias("tier"), "rank"))
    first = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("tier", "rank")).alias("_o"))
    w = Window.partitionBy("query_id").orderBy("_o", "doc_id")
    return first_ranks(first.select("query_id", "doc_id", F.col("_o.tier").cast("long").alias("tier"), F.row_number().over(w).cast("long").alias("rank")), k)


def safeguard(reranked: DataFrame, lexical: DataFrame, k: int, slots: int) -> DataFrame:
    """Reranked down to k - slots, then the lexical search's first `slots` if not yet taken (one already taken burns its slot),
    then reranked again, k in all, with the tier that each comes from."""
    t1 = reranked.where(F.col("rank") <= k - slots).select("query_id", "doc_id", F.lit("reranker").alias("tier"), F.lit(1).alias("_t"), "rank")
    t2 = lexical.where(F.col("rank") <= slots).select("query_id", "doc_id", F.lit("lexical").alias("tier"), F.lit(2).alias("_t"), "rank")
    t3 = reranked.select("query_id", "doc_id", F.lit("fill").alias("tier"), F.lit(3).alias("_t"), "rank")
    one = Window.partitionBy("query_id", "doc_id").orderBy("_t", "rank")
    u = t1.union(t2).union(t3).withColumn("_n", F.row_number().over(one)).where("_n = 1")
    w = Window.partitionBy("query_id").orderBy("_t", "rank", "doc_id")
    return u.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= k).select("query_id", "doc_id", "tier", "position")


def cap_per_group(hits: DataFrame, group: str, cap: int, k: int) -> DataFrame:
    """Top k of each query with at most `cap` of a group (a skipped row never frees a slot)."""
    inner = Window.partitionBy("query_id", group).orderBy(F.desc("score"), "doc_id")
    outer = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    h = hits.withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= cap)
    return h.withColumn("position", F.row_number().over(outer).cast("long")).where(F.col("position") <= k).drop("_n")


def document_rank(hits: DataFrame, top: int = 3) -> DataFrame:
    """Documents by the sum of 1 / rank over their best `top` hits, then best rank, hits and id. hits(query_id, group_id, rank)."""
    w = Window.partitionBy("query_id", "group_id").orderBy("rank")
    h = hits.where("rank > 0").withColumn("_n", F.row_number().over(w))
    g = h.groupBy("query_id", "group_id").agg(F.round(F.sum(F.when(F.col("_n") <= top, 1.0 / F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("hits"))
    o = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("best_rank", F.lit(1_000_000_000)), F.desc("hits"), "group_id")
    return g.withColumn("position", F.row_number().over(o).cast("long"))


def reserve_by_role(long: DataFrame, per_role: int) -> DataFrame:
    """Each role in turn takes its best `per_role` documents that no earlier role has taken. long(query_id, role_no, doc_id, rank).

    Later picks depend on earlier ones, so a query's candidates (a few roles by a bounded depth) are handled together.
    """
    import pandas as pd

    def run(p: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for role, g in p.sort_values(["role_no", "rank", "doc_id"]).groupby("role_no", sort=True):
            n = 0
            for r in g.itertuples():
                if n < per_role and r.doc_id not in taken:
                    taken.add(r.doc_id)
                    n += 1
                    out.append((r.query_id, role, r.doc_id, n))
        return pd.DataFrame(out, columns=["query_id", "role_no", "doc_id", "pick"])

    return long.select("query_id", "role_no", "doc_id", "rank").groupBy("query_id").applyInPandas(run, "query_id long, role_no long, doc_id long, pick long")


def two_caps(hits: DataFrame, inner: str, outer: str, per_inner: int, per_outer: int, k: int) -> DataFrame:
    """Top k of each query by score with at most `per_inner` of an inner and `per_outer` of an outer group. The caps act on
    each other (a row that one skips leaves room in the other), so a query's candidates are taken one by one."""
    import pandas as pd

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a, b, out = {}, {}, []
        for r in p.sort_values(["score", "doc_id"], ascending=[False, True]).itertuples():
            x, y = getattr(r, inner), getattr(r, outer)
            if len(out) < k and a.get(x, 0) < per_inner and b.get(y, 0) < per_outer:
                a[x], b[y] = a.get(x, 0) + 1, b.get(y, 0) + 1
                out.append((r.query_id, r.doc_id, len(out) + 1))
        return pd.DataFrame(out, columns=["query_id", "doc_id", "position"])

    return hits.select("query_id", "doc_id", "score", inner, outer).groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, position long")


def one_per_role(ranked: DataFrame, by_role: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, position, origin): for each role in order its best document not yet taken (its best, if all are), then
    the ranking, k in all. ranked(query_id, doc_id, rank), by_role(query_id, role_no, doc_id, rank): bounded candidate lists."""
    import pandas as pd

    u = ranked.select("query_id", F.lit(0).cast("long").alias("role_no"), "doc_id", "rank").union(by_role.select("query_id", "role_no", "doc_id", "rank"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p, got = p.sort_values(["role_no", "rank", "doc_id"]), {}
        for role, g in p[p["role_no"] > 0].groupby("role_no", sort=True):
            free = [d for d in g["doc_id"] if d not in got]
            d = free[0] if free else g["doc_id"].iloc[0]
            got[d] = f"{got[d]}+{role}" if d in got else f"role {role}"
        for d in p[p["role_no"] == 0]["doc_id"]:
            got.setdefault(d, "fill")
        return pd.DataFrame([(p["query_id"].iloc[0], d, i + 1, o) for i, (d, o) in enumerate(list(got.items())[:k])], columns=["query_id", "doc_id", "position", "origin"])

    return u.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, position long, origin string")
