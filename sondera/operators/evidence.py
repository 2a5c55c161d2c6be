"""Evidence: budgets, packing of parents and neighbours, citation binding, grounding of answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import citations, numbers

PER_BUNDLE, IN_ALL = 650, 2600


def within_budget(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """The newest rows of each group whose sizes add up to the budget at most (a running sum from the last)."""
    w = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def pack_evidence(anchors: DataFrame, children: DataFrame, per_bundle: int = PER_BUNDLE, in_all: int = IN_ALL) -> DataFrame:
    """Bundles of evidence for each query: (query_id, bundle_no, parent_id, scope, child_ids, n_tokens).

    anchors(query_id, child_id, score), children(child_id, parent_id, pos, tokens). Anchors are grouped by parent, best
    score first. A parent comes whole if it fits the bundle and what is left; else its anchors, then siblings by
    distance while they fit; siblings that are anchors elsewhere are left to them. Later picks depend on what earlier
    ones used, so a query is handled whole: its anchors and their parents' children, a bounded candidate list.
    """
    fam = anchors.join(children.select("child_id", "parent_id"), "child_id").select("query_id", "parent_id").distinct()
    rows = fam.join(children, "parent_id").join(anchors, ["query_id", "child_id"], "left")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p, left, out = p.sort_values(["parent_id", "pos", "child_id"]), in_all, []
        best = p.groupby("parent_id")["score"].max().sort_values(ascending=False, kind="stable")
        for parent in best.index:
            g = p[p["parent_id"] == parent]
            room, total = min(per_bundle, left), int(g["tokens"].sum())
            if total <= room:
                ids, used, scope = list(g["child_id"]), total, "full_parent"
            else:
                a = g[g["score"].notna()].sort_values(["score", "pos"], ascending=[False, True])
                ids, used = [], 0
                for r in a.itertuples():
                    if used + r.tokens <= room:
                        ids.append(r.child_id)
                        used += r.tokens
                if not ids:
                    continue
                at, scope = g[g["child_id"].isin(ids)]["pos"], "anchor_only"
                rest = g[g["score"].isna()].assign(far=lambda x: x["pos"].map(lambda v: (at - v).abs().min())).sort_values(["far", "pos"])
                for r in rest.itertuples():
                    if used + r.tokens <= room:
                        ids.append(r.child_id)
                        used, scope = used + r.tokens, "partial_parent"
            left -= used
            out.append((p["query_id"].iloc[0], len(out) + 1, parent, scope, sorted(ids), used))
        return pd.DataFrame(out, columns=["query_id", "bundle_no", "parent_id", "scope", "child_ids", "n_tokens"])

    cols = ["query_id", "parent_id", "child_id", "pos", "tokens", "score"]
    return rows.select(*cols).groupBy("query_id").applyInPandas(run, "query_id long, bundle_no long, parent_id long, scope string, child_ids array<long>, n_tokens long")


def fair_share(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Budget dealt over a group's sources in order: each may use what is left divided by the sources left; what it doesn't
    use is carried on."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p, left, got = p.sort_values(order, kind="stable"), budget, []
        for i, n in enumerate(p[size]):
            got.append(min(int(n), left // (len(p) - i)))
            left -= got[-1]
        return p.assign(share=got)

    return df.select(group, order, size).groupBy(group).applyInPandas(run, f"{group} long, {order} long, {size} long, share long")


def citation_check(answers: DataFrame, n_sources: str) -> DataFrame:
    """Adds cited (numbers in order of appearance), n_out_of_range and valid (at least one, all in 1..n_sources)."""
    c = answers.withColumn("cited", citations(F.col("text")))
    out = F.size(F.filter("cited", lambda x: x.cast("long") > F.col(n_sources))).cast("long")
    return c.withColumn("n_out_of_range", out).withColumn("valid", (F.size("cited") > 0) & (F.col("n_out_of_range") == 0))


def ungrounded_numbers(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, n_numbers, n_missing), one row a key of claims(key, text): the distinct numbers that its claims state, and how many
    of them its evidence(key, text) lacks. Numbers are made distinct before they meet, texts never do. A key without
    numbers, or with null texts alone, has zeros; a null key has no evidence."""
    e = evidence.select(key, F.explode(numbers(F.col("text"))).alias("_n")).distinct().withColumn("_held", F.lit(1))
    c = claims.select(key, F.explode_outer(numbers(F.col("text"))).alias("_n")).distinct()
    missing = F.count(F.when(F.col("_held").isNull() & F.col("_n").isNotNull(), 1))
    return c.join(e, [key, "_n"], "left").groupBy(key).agg(F.count("_n").alias("n_numbers"), missing.alias("n_missing"))


def focused_windows(df: DataFrame, budget: int) -> DataFrame:
    """Adds window: of df(…, text, terms) the stretch of sentences around the one with most of the terms, grown on the side
    with more terms until `budget` characters are reached; a text within the budget stays whole."""
    import re

    @F.pandas_udf("string")
    def pick(text: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for t, w in zip(text, terms, strict=True):
            if t is None or len(t) <= budget:
                out.append(t)
                continue
            s = re.split(r"(?<=[.!?])\s+", t)
            hits = [sum(x in part.lower() for x in ([] if w is None else w)) for part in s]
            lo = max(range(len(s)), key=lambda i: (hits[i], -abs(i - len(s) / 2)))
            hi, size = lo + 1, len(s[lo])
            while True:
                left = hits[lo - 1] if lo and size + len(s[lo - 1]) + 1 <= budget else -1
                right = hits[hi] if hi < len(s) and size + len(s[hi]) + 1 <= budget else -1
                if left < 0 and right < 0:
                    break
                if right >= left:
                    size, hi = size + len(s[hi]) + 1, hi + 1
                else:
                    lo, size = lo - 1, size + len(s[lo - 1]) + 1
            out.append(" ".join(s[lo:hi])[:budget])
        return pd.Series(out, dtype=object)

    return df.withColumn("window", pick("text", "terms"))
