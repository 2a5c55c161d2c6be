"""Quality rules: fixed rules, then robust multivariate outliers.

Minimum-covariance-determinant estimates for each language and source, by deterministic concentration steps over
all rows; small groups lean on their language. A document is rejected if its transformed statistics are far by Mahalanobis distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_TABLE, Scratch, WordCode, rows, text_slices, texts_of

#: Fixed rules of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\v\f\r"
_NOT_CHARS = SPACE + bytes(range(0x80, 0xC0))

#: Transformed statistics, and the least scale of each: below it, spread is of no interest.
FEATURES = {"x_word": 0.08, "x_symbol": 0.15, "x_dup": 0.1, "x_repeat": 0.1, "x_line": 0.5}
#: Statistics are rounded to so many parts of one, and held as integers: their sums are exact in any order.
UNIT = 4096
#: Share of a group's rows that the estimate is concentrated on, concentration steps at most, and the mean fall of the log
#: determinants below which they end.
SUBSET, STEPS, LEAST_FALL = 0.75, 12, 1e-3
#: Groups whose estimates are broadcast at most (some 400 bytes each); more are joined.
FEW_GROUPS = 50_000
#: Parts of a stored table of so few groups.
SMALL_PARTS = 8
#: Rows' worth of its language that a source's estimate takes in, and of all rows that a language's does.
PRIOR = 60.0
#: A row is rejected if so unlikely under the chi-square law of the distance, times the slack for heavy tails.
ALPHA, SLACK = 1e-5, 3.0
P = len(FEATURES)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def chi2(q: float, p: int = P) -> float:
    """Chi-square quantile (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * (2 / (9 * p)) ** 0.5) ** 3


def repeated_words(code: np.ndarray, width: int) -> int:
    """Words covered by 3-word windows that the text holds twice or more; code: a number below 2**width for each word."""
    if len(code) < 4:
        return 0
    w = np.uint64(width)
    c = code.astype(np.uint64)
    if width <= 21:
        key = ((c[:-2] << w) | c[1:-1]) << w | c[2:]
    else:  # numbers of pairs first
        _, pair = np.unique(c[:-1] << np.uint64(32) | c[1:], return_inverse=True)
        key = pair[:-1].astype(np.uint64) << np.uint64(32) | c[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(code), bool)
    at = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text (null: none), in one pass over the rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in _COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordCode()
        for b in text_slices(batches):
            out = []
            for t in texts_of(b):
                if len(code.words) > WORD_TABLE:
                    code.reset()
                words = t.split()
                lines = [x for x in t.split(b"\n") if x.strip(SPACE)]
                c = code.of(words)
                width = max(21, len(code.words).bit_length())
                out.append((len(words), len(t.translate(None, _NOT_CHARS)), len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(c, width), len(lines)))
            yield rows(schema, doc_id=b.column("doc_id"), lang=b.column("lang"), source=b.column("source"), **dict(zip(_COUNTS, map(list, zip(*out, strict=True)), strict=True)))

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def with_features(c: DataFrame) -> DataFrame:
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    x = {
        "x_word": F.log(F.greatest(F.col("word_chars") / n, F.lit(0.1))), "x_symbol": F.log1p(F.col("n_symbols") / n),
        "x_dup": F.col("n_dup_lines") / lines, "x_repeat": F.col("n_repeat_words") / n, "x_line": F.log(n / lines),
    }
    return c.withColumns({"base_failed": failed, **{k: F.round(v * UNIT).cast("long") for k, v in x.items()}})


def beside(t: DataFrame, small: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """t with the columns of a table of groups, which is broadcast if it is known to be small: rows needn't be dealt by group."""
    return t.join(F.broadcast(small) if few else small, on, how)


def grouped(t: DataFrame) -> DataFrame:
    """Adds g, the language and source of a row, and l, its language; null is a value of its own."""
    key = lambda *c: F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("0")) for x in c))
    return t.withColumns({"g": key("lang", "source"), "l": key("lang")})


def leaning(m: DataFrame, prior: float) -> DataFrame:
    """Moments (g, l, start, n, sums) of each group with `prior` more rows of its language's mean moments, which in turn
    have as many rows of the mean moments of all: an estimate of n rows is its own by n / (n + prior), at every n."""
    names = [c for c in m.columns if c not in ("g", "l", "start")]
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]
    lang = m.groupBy("l", "start").agg(*exact)
    every = lang.groupBy("start").agg(*exact)
    mean = lambda c: F.col(f"{c}").cast("double") / F.col("n").cast("double")
    every = every.select("start", *(mean(c).alias(f"a_{c}") for c in names))
    lang = lang.join(F.broadcast(every), "start")  # a row for each start
    of_lang = lambda c: (F.col(c).cast("double") + prior * F.col(f"a_{c}")) / (F.col("n").cast("double") + prior)
    lang = lang.select("l", "start", *(of_lang(c).alias(f"l_{c}") for c in names))
    return m.join(lang, ["l", "start"]).select("g", "l", "start", *((F.col(c).cast("double") + prior * F.col(f"l_{c}")).alias(c) for c in names))


def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments of rows of a group -> m (centre) and w (rows of the inverse Cholesky factor, lower part), and log determinant."""
    for b in batches:
        if not b.num_rows:
            continue
        col = {f: b.column(f).to_numpy(zero_copy_only=False) for f in b.schema.names if f not in ("g", "l", "start")}
        n = np.maximum(col["n"], 1.0)
        m = np.stack([col[f"s{i}"].astype(np.float64) / UNIT / n for i in range(P)], 1)
        cov = np.zeros((b.num_rows, P, P))
        for i, j in _PAIRS:
            cov[:, i, j] = cov[:, j, i] = col[f"q{i}_{j}"].astype(np.float64) / UNIT**2 / n - m[:, i] * m[:, j]
        floor = np.array(list(FEATURES.values())) ** 2
        cov[:, range(P), range(P)] = np.maximum(cov[:, range(P), range(P)], 0) + floor  # a ridge: a constant statistic keeps its least scale
        chol = np.linalg.cholesky(cov)
        inv = np.linalg.inv(chol)
        out = {"g": b.column("g"), "l": b.column("l"), "start": b.column("start"), "n": col["n"], "det": 2 * np.log(chol[:, range(P), range(P)]).sum(1)}
        out |= {f"m{i}": m[:, i] for i in range(P)} | {f"w{i}_{j}": inv[:, i, j] for i, j in _PAIRS}
        yield pa.RecordBatch.from_pydict(out)


_PARAMS = "g string, l string, start int, n double, det double, " + ", ".join([f"m{i} double" for i in range(P)] + [f"w{i}_{j} double" for i, j in _PAIRS])


def distance(xs: list[Column]) -> Column:
    """Squared Mahalanobis distance, a plain arithmetic expression over the parameter columns."""
    z = [x / F.lit(float(UNIT)) - F.col(f"m{i}") for i, x in enumerate(xs)]
    out = F.lit(0.0)
    for i in range(P):
        y = sum((F.col(f"w{i}_{j}") * z[j] for j in range(i + 1)), F.lit(0.0))
        out = out + y * y
    return out


def moments(df: DataFrame, *by: str) -> DataFrame:
    xs = [F.col(x) for x in FEATURES]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)] + [F.sum(xs[i] * xs[j]).alias(f"q{i}_{j}") for i, j in _PAIRS]
    return df.groupBy(*by).agg(F.count("*").cast("double").alias("n"), *sums)


def in_bins(d: DataFrame) -> DataFrame:
    """Adds the bin of d, a 32nd of an e-fold wide; a cut is made between bins."""
    return d.withColumn("bin", F.floor(F.log(F.col("d") + 1e-9) * 32).cast("int"))


def concentrate(d: DataFrame, share: float) -> DataFrame:
    """Moments of the `share` of each (g, start)'s rows with the least d: one pass with partial sums by bin, no sort of rows."""
    bins = moments(in_bins(d), "g", "l", "start", "bin")
    w = Window.partitionBy("g", "start")
    bins = bins.withColumns({"_before": F.sum("n").over(w.orderBy("bin")) - F.col("n"), "_all": F.sum("n").over(w)})
    kept = bins.where(F.col("_before") < share * F.col("_all"))
    return kept.groupBy("g", "l", "start").agg(*(F.sum(c).alias(c) for c in bins.columns if c not in ("g", "l", "start", "bin", "_before", "_all")))


def middle(d: DataFrame, prior: float, scratch: Scratch, name: str) -> DataFrame:
    """(g, mid): median of d by bins (their upper ends); as moments do, its logarithm leans on the language's and that on all rows'."""
    bins = scratch.cut(in_bins(d).groupBy("g", "l", "bin").agg(F.count("*").alias("n")), name)

    def median(*by: str) -> DataFrame:
        w = Window.partitionBy(*by)
        n = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n")).withColumns({"_upto": F.sum("n").over(w.orderBy("bin")), "_all": F.sum("n").over(w)})
        return n.where(2 * F.col("_upto") >= F.col("_all")).groupBy(*by).agg(F.first("_all").cast("double").alias("n"), ((F.min("bin") + 1) / 32.0).alias("mid"))

    every = bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    w = Window.partitionBy("one")  # a row a bin: a thousand or two, whatever the rows
    every = every.withColumns({"_upto": F.sum("n").over(w.orderBy("bin")), "_all": F.sum("n").over(w)})
    every = every.where(2 * F.col("_upto") >= F.col("_all")).groupBy("one").agg(((F.min("bin") + 1) / 32.0).alias("of_all"))
    lean = lambda up: (F.col("n") * F.col("mid") + prior * F.col(up)) / (F.col("n") + prior)
    lang = median("l").withColumn("one", F.lit(1)).join(F.broadcast(every), "one").select("l", lean("of_all").alias("of_lang"))
    return median("g", "l").join(lang, "l").select("g", F.exp(lean("of_lang")).alias("mid"))


def falls(before: DataFrame, after: DataFrame) -> bool:
    """Whether the log determinants of a start fell by LEAST_FALL or more, in the mean of groups by their rows (sums of integers)."""
    j = after.select("g", "start", "n", F.col("det").alias("_new")).join(before.select("g", "start", "det"), ["g", "start"])
    n = F.col("n").cast("long")
    d = j.groupBy("start").agg(F.sum(n * F.round((F.col("det") - F.col("_new")) * 1e6).cast("long")).alias("fall"), F.sum(n).alias("n"))
    return not d.where(F.col("fall") >= LEAST_FALL * 1e6 * F.col("n")).isEmpty()


def mcd(t: DataFrame, scratch: Scratch, prior: float = PRIOR) -> DataFrame:
    """Reweighted MCD estimate of each group g of t(g, l, statistics): parameter columns and `mid`, the median squared distance.

    Deterministic starts (the group's medians with its language's MAD scales; means of all its rows with their covariance),
    concentration steps until the log determinants fall no more (in the mean of all groups), the start of the smaller determinant (ties: the first), then one
    reweighting step. Every estimate leans on its language's and on all rows' by `prior` rows, so that a group of any
    size has one of its own. All sums are over all rows, of integers, so estimates don't depend on partitions. A
    subset ends with a whole bin of distances.
    """
    xs = [F.col(x) for x in FEATURES]
    med = scratch.cut(t.groupBy("g").agg(*(F.percentile_approx(x, 0.5, 10000).alias(f"c{i}") for i, x in enumerate(xs))), "medians")
    few = med.count() <= FEW_GROUPS  # every table of groups below has a row, or two, for each
    held = lambda m, name: scratch.cut(m.coalesce(SMALL_PARTS) if few else m, name)
    fitted = lambda m, name: held(leaning(held(m, f"moments-{name}"), prior).mapInArrow(fit, _PARAMS), f"params-{name}")
    dev = beside(t, med, ["g"], few).select("l", *(F.abs(x - F.col(f"c{i}")).alias(f"a{i}") for i, x in enumerate(xs)))
    mad = scratch.cut(dev.groupBy("l").agg(*((F.percentile_approx(f"a{i}", 0.5, 10000) * 1.4826).alias(f"a{i}") for i in range(P))), "scales")
    z = sum((F.pow((x - F.col(f"c{i}")) / F.greatest(F.col(f"a{i}"), F.lit(s * UNIT)), 2) for i, (x, s) in enumerate(zip(xs, FEATURES.values(), strict=True))), F.lit(0.0))
    start = beside(beside(t, med, ["g"], few), mad, ["l"], few)
    robust = concentrate(start.select("g", "l", *FEATURES, F.lit(0).alias("start"), z.alias("d")), 0.5)
    plain = moments(t.withColumn("start", F.lit(1)), "g", "l", "start")
    params = fitted(robust.unionByName(plain), "0")
    for k in range(1, STEPS + 1):
        d = beside(t, params.drop("l", "n"), ["g"], few).withColumn("d", distance(xs))
        after = fitted(concentrate(d, SUBSET), str(k))
        # the first step goes from half of the rows, or all, to the subset; only from then on determinants compare
        stop, params = k > 1 and not falls(params, after), after
        if stop:
            break
    params = params.groupBy("g").agg(F.min_by(F.struct(*params.columns), F.struct("det", "start")).alias("p")).select("p.*")
    params = scratch.cut(params, "best")
    d = beside(t, params.drop("l", "n"), ["g"], few).withColumn("d", distance(xs))
    mid = scratch.cut(middle(d, prior, scratch, "bins"), "near")
    near = beside(d, mid, ["g"], few).where(F.col("d") <= F.col("mid") * (chi2(0.975) / chi2(0.5)))
    # a small group may have no row so near: it has its language's moments alone
    m = params.select("g", "l", F.lit(0).alias("start")).join(moments(near, "g"), "g", "left").na.fill(0)
    params = fitted(m, "final").drop("l", "start", "n", "det")
    mid = middle(beside(t, params, ["g"], few).withColumn("d", distance(xs)), prior, scratch, "last-bins")
    return scratch.cut(params.join(mid, "g"), "estimates")


def judge(docs: DataFrame, scratch: Scratch, alpha: float = ALPHA, slack: float = SLACK, prior: float = PRIOR) -> DataFrame:
    """Counts, base_failed, distance2 (null in a group without a row that passes the fixed rules) and kept, a row for each row of docs.

    Rows that fail the fixed rules are out and take no part in the estimates. Null lang or source is a value of
    its own. Every group of language and source has an estimate: it leans on that of its language by n / (n + prior), so
    that no size switches to another rule. Rows of equal statistics, repeated rows
    among them, have equal verdicts; a distance equal to the limit is kept. Long texts are counted whole. An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    t = scratch.cut(with_features(counts(docs)), "counts")
    t = grouped(t)
    est = mcd(t.where(~F.col("base_failed")).select("g", "l", *FEATURES), scratch, prior)
    d = beside(t, est, ["g"], est.count() <= FEW_GROUPS, "left").withColumn("distance2", distance([F.col(x) for x in FEATURES]) * (chi2(0.5) / F.col("mid")))
    far = F.coalesce(F.col("distance2") > slack * chi2(1 - alpha), F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~far).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2", "lang", "source", "g", *((F.col(x) / UNIT).alias(x) for x in FEATURES)
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.when(~F.col("base_failed"), F.round("distance2", 6)).alias("distance2"))
