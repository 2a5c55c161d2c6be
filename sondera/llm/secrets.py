"""Secret scanning: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The models are compared by the log-likelihood ratio of a string under both; the ratio alone decides about a run of the
alphabet. They are trained from labelled samples: generated keys over the usual alphabets and values that the fixed
patterns find in the corpus are random strings; generated numbers and dates, and the corpus's words and runs outside all
fixed spans, are ordinary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import rows, text_slices, texts_of

# The patterns of the contract, on UTF-8 bytes (IGNORECASE on bytes is A-Z only).
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

#: Characters that a run must have at least for the models to judge it: a shorter one is too little evidence.
MIN_RUN = 16
_HEX_RUN = re.compile(rb"[0-9a-f]{24,}")
_DIGIT = re.compile(rb"[0-9]")
#: Bound of the training sample: strings of each label, those of the smallest hash.
SAMPLE = 4000
#: Bytes of a training string that count.
LONGEST = 4096
#: A candidate is a secret if its mean log-likelihood ratio (nats a character) is above this.
THRESHOLD = 0.75
#: Character classes of the models: one symbol for each character of the candidates' alphabet, and an end mark.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(len(ALPHABET))


def base_spans(t: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) in bytes of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    low = t.lower()
    if any(k in low for k in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        out += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= MIN_VALUE]
    if b"AKIA" in t:
        out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(t) if m.end() - m.start() >= MIN_ACCESS]
    # a run of the pattern with fewer than 24 characters fails, so the longer runs are the same matches
    out += [(m.start(), m.end(), 2, m.start()) for m in _HEX_RUN.finditer(t)]
    return sorted(out)


def outside(spans: list[tuple], at: int, to: int) -> bool:
    return all(to <= s[0] or s[1] <= at for s in spans)


def candidates(t: bytes, spans: list[tuple], run: re.Pattern) -> list[tuple[int, int]]:
    """Runs for the models, whatever their characters, that touch no fixed span."""
    return [(m.start(), m.end()) for m in run.finditer(t) if outside(spans, m.start(), m.end())]


def run_of(least: int) -> re.Pattern:
    """Runs of at least so many characters of the alphabet."""
    return re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % least)


class Markov:
    """First-order character chain; a character's followers are smoothed by the frequencies of all characters."""

    def __init__(self, strings: list[bytes]):
        n = len(ALPHABET) + 1
        c = np.zeros((n, n))
        if strings:
            raw = np.frombuffer(b"\0".join(strings), np.uint8)
            x, mark = _CODE[raw], raw == 0
            x[mark] = n - 1
            before = np.concatenate([[n - 1], x[:-1]])
            np.add.at(c, (before[~mark], x[~mark]), 1)
        every = c.sum(0) + 0.5
        c += 8 * every / every.sum()
        self.log = np.log(c / c.sum(1, keepdims=True))

    def mean(self, s: bytes) -> float:
        x = _CODE[np.frombuffer(s, np.uint8)]
        return float(self.log[np.concatenate([[len(ALPHABET)], x[:-1]]), x].mean())


def generated(n: int, seed: int = 6) -> list[tuple[bytes, bool]]:
    """The labelled samples that every training has: n keys of 16 to 64 characters over each usual alphabet (True), and as
    many decimal numbers, dates, times and rules of one repeated sign (False)."""
    rng, out = np.random.default_rng(seed), []
    base62 = ALPHABET[:62]
    for letters in (base62, base62[:52], ALPHABET, base62[:26] + b"234567", b"0123456789ABCDEF", base62[26:62]):
        pool = np.frombuffer(letters, np.uint8)
        out += [(rng.choice(pool, int(k)).tobytes(), True) for k in rng.integers(16, 65, n)]
    digits = np.frombuffer(b"0123456789", np.uint8)
    out += [(rng.choice(digits, int(k)).tobytes(), False) for k in rng.integers(2, 31, 2 * n)]
    y, m, d, x = (rng.integers(a, z, n) for a, z in ((1900, 2100), (1, 13), (1, 29), (0, 240000)))
    out += [(b"%04d-%02d-%02d" % t, False) for t in zip(y.tolist(), m.tolist(), d.tolist(), strict=True)]
    out += [(b"%04d%02d%02d-%06d" % t, False) for t in zip(y.tolist(), m.tolist(), d.tolist(), x.tolist(), strict=True)]
    return out + [(bytes([c]) * 40, False) for c in ALPHABET] * max(1, n // 60)


def train(docs: DataFrame, size: int = SAMPLE, labelled: list[tuple[bytes, bool]] | None = None, least: int = MIN_RUN) -> tuple[Markov, Markov]:
    """(random, ordinary) models from labelled samples of at most `size` distinct strings a label, found over all rows in
    one pass, and from `labelled` strings (random or not; by default generated ones).

    Random: values of `assign` with a digit, `access` and `hex` spans. Ordinary: whole words of 6 characters or more
    outside all fixed spans (long ones that a first pair of models doesn't call random), and identifiers made of them. The strings of
    smallest hash are taken, so the sample doesn't depend on partitions. A string counts as its first 4096 bytes.
    """
    schema = pa.schema([("random", pa.bool_()), ("s", pa.binary()), ("h", pa.int64())])
    word = re.compile(rb"(?<![^\s])[A-Za-z0-9_-]{6,}(?![^\s.,;:!?])")
    labelled = generated(SAMPLE // 10) if labelled is None else labelled
    sure = {x: [s for s, r in labelled if r == x] for x in (True, False)}

    def smallest(found: set[bytes]) -> tuple[list[bytes], np.ndarray]:
        x = sorted(found)
        h = np.array([int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in x], np.int64)
        keep = np.argsort(h, kind="stable")[:size]
        return [x[i] for i in keep], h[keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {True: set(), False: set()}
        for b in text_slices(batches):
            for t in texts_of(b):
                spans = base_spans(t)
                for _, to, kind, value in spans:
                    v = t[value:to]
                    if (kind or _DIGIT.search(v)) and b"." not in v:
                        kept[True].add(v[:LONGEST])
                if spans:
                    kept[False].update(m[0][:LONGEST] for m in word.finditer(t) if outside(spans, m.start(), m.end()))
                else:
                    kept[False].update(x[:LONGEST] for x in word.findall(t))
            for label, found in kept.items():
                if len(found) > 4 * size:
                    kept[label] = set(smallest(found)[0])
        for label, found in kept.items():
            s, h = smallest(found)
            yield rows(schema, random=[label] * len(s), s=s, h=h)

    found = docs.select("text").mapInArrow(scan, "random boolean, s binary, h long").distinct()
    first = Window.partitionBy("random").orderBy("h", "s")
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= size).select("random", "s").collect()  # at most 2 * size strings
    strings = {x: sorted(bytes(r["s"]) for r in found if r["random"] == x) for x in (True, False)}
    prior = Markov(sure[True]), Markov([*sure[False], *identifiers([s for s in strings[False] if len(s) < least])])
    plain = [s for s in strings[False] if len(s) < least or not ratio(prior, s) > THRESHOLD]  # no keys among the words
    return Markov([*strings[True], *sure[True]]), Markov([*identifiers(plain), *sure[False]])


def identifiers(words: list[bytes]) -> list[bytes]:
    """The words, and the names that are made of them: upper case, and neighbours joined in the usual ways."""
    both = list(zip(words, words[1:], strict=False))
    joined = [x for a, b in both for x in (a + b"_" + b, a + b"-" + b, a + b"/" + b, a.lower() + b.capitalize(), a.upper() + b"_" + b.upper())]
    return [*words, *(w.upper() for w in words), *joined]


def ratio(models: tuple[Markov, Markov], s: bytes) -> float:
    """Mean log-likelihood ratio of a string, random against ordinary, in nats a character."""
    return models[0].mean(s) - models[1].mean(s)


def joined(spans: list[tuple], points: np.ndarray | None) -> str:
    """kind:start:end by start, then kind, in code points."""
    p = (lambda i: i) if points is None else (lambda i: int(points[i]))
    return ",".join(f"{KINDS[k]}:{p(a)}:{p(z)}" for a, k, z in sorted((s[0], s[2], s[1]) for s in spans))


def scan(docs: DataFrame, models: tuple[Markov, Markov], threshold: float = THRESHOLD, least: int = MIN_RUN) -> DataFrame:
    """A row for each document: counts of the fixed kinds, digest of the fixed spans, all spans, number of the models' spans.

    Every run of `least` characters of the alphabet outside the fixed spans is judged by the models alone; it is a span if
    its ratio is above the threshold (one equal to it is not). Null and empty texts have no spans (the digest of an empty
    string); long texts are scanned whole, in bytes. Offsets are code points, end exclusive; a span is the whole
    match. Repeated rows give repeated results, an empty table none. Other columns, whatever their names, are not read.
    """
    run_rx = run_of(least)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_markov", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, plain = shared.value
        for b in text_slices(batches):
            out: dict[str, list] = {f.name: [] for f in schema if f.name != "doc_id"}
            for t in texts_of(b):
                base = base_spans(t)
                more = [(a, z, 3, a) for a, z in candidates(t, base, run_rx) if random.mean(t[a:z]) - plain.mean(t[a:z]) > threshold]
                points = None
                if (base or more) and not t.isascii():
                    raw = np.frombuffer(t, np.uint8)
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base, points).encode()).hexdigest())
                out["spans"].append(joined(base + more, points))
                out["n_markov"].append(len(more))
            yield rows(schema, doc_id=b.column("doc_id"), **out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
