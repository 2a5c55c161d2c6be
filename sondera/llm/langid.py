"""Language identification by language-bitmask n-gram filters.

A Bloom filter for each language holds that language's frequent character n-grams. The filters are bit-sliced:
one table of machine words, in which bit l belongs to language l, so that a single look-up (the AND of K words)
returns all languages that contain an n-gram. A text's popcounts by language, corrected for the filters' false
positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_TABLE, WordCode, mix, rows, text_slices, texts_of

#: Training sample: at most so many documents of each language, those of the smallest hash.
TRAIN_DOCS = 1000
#: n-gram sizes in characters, and n-grams kept for each language.
SIZES, KEEP = (1, 2, 3, 4), 3000
#: Slots of the bit-sliced filter, and look-ups for each n-gram.
SLOTS, LOOKUPS = 1 << 20, 3
UNDETERMINED = "und"
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter (Unicode categories L*)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word index) of the n-grams of each word, and whether each word has a letter.

    A word is lower-cased; runs of letters are its parts, with a boundary mark at either end of a part. An
    n-gram lies within a part and its marks.
    """
    text = b"\n".join(words).decode("utf-8", "replace")
    low = [w.lower() for w in text.split("\n")]
    cp = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.cumsum(cp == 10) - 1
    isl = letters()[cp]
    has = np.zeros(len(words) + 1, bool)
    has[of[isl]] = True
    c = np.where(isl, cp, 0).astype(np.uint64)
    found, owner = [], []
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        inner = np.ones(m, bool)
        for k in range(1 if n > 1 else 0, n - 1 if n > 1 else 1):
            inner &= isl[k : k + m]
        if n > 1:
            inner &= isl[:m] | isl[n - 1 :]
        at = np.flatnonzero(inner)
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x1000193_0001) + c[at + k]
        found.append(mix(key))
        owner.append(np.where(isl[at], of[at], of[np.minimum(at + 1, len(of) - 1)]))
    return np.concatenate(found), np.concatenate(owner), has[: len(words)]


@dataclass
class Filters:
    """The trained filters: languages by bit, slots as 64-bit words (one row of words for every 64 languages)."""

    langs: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    default: int

    @classmethod
    def build(cls, langs: list[str], members: list[np.ndarray], default: int) -> Filters:
        table = np.zeros(((len(langs) + 63) // 64 or 1, SLOTS), np.uint64)
        for i, grams in enumerate(members):
            for k in range(LOOKUPS):
                np.bitwise_or.at(table[i // 64], slot(grams, k), np.uint64(1 << (i % 64)))
        fill = np.array([np.count_nonzero(table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS for i in range(len(langs))])
        return cls(langs, table, fill**LOOKUPS, default)

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that contain each n-gram: shape (words of 64 languages, n-grams)."""
        m = self.table[:, slot(grams, 0)]
        for k in range(1, LOOKUPS):
            m &= self.table[:, slot(grams, k)]
        return m

    def counts(self, words: list[bytes]) -> np.ndarray:
        """For each word: n-grams in each language's filter, n-grams, and 1 if it has a letter."""
        out = np.zeros((len(words), len(self.langs) + 2), np.int64)
        grams, owner, has = word_grams(words)
        mask = self.lookup(grams)
        for i in range(len(self.langs)):
            bit = mask[i // 64] >> np.uint64(i % 64) & np.uint64(1)
            out[:, i] = np.bincount(owner, bit.astype(np.float64), len(words))[: len(words)]
        out[:, -2] = np.bincount(owner, minlength=len(words))[: len(words)]
        out[:, -1] = has
        return out

    def decide(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index (-1: no letter), score, and share of the n-grams that the language's filter holds."""
        n, has = sums[:, -2:-1], sums[:, -1] > 0
        true = np.maximum(0, (sums[:, :-2] - n * self.false_rate) / (1 - self.false_rate))
        first = [self.default, *(i for i in range(true.shape[1]) if i != self.default)] if true.shape[1] else []
        best = np.array(first)[true[:, first].argmax(1)] if first else np.full(len(sums), -1)
        top = np.sort(np.pad(true, ((0, 0), (2, 0))), axis=1)[:, -2:]
        best = np.where(top[:, 1] > 0, best, self.default)
        score = np.divide(top[:, 1] - top[:, 0], top[:, 1], out=np.zeros(len(sums)), where=top[:, 1] > 0)
        share = np.divide(top[:, 1], n[:, 0], out=np.zeros(len(sums)), where=n[:, 0] > 0)
        return np.where(has, best, -1), np.where(has, score, 0.0), np.where(has, share, 0.0)


def slot(grams: np.ndarray, k: int) -> np.ndarray:
    return ((grams >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> Filters:
    """Filters from a bounded sample of the labelled documents outside the held-out fold.

    Documents of null text or lang are not learned from; a language's sample holds those whose id has the smallest hash,
    found from counts by leading zeros. The n-grams of a language are the KEEP most frequent in its sample (ties:
    smaller hash). Languages are in code point order. An empty table gives filters without languages; other columns,
    whatever their names, are not read.
    """
    lab = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64("doc_id")
    zeros = 64 - F.length(F.bin(h))  # leading zeros: each more halves what is left of a language
    size, least = {}, {}
    for r in lab.groupBy("lang", zeros.alias("z")).agg(F.count("*").alias("n")).orderBy(F.desc("z")).collect():  # 64 counts a language at most
        if size.get(r["lang"], 0) < per_lang:
            least[r["lang"]] = r["z"]
        size[r["lang"]] = size.get(r["lang"], 0) + r["n"]
    near = F.lit(False)
    for lang, z in least.items():
        near = near | ((F.col("lang") == lang) & (zeros >= z))
    # some per_lang to 2 * per_lang texts of a language leave the scan; the bound then cuts those of the greatest hash
    order = Window.partitionBy("lang").orderBy(F.desc("__z"), "__h")
    sample = lab.where(near).select("text", "lang", zeros.alias("__z"), h.alias("__h"))
    sample = sample.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_lang).select("text", "lang")

    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = texts_of(b)
            for lang in sorted(set(langs)):
                words = [w for t, x in zip(texts, langs, strict=True) if x == lang for w in t.split()]
                code = WordCode()
                times = np.bincount(code.of(words), minlength=len(code.words))
                if not code.words:
                    continue
                g, owner, _ = word_grams(code.words)
                u, inv = np.unique(g, return_inverse=True)
                yield rows(schema, lang=[lang] * len(u), gram=u.view(np.int64), n=np.bincount(inv, times[owner], len(u)).astype(np.int64))

    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = sample.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = kept.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= KEEP).groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("g"))
    found = {r["lang"]: np.array(r["g"], np.int64).view(np.uint64) for r in kept.collect()}
    langs = sorted(found)
    return Filters.build(langs, [found[x] for x in langs], max(range(len(langs)), key=lambda i: (size.get(langs[i], 0), -i), default=-1))


class Judge:
    """Decides texts with a table of the words met; a word is looked up in the filters once."""

    def __init__(self, f: Filters):
        self.f, self.code = f, WordCode()
        self.table = np.zeros((1 << 16, len(f.langs) + 2), np.int16)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.code.words) > WORD_TABLE:
            self.code.reset()
        known = len(self.code.words)
        idx = [self.code.of(t.split()) for t in texts]
        while len(self.table) < len(self.code.words):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at in range(known, len(self.code.words), 50_000):
            part = self.f.counts(self.code.words[at : at + 50_000])
            if part.max(initial=0) > 32_000 and self.table.dtype != np.int64:
                self.table = self.table.astype(np.int64)
            self.table[at : at + len(part)] = part
        return self.f.decide(np.stack([self.table[i].sum(0, dtype=np.int64) for i in idx]))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score, share for every row; only `text` decides.

    lang_pred is `und` with score 0 for a null text, one without a letter, or if nothing was learned. A text
    whose n-grams are in no filter gets the language with most labelled documents, with score 0. score is the
    lead of the best language over the next as a share of the best; share is the corrected part of the n-grams
    that the best language's filter holds. Equal counts go to the language with most labelled documents, then to
    the first by code point. Repeated rows
    give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for b in text_slices(batches):
            best, score, share = judge.of(texts_of(b))
            names = [judge.f.langs[i] if i >= 0 else UNDETERMINED for i in best]
            yield rows(schema, doc_id=b.column("doc_id"), lang_pred=names, score=score, share=share)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, share double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "share")


#: A document is rejected if less of its n-grams than this is in the filter of its language.
MIN_SHARE = 0.3


def keep_identified(docs: DataFrame, filters: Filters, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs, unchanged, whose text has letters and is in a learned language (see predict)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for b in text_slices(batches):
            best, _, share = judge.of(texts_of(b))
            yield b.filter(pa.array((best >= 0) & (share >= min_share)))

    return docs.mapInArrow(run, docs.schema)
