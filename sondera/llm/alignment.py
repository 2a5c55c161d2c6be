"""Alignment of two tokenisers over a corpus, by postings of id pairs that are cogrouped by side id.

Each text is tokenised twice; where tokens of both sides end at one byte, a group ends, and the two tokens are linked.
How often an id pair is linked is counted over all documents: blocks of documents send their postings
(pair, document, multiplicity) and their totals of pairs by the side B id. In a task the totals come first, in
sorted order and spilled by Spark's sort, so the counts and each B id's highest count are known when the postings stream by;
they leave as contributions to documents, which are summed block by block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Scratch, blob, mix, rows, runs, tasks, text_slices
from .pieces import BYTE, NORMAL, SPACE, loaded, model_path

#: Chunks of text that a worker remembers with their alignment; longer ones than LONG characters are not remembered.
CHUNKS, LONG, MOST_LINKS = 600_000, 64, 8_000_000
#: A block of documents ends with so many links or documents.
BLOCK_LINKS, BLOCK_DOCS = 2_000_000, 8192
#: Groups of side ids. All pairs of an id are in one group.
BUCKETS = 64
#: Rules of side A (as its file states them) under which no token crosses a border between a sign and white space.
_BY_CHUNK = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}}
_CHUNK = re.compile("[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: White space beyond that; in texts with such signs only a border behind what is surely none counts.
_ODD_SPACE = re.compile("[\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
_PLAIN = re.compile("[ \t\n][^▁]*[^\\s\u180e\u200b▁]")
_BORDER = re.compile("(?<=[^\\s\u180e\u200b])(?=[ \t\n])")


def byte_signs() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Groups and links of texts; chunks that neither side's tokens cross are aligned once, many at a time."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            rules = json.load(f)
        signs, names = byte_signs(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.bytes_a[i] = bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b, _ = loaded(path_b)
        m = self.b.m
        self.bytes_b = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b"" for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.len_a, self.len_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        #: Decimal ids with the sign that follows them within a side, and at a side's end.
        self.text = [[f"{i}{z}" for i in range(n)] for n, z in ((len(self.bytes_a), ","), (len(self.bytes_a), "|"), (len(self.bytes_b), ","), (len(self.bytes_b), ";"))]
        pre = {k: v for k, v in (rules.get("pre_tokenizer") or {}).items() if (k, v) != ("use_regex", True)}
        apart = m.by_word and not any(re.search("[^ \t\n▁][\t\n]", p) for p in m.ids)
        self.by_chunk = apart and {"normalizer": rules.get("normalizer"), "pre_tokenizer": pre} == _BY_CHUNK and rules["model"].get("dropout") is None
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.said: list[str | None] = []
        self.size, self.links = np.zeros((1 << 12, 3), np.int32), np.zeros(1 << 14, np.int64)
        self.at, self.used = np.zeros(1 << 12, np.int64), 0

    def chunks(self, text: str) -> list[str]:
        if not self.by_chunk:
            return [text]
        return _BORDER.split(text) if _ODD_SPACE.search(text) else _CHUNK.findall(text)

    def learn(self, chunks: list[str]) -> None:
        """Align new chunks. One whose tokens are not its bytes says None."""
        plain = [c for c in chunks if self.by_chunk and _PLAIN.fullmatch(c)]
        have = set(plain)
        for at in range(0, len(plain), 4096):
            self._align(plain[at : at + 4096])
        for c in chunks:
            if c not in have:
                ids = self.a.encode(c, add_special_tokens=False).ids, self.b.ids_of(c.replace(" ", SPACE))
                self._store([c], *(np.array(x, np.int64) for x in ids))

    def _align(self, chunks: list[str]) -> None:
        """Chunks that begin with white space and end without are tokenised one behind the other."""
        text = " ." + "".join(chunks)
        a, b = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), np.array(self.library.encode(text[1:]), np.int64)
        a, b = (x[np.searchsorted(np.cumsum(n[x]), 2) + 1 :] for x, n in ((a, self.len_a), (b, self.len_b)))
        self._store(chunks, a, b)

    def _store(self, chunks: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Take in chunks with the ids of their joined text."""
        data = [c.encode() for c in chunks]
        whole = b"".join(data)
        if not (b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))):
            if len(chunks) == 1:
                return self._append(chunks, [None], np.zeros((1, 3), np.int64), np.empty(0, np.int64))
            for c in chunks:
                self._align([c])
            return None
        end_a, end_b, end = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]), np.cumsum([len(x) for x in data])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.isin(end_a, common, assume_unique=True), np.isin(end_b, common, assume_unique=True)
        group = np.concatenate([np.searchsorted(common, end_a) * 2, np.searchsorted(common, end_b) * 2 + 1])
        order = np.argsort(group, kind="stable")
        kind, ids = np.concatenate([last_a.astype(np.int8), last_b + np.int8(2)])[order].tolist(), np.concatenate([a, b])[order].tolist()
        parts = [self.text[k][i] for k, i in zip(kind, ids, strict=True)]
        n = np.diff(np.stack([np.searchsorted(x, end, "right") for x in (end_a, end_b, common)], 1), axis=0, prepend=0)
        cut = np.cumsum(n[:, 0] + n[:, 1]).tolist()
        said = ["".join(parts[x:y])[:-1] for x, y in zip([0, *cut], cut, strict=False)]
        return self._append(chunks, said, n, b[last_b] << 32 | a[last_a])

    def _append(self, chunks: list[str], said: list, n: np.ndarray, links: np.ndarray) -> None:
        first = len(self.said)
        self.known.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.said += said
        while len(self.at) < len(self.said):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while len(self.links) < self.used + len(links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.at[first : len(self.said)], self.size[first : len(self.said)] = self.used + np.cumsum(n[:, 2]) - n[:, 2], n
        self.links[self.used : self.used + len(links)] = links
        self.used += len(links)

    def aligned(self, texts: list[list[str]]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """Of texts in known chunks: numbers of tokens and groups, digests, links."""
        numbers, digests, links = np.zeros((len(texts), 3), np.int64), [], []
        for k, t in enumerate(texts):
            at = list(map(self.known.__getitem__, t))
            said = list(map(self.said.__getitem__, at))
            if not at or None in said:
                digests.append("")
                links.append(np.empty(0, np.int64))
                continue
            digests.append(hashlib.sha256(";".join(said).encode()).hexdigest())
            at = np.array(at)
            size = self.size[at]
            numbers[k] = size.sum(0, dtype=np.int64)
            n = size[:, 2].astype(np.int64)
            links.append(self.links[np.repeat(self.at[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return numbers, digests, links


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Aligner(a, b)
    return _LOADED[a, b]


_ROWS = pa.schema([
    ("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("codes", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("n", pa.binary()), ("digests", pa.list_(pa.string())),
])
_DDL = "block long, bucket int, codes binary, sizes binary, docs binary, times binary, ids array<long>, n binary, digests array<string>"
#: Kinds of rows: documents of a block, postings of a block in a bucket, totals of a block's pairs in a bucket.
DOCS, POSTINGS, TOTALS = 0, 1, 2


def _packed(block: int, ids: list, sizes: list, digests: list, doc: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    out: dict[str, list] = {c: [] for c in _ROWS.names}

    def add(**cols) -> None:
        for c in out:
            out[c].append(cols.get(c))

    add(kind=DOCS, block=block, ids=ids, n=blob(np.array(sizes, np.int64)), digests=digests)
    pair, at = np.unique(code, return_inverse=True)
    bucket = (mix(pair >> 32) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.lexsort((pair, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key, times = np.unique(rank[at] * len(ids) + doc, return_counts=True)
    of, d = key // len(ids), (key % len(ids)).astype(np.uint16)
    start = np.searchsorted(of, np.arange(len(pair) + 1))
    pair, bucket = pair[order], bucket[order]
    total = np.add.reduceat(times, start[:-1]) if len(pair) else times
    times = times.astype(np.uint8 if times.max(initial=0) < 256 else np.uint32)
    for x, y in runs(bucket):
        s, e = start[x], start[y]
        cols = {"block": block, "bucket": int(bucket[x]), "codes": blob(pair[x:y])}
        add(kind=POSTINGS, sizes=blob(np.diff(start[x : y + 1]).astype(np.uint32)), docs=blob(d[s:e]), times=blob(times[s:e]), **cols)
        add(kind=TOTALS, times=blob(total[x:y].astype(np.int64)), **cols)
    return rows(_ROWS, **out)


def postings(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of blocks of documents: the documents, their postings by bucket, the totals of pairs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, block = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        ids, sizes, digests, held = [], [], [], []
        links = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, sizes, digests, held, links, block
            n = np.array([len(x) for x in held], np.int64)
            out = _packed(block, ids, sizes, digests, np.repeat(np.arange(len(ids)), n), np.concatenate(held))
            ids, sizes, digests, held, links, block = [], [], [], [], 0, block + 1
            return out

        for b in text_slices(batches):
            texts = [al.chunks(" " + t) if t else [] for t in b.column("text").to_pylist()]
            new = {c for t in texts for c in t if c not in al.known}
            if (len(al.said) + len(new) > CHUNKS or al.used > MOST_LINKS) and al.said:
                al._reset()
                new = {c for t in texts for c in t}
            al.learn(sorted(new))
            for i, n, h, x in zip(b.column("doc_id").to_pylist(), *al.aligned(texts), strict=True):
                ids.append(i)
                sizes.append(n)
                digests.append(h)
                held.append(x)
                links += len(x)
                if links >= BLOCK_LINKS or len(ids) >= BLOCK_DOCS:
                    yield flush()
            for c in new:
                if len(c) > LONG:  # said once; its place in the lists goes with the next reset
                    al.said[al.known.pop(c)] = ""
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"kind int, {_DDL}")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x, n, k in zip(b.column("codes").to_pylist(), b.column("times").to_pylist(), b.column("bucket").to_pylist(), strict=True):
            code = np.frombuffer(x, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(np.frombuffer(n, np.int64))], ["bucket", "code", "total"])


_GIVEN = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


def exact_bins(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of 64-bit integers by position, exact beyond what doubles hold."""
    low = np.bincount(at, weight & ((1 << 30) - 1)).astype(np.int64)
    return low + (np.bincount(at, weight >> 30).astype(np.int64) << 30)


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of parts that come sorted, totals before postings: what the pairs of a part give to each document of a block."""
    part, codes, totals, best, ready = None, [], [], np.empty(0, bool), False
    code = total = np.empty(0, np.int64)
    for b in batches:
        at = b.column("part").to_numpy()
        for x, y in runs(at):
            if at[x] != part:
                part, codes, totals, ready = at[x], [], [], False
            kinds = b.column("kind").slice(x, y - x).to_numpy()
            n = int(np.searchsorted(kinds, POSTINGS))
            if n:
                codes.append(b.column("code").slice(x, n).to_numpy())
                totals.append(b.column("total").slice(x, n).to_numpy())
            for k in range(x + n, y):
                if not ready:
                    code, total = np.concatenate(codes), np.concatenate(totals)
                    order = np.argsort(code)
                    code, total = code[order], total[order]
                    side = np.unique(code >> 32, return_index=True)[1]
                    top = np.maximum.reduceat(total, side)
                    best = total == np.repeat(top, np.diff(np.append(side, len(code))))
                    codes, totals, ready = [], [], True
                size, doc = (np.frombuffer(b.column(c)[k].as_py(), t) for c, t in (("sizes", np.uint32), ("docs", np.uint16)))
                raw = b.column("times")[k].as_py()
                times = np.frombuffer(raw, np.uint8 if len(raw) == len(doc) else np.uint32).astype(np.int64)
                at_pair = np.repeat(np.searchsorted(code, np.frombuffer(b.column("codes")[k].as_py(), np.int64)), size)
                counts, good = exact_bins(doc, times * total[at_pair]), np.bincount(doc, times * best[at_pair]).astype(np.int64)
                some = np.unique(doc)
                yield rows(_GIVEN, block=[b.column("block")[k].as_py()], docs=[blob(some)], counts=[blob(counts[some])], best=[blob(good[some].astype(np.uint32))])


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _summed(docs: pa.Table, given: pa.Table) -> pa.Table:
    out = []
    for k in range(docs.num_rows):  # one row for a block
        ids = docs.column("ids")[k].as_py()
        n = np.frombuffer(docs.column("n")[k].as_py(), np.int64).reshape(len(ids), 3)
        counts, best = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for d, c, g in zip(*(given.column(x).to_pylist() for x in ("docs", "counts", "best")), strict=True):
            at = np.frombuffer(d, np.uint16)
            counts[at] += np.frombuffer(c, np.int64)
            best[at] += np.frombuffer(g, np.uint32)
        out.append(rows(_OUT, doc_id=ids, n_a=n[:, 0], n_b=n[:, 1], n_groups=n[:, 2], n_links=n[:, 2], n_best=best, count_sum=counts, groups_sha256=docs.column("digests")[k].as_py()))
    return pa.Table.from_batches(out, _OUT)


def path_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def align(docs: DataFrame, scratch: Scratch, a: str | None = None, b: str | None = None) -> DataFrame:
    """Tokens, groups and links of each document, and how often its links' pairs are linked in all documents.

    A row for a row: repeated rows and rows of equal or null doc_id count each for itself, other columns are left aside,
    and an empty table gives an empty table. Null and empty texts, and texts whose tokens are not their bytes
    (those with U+2581), have no tokens. No token is empty, so a group ends with exactly one link. A pair's count is exact
    in 64 bits; a block's totals of a pair travel once, so a frequent id is summed before it is shuffled, and the
    postings of an id are dealt over as many parts as the postings' size asks for, each with the id's totals.
    """
    spark = docs.sparkSession
    to = scratch.path("postings")
    postings(docs, a or path_a(), b or model_path()).write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(to)
    stored = spark.read.schema(f"{_DDL}, kind int").parquet(to)
    of = lambda kind: stored.where(F.col("kind") == kind)
    pairs = of(TOTALS).select("bucket", "codes", "times").mapInArrow(_pairs, "bucket int, code long, total long").groupBy("bucket", "code").agg(F.sum("total").alias("total"))
    pairs = scratch.cut(pairs, "totals")
    size = of(POSTINGS).agg(F.coalesce(F.sum(F.octet_length("docs") + F.octet_length("codes") + F.octet_length("sizes")), F.lit(0)).alias("n")).first()["n"]
    salts = max(1, min(-(-size // (PIECE_BYTES * BUCKETS)), 1 << 16))
    none = F.lit(None)
    sent = of(POSTINGS).select(
        (F.col("bucket") * salts + F.pmod(F.xxhash64("block"), F.lit(salts))).cast("int").alias("part"), F.lit(POSTINGS).alias("kind"),
        none.cast("long").alias("code"), none.cast("long").alias("total"), "block", "codes", "sizes", "docs", "times",
    )
    told = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).select(
        (F.col("bucket") * salts + F.col("salt")).cast("int").alias("part"), F.lit(DOCS).alias("kind"), "code", "total",
        none.cast("long").alias("block"), *(none.cast("binary").alias(c) for c in ("codes", "sizes", "docs", "times")),
    )
    n = max(tasks(spark), min(BUCKETS * salts, -(-size // PIECE_BYTES)))
    given = told.unionByName(sent).repartition(n, "part").sortWithinPartitions("part", "kind").mapInArrow(_contributions, "block long, docs binary, counts binary, best binary")
    ddl = ", ".join(f"{c} long" for c in _OUT.names[:-1]) + ", groups_sha256 string"
    return of(DOCS).select("block", "ids", "n", "digests").groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_summed, ddl)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
