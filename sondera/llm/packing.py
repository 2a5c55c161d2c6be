"""Packing token sequences by order-preserving dynamic programming.

Documents keep their order by id. Windows of at most 4096 tokens are cut at document ends, at sentence ends or,
at a price, within sentences; the cuts minimise padding plus truncation penalties. The best predecessor of a cut
is a sliding-window minimum, kept in a monotone queue, so a chunk of documents takes linear time.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCode, rows, tasks, text_slices, texts_of

WINDOW, END_ID = 4096, 2
#: Penalties, in tokens of padding, of a cut at a sentence end and of one within a sentence.
AT_SENTENCE, WITHIN = 4.0, 24.0
#: Within a sentence, cuts are considered at each so many tokens.
STRIDE = 32
#: Tokens that are cut together: a chunk ends with the document that fills it.
CHUNK = 64 * WINDOW
#: Words and stems that a worker remembers, and stems that it has ids of. Full, the word table keeps the words met again
#: since it was last full; the stems are found anew, while the ids of known words stay.
WORDS, STEMS, STORED = 400_000, 300_000, 2_000_000
#: A Latin-1 word with signs behind it is tokenised as its lower-case letters, then the signs (an apostrophe may begin a
#: token with letters, so it isn't among them); other words as they are.
_PLAIN = re.compile("^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)|(.*))$", re.M)


#: The tokeniser's rules (as its file states them) under which words can be encoded each for itself.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}
_SENTENCE = re.compile(r"\n|[.!?](?=\s|$)")


class Tokens:
    """Token ids of ASCII-space-separated words, each encoded once, if the tokeniser's rules are known never to join what such a
    space parts; under other rules whole texts are encoded."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_word = all(rules.get(k) == v for k, v in _BY_WORD.items()) and rules["model"].get("end_of_word_suffix") == "</w>" and rules["model"].get("dropout") is None
        vocab = self.tk.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a stem
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.code = WordCode()
        self.stem, self.mark, self.stop, self.hits = (np.zeros(1 << 16, t) for t in (np.int32, np.int32, bool, np.int32))
        self._reset_stems()

    def _reset_stems(self) -> None:
        """Stem 0 is empty. Signs are stems as well."""
        self.stems: dict[str, int] = {}
        self.flat, self.used, self.stored = np.zeros(1 << 20, np.uint16 if len(self.last) <= 1 << 16 else np.uint32), 0, 0
        self.off, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self._store([""], [[]])

    def _ids(self, text: str) -> list[int]:
        return self.tk.encode(text, add_special_tokens=False).ids

    def _store(self, stems: list[str], ids: list[list[int]] | None = None, flat: np.ndarray | None = None, n: np.ndarray | None = None) -> None:
        if ids is not None:
            flat, n = np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        first = self.stored
        self.stored += len(stems)
        self.stems.update(zip(stems, range(first, self.stored), strict=True))
        while len(self.n) < self.stored:
            self.off, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.n))
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.off[first : first + len(stems)], self.n[first : first + len(stems)] = self.used + np.cumsum(n) - n, n
        self.used += len(flat)

    def _learn_stems(self, plain: list[str], other: list[str]) -> None:
        """Plain stems are encoded many at a time, joined by spaces; a stem's ids end with one that ends a word."""
        for at in range(0, len(plain), 4000):
            part = plain[at : at + 4000]
            ids = np.array(self.tk.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                self._store(part, flat=ids, n=np.diff(ends, prepend=0))
            else:
                self._store(part, [self._ids(x) for x in part])
        if other:
            self._store(other, [e.ids for e in self.tk.encode_batch_fast(other, add_special_tokens=False)])

    def _learn(self, known: int) -> None:
        words = self.code.words[known:]
        while len(self.stem) < len(self.code.words):
            self.stem, self.mark, self.stop, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.stem, self.mark, self.stop, self.hits))
        parts = _PLAIN.findall(b"\n".join(words).decode("utf-8", "replace"))
        keys = [a.lower() or z for a, _, z in parts]
        new = {k: bool(a) for k, (a, _, _) in zip(keys, parts, strict=True) if k not in self.stems}
        new |= dict.fromkeys({m for _, m, _ in parts}.difference(self.stems, new), False)
        if new:
            self._learn_stems([k for k, plain in new.items() if plain], [k for k, plain in new.items() if not plain])
        to = slice(known, known + len(words))
        self.stem[to] = np.fromiter(map(self.stems.__getitem__, keys), np.int32, len(keys))
        self.mark[to] = [self.stems[m] for _, m, _ in parts]
        self.stop[to] = [w[-1] in b".!?" for w in words]
        self.hits[to] = 0

    def _make_room(self) -> None:
        if self.stored > STORED:
            self._reset_stems()
            self.code.reset()
        elif len(self.stems) > STEMS:
            self.stems = {"": 0}
        if len(self.code.words) > WORDS:
            keep = np.flatnonzero(self.hits[: len(self.code.words)] > 1)
            keep = keep[np.argsort(-self.hits[keep], kind="stable")[: WORDS // 2]]
            words = [self.code.words[i] for i in keep]
            self.code.reset()
            self.code.update(zip(words, range(len(words)), strict=True))
            self.code.words = words
            for x in (self.stem, self.mark, self.stop):
                x[: len(keep)] = x[keep]
            self.hits[: len(keep)] = 0

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, places in them where a sentence or line ends) of each text, without the end id."""
        if not self.by_word:
            for t in texts:
                text = t.decode("utf-8", "replace")
                e = self.tk.encode(text, add_special_tokens=False)
                ends = np.array([m.end() for m in _SENTENCE.finditer(text)], np.int64)
                starts = np.array([a for a, _ in e.offsets], np.int64)
                yield np.array(e.ids, np.uint32), np.unique(np.searchsorted(starts, ends, "left"))
            return
        self._make_room()
        known = len(self.code.words)
        words, breaks, ends = [], [], []
        for t in texts:
            for line in t.split(b"\n"):
                words += line.split()
                breaks.append(len(words))
            ends.append(len(words))
        c = self.code.of(words)
        if len(self.code.words) > known:
            self._learn(known)
        self.hits[: len(self.code.words)] += np.bincount(c, minlength=len(self.code.words)).astype(np.int32)
        units = np.empty(2 * len(c), np.int64)
        units[0::2], units[1::2] = self.stem[c], self.mark[c]
        n = self.n[units]
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = self.flat[np.repeat(self.off[units] - upto[:-1], n) + np.arange(upto[-1])].astype(np.uint32)
        upto = upto[0::2]
        stop = np.zeros(len(words) + 1, bool)
        stop[1:] = self.stop[c]
        stop[breaks] = True
        cut = np.flatnonzero(stop)
        a = 0
        for z in ends:
            i, j = np.searchsorted(cut, [a, z], "right")
            yield ids[upto[a] : upto[z]], upto[cut[i:j]] - upto[a]
            a = z


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The worker process's tokens: tasks that follow each other in it share what it has learned."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def tail_pieces(length: int) -> list[int]:
    """Powers of two, largest first, that add up to length."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def cuts(pos: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the best cuts, from pos[0] to pos[-1]: a list of window ends.

    pos: increasing candidate cuts with gaps of at most `window`. The cost of a window is its padding to
    `window` (none at the full length or, in the last stretch, if it is split into powers of two) plus the penalty
    of the cut at its end. For a cut at j: cost(j) = penalty(j) + window - pos(j) + min over i of cost(i) + pos(i),
    where i runs over the candidates in the last `window` tokens: a sliding minimum.
    """
    p, pen = pos.tolist(), penalty.tolist()
    m = len(p)
    cost, back = [0.0] * m, [0] * m
    key = [0.0] * m  # cost + pos
    key[0] = p[0]
    q = deque([0])
    for j in range(1, m):
        low = p[j] - window
        while p[q[0]] < low:
            q.popleft()
        i = q[0]
        back[j] = i
        cost[j] = c = pen[j] + window - p[j] + key[i]
        key[j] = k = c + p[j]
        while q and key[q[-1]] >= k:
            q.pop()
        q.append(j)
    end, best, how = p[-1], (float("inf"), 0, []), []
    for i in range(m - 2, -1, -1):
        length = end - p[i]
        if length > window:
            break
        parts = tail_pieces(length)
        price = (len(parts) - 1) * WITHIN
        how = parts if price < window - length else [length]
        best = min(best, (cost[i] + min(price, window - length), i, how), key=lambda x: x[0])
    _, i, how = best
    out = (p[i] + np.cumsum(how)).tolist()
    while i:
        out.append(p[i])
        i = back[i]
    return sorted(out)


def candidates(lengths: np.ndarray, sentence: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts of a chunk and their penalties: document ends, sentence ends, and places within long stretches."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    s = np.concatenate([x[(x > 0) & (x < n - 1)] + a for x, n, a in zip(sentence, lengths, starts, strict=True)] or [np.empty(0, np.int64)])
    at = np.unique(np.concatenate([[0], s, ends]))
    gap = np.diff(at)
    wide = np.flatnonzero(gap > 2 * STRIDE)
    extra = (gap[wide] - 1) // STRIDE
    inner = np.repeat(at[wide], extra) + STRIDE * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
    pos = np.concatenate([at, inner])
    pen = np.concatenate([np.where(np.isin(at, ends), 0.0, AT_SENTENCE), np.full(len(inner), WITHIN)])
    order = np.argsort(pos, kind="stable")
    return pos[order], pen[order]


_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False, as_stored: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, a row for each piece.

    Documents are dealt by ranges of doc_id (nulls first, repeated rows one after the other) and kept in order; with
    as_stored they are packed in the order and the partitions in which docs are read, without a shuffle (a mix stored in
    the order of its shards keeps it). Other columns are left aside; an empty table gives no rows. A document's ids are those of its whole text and the end id; null and empty texts have the end id alone. Each
    chunk of documents ends with sequences whose lengths are powers of two, or one padded sequence. with_ids adds
    each piece's ids.
    """
    path = tokenizer or tokenizer_path()
    schema = _SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number = tokens_of(path), TaskContext.get().partitionId() << 32
        docs_in: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs_in, held, number
            lengths = np.array([len(x[1]) + 1 for x in docs_in], np.int64)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            ids = np.full(ends[-1], END_ID, np.uint32)
            for a, x in zip(starts, docs_in, strict=True):
                ids[a : a + len(x[1])] = x[1]
            w = np.array(cuts(*candidates(lengths, [x[2] for x in docs_in])), np.int64)
            edge = np.unique(np.concatenate([[0], w, ends]))
            a, z = edge[:-1], edge[1:]
            d, s = np.searchsorted(ends, a, "right"), np.searchsorted(w, a, "right")
            raw = memoryview(ids.astype("<u4").tobytes())
            first = np.concatenate([[0], w])
            cols = {
                "doc_id": [docs_in[i][0] for i in d], "start": a - starts[d], "length": z - a, "ids_crc32": [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a, z, strict=True)],
                "doc_tokens": lengths[d], "sequence_id": number + s, "offset": a - first[s],
            }
            if with_ids:
                cols["ids"] = [ids[x:y].astype(np.int32) for x, y in zip(a, z, strict=True)]
            number += len(w)
            docs_in, held = [], 0
            return rows(schema, **cols)

        for b in text_slices(batches):
            for i, (x, s) in zip(b.column("doc_id").to_pylist(), tokens.of(texts_of(b)), strict=True):
                docs_in.append((i, x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, s))
                held += len(x) + 1
                if held >= CHUNK:
                    yield flush()
        if docs_in:
            yield flush()

    dealt = docs.select("doc_id", "text")
    if not as_stored:
        dealt = dealt.repartitionByRange(tasks(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(run, ", ".join(f"{c.name} long" for c in _SCHEMA) + ", ids array<int>" * with_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
