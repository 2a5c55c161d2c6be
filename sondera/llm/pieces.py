"""SentencePiece BPE: encoding by backtracking over longest matches, and decoding.

A sequence of pieces is what merging gives if, and only if, any two neighbours merge back to themselves when merged
alone (and a lone piece to itself). So no merge queue over the text is needed: an Aho-Corasick pass finds the longest piece
at each character; from left to right the longest piece that suits its left neighbour is taken, then shorter
prefixes of it, and where none suits, the last piece is taken back. A prefix of a text has one such sequence only, so a
position that failed once fails always; a bit for each position remembers it, and the time is linear in the text.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import rows, text_slices

SPACE = "▁"
#: Words and neighbour checks that a worker remembers; words longer than LONG characters are not remembered.
WORDS, PAIRS, LONG = 800_000, 1_000_000, 64
NONE = float("-inf")
#: Kinds of pieces as the model file numbers them (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")
codecs.register_error("sondera-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and kinds of a BPE model file; models with other rules than merging alone are refused."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        rules, norm = {}, {}
        with open(path, "rb") as f:
            data = f.read()
        for n, v in _fields(data):
            if n == 1:
                x = dict(_fields(v))
                self.pieces.append(x[1].decode())
                self.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
            elif n == 2:
                rules = dict(_fields(v))
            elif n == 3:
                norm = dict(_fields(v))
        known = (
            rules.get(3, 1) == 2 and rules.get(24, 0) == 0  # BPE; spaces before words
            and not norm.get(2) and norm.get(3, 1) == 1 and norm.get(4, 1) == 0 and norm.get(5, 1) == 1  # text as it is, with a space before it
            and USER not in self.kinds and UNUSED not in self.kinds
        )
        if not known:
            raise ValueError(f"{path}: a BPE model that keeps the text as it is, with a space before it, is needed")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        #: No piece has a space after another sign or has a line end, so no merge joins what lies on both sides of such places.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}|\\n", p) for p in self.ids)


class Encoder:
    """Ids of texts. A sign that no piece begins with stands for itself until the end, then for its bytes; meanwhile
    it has a number beyond those of the pieces."""

    def __init__(self, model: Model):
        self.m, self.most = model, len(model.pieces)
        self.find = ahocorasick.Automaton()
        for p, i in model.ids.items():
            self.find.add_word(p, (len(p) - 1, i))
        self.find.make_automaton()
        self.size, self.shorter = [0] * self.most, [-1] * self.most
        for p, i in model.ids.items():
            self.size[i] = len(p)
            self.shorter[i] = next((model.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in model.ids), -1)  # the longest piece that it begins with
        self.score = {p: model.scores[i] for p, i in model.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, str] = {}

    def piece(self, i: int) -> str:
        return self.m.pieces[i] if i < self.most else chr(i - self.most)

    def suits(self, left: int, right: int) -> bool:
        """Whether the two pieces (left -1 at the beginning) come back when their text is merged anew: the pair
        of the highest score first, of equal ones the leftmost."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self.piece(left) if left >= 0 else "", self.piece(right)
        out = self.pairs[left << 32 | right] = not (a and a + b in self.score) and self._stays(a, b)
        return out

    def _stays(self, left: str, right: str) -> bool:
        s, border, score = list(left + right), len(left), self.score.get
        merges = [score(a + b, NONE) for a, b in zip(s, s[1:])]
        while merges:
            best = max(merges)
            if best == NONE:
                break
            k = merges.index(best)
            if k == border - 1:
                return False
            border -= k < border
            s[k : k + 2] = [s[k] + s[k + 1]]
            del merges[k]
            if k:
                merges[k - 1] = score(s[k - 1] + s[k], NONE)
            if k < len(merges):
                merges[k] = score(s[k] + s[k + 1], NONE)
        return len(s) == (2 if left else 1)

    def backtrack(self, text: str) -> list[int]:
        """Pieces and lone signs of a text."""
        n, size, shorter, pairs, most = len(text), self.size, self.shorter, self.pairs, self.most
        longest = [-1] * n
        for end, (back, i) in self.find.iter(text):  # for each beginning the last match is the longest
            longest[end - back] = i
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        last, at, i = -1, 0, longest[0]
        if i < 0:
            i = most + ord(text[0])
        while True:
            while i >= 0:
                end = at + (size[i] if i < most else 1)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get(last << 32 | i)
                    if fits is None:
                        fits = self.suits(last, i)
                    if fits:
                        break
                i = shorter[i] if i < most else -1
            else:  # nothing suits here, ever: the last piece gives way to a shorter one
                if last < 0:
                    raise AssertionError(f"no pieces for {text[:40]!r}")
                failed[at >> 3] |= 1 << (at & 7)
                out.pop()
                at -= size[last] if last < most else 1
                i = shorter[last] if last < most else -1
                last = out[-1] if out else -1
                continue
            out.append(i)
            at, last = end, i
            if at == n:
                return out
            i = longest[at]
            if i < 0:
                i = most + ord(text[at])

    def ids_of(self, word: str) -> list[int]:
        out = self.backtrack(word)
        if max(out) < self.most:
            return out
        byte, unknown = self.m.bytes, self.m.unknown
        return [j for i in out for j in ([i] if i < self.most else [byte[b] for b in chr(i - self.most).encode()] if byte else [unknown])]

    def _word(self, word: str) -> str:
        got = self.words.get(word)
        if got is None:
            got = ",".join(map(str, self.ids_of(word)))
            if len(word) <= LONG:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[word] = got
        return got

    def encode(self, text: str) -> str:
        """The ids of a text, in decimal joined by commas. Words are encoded each for itself if no piece crosses
        their borders."""
        if not text:
            return ""
        text = SPACE + text.replace(" ", SPACE)
        return ",".join(map(self._word, _WORDS.findall(text) if self.m.by_word else [text]))


def numbers(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int32, sep=",") if ids else np.empty(0, np.int32)


class Decoder:
    """Text of ids. Signs of bytes that are no UTF-8 become U+FFFD, one for each byte; the first space goes."""

    def __init__(self, model: Model):
        surface = []
        for p, k in zip(model.pieces, model.kinds, strict=True):
            surface.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode())
        self.size = np.array([len(x) for x in surface], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.drops = np.array([p.startswith(SPACE) and k == NORMAL for p, k in zip(model.pieces, model.kinds, strict=True)])
        self.silent = np.array([k == CONTROL for k in model.kinds])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text. Control pieces are silent, but no sign goes across them."""
        if not len(ids):
            return b""
        if not self.silent[ids].any():
            return self._plain(ids, True)
        parts = [p[int(self.silent[p[0]]) :] for p in np.split(ids, np.flatnonzero(self.silent[ids])) if len(p)]
        return b"".join(self._plain(p, k == 0) for k, p in enumerate(p for p in parts if len(p)))

    def _plain(self, ids: np.ndarray, begins: bool) -> bytes:
        n = self.size[ids]
        out = self.flat[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        if begins and self.drops[ids[0]]:
            out = out[1:]
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "sondera-each-byte").encode()
        return out


_LOADED: dict[str, tuple[Encoder, Decoder]] = {}


def loaded(path: str) -> tuple[Encoder, Decoder]:
    """The coder of a model file, built once a worker."""
    if path not in _LOADED:
        m = Model(path)
        _LOADED[path] = Encoder(m), Decoder(m)
    return _LOADED[path]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, a row for a row; null and empty texts have none. No other column counts,
    repeated rows are encoded each for itself, and an empty table gives an empty table."""
    path = model or model_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = loaded(path)
        for b in text_slices(batches):
            yield rows(schema, doc_id=b.column("doc_id"), ids=[numbers(coder.encode(t or "")) for t in b.column("text").to_pylist()])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids are no ids, and no ids give an empty text."""
    path = model or model_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coder = loaded(path)
        for b in batches:
            ids = b.column("ids").to_pylist()
            yield rows(schema, doc_id=b.column("doc_id"), text=[coder.decode(np.array(x or [], np.int32)).decode() for x in ids])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Number and digest of each text's ids, and the digest of the text that these ids decode to; rows as in encode()."""
    path = model or model_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = loaded(path)
        for b in text_slices(batches):
            n, a, z = [], [], []
            for t in b.column("text").to_pylist():
                said = enc.encode(t or "")
                ids = numbers(said)
                n.append(len(ids))
                a.append(sha(said.encode()))
                z.append(sha(dec.decode(ids)))
            yield rows(schema, doc_id=b.column("doc_id"), n_tokens=n, ids_sha256=a, decoded_sha256=z)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
