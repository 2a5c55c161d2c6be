"""Substring dedup with compressed FM-indexes.

A window of 20 words belongs to the shard that its minimizer chooses, the least hash of its 8-word grams: equal
windows meet in one shard, whatever surrounds them. A document goes to the shards in fragments, runs of windows with
one minimizer. Fragments whose minimizer occurs only once in the corpus can't repeat and stay behind. Each shard
builds a compressed FM-index (the Burrows-Wheeler transform in a wavelet matrix of bit vectors), lets the suffix order
go, and streams its fragments through backward search, from right to left with a parent step at 20 words: the
matching statistics, up to the threshold, against all that the shard holds. Intervals of windows whose earliest match
is another place are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyRows, Repeated, Scratch, WordHash, blob, block_of, dealt, gram_hashes, pieces, repeated_keys, rows, runs, text_slices, texts_of

WINDOW, GRAM = 20, 8
#: A fragment, or a run of windows to delete: document, hash of its text, first window, windows.
_RUN = np.dtype([("d", "<i8"), ("t", "<i8"), ("s", "<u4"), ("w", "<u4")])
_NULL = -(1 << 63)


def minimizers(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each run of windows with the same leftmost least gram."""
    if len(h) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    g = gram_hashes(h, gram)
    best, width, span = np.arange(len(g)), 1, window - gram + 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(g[a] <= g[b], a, b)
        width += step
    at = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    return g[best[at]], at, np.diff(np.append(at, len(best)))


def blocks_sent(docs: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """Each block's distinct minimizers with the times that they were chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, send = WordHash(), KeyRows(buckets)
        for b in text_slices(batches):
            k, found = b.column("k").to_numpy(), [minimizers(words.of(t.split()), window, gram)[0] for t in texts_of(b)]
            order = np.argsort(k, kind="stable").tolist()
            blocks = [(int(k[order[x]]), *np.unique(np.concatenate([found[i] for i in order[x:y]]), return_counts=True)) for x, y in runs(k[order])]
            yield send.rows(blocks)

    return docs.mapInArrow(run, KeyRows.DDL)


_FRAGMENTS = pa.schema([("shard", pa.int32()), ("k", pa.int64()), ("runs", pa.binary()), ("words", pa.binary()), ("codes", pa.binary())])


def fragments(docs: DataFrame, flags: DataFrame, window: int, gram: int, buckets: int, shards: int) -> DataFrame:
    """(shard, k, runs, words, codes): fragments with a shared minimizer, by shard, coded with the row's own word list.

    A block sends a fragment once, from its first place; its other places are known to be later copies, and come as
    rows without words, dealt over the shards.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rep, hashes, out, later = Repeated(right, buckets), WordHash(), [], []
        k = left.column("k")[0].as_py()
        first: dict[bytes, tuple] = {}
        todo: dict[int, list[tuple]] = {}
        places = []
        for b in text_slices(left.to_batches()):
            for d, t in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
                h = hashes.of(t.split())
                v, at, n = minimizers(h, window, gram)
                hit = np.flatnonzero(rep.levels(v) > 0)
                if len(hit):
                    th = xxhash.xxh3_64_intdigest(t)
                    places.append((_NULL if d is None else d, th - (1 << 64) if th >> 63 else th, h, (v[hit] % np.uint64(shards)).tolist(), at[hit].tolist(), n[hit].tolist()))
        places.sort(key=lambda x: x[:2])
        for d, th, h, shard, at, n in places:
            raw = h.tobytes()
            for s, a, w in zip(shard, at, n, strict=True):
                key = raw[8 * a : 8 * (a + w + window - 1)]
                if (old := first.setdefault(key, (d, a))) == (d, a):
                    todo.setdefault(s, []).append((d, th, a, w, key))
                elif old < (d, a):
                    later.append((d, th, a, w))
                else:
                    todo.setdefault(s, []).append((d, th, a, w, key))
        for s, f in todo.items():
            u, codes = np.unique(np.frombuffer(b"".join(x[4] for x in f), np.int64), return_inverse=True)
            out.append((s, blob(np.array([x[:4] for x in f], _RUN)), blob(u), blob(codes.astype(np.uint16 if len(u) <= 1 << 16 else np.uint32))))
        if later:
            out.append((k % shards, blob(np.array(later, _RUN)), b"", b""))
        s, r, w, c = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.Table.from_batches([rows(_FRAGMENTS, shard=list(s), k=[k] * len(s), runs=list(r), words=list(w), codes=list(c))], _FRAGMENTS)

    return docs.groupBy("k").cogroup(flags.groupBy("k")).applyInArrow(run, "shard int, k long, runs binary, words binary, codes binary")


class Bits:
    """A bit vector with constant-time rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)]).astype(np.int32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def last(self, i: np.ndarray) -> np.ndarray:
        """Place of the last one at or before i (there is one)."""
        w, at = i >> 6, np.empty(len(i), np.int64)
        x = self.words[w] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (i & 63)).astype(np.uint64))
        todo = np.arange(len(i))
        while len(todo):
            hit = x != 0
            at[todo[hit]] = (w[hit] << 6) + _top(x[hit])
            todo, w = todo[~hit], w[~hit] - 1
            x = self.words[w]
        return at

    def next(self, i: np.ndarray, n: int) -> np.ndarray:
        """Place of the first one after i, n if there is none."""
        w, at = i >> 6, np.full(len(i), n, np.int64)
        x = self.words[w] & (np.uint64(0xFFFFFFFFFFFFFFFE) << (i & 63).astype(np.uint64))
        todo = np.arange(len(i))
        while len(todo):
            hit = x != 0
            at[todo[hit]] = (w[hit] << 6) + _top(x[hit] & (~x[hit] + np.uint64(1)))
            left = ~hit & (w + 1 < len(self.words))
            todo, w = todo[left], w[left] + 1
            x = self.words[w]
        return at

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


def _top(x: np.ndarray) -> np.ndarray:
    """Number of the highest bit of each non-zero word."""
    high = x >> np.uint64(32)
    return np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1] - 1).astype(np.int64)


#: What stream() says of a window that the index doesn't hold, or holds at one place that it doesn't keep.
NONE, ONCE = -1, -2


class FMIndex:
    """Compressed FM-index of an integer text (values 1 and up) for windows of `depth` symbols.

    Kept are the Burrows-Wheeler transform in a wavelet matrix, bit vectors of the rows where the first depth - 1 and the
    first depth symbols change, and the earliest place of each window that occurs twice or more (of every window with
    `every`). Suffixes are sorted to `depth` symbols, by prefix doubling, and their order is let go.
    """

    def __init__(self, text: np.ndarray, depth: int, every: bool = False):
        n, self.depth, self.n = len(text), depth, len(text)
        rank, short, h = text.astype(np.int64), None, 1

        def ahead(r: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[: max(0, n - by)] = r[by:] + 1
            return out

        order = None
        while h < depth:  # ranks of the next h symbols; the last step overlaps
            if h >= depth - 1:
                short = rank
            step = min(h, depth - h)
            key = rank * (int(rank.max()) + 2) + ahead(rank, step)
            if h + step == depth and short is None:
                other = rank * (int(rank.max()) + 2) + ahead(rank, step - 1)  # depth - 1 symbols
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            h += step
        if order is None:
            order = np.argsort(rank, kind="stable")
        s = rank[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        s = (short if short is not None else other)[order] if depth > 1 else np.zeros(n, np.int64)
        self.shorter, self.heads = Bits(np.concatenate([[True], s[1:] != s[:-1]])), Bits(new)
        start = np.flatnonzero(new)
        held = np.diff(np.append(start, n)) > 1
        if every:
            held[:] = True
        self.held = Bits(held)
        self.place = np.minimum.reduceat(order, start)[held].astype(np.int32 if n < 1 << 31 else np.int64)
        bwt = text[order - 1]
        del rank, short, order, s, new, start
        sigma = int(text.max()) + 1
        self.c = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels, self.zeros = [], []
        for bit in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):  # wavelet matrix
            ones = (bwt >> bit) & 1
            self.levels.append((bit, Bits(ones.astype(bool))))
            self.zeros.append(int(n - ones.sum()))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])
        self.origin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    @property
    def nbytes(self) -> int:
        return sum(b.nbytes for _, b in self.levels) + self.shorter.nbytes + self.heads.nbytes + self.held.nbytes + self.place.nbytes + self.c.nbytes + self.origin.nbytes

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (bit, bits), z in zip(self.levels, self.zeros, strict=True):
            one = bits.rank1(i)
            i = np.where((c >> bit) & 1, z + one, i - one)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of the patterns c + X from those of X; empty for symbols that the text doesn't have."""
        known = (c > 0) & (c < len(self.c) - 1)
        c = np.where(known, c, 1)
        base = self.c[c] - self.origin[c]
        lo, hi = base + self._descend(c, lo), base + self._descend(c, hi)
        return lo, np.where(known, hi, lo)

    def parent(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the first depth - 1 symbols of rows."""
        return self.shorter.last(row), self.shorter.next(row, self.n)

    def earliest(self, row: np.ndarray) -> np.ndarray:
        """Earliest place of the window at the head of rows, ONCE where it isn't kept."""
        g = self.heads.rank1(row + 1) - 1
        out = np.full(len(row), ONCE, np.int64)
        held = self.held.get(g)
        out[held] = self.place[self.held.rank1(g[held])]
        return out

    def stream(self, text: np.ndarray, at: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Earliest place of each window of the stretches of `text` at `at`, NONE where the index doesn't hold it; stretch by
        stretch, from the left.

        Stretches are streamed side by side, from the right: a lane holds the interval of the symbols matched so far, at most
        a window. At a full window the interval's place is noted and the last symbol let go by a parent step. A symbol
        that can't be matched ends all windows over it; the lane starts anew with the next window to the left.
        """
        first = np.cumsum(windows) - windows
        out = np.full(int(windows.sum()), NONE, np.int64)
        lane = np.flatnonzero(windows > 0)
        i = at[lane] + windows[lane] + self.depth - 2  # symbol that comes next
        have = np.zeros(len(lane), np.int64)
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64)
        while len(lane):
            lo, hi = self.extend(text[i], lo, hi)
            ok = hi > lo
            have += 1
            full = ok & (have == self.depth)
            if full.any():
                f = np.flatnonzero(full)
                out[first[lane[f]] + i[f] - at[lane[f]]] = self.earliest(lo[f])
                lo[f], hi[f] = self.parent(lo[f])
                have[f] -= 1
            i = i - 1
            if not ok.all():
                f = np.flatnonzero(~ok)
                i[f] += have[f] - 1  # all windows over the stretch that failed are out: the one that ends before its end is next
                have[f], lo[f], hi[f] = 0, 0, self.n
            going = i - self.depth + 1 + have >= at[lane]
            if not going.all():
                lane, i, have, lo, hi = lane[going], i[going], have[going], lo[going], hi[going]
        return out


_LATER = pa.schema([("k", pa.int64()), ("runs", pa.binary())])


def search_shard(window: int):
    def run(t: pa.Table) -> pa.Table:
        coded = pc.greater(pc.binary_length(t.column("words")), 0)
        known = t.filter(pc.invert(coded)).select(["k", "runs"]).cast(_LATER)
        t = t.filter(coded)
        if not t.num_rows:
            return known
        parts = [np.frombuffer(x, _RUN) for x in t.column("runs").to_pylist()]
        ks = np.repeat(t.column("k").to_numpy(), [len(x) for x in parts])
        words = [np.frombuffer(x, np.int64) for x in t.column("words").to_pylist()]
        _, inv = np.unique(np.concatenate(words), return_inverse=True)
        code, a = [], 0
        for w, x in zip(words, t.column("codes").to_pylist(), strict=True):
            code.append(inv[a : a + len(w)][np.frombuffer(x, np.uint16 if len(w) <= 1 << 16 else np.uint32)] + 2)  # 1 parts fragments
            a += len(w)
        code, r = np.concatenate(code).astype(np.int32), np.concatenate(parts)
        length = r["w"].astype(np.int64) + window - 1
        at = np.cumsum(length) - length
        order = np.lexsort((r["s"], r["d"]))
        seen: dict[bytes, int] = {}
        which = np.empty(len(r), np.int64)
        firsts = []
        raw = code.tobytes()
        for i in order.tolist():  # equal fragments are indexed once, at their first place
            key = raw[4 * at[i] : 4 * (at[i] + length[i])]
            if (n := seen.setdefault(key, len(firsts))) == len(firsts):
                firsts.append(i)
            which[i] = n
        f = np.array(firsts)
        size = length[f] + 1
        place = np.cumsum(size) - size
        text = np.ones(int(size.sum()), np.int32)
        pick = np.repeat(at[f] - place, size) + np.arange(len(text))
        inside = np.arange(len(text)) - np.repeat(place, size) < np.repeat(length[f], size)
        text[inside] = code[pick[inside]]
        n = r["w"][f].astype(np.int64)
        found = FMIndex(text, window).stream(text, place, n)
        from_ = np.cumsum(n) - n
        own = np.repeat(place - from_, n) + np.arange(len(found))
        dup = (found != own) & (found != ONCE)
        # runs of deleted windows: all of a later copy, what has an earlier match of a first place
        d, s = r["d"], r["s"].astype(np.int64)
        copy = np.flatnonzero((d != d[f][which]) | (s != s[f][which]))
        out = [np.stack([copy, s[copy], r["w"][copy].astype(np.int64)])]
        of = np.repeat(np.arange(len(f)), n)
        idx = np.flatnonzero(dup)
        if len(idx):
            head = np.concatenate([[True], (np.diff(idx) > 1) | (of[idx[1:]] != of[idx[:-1]])])
            x = idx[head]
            w = np.diff(np.append(np.flatnonzero(head), len(idx)))
            out.append(np.stack([f[of[x]], s[f[of[x]]] + x - from_[of[x]], w]))
            same = np.flatnonzero((which != -1) & ~np.isin(np.arange(len(r)), f) & (d == d[f][which]) & (s == s[f][which]))  # repeated rows of one document
            for i in same.tolist():
                g = which[i]
                hit = np.flatnonzero(dup[from_[g] : from_[g] + n[g]])
                out.append(np.stack([np.full(len(hit), i), s[i] + hit, np.ones(len(hit), np.int64)]))
        i, s, w = np.concatenate(out, axis=1)
        res = np.zeros(len(i), _RUN)
        res["d"], res["t"], res["s"], res["w"] = r["d"][i], r["t"][i], s, w
        order = np.argsort(ks[i], kind="stable")
        res, kk = res[order], ks[i][order]
        cut = list(runs(kk))
        found = pa.Table.from_batches([rows(_LATER, k=[int(kk[x]) for x, _ in cut], runs=[blob(res[x:y]) for x, y in cut])], _LATER)
        return pa.concat_tables([known, found])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def rebuild(docs: DataFrame, later: DataFrame, window: int, digest: bool) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces (or their SHA-256) of each row."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = np.concatenate([np.zeros(0, _RUN), *(np.frombuffer(x, _RUN) for x in right.column("runs").to_pylist())])
        r = r[np.lexsort((r["s"], r["t"], r["d"]))]
        ids = {}
        for x, y in runs(r["d"]):
            for a, z in runs(r["t"][x:y]):
                ids[int(r["d"][x]), int(r["t"][x + a])] = r[x + a : x + z]
        out = []
        for b in text_slices(left.to_batches()):
            n, gone, kept = [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
                w = t.split()
                cut = 0
                if ids:
                    th = xxhash.xxh3_64_intdigest(t)
                    mine = ids.get((_NULL if d is None else d, th - (1 << 64) if th >> 63 else th))
                    if mine is not None:
                        delta = np.zeros(len(w) + 1, np.int64)
                        np.add.at(delta, mine["s"], 1)
                        np.add.at(delta, mine["s"].astype(np.int64) + mine["w"] + (window - 1), -1)
                        keep = np.cumsum(delta[:-1]) == 0
                        cut = len(w) - int(keep.sum())
                        n_all, w = len(w), [w[i] for i in np.flatnonzero(keep)]
                n.append(len(w) + cut), gone.append(cut)
                x = b" ".join(w)
                kept.append(hashlib.sha256(x).hexdigest() if digest else x.decode("utf-8", "replace"))
            out.append(rows(_OUT, doc_id=b.column("doc_id"), n_words=n, n_removed=gone, kept=kept))
        return pa.Table.from_batches(out, _OUT)

    return docs.groupBy("k").cogroup(later.groupBy("k")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each document without the words of windows that also start earlier.

    Words are runs without ASCII space, from whole texts (null: none). A window is `window` words of one document;
    earlier means a smaller doc_id (null first), or the same and an earlier start. Windows are judged on the input.
    Rows that share a doc_id are one document: at the same start neither is earlier. Kept words are joined by
    one space; shorter documents stay whole, as do long ones in memory: a document is handled in one task. Words are
    compared by 64-bit hashes. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    p = pieces(docs)
    n = 4 * p
    d = docs.select("doc_id", "text", block_of(F.col("doc_id")).alias("k"))
    flags = repeated_keys(blocks_sent(d, window, gram, n), p)
    frag = fragments(d, flags, window, gram, n, n // 2)
    later = scratch.cut(dealt(frag, p, "shard").groupBy("shard").applyInArrow(search_shard(window), "k long, runs binary"), "later")
    return rebuild(d, later, window, digest)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
