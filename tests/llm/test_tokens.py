"""Alignment, ranked search and SentencePiece coding against brute force and the libraries."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sondera.llm import alignment, pieces, ranked

ODD = [
    (1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> <s> x"), (5, "<|endoftext|> <s> x"), (None, "a  b\n\n  c \t d\x1c e　 f"), (7, "\0 q\r\n  z"),
    (8, "日本語 テキスト 😀😀"), (9, "don't  can't we'll 12345 6,7.8"), (10, "x" * 5000), (11, "\n a\n\n b \n"), (12, "a\x85 b  c᠎ d"), (13, "▁"), (14, "<0x41></s> Ǻ"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS block", "3 AS part", "'x' AS ids", "4 AS n", "5 AS score")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_codes_like_the_library(library):
    enc, dec = pieces.loaded(pieces.model_path())
    rng, known = random.Random(3), list(enc.m.ids)
    signs = "abcdeghinorst  ▁éü\n.,'12中\U0001f600"
    texts = [t or "" for _, t in ODD]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice(known) for _ in range(rng.randrange(1, 6))).replace("▁", " ") for _ in range(3000)]
    texts += [rng.choice("ab ") * rng.randrange(300) + rng.choice(known) * rng.randrange(20) for _ in range(300)]
    for t in texts:
        want = library.encode(t)
        assert enc.encode(t) == ",".join(map(str, want)), t
        assert dec.decode(np.array(want, np.int32)).decode() == library.decode(want), t
    for _ in range(3000):
        ids = [rng.randrange(300) if rng.random() < 0.7 else rng.randrange(len(enc.m.pieces)) for _ in range(rng.randrange(9))]
        assert dec.decode(np.array(ids, np.int32)).decode() == library.decode(ids), ids
    long = "".join(rng.choice(known).replace("▁", "") for _ in range(20000))  # one word
    assert enc.encode(long) == ",".join(map(str, library.encode(long)))


def test_whole_texts_when_words_may_join(library):
    enc = pieces.Encoder(pieces.Model(pieces.model_path()))
    enc.m.by_word = False
    for _, t in ODD:
        assert enc.encode(t or "") == ",".join(map(str, library.encode(t or "")))


def test_refuses_models_of_other_rules(tmp_path):
    with open(pieces.model_path(), "rb") as f:
        data = f.read()
    (tmp_path / "m").write_bytes(data + bytes([0x12, 2, 0x18, 1]))  # a later trainer message: unigram
    with pytest.raises(ValueError, match="BPE"):
        pieces.Model(str(tmp_path / "m"))


def test_round_trip(docs, odd, library):
    for d in (docs.select("doc_id", "text"), odd):
        given = [(r["doc_id"], r["text"] or "") for r in d.select("doc_id", "text").collect()]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = Counter((i, len(x := library.encode(t)), sha(",".join(map(str, x))), sha(library.decode(x))) for i, t in given)
        assert Counter(tuple(r) for r in pieces.round_trip(d).collect()) == want
        back = pieces.decode(pieces.encode(d))
        assert Counter(tuple(r) for r in back.collect()) == Counter((i, library.decode(library.encode(t))) for i, t in given)
    assert pieces.round_trip(odd.where("false")).count() == 0


def brute_alignment(given, library):
    tk = Tokenizer.from_file(alignment.path_a())
    tk.encode_special_tokens = True
    signs, names = alignment.byte_signs(), {i: t for t, i in tk.get_vocab().items()}
    rows, count = [], Counter()
    for i, t in given:
        a, b, want = (tk.encode(" " + t, add_special_tokens=False).ids, library.encode(t), (" " + t).encode()) if t else ([], [], b"")
        of_a = [bytes(signs[c] for c in names[x]) for x in a]
        of_b = [bytes([x - 3]) if library.is_byte(x) else library.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(of_a) != want or b"".join(of_b) != want:
            rows.append((i, [], [], [], [], ""))
            continue
        ends_a, ends_b = (dict(zip(np.cumsum([len(x) for x in y]).tolist(), range(len(y)), strict=True)) for y in (of_a, of_b))
        common = sorted(set(ends_a) & set(ends_b))
        groups = [
            ",".join(map(str, a[(ends_a[p] + 1 if p else 0) : ends_a[e] + 1])) + "|" + ",".join(map(str, b[(ends_b[p] + 1 if p else 0) : ends_b[e] + 1]))
            for p, e in zip([0, *common], common, strict=False)
        ]
        links = [(a[x], b[y]) for e, x in ends_a.items() for f, y in ends_b.items() if e == f] if len(a) < 400 else [(a[ends_a[e]], b[ends_b[e]]) for e in common]
        count.update(links)
        rows.append((i, a, b, groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return Counter((i, len(a), len(b), len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), h) for i, a, b, g, x, h in rows)


@pytest.mark.parametrize("limits", [(2_000_000, 8192, 400_000, 32 << 20), (900, 7, 500, 64)])
def test_alignment(docs, odd, library, scratch, monkeypatch, limits):
    """The smaller limits make many blocks, tables that start anew, and several parts for a bucket."""
    for name, x in zip(("BLOCK_LINKS", "BLOCK_DOCS", "CHUNKS", "PIECE_BYTES"), limits, strict=True):
        monkeypatch.setattr(alignment, name, x)
    alignment._LOADED.clear()
    assert alignment.aligner(alignment.path_a(), alignment.model_path()).by_chunk
    d = odd.select("doc_id", "text").union(docs.select("doc_id", "text").limit(60))
    given = [tuple(r) for r in d.collect()]
    got = alignment.align(d.selectExpr("*", "1 AS code", "2 AS bucket"), scratch)
    assert Counter(tuple(r) for r in got.collect()) == brute_alignment(given, library)
    assert alignment.align(odd.where("false"), scratch).count() == 0


def test_sums_beyond_doubles():
    x = np.array([(1 << 61) + 1, (1 << 60) + 3, 5])
    assert alignment.exact_bins(np.array([1, 1, 0]), x).tolist() == [5, (1 << 61) + (1 << 60) + 4]


def brute_search(given, items, k):
    rx = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [rx.findall((t or "").translate(fold)) for _, t in given]
    n, total, df = sum(map(bool, words)), sum(map(len, words)), Counter(w for x in words for w in set(x))
    counts = [Counter(x) for x in words]
    out = []
    for item, text in items:
        ask = set(rx.findall((text or "").translate(fold))) & set(df)
        hits = []
        for (i, _), x, c in zip(given, words, counts, strict=True):
            m = 50 + (50 * len(x) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in ask if c[w])
            if s > 0:
                hits.append((-s, i is None, i or 0, i))
        out += [(item, r, h[3], -h[0]) for r, h in enumerate(sorted(hits)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("k", "limits"), [(50, {}), (3, {"PART_BYTES": 5000, "CELLS": 16}), (5, {"QUERIES": 7}), (1, {"PART_BYTES": 1, "DEPTH": 0})])
def test_ranked_search(spark, sf, docs, odd, scratch, monkeypatch, k, limits):
    """Small limits make many parts, intervals by halves, and rounds of queries."""
    for name, x in limits.items():
        monkeypatch.setattr(ranked, name, x)
    d = odd.select("doc_id", "text").union(docs.select("doc_id", "text")).selectExpr("*", "1 AS rank", "2 AS item_id", "3 AS place")
    extra = [(900, None), (901, ""), (902, "--"), (903, "X x q Q 日本語 word1"), (903, "zzz unknownterm"), (None, "thing5 word5"), (904, "same one")]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame(extra, "item_id long, text string"))
    got = Counter(tuple(r) for r in ranked.search(d, items, scratch, k).collect())
    assert got == brute_search([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()], k)


def test_ranked_search_of_nothing(spark, docs, odd, scratch):
    items = spark.createDataFrame([(1, "word1")], "item_id long, text string")
    assert ranked.search(odd.where("false"), items, scratch).count() == 0
    assert ranked.search(odd, items.where("false"), scratch).count() == 0
    assert ranked.search(odd.where("text IS NULL"), items, scratch).count() == 0


def test_treaps_prune():
    """A heap by impact and a search tree by document; a query for few leaves most postings alone."""
    rng = np.random.default_rng(5)
    own = [3000, 4000, 50, 0, 1]
    doc = np.concatenate([np.sort(rng.choice(5000, n, replace=False)) for n in own])
    impact = np.concatenate([rng.integers(1, h, n) for n, h in zip(own, (10, 30, 10_000, 2, 5), strict=True)])
    t = ranked.Treaps(np.concatenate([[0], np.cumsum(own)]), doc, impact, 5000)
    for child, side in ((t.left, -1), (t.right, 1)):
        at = np.flatnonzero(child >= 0)
        assert (impact[child[at]] <= impact[at]).all() and (np.sign(doc[child[at]] - doc[at]) == side).all()
    seen = []
    plain = t.impacts
    t.impacts = lambda key: seen.append(key.size) or plain(key)
    d, s = t.search(np.arange(5), 3, 0)
    want = np.zeros(5000, np.int64)
    np.add.at(want, doc, impact)
    order = np.lexsort((np.arange(5000), -want))[:3]
    assert sorted(zip(-s, d, strict=True))[:3] == [(-want[i], i) for i in order]
    assert sum(seen) < 1000
