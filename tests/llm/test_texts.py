"""Operators on texts, each against a brute-force version over the edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondera.llm import jaccard, langid, linededup, mixing, packing, quality, secrets, substring

SPACE = b" \t\n\v\f\r"


def words(t):
    return (t or "").encode().split()


def key(d):
    return -(1 << 63) if d is None else d


def test_substring_dedup(docs, rows, scratch, empty):
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedup_substrings(docs, scratch, digest=True).collect()}
    first, want = {}, set()
    distinct = {(r["doc_id"], r["text"]) for r in rows}
    for d, t in sorted(distinct, key=lambda x: key(x[0])):
        w = words(t)
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (key(d), i))
    for d, t in distinct:
        w = words(t)
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (key(d), i):
                gone.update(range(i, i + 20))
        want.add((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    assert got == want
    assert sum(x[2] for x in got) > 500
    assert substring.dedup_substrings(empty, scratch).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, 20])
def test_fm_index_matches_by_brute_force(depth):
    """Its own text, and a foreign one of which some windows are in the index, some symbols are unknown."""
    rng = np.random.default_rng(depth)
    text = np.concatenate([np.tile(rng.integers(2, 6, 60), 7)[:400], [1], rng.integers(2, 6, 300), [1]]).astype(np.int32)
    text[390:400] = text[3:13]
    first = {}
    for p in range(len(text) - depth + 1):
        first.setdefault(tuple(text[p : p + depth]), p)
    fm = substring.FMIndex(text, depth, every=True)
    at, n = np.array([0, 401]), np.array([400 - depth + 1, 300 - depth + 1])
    places = [p for a, k in zip(at, n, strict=True) for p in range(a, a + k)]
    assert fm.stream(text, at, n).tolist() == [first[tuple(text[p : p + depth])] for p in places]
    other = np.concatenate([text[30:200], rng.integers(2, 9, 80), text[405:500], [7], text[10:40]]).astype(np.int32)
    got = fm.stream(other, np.array([0, 100]), np.array([100 - depth + 1, len(other) - 100 - depth + 1]))
    places = [*range(100 - depth + 1), *range(100, len(other) - depth + 1)]
    assert got.tolist() == [first.get(tuple(other[p : p + depth]), substring.NONE) for p in places]
    few = substring.FMIndex(text, depth).stream(text, at, n)
    times = Counter(tuple(text[p : p + depth]) for p in range(len(text) - depth + 1))
    places = [p for a, k in zip(at, n, strict=True) for p in range(a, a + k)]
    assert few.tolist() == [first[w] if times[w] > 1 else substring.ONCE for w in (tuple(text[p : p + depth]) for p in places)]


def test_fm_index_is_compressed():
    text = np.random.default_rng(1).integers(2, 5000, 200_000).astype(np.int32)
    text[100_000:110_000] = text[:10_000]
    fm = substring.FMIndex(text, 20)
    kept = [v.nbytes for v in vars(fm).values() if hasattr(v, "nbytes")]
    assert fm.nbytes < 4 * len(text) and max(kept) < 8 * 11_000 and not {"sa", "group", "names"} & set(vars(fm))


@pytest.mark.parametrize("min_lines", [2, 3])
def test_line_dedup(docs, rows, scratch, empty, min_lines):
    out = linededup.dedup_lines(docs, scratch, min_lines, 100)
    got = Counter((r["doc_id"], r["text"], r["__ld_lines"], r["__ld_removed"]) for r in out.collect())
    assert out.columns[: len(docs.columns)] == docs.columns
    best = {(r["doc_id"], r["text"] is None, r["__ld_lines"]): (r["__ld_runs"], r["__ld_longest"]) for r in out.collect()}
    seqs = {}
    for r in rows:
        if r["text"] is not None:
            seqs[r["doc_id"], r["text"]] = [(j, x) for j, x in enumerate(r["text"].split("\n")) if x.encode().strip(SPACE)]
    order = sorted(seqs, key=lambda x: key(x[0]))  # ids of different texts differ here
    first, gone = {}, defaultdict(set)
    for n in (1, min_lines):
        for d in order:
            for i in range(len(seqs[d]) - n + 1):
                first.setdefault(tuple(x for _, x in seqs[d][i : i + n]), (d, i))
    for n in (1, min_lines):
        for d in order:
            for i in range(len(seqs[d]) - n + 1):
                w = seqs[d][i : i + n]
                if first[tuple(x for _, x in w)] != (d, i) and (n == min_lines or len(w[0][1]) >= 100):
                    gone[d].update(j for j, _ in w)
    want = Counter()
    for r in rows:
        t, d = r["text"], (r["doc_id"], r["text"])
        lines = t.split("\n") if t is not None else []
        want[r["doc_id"], None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone[d]), len(lines), len(gone[d])] += 1
    assert got == want
    longest, n = {}, 1  # greatest prefix shared with an earlier sequence, length by length
    while True:
        seen, hit = {}, False
        for d in order:
            for i in range(len(seqs[d]) - n + 1):
                if seen.setdefault(tuple(x for _, x in seqs[d][i : i + n]), (d, i)) != (d, i):
                    longest[d, i], hit = n, True
        if not hit:
            break
        n += 1
    maximal = defaultdict(list)
    for (d, i), k in longest.items():
        if k >= min_lines and longest.get((d, i - 1)) != k + 1:
            maximal[d].append(k)
    assert max(map(max, maximal.values())) > 8
    for d in seqs:
        assert best[d[0], False, len(d[1].split("\n"))] == (len(maximal[d]), max(maximal[d], default=0))
    assert linededup.dedup_lines(empty, scratch).count() == 0


def test_quality_counts(docs, rows, scratch, empty):
    got = Counter(tuple(r) for r in quality.counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for r in rows:
        t = r["text"] or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want[r["doc_id"], len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)] += 1
    assert got == want
    out = quality.judge(docs, scratch).collect()
    assert len(out) == len(rows)
    assert all(not r["kept"] for r in out if r["base_failed"])
    good = [r for r in out if not r["base_failed"]]
    assert sum(r["kept"] for r in good) > 0.8 * len(good)
    assert quality.judge(empty, scratch).count() == 0


def test_mcd_finds_planted_outliers(spark, scratch):
    rng = np.random.default_rng(3)
    x = rng.normal(0, [0.1, 0.2, 0.12, 0.15, 0.6], (900, 5))
    x[:120] += 6  # a cluster that would draw means and covariances
    rows = [(i, "g", "l", *(round(float(y) * quality.UNIT) for y in v)) for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, "i int, g string, l string, " + ", ".join(f"{c} long" for c in quality.FEATURES))
    est = quality.mcd(t.select("g", "l", *quality.FEATURES), scratch)
    d = t.join(est, "g").withColumn("d", quality.distance([t[c] for c in quality.FEATURES]) * (quality.chi2(0.5) / est["mid"]))
    far = {r["i"] for r in d.where(d["d"] > 3 * quality.chi2(1 - 1e-5)).collect()}
    assert set(range(120)) <= far and len(far) < 125


def test_mixing(docs, rows, scratch, empty):
    sized = scratch.cut(mixing.sizes(docs), "sizes")
    a = mixing.mix(sized, scratch, shards=5).cache()
    size, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
        largest[r["source"]] = max(largest[r["source"]], len(words(r["text"])))
    names = sorted((s for s in size if s is not None), key=str.encode) + [None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(size.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 2 * size[s]}
        if not over:
            target |= t
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    got = {r["source"]: (r["t"], r["k"]) for r in a.groupBy("source").agg(F.first("target").alias("t"), F.sum("size").alias("k")).collect()}
    for s in names:
        if size[s]:
            assert got[s][0] == pytest.approx(target[s]) and abs(got[s][1] - target[s]) <= largest[s] / 2 + 1
    assert a.groupBy("row_key").count().agg(F.max("count")).first()[0] <= 2
    b = mixing.mix(sized, scratch, shards=5)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    d = mixing.mixed_documents(docs, scratch)
    assert d.columns == docs.columns and d.count() == a.count()
    assert mixing.mixed_documents(empty, scratch).count() == 0


def test_splitting_tree_gives_each_block_one_place():
    quota = np.array([40, 7, 0, 93])
    color = np.repeat(np.arange(4), quota)
    ordinal = np.concatenate([np.arange(q) for q in quota])
    at = mixing.walk(quota, 6, color, ordinal)
    n = np.bincount(at, minlength=6)
    assert n.sum() == quota.sum() and n.max() - n.min() <= 3
    assert (at == mixing.walk(quota, 6, color, ordinal)).all()
    some = np.arange(0, len(color), 3)
    assert (at[some] == mixing.walk(quota, 6, color[some], ordinal[some])).all()


def test_secrets(docs, rows, empty):
    rx = [re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]): r["spans"] for r in secrets.scan(docs, secrets.train(docs)).collect()}
    want = set()
    for r in rows:
        t = r["text"] or ""
        s = [[(m.start(), m.end()) for m in rx[0].finditer(t) if len(m[2]) >= 6], [m.span() for m in rx[1].finditer(t) if len(m[0]) >= 20], [m.span() for m in rx[2].finditer(t) if len(m[0]) >= 24]]
        spans = sorted((a, k, z) for k, x in enumerate(s) for a, z in x)
        want.add((r["doc_id"], *map(len, s), hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in spans).encode()).hexdigest()))
    assert set(got) == want
    assert any(x[1] for x in got) and any(x[2] for x in got) and any(x[3] for x in got)
    assert secrets.scan(empty, secrets.train(empty)).count() == 0


def test_markov_ratio_tells_random_from_ordinary():
    rng = np.random.default_rng(5)
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = ["".join(rng.choice(list(abc), 30)).encode() for _ in range(400)]
    plain = [f"{a}_{b}{i % 9}".encode() for i in range(30) for a in ("load", "user", "index", "token") for b in ("manager", "handler", "number")]
    r, p = secrets.Markov(made[:300]), secrets.Markov(plain)
    assert np.mean([r.mean(s) - p.mean(s) > secrets.THRESHOLD for s in made[300:]]) > 0.95
    assert r.mean(b"user_handler_index2") - p.mean(b"user_handler_index2") < 0


def test_random_letters_without_a_digit_are_secrets(spark):
    rng = np.random.default_rng(8)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    keys = ["".join(rng.choice(letters, n)) for n in (16, 20, 40)]
    part = ["".join(rng.choice(list("aeiou" if i % 2 else "lmnrst")) for i in range(6)) for _ in range(2000)]
    texts = [" ".join(part[i : i + 40]) for i in range(0, 2000, 40)]
    d = [*texts, *(f"{texts[0]} {k} end" for k in keys), "remanita-lomesuta-nalimero 12345678901234567890"]
    docs = spark.createDataFrame(list(enumerate(d)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, secrets.train(docs.where(F.col("doc_id") < len(texts)))).collect()}
    at = len(texts[0]) + 1
    assert [got[len(texts) + i] for i in range(3)] == [f"markov:{at}:{at + len(k)}" for k in keys]
    assert not any(got[i] for i in (*range(len(texts)), len(d) - 1))


def test_ordinary_words_come_from_any_text(spark):
    one = [t for t in (f"ordinary words of text number{i}" for i in range(99)) if zlib.crc32(t.encode()) % 16][:1]
    seen = secrets.train(spark.createDataFrame([(1, one[0])], "doc_id long, text string"))[1]
    none = secrets.train(spark.createDataFrame([(1, "")], "doc_id long, text string"))[1]
    assert seen.mean(b"ordinary") > none.mean(b"ordinary")


@pytest.mark.parametrize(("n", "t"), [(4, (85, 100)), (5, (80, 100))])
def test_ngram_jaccard(docs, rows, scratch, empty, n, t):
    got = Counter(tuple(r) for r in jaccard.join(docs, scratch, n, t).collect())

    def shingles(x):
        w = (x or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    s = [shingles(r["text"]) for r in rows]
    ids, root = [r["doc_id"] for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            k = len(s[i] & s[j])
            if k and t[1] * k >= t[0] * (len(s[i]) + len(s[j]) - k):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i in range(len(s)):
        low[find(i)].append(ids[i])
    low = {c: min((x for x in v if x is not None), default=None) for c, v in low.items()}
    assert got == Counter((ids[i], len(s[i]), low[find(i)]) for i in range(len(s)))
    assert jaccard.join(empty, scratch).count() == 0


def test_long_posting_lists_lose_no_link(spark, scratch):
    """A group of near copies without its original, larger than a short list, next to others that share a passage."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 120))] = f"e{rng.integers(1 << 30)}"
        texts.append(" ".join(w))
    texts += [" ".join([*base[:40], *(f"u{i}_{j}" for j in range(80))]) for i in range(40)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(d, scratch, 4, (85, 100)).collect()}
    s = [frozenset(tuple(t.split()[i : i + 4]) for i in range(117)) for t in texts]
    root = list(range(len(s)))
    for _ in range(len(s)):
        for i in range(len(s)):
            for j in range(i):
                k = len(s[i] & s[j])
                if 100 * k >= 85 * (len(s[i]) + len(s[j]) - k):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root))


@pytest.mark.parametrize("side", [16, 512])
def test_ngram_jaccard_counts_every_link(spark, scratch, side):
    """Near copies in one long list, of which not all pairs link, a chain, exact copies and texts that link with nothing."""
    rng = np.random.default_rng(11)
    texts = []
    for i in range(70):
        w = [f"b{j}" for j in range(120)]
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 120))] = f"e{rng.integers(1 << 30)}"
        texts += [" ".join(w)] * (1 + i % 3)
    texts += [" ".join(f"c{j}" for j in range(8 * i, 8 * i + 120)) for i in range(9)]
    texts += ["", " ", "one", "one", *(f"x{i} y{i} z{i}" for i in range(5))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = jaccard.join(d, scratch, 4, (85, 100), links=True, side=side)
    s = [frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if (w := t.split()) else frozenset() for t in texts]
    both = lambda a, b: len(a & b)
    want = {i: sum(i != j and both(a, b) > 0 and 100 * both(a, b) >= 85 * len(a | b) for j, b in enumerate(s)) for i, a in enumerate(s)}
    assert {r["doc_id"]: r["n_links"] for r in out.collect()} == want
    plain = jaccard.join(d, scratch, 4, (85, 100))
    assert plain.columns == ["doc_id", "n_shingles", "component_id"] and sorted(map(tuple, plain.collect())) == sorted(tuple(r)[:3] for r in out.collect())


def test_components(spark, scratch, monkeypatch):
    from sondera.llm import common

    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(7, i) for i in range(100, 140)] + [(i, i + 1) for i in range(1000, 1064)]
    root = common.components(*np.array(pairs).T, 2000)
    want = {i: int(r) for i, r in enumerate(root) if i != r}
    got = common.connected(spark, spark.createDataFrame(pairs, "a long, b long").repartition(7), scratch, "some").collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert common.connected(spark, spark.createDataFrame([], "a long, b long"), scratch, "none").count() == 0
    monkeypatch.setattr(common, "FOREST_EDGES", 16)
    a, b = np.array(pairs).T
    cut = pa.table({"a": a, "b": b}).to_batches(max_chunksize=5)
    f = np.concatenate([np.stack([x.column("a").to_numpy(), x.column("b").to_numpy()]) for x in common.forest(iter(cut))], axis=1)
    assert (common.components(f[0], f[1], 2000) == root).all()


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.pack(docs, with_ids=True).collect()
    ids = Counter()
    for r in rows:
        x = [*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        ids[r["doc_id"], tuple(x)] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    padding = 0
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in s)
        assert [r["offset"] for r in s] == np.cumsum([0] + [r["length"] for r in s])[:-1].tolist() and n <= 4096
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    total = sum(r["length"] for r in out)
    assert padding < 0.01 * total and total == sum(len(x) * c for (_, x), c in ids.items())
    found = Counter()
    for d, p in by_doc.items():
        p.sort(key=lambda r: (r["sequence_id"], r["offset"]))
        have = []
        for r in p:
            assert r["start"] == len(have)
            have += r["ids"]
            if len(have) == r["doc_tokens"]:
                found[d, tuple(have)] += 1
                have = []
        assert not have
    assert found == ids
    assert packing.pack(empty).count() == 0


def test_cuts_are_the_best():
    rng = np.random.default_rng(4)
    for _ in range(30):
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 25))])
        pen = rng.choice([0.0, 1.0, 3.0], len(pos))
        got, w = packing.cuts(pos, pen, 16), 16

        def tail(n):
            parts = len(packing.tail_pieces(n))
            return min((parts - 1) * packing.WITHIN, w - n)

        best = [0.0] + [float("inf")] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                n = int(pos[j] - pos[i])
                if n <= w:
                    best[j] = min(best[j], best[i] + (pen[j] + w - n if j < len(pos) - 1 else tail(n)))
        cost, at = 0.0, 0
        where = {int(p): k for k, p in enumerate(pos)}
        for z in got:
            if z == pos[-1] or z not in where or tail(int(pos[-1]) - at) + cost == best[-1]:
                cost += tail(int(pos[-1]) - at)
                break
            cost += pen[where[z]] + w - (z - at)
            at = z
        assert cost == pytest.approx(best[-1])


def test_every_sentence_end_is_a_candidate():
    ends = np.array([3, 5, 9, 11, 30, 33])
    pos, pen = packing.candidates(np.array([40, 20]), [ends, np.array([2, 4])])
    assert {*ends.tolist(), 42, 44} <= set(pos[pen == packing.AT_SENTENCE].tolist())


def test_language_id(docs, rows, empty, scratch):
    f = langid.train(docs)
    out = langid.predict(docs, f).withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) and f.langs == sorted(f.langs)
    by = {(r["doc_id"], r["lang_pred"]): r for r in out}
    for r in out:
        assert r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in [*f.langs, "und"]
    assert (5001, "und") in by and (5002, "und") in by and (5003, "und") in by and (5009, "und") in by
    lang = {r["doc_id"]: r["lang"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 5000}
    held = [r for r in out if r["held"] and r["doc_id"] < 5000]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.9
    kept = langid.keep_identified(docs, f)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["lang_pred"] != "und" and r["share"] >= langid.MIN_SHARE for r in out)
    g = langid.train(empty)
    assert langid.predict(empty, g).count() == 0 and {r["lang_pred"] for r in langid.predict(docs, g).collect()} == {"und"}


def test_filters_hold_their_members():
    rng = np.random.default_rng(6)
    g = [rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(70)]  # more languages than bits in a word
    f = langid.Filters.build([f"l{i:02}" for i in range(70)], g, 0)
    for i in (0, 63, 64, 69):
        assert (f.lookup(g[i])[i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    miss = f.lookup(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))[1] >> np.uint64(5) & np.uint64(1)
    assert miss.mean() < 0.01
