"""Operators 11 to 13 against brute-force versions: long runs, small tries and sketches, early stops, copies, ties and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lumaspan.llm import divergence, resampling, topk
from lumaspan.llm.hashing import word_lists

rng = random.Random(31)
WORDS = ["Alpha", "beta", "größe", "x9", "ICE", "été", "b2b", "end", "i", "of"] + ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(80)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n):
    return rng.choice([" ", ", ", "\n"]).join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(k, words(rng.choice([0, 1, 5, 25, 40, 90])), ["de", "en", None][k % 3], ["a", "b", "c", "", None][k % 5]) for k in range(120)]
    return out + [(500, None, "de", "z"), (501, "", None, None), (502, "... 12 !", "fr", "a"), (503, words(9000), "en", "a"), out[7], out[7], (None, words(30), "en", "a")]


KIND = "doc_id long, text string, lang string, source string"


def test_words_of_a_text_do_not_depend_on_pieces():
    for t in (words(300), "a" * 9000 + " b", "  ", "", "é" * 5000 + "!", "x" * 4096 + " " + "y" * 4096):
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        for piece in (1, 7, 4096, 1 << 20):
            assert [w.decode() for some in word_lists(t.encode(), resampling.LETTERS, piece) for w in some] == want


@pytest.mark.parametrize(("longest", "nodes"), [(1, 200_000), (1, 5), (3, 50)])
def test_resampling_against_brute_force(spark, rows, longest, nodes, monkeypatch):
    monkeypatch.setattr(resampling, "NODES", nodes)
    monkeypatch.setattr(resampling.word_lists, "__defaults__", (64,))
    items = [(0, words(40)), (1, None), (2, "")]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    target = spark.createDataFrame(items, "item_id long, text string")

    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 97
    s, t = (collections.Counter(bucket(f) for r in table for f in runs(r[1])[1]) for table in (rows, items))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 97) / ((s[b] + 1) * (T + 97)))) for b in range(97)]
    assert resampling.gains(docs, target, "text", longest, 97) == gain
    want = []
    for k, text, *_ in rows:
        n, f = runs(text)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        want.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in want if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = [(*x[:4], i + 1 if i < len(able) * 10 // 100 else None) for i, x in enumerate(able)] + [(*x[:4], None) for x in want if x[4] < 20]
    got = resampling.resample(docs, target, longest=longest, buckets=97)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(rank)


def brute(vectors, queries, k):
    own = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            own[i] = min(own.get(i, q), q)
    out = []
    for i in queries & own.keys():
        s = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own[i], v)))), j) for j, v in own.items() if j != i))  # noqa: B905
        out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("spread", [0.0, 0.05, 1.0])
def test_search_against_brute_force(spark, spread):
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    vectors = [(k, [x + spread * rng.gauss(0, 1) for x in centres[k % 9]]) for k in range(400)]
    vectors += [(1000 + k, list(vectors[5][1])) for k in range(90)] + [(2000, []), (2001, [1.0, -1.0]), (2002, None), (2003, [None] * 12), (2004, [float("nan")] * 12), (5, [0.0] * 12), vectors[9], (None, [1.0])]
    vectors += [(3000, [1e15] * 12), (3001, [-1e15] * 12)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    asked = df.where("vec_id % 10 = 0 or vec_id = 5 or vec_id > 2000")
    ids = {i for i, _ in vectors if i is not None and (i % 10 == 0 or i == 5 or i > 2000)}
    want = brute(vectors, ids, 5)
    for per_block, per_batch in ((10**6, 10**6), (64, 7)):
        assert sorted(map(tuple, topk.search(df, asked, per_block=per_block, per_batch=per_batch).collect())) == sorted(want)


def test_search_stops_early_only_on_proof():
    gen = np.random.default_rng(3)
    values = np.floor(256 * gen.normal(0, 0.02, (3000, 32))).astype(np.int64)
    values[np.arange(3000), gen.integers(0, 32, 3000)] += gen.integers(300, 4000, 3000)
    queries = values[:40]
    index = topk.built(np.arange(3000), values, 5)
    query, row, score, done = topk.searched(index, queries, 5)
    assert 0 < done < len(index["level"])
    want = queries @ values.T
    for i in range(40):
        assert row[query == i].tolist() == np.lexsort((np.arange(3000), -want[i]))[:6].tolist()
        assert score[query == i].tolist() == np.sort(want[i])[::-1][:6].tolist()


def test_copies_leave_a_block_but_for_the_first():
    values = np.repeat(np.array([[1, 2], [3, 4]]), 50, axis=0)
    assert topk.built(np.arange(100)[::-1].copy(), values, 5)["ids"].tolist() == [55, 54, 53, 52, 51, 50, 5, 4, 3, 2, 1, 0]


@pytest.mark.parametrize(("width", "held", "min_docs"), [(1 << 12, 400_000, 12), (16, 3, 12), (1 << 12, 400_000, 10_000)])
def test_divergence_against_brute_force(spark, rows, width, held, min_docs, monkeypatch):
    for f in (divergence.marks, divergence.counted):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], held))
    groups, df = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, source in rows:
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(w)
        df.update((lang or "", t) for t in set(w))
    want = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= min_docs)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        whole = p(sum((c for (x, _), c in groups.items() if x == lang), collections.Counter()))
        own = {s: p(c) for (x, s), c in groups.items() if x == lang}
        for s in own:
            pair = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in own if o != s]
            term = [(t, own[s][t] - whole[t]) for t in kept if groups[lang, s][t] and own[s][t] > whole[t]]
            for part, found, top in (("pair", pair, None), ("term", term, 50)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                want += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(found[:top])]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    got = divergence.audit(docs, min_docs=min_docs, width=width).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_sketch_never_underestimates(spark, rows):
    docs = spark.createDataFrame(rows, KIND).selectExpr("lang as _lang", "text as _text", "source as _source").na.fill("").repartition(4)
    marked = divergence.marks(docs, 64, 20, tasks=3)
    df = collections.Counter((r._lang, t) for r in docs.collect() for t in set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r._text.translate(LOWER))))
    for (lang, t), n in df.items():
        at = divergence.cells(lang, [t.encode()], 64)[:, 0]
        if n >= 20:
            assert all(marked[r][at[r] >> 3] >> (7 - (at[r] & 7)) & 1 for r in range(divergence.ROWS))
