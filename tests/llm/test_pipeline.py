"""The pipeline's stages, with its own parameters, against plain-Python versions."""

import collections
import random
import re

import pytest

import corpus_pipeline

rng = random.Random(21)
WORDS = ["".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(600)]


def words(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def grams(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(50):
        t = words(rng.randint(55, 140))
        for _ in range(rng.randint(1, 3)):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append((len(out), " ".join(w), "en", f"s{k % 3}", 1))
    out += [out[3], (out[4][0], words(80), "en", "s1", 1), (None, words(70), None, None, None), (500, None, None, "s0", 0), (501, "", "en", "s0", 0)]
    return out


KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_keep_one_document_of_each_group(spark, rows):
    got = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, KIND).repartition(3), "").collect()
    docs = sorted({(r[0], r[1]) for r in rows}, key=str)
    sets = {d: grams(d[1]) for d in docs}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    kept = collections.Counter(find((r.doc_id, r.text)) for r in got)
    assert set(kept) == {find(d) for d in docs}
    assert all(n == 1 for d, n in kept.items() if sets[d])


def test_quality_stage_keeps_what_the_rules_keep(spark, rows):
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, KIND), "").collect()
    fails, n = collections.Counter(), collections.Counter()
    failed = []
    for r in rows:
        w = (r[1] or "").split()
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(tri)
        bad = len(w) < 50 or 100 * len({i + d for i, g in enumerate(tri) if c[g] > 1 for d in range(3)}) > 50 * len(w)
        failed.append(bad)
        fails[r[3]] += bad
        n[r[3]] += 1
    m = sum(fails.values()) / sum(n.values())
    v = max(1e-9, sum(fails[h] ** 2 / n[h] for h in n) / sum(n.values()) - m * m)
    k = min(1000.0, max(1.0, m * (1 - m) / v - 1))
    want = [r for r, bad in zip(rows, failed, strict=True) if not bad and (fails[r[3]] + m * k) / (n[r[3]] + k) <= 0.8]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_whole_run_shards_what_the_stages_keep(spark, rows, tmp_path):
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, rows[0][1]), (1, words(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    left = docs.collect()
    assert rows[0][1] not in {r.text for r in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in left)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
