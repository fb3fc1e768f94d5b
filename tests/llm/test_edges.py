"""Every query and the pipeline over empty tables, nulls in any column, repeated rows and columns with clashing names; language held out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumaspan.llm import language, registry

rng = random.Random(11)
KINDS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
#: Names that the operators use inside or return; extra columns of the input may have them.
EXTRA = ["shard", "slot", "size", "law", "kept", "n", "_n", "_a", "_b", "_h", "_host", "_q_failed", "_q_host", "_t", "_k", "_gone", "component_id", "n_shingles", "verdict", "rule", "host", "path", "_source", "_copies", "_shards", "target", "_ll", "_best", "label", "key", "id"]
SYLLABLES = {"de": ["sch", "ein", "ung", "lich", "ver"], "en": ["the", "ing", "tion", "ough", "wh"], "fr": ["eau", "que", "oir", "eux", "ille"]}


def sentence(lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(2)) for _ in range(n))


def folder(spark, where, rows, extra=()):
    for name, kind in KINDS.items():
        df = spark.createDataFrame(rows.get(name, []), kind)
        for c in extra:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        df.write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    docs = [(i, sentence(["de", "en", "fr"][i % 3], 20 + 7 * i), ["de", "en", "fr"][i % 3], ["a", "b"][i % 2], 5) for i in range(24)]
    docs += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n ", None, "b", 3), docs[20], docs[20], (103, docs[20][1], "en", None, 1), (104, docs[21][1].upper(), None, "a", 1)]
    docs += [(None, sentence("en", 60), "en", "a", 1), (None, None, None, None, None)]
    pages = [(0, "https://a.example.com/en/1", "<html lang=de><body><p>" + sentence("de", 40) + "</p></body></html>"), (1, None, None), (2, "", ""), (None, "x", "<p>a"), (0, "https://a.example.com/en/1", "<p>b &amp; c")]
    items = [(0, sentence("en", 30)), (1, None), (2, ""), (None, "a b"), (0, sentence("fr", 9))]
    vectors = [(k * 10, [rng.gauss(0, 1) for _ in range(6)], 0) for k in range(20)] + [(50, None, 1), (150, [], None), (None, [1.0], 0), (7, [1.0, None], 0), (0, [float("nan")], 0), (250, [1.0], 0), (3, [float("inf")], 0)]
    return folder(spark, tmp_path_factory.mktemp("full"), {"documents": docs, "pages": pages, "benchmark": items, "embeddings": vectors}, EXTRA), len(docs), len(pages)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("nothing"), {}, EXTRA[:4])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_nulls_repeats_and_clashing_columns(spark, full, name):
    path, docs, pages = full
    n = registry.QUERIES[name](spark, path).count()
    want = {"op3_url_filters": pages, "op4_html_extraction": pages, "op6_language_id": docs + pages, "op7_benchmark_decontamination": None, "op12_exact_topk": 25, "op13_source_divergence": 16}
    assert want.get(name, docs) in (None, n)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert registry.QUERIES[name](spark, nothing).count() == 0


def test_pipeline_on_nulls_and_on_nothing(spark, full, nothing):
    docs = spark.read.parquet(f"{full[0]}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, full[0])
        assert after.columns == docs.columns
        before = after
    assert corpus_pipeline.run(spark, full[0]).count() > 0
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_language_of_held_out_texts_and_weak_evidence(spark):
    make = lambda k: (k, sentence(["de", "en", "fr"][k % 3], 30), ["de", "en", "fr"][k % 3], f"h{k % 3}")
    kind = "doc_id long, text string, lang string, source string"
    model = language.fit(spark.createDataFrame([make(k) for k in range(60)], kind))
    held = spark.createDataFrame([(k, t, None, None) for k, t, *_ in map(make, range(60, 120))], kind)
    got = {r.doc_id: r for r in language.identify_documents(held, model, declared="lang").collect()}
    assert all(got[k].lang == ["de", "en", "fr"][k % 3] and 0 < got[k].confidence <= 1 for k in got) and len(got) == 60
    # without text, what the host and the declaration say decides
    rows = [make(k) for k in range(60)] + [(200, None, "fr", "h2"), (201, "", None, "h1")]
    got = {r.doc_id: r for r in language.identify_documents(spark.createDataFrame(rows, kind), model, declared="lang").collect()}
    assert got[200].lang == "fr" and got[200].text_lang is None and got[201].lang == "en"


def test_text_after_unmatched_brackets_is_read():
    read = lambda t: bytes(language.without_tags(np.frombuffer(t, np.uint8))).decode().split()
    assert read(b"<script>for(i=0;i<n;i++){}</script><p>hello text</p>") == ["hello", "text"]
    assert read(b"<p>3 < 5 and a > b</p>end") == ["3", "<", "5", "and", "a", ">", "b", "end"]
    assert read(b"<!-- <b> x --><STYLE>a>b{}</style >one<br/>two <b three") == ["one", "two", "<b", "three"]
    assert read(b"<!-- open <p>one</p><script>two") == ["one", "two"]
    assert read(b"") == [] and read(b"<") == ["<"] and read(b"<!-->a") == ["a"]


def test_language_evidence_against_plain_python(spark):
    rows = [(k, sentence(["de", "en", "fr"][k % 3], rng.choice([0, 1, 1, 2, 30])), rng.choice(["de", "en", "fr-CA", None, "x"]), f"h{k % 5}" if k % 7 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, said string, source string")
    model = language.fit(spark.createDataFrame([(k, sentence(x, 40), x) for k, x in enumerate(["de", "en", "fr"] * 9)], "doc_id long, text string, lang string"))
    names, n = model.languages, 3
    ll = {r[0]: model.scores([np.frombuffer(r[1].encode(), np.uint8)], language.MAX_WEIGHT)[0] for r in rows}
    best = {k: int(np.argmax(x)) if max(x) > min(x) else None for k, x in ll.items()}
    tag = lambda d: {"fr-CA": "fr", "x": None}.get(d, d)

    def counts(by):
        out = {}
        for k, _, d, h in rows:
            c = out.setdefault(by(d, h), np.zeros(n))
            if best[k] is not None:
                c[best[k]] += 1
        return out

    smooth = lambda c, prior, pseudo: (c + pseudo * prior) / (c.sum() + pseudo)
    pool = counts(lambda d, h: 0)[0] + 1
    p0 = pool / pool.sum()
    p1 = smooth(counts(lambda d, h: 0)[0], p0, language.PSEUDO_SUFFIX)
    host = {h: np.log(smooth(c, p1, language.PSEUDO_HOST)) for h, c in counts(lambda d, h: h).items()}
    says = {d: np.log(smooth(c, p0, language.PSEUDO_DECLARED) / p0) for d, c in counts(lambda d, h: tag(d)).items()}
    got = {r.doc_id: r for r in language.identify_documents(df, model, declared="said").collect()}
    for k, _, d, h in rows:
        score = ll[k] + host[h] + says[tag(d)]
        assert got[k].lang == names[int(np.argmax(score))]
        assert abs(got[k].confidence - 1 / np.exp(score - score.max()).sum()) < 1e-5
        assert got[k].text_lang == (None if best[k] is None else names[best[k]])


def test_declared_language_of_broken_pages_in_one_pass(spark):
    import time

    pages = ["<html " * 180_000, "<HTML data-lang='de' lang=\"fr\"><p>", "<html><p lang=de>", "<htmlx lang=de>", "<html\nlang = it >", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id long, html string").cache()
    df.count()
    began = time.perf_counter()
    got = [r.x for r in df.select("id", language.declared_language(F.col("html")).alias("x")).orderBy("id").collect()]
    assert got == ["", "fr", "", "", "it", None] and time.perf_counter() - began < 5


def test_long_repeated_texts_lose_whole_runs(spark):
    from lumaspan.llm import lines

    text = "\n".join(f"line {i % 900} of {i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "own line\n" + text)], "doc_id long, text string")
    got = {r.doc_id: (r._n_lines, r._n_removed, r._n_runs, r._longest_run, len(r._kept_text)) for r in lines.dedup(docs).collect()}
    assert got == {1: (100_000, 0, 0, 0, len(text)), 2: (100_001, 100_000, 1, 100_000, 8)}
