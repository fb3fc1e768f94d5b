"""Operator 6, language identification by Bayesian evidence fusion.

Evidence of a text: the log likelihood of its byte trigrams under a multinomial model per language (Laplace smoothing,
hashed into ``buckets``), tempered to at most ``max_weight`` trigrams' worth because neighbouring trigrams are not
independent. Further evidence: the language that the markup (or the record) declares, the address suffix (the host's last
label), and the host. What a declaration or a suffix says is learned from all rows: counts of (declared language,
language of the text alone) give smoothed P(declared | language). The host's prior is smoothed hierarchically: pooled
language shares over all rows, then the suffix's shares shrunk towards them, then the host's shares shrunk
towards its suffix's, each by a pseudo count; all of them come from grouped aggregations. The posterior is the
normalised sum of log evidence.

The trigram model alone is fitted on a sample of labelled rows: the ``sample_rows`` rows of least key hash (a
documented bound). Everything else uses all rows and whole texts.

Null and empty texts have no text evidence and are decided by the rest; a null declaration, suffix or host is a value of
its own (declarations and suffixes of rows without any say nothing: all such rows share one value). Ties go to
the first language by code. Repeated rows are judged each. An empty table gives an empty result; without any
labelled row ``fit`` returns None and op6 leaves the language null. Rows with a null key are not in the sample. Other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspan.llm.common import documents, pages, small, stored
from lumaspan.llm.hashing import ascii_fold, mix, pieces, text_bytes
from lumaspan.llm.urls import host_path

SAMPLE_ROWS = 2_000
BUCKETS = 1 << 14
MAX_WEIGHT = 60.0
PSEUDO_SUFFIX, PSEUDO_HOST, PSEUDO_DECLARED = 20.0, 5.0, 2.0
OPENS = re.compile(rb"<(?:(!--|(?:script|style)(?=[\s/>]))|[a-z/!?])", re.I)
ENDS = {b"!--": re.compile(b"-->"), b"script": re.compile(rb"</script", re.I), b"style": re.compile(rb"</style", re.I)}


def trigram_buckets(text: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the trigram from each byte on (the last two bytes start none)."""
    t = text.astype(np.uint32)
    key = (t[:-2] << 16) | (t[1:-1] << 8) | t[2:]
    return (mix(key.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) & (buckets - 1)


def without_tags(text: np.ndarray) -> np.ndarray:
    """Markup's text: comments, scripts, styles and tags become spaces. A tag opens where < is followed by a letter, /, ! or ?
    and ends at the next >; without one, or without its end mark, nothing after it is taken for markup."""
    page, out, pos, unclosed = text.tobytes(), text.copy(), 0, set()
    last = page.rfind(b">") + 1
    while m := OPENS.search(page, pos, last):
        name = (m[1] or b"").lower()
        pos = page.find(b">", m.end()) + 1
        if name and name not in unclosed:
            end = ENDS[name].search(page, m.start() + 2 if name == b"!--" else pos)
            if end:
                pos = end.end() if name == b"!--" else end.start()
            else:
                unclosed.add(name)
        if not pos:
            break
        out[m.start() : pos] = 32
    return out


class Model:
    """Log probabilities of trigram buckets by language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def scores(self, texts: list[np.ndarray], max_weight: float) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for k, t in enumerate(texts):
            if len(t) >= 3:
                got = self.table[trigram_buckets(t, len(self.table))].sum(axis=0)
                out[k] = got * min(1.0, max_weight / (len(t) - 2))
        return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> Model | None:
    """Fits on the whole texts of the ``sample_rows`` labelled rows of least key hash, counted where the texts are."""
    labelled = docs.select(F.col(key).alias("_k0"), F.col(label).alias("_l"), F.col(text).alias("_t")).where("_l is not null and _t is not null")
    chosen = labelled.select(F.col("_k0").alias("_k"), F.xxhash64(F.lit(3), "_k0").alias("_o")).orderBy("_o", "_k").limit(sample_rows).select("_k").distinct()

    def run(batches):
        fold, sums = ascii_fold(), {}
        for batch in batches:
            data, at = text_bytes(batch.column("_t"))
            for k, lang in enumerate(batch.column("_l").to_pylist()):
                t = fold[data[at[k] : at[k + 1]]]
                got = sums.setdefault(lang, np.zeros(buckets, np.int64))
                if len(t) >= 3:
                    got += np.bincount(trigram_buckets(t, buckets), minlength=buckets)
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(got[at], 0))], ["_l", "_b", "_n"])

    rows = labelled.join(F.broadcast(chosen), F.col("_k0") == F.col("_k"), "left_semi").select("_l", "_t")
    found = rows.mapInArrow(run, "_l string, _b long, _n long").groupBy("_l", "_b").agg(F.sum("_n").alias("_n")).collect()  # buckets x languages at most
    if not found:
        return None
    languages = sorted({r["_l"] for r in found})
    counts = np.ones((buckets, len(languages)))
    for r in found:
        if r["_b"] >= 0:
            counts[r["_b"], languages.index(r["_l"])] += r["_n"]
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def text_scores(df: DataFrame, model: Model, keep: list[str], text: str, markup: bool, max_weight: float = MAX_WEIGHT) -> DataFrame:
    """``keep`` and _ll, the text's tempered log likelihood by language."""

    def run(batches):
        fold = ascii_fold()
        for batch in batches:
            data, at = text_bytes(batch.column(text))
            out = np.zeros((batch.num_rows, len(model.languages)))
            for i, j in pieces(at):
                own = fold[data[at[i] : at[j]]]
                texts = [own[at[k] - at[i] : at[k + 1] - at[i]] for k in range(i, j)]
                out[i:j] = model.scores([without_tags(t) if markup and len(t) else t for t in texts], max_weight)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(model.languages)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "_ll"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{kinds}, _ll array<double>")


def _shares(by: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Counts by language of each key: _c."""
    return by.groupBy(*keys).agg(F.array(*(F.sum(F.when(F.col("_best") == k, F.col("_n")).otherwise(0)).cast("double") for k in range(n))).alias("_c"))


def fused(rows: DataFrame, languages: list[str], keep: list[str]) -> DataFrame:
    """rows: keep, _declared, _suffix, _host (strings, may be null), _ll. Returns keep, lang, confidence, text_lang."""
    n = len(languages)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    first_max = lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("int")
    smooth = lambda c, prior, pseudo: F.zip_with(c, prior, lambda x, p: (x + pseudo * p) / (total(c) + pseudo))
    rows = rows.withColumn("_best", F.when(F.array_max("_ll") > F.array_min("_ll"), first_max(F.col("_ll"))))
    counts = stored(rows.groupBy("_declared", "_suffix", "_host", "_best").agg(F.count("*").alias("_n")))
    pooled = counts.agg(F.array(*((F.sum(F.when(F.col("_best") == k, F.col("_n")).otherwise(0)) + 1).cast("double") for k in range(n))).alias("_pool"))
    pooled = pooled.select("_pool", F.transform("_pool", lambda x: x / total(F.col("_pool"))).alias("_p0"))
    suffix = _shares(counts, ["_suffix"], n).crossJoin(F.broadcast(pooled)).select(F.col("_suffix").alias("_s"), smooth(F.col("_c"), F.col("_p0"), PSEUDO_SUFFIX).alias("_p1"))
    host = _shares(counts, ["_suffix", "_host"], n).join(suffix, F.col("_suffix").eqNullSafe(F.col("_s"))).select(
        F.col("_suffix").alias("_s"), F.col("_host").alias("_h"), F.transform(smooth(F.col("_c"), F.col("_p1"), PSEUDO_HOST), lambda p: F.log(p)).alias("_prior"))
    # P(declared | language) up to a factor by declared value: the declared value's count by language over the language's
    declared = _shares(counts, ["_declared"], n).crossJoin(F.broadcast(pooled)).select(
        F.col("_declared").alias("_d"), F.zip_with(smooth(F.col("_c"), F.col("_p0"), PSEUDO_DECLARED), "_p0", lambda a, p: F.log(a / p)).alias("_says"))
    host, declared = stored(host), stored(declared)
    joined = rows.join(small(host), F.col("_suffix").eqNullSafe(F.col("_s")) & F.col("_host").eqNullSafe(F.col("_h"))).join(
        small(declared), F.col("_declared").eqNullSafe(F.col("_d")))
    score = F.zip_with(F.zip_with("_ll", "_prior", lambda a, b: a + b), "_says", lambda a, b: a + b)
    joined = joined.withColumn("_score", score)
    names = F.array(*map(F.lit, languages))
    top = first_max(F.col("_score"))
    odds = total(F.transform("_score", lambda x: F.exp(x - F.array_max("_score"))))
    return joined.select(*keep, F.get(names, top).alias("lang"), F.round(1 / odds, 6).alias("confidence"), F.get(names, F.col("_best")).alias("text_lang"))


def primary_tag(tag: Column) -> Column:
    """The primary language subtag, lower-cased; null if there is none of two or three letters."""
    found = F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]{2,3})(?:[-_]|$)", 1)
    return F.nullif(found, F.lit(""))


def host_suffix(host: Column) -> Column:
    name = F.regexp_replace(host, r":\d*$", "")
    return F.nullif(F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)), F.lit(""))


def identify_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", declared: str | None = None, host: str = "source") -> DataFrame:
    """declared: a column with what the record itself declares, if it is not the label that the model was fitted on."""
    said = primary_tag(F.col(declared)) if declared else F.lit(None).cast("string")
    df = docs.select(F.col(key), F.col(text), said.alias("_declared"), F.lit(None).cast("string").alias("_suffix"), F.col(host).alias("_host"))
    return fused(stored(text_scores(df, model, [key, "_declared", "_suffix", "_host"], text, False)), model.languages, [key])


def declared_language(html: Column) -> Column:
    """The lang attribute of the first html tag; empty without one. The tag is cut out once, up to its end or the page's, so broken pages are read once."""
    tag = F.regexp_extract(html, r"(?i)<html(?=[\s/>])[^>]*", 0)
    return F.regexp_extract(tag, r"(?i)[\s\"'/]lang\s*=\s*[\"']?([A-Za-z_-]+)", 1)


def identify_pages(frame: DataFrame, model: Model, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    host, _ = host_path(F.col(url))
    df = frame.select(F.col(key), F.col(html), primary_tag(declared_language(F.col(html))).alias("_declared"), host_suffix(host).alias("_suffix"), F.nullif(host, F.lit("")).alias("_host"))
    return fused(stored(text_scores(df, model, [key, "_declared", "_suffix", "_host"], html, True)), model.languages, [key])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (source as host; their lang is the label that the sample is fitted on, and no evidence) and all pages: doc_id or
    page_id, lang, confidence, text_lang."""
    docs, web = documents(spark, sf_dir), pages(spark, sf_dir)
    model = fit(docs)
    if model is None:
        unknown = [F.lit(None).cast(kind).alias(c) for c, kind in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"))]
        return docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), *unknown).unionByName(
            web.select(F.lit(None).cast("long").alias("doc_id"), "page_id", *unknown))
    a = identify_documents(docs, model).withColumn("page_id", F.lit(None).cast("long"))
    b = identify_pages(web, model).withColumn("doc_id", F.lit(None).cast("long"))
    return a.unionByName(b).select("doc_id", "page_id", "lang", "confidence", "text_lang")
