"""Operator 13, source divergence audit: term counts behind a merged count-min sketch, then sparse pair joins.

1. Sketch. Each task counts in how many of its documents a (language, term) occurs and adds that to ``ROWS`` rows of counters, which stop
   at ``min_docs``. The counters of all tasks are summed, in chunks; a cell is marked when its sum reaches ``min_docs``. A sum is never below
   a term's own number, so a term with an unmarked cell is in fewer than ``min_docs`` documents. Only the marks (a bit a cell, at most ``ROWS`` x
   ``MAX_WIDTH`` bits) pass through the driver. ``width`` grows with the documents up to that bound; a fuller sketch discards less, results stay exact.
2. Counts. Terms that the marks allow are counted exactly by (language, source, term), first within a task, then by a shuffle. Terms in ``min_docs``
   documents of their language or more are kept.
3. Pairs. Two sources differ by f at a term that neither has by a constant, at one that only one has by a function of its count alone, which is
   summed over all counts at once by a window over a source's distinct counts. Only terms that both have need the join of
   their counts; it is summed before it is shuffled. Sources are paired once and the sum is given to both.

A source with a third of all rows is spread over all tasks in 1 and 2 and has one row a term from there on. The result itself has a row for each
two sources of a language. Null text, language and source are ''. Texts without terms give their group a row in the result. Very long texts are read in pieces. Rows
that repeat are documents each. Ties in value go to the item that comes first in bytes. An empty table gives an empty result. Other
columns are ignored. Shares are exact integers (decimals of 38 digits inside).
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaspan.llm.common import documents, small, stored, whole
from lumaspan.llm.hashing import folded, word_lists

MIN_DOCS = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP = 50
ROWS = 4
MAX_WIDTH = 1 << 24
CHUNK = 1 << 14  # cells that are merged as one row
SKETCH_TASKS = 4096  # tasks that send a sketch, at most
HELD = 400_000  # terms that a task holds
LETTERS = folded("")


def cells(lang: str, terms: list[bytes], width: int) -> np.ndarray:
    """The cell of each term in each row of the sketch."""
    seed = hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    h = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16, key=seed).digest() for t in terms), np.uint32).reshape(-1, ROWS)
    return h.T & np.uint32(width - 1)


def columns(batch) -> list:
    lang, source = batch.column("_lang").to_pylist(), batch.column("_source").to_pylist()
    return [lang, source, batch.column("_text").cast(pa.large_binary())]


def marks(docs: DataFrame, width: int, min_docs: int = MIN_DOCS, tasks: int = SKETCH_TASKS, held: int = HELD) -> np.ndarray:
    """docs: _lang, _text. The marked cells, packed, a row of the sketch each."""
    chunk = min(CHUNK, width)
    kind = np.min_scalar_type(min_docs)

    def count(batches):
        sketch = np.zeros((ROWS, width), kind)
        found: dict[str, Counter] = {}

        def add():
            for lang, n in found.items():
                number = np.minimum(np.fromiter(n.values(), np.int64, len(n)), min_docs)
                for row, at in zip(sketch, cells(lang, list(n), width), strict=True):
                    own, back = np.unique(at, return_inverse=True)
                    row[own] = np.minimum(row[own] + np.bincount(back, number), min_docs)
            found.clear()

        for batch in batches:
            for lang, _, text in zip(*columns(batch), strict=True):
                terms: set = set()
                for words in word_lists(text.as_py() or b"", LETTERS):
                    terms.update(words)
                found.setdefault(lang, Counter()).update(terms)
                if sum(map(len, found.values())) >= held:
                    add()
        add()
        parts = sketch.reshape(-1, chunk)
        some = np.flatnonzero(parts.any(axis=1))
        for i in range(0, len(some), 64):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 64], pa.int32()), pa.array([parts[k].tobytes() for k in some[i : i + 64]], pa.binary())], ["_chunk", "_cells"])

    def merge(rows: pa.Table) -> pa.Table:
        total = np.zeros(chunk, np.int64)
        for x in rows.column("_cells"):
            total += np.frombuffer(x.as_buffer(), kind)
        return pa.table({"_chunk": rows.column("_chunk")[:1], "_bits": pa.array([np.packbits(total >= min_docs).tobytes()], pa.binary())})

    found = docs.coalesce(tasks).mapInArrow(count, "_chunk int, _cells binary").groupBy("_chunk").applyInArrow(merge, "_chunk int, _bits binary")
    out = np.zeros((ROWS * width // chunk, max(1, chunk // 8)), np.uint8)
    for k, bits in found.collect():  # ROWS x width bits
        out[k] = np.frombuffer(bits, np.uint8)
    return out.reshape(ROWS, -1)


def counted(docs: DataFrame, marked: np.ndarray, width: int, held: int = HELD) -> DataFrame:
    """docs: _lang, _source, _text. Per group and term that the marks allow: _lang, _source, _term, _docs, _n; a row without a term for each group."""

    def allowed(lang: str, terms: list[bytes]) -> np.ndarray:
        at = cells(lang, terms, width)
        return np.all([marked[r][at[r] >> 3] >> (7 - (at[r] & 7)) & 1 for r in range(ROWS)], axis=0)

    def count(batches):
        found: dict[tuple[str, str], tuple[dict, dict]] = {}

        def rows():
            for (lang, source), (n_docs, n) in found.items():
                terms = list(n)
                keep = np.flatnonzero(allowed(lang, terms)).tolist() if terms else []
                terms = [terms[i] for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()),
                     pa.array([*(t.decode("utf-8", "replace") for t in terms), None], pa.string()),
                     pa.array([*(n_docs[t] for t in terms), 0], pa.int64()), pa.array([*(n[t] for t in terms), 0], pa.int64())],
                    ["_lang", "_source", "_term", "_docs", "_n"])
            found.clear()

        some = 0
        for batch in batches:
            for lang, source, text in zip(*columns(batch), strict=True):
                n_docs, n = found.setdefault((lang, source), ({}, {}))
                before, own = len(n), Counter()
                for words in word_lists(text.as_py() or b"", LETTERS):
                    own.update(words)
                for t, c in own.items():
                    n[t] = n.get(t, 0) + c
                    n_docs[t] = n_docs.get(t, 0) + 1
                some += len(n) - before
                if some >= held:
                    yield from rows()
                    some = 0
        yield from rows()

    return docs.mapInArrow(count, "_lang string, _source string, _term string, _docs long, _n long").groupBy("_lang", "_source", "_term").agg(
        F.sum("_docs").alias("_docs"), F.sum("_n").alias("_n"))


def share(n: Column, total: Column, kept: Column, smooth: int = SMOOTH, unit: int = UNIT) -> Column:
    """1 + floor(unit * (n + smooth) / (total + smooth * kept)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(F.lit(unit)) * wide(n + smooth), wide(total + smooth * kept))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, width: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by their distance (pair), terms that the source has more of than its language (term)."""
    docs = docs.select(whole(F.col(lang)).alias("_lang"), whole(F.col(source)).alias("_source"), F.col(text).alias("_text"))
    if width is None:
        width = min(MAX_WIDTH, max(1 << 12, 1 << (4 * docs.count()).bit_length()))
    counts = stored(counted(docs, marks(docs, width, min_docs), width))
    terms = stored(counts.where("_term is not null").groupBy("_lang", "_term").agg(F.sum("_docs").alias("_d"), F.sum("_n").alias("_all")).where(F.col("_d") >= min_docs).drop("_d"))
    langs = terms.groupBy("_lang").agg(F.count("*").alias("_v"), F.sum("_all").alias("_nl"))
    own = stored(counts.where("_term is not null").join(terms, ["_lang", "_term"]).select("_lang", "_source", "_term", "_n", "_all"))
    totals = own.groupBy("_lang", "_source").agg(F.sum("_n").alias("_ng"), F.count("*").alias("_kinds"))
    groups = counts.where("_term is null").select("_lang", "_source").join(totals, ["_lang", "_source"], "left").join(langs, "_lang", "left")
    groups = groups.select("_lang", "_source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("_ng", "_kinds", "_v", "_nl")))
    groups = stored(groups.withColumn("_p0", F.when(F.col("_v") > 0, share(F.lit(0), F.col("_ng"), F.col("_v"))).otherwise(0)))
    n = groups.count()
    own = stored(own.join(small(groups, n), ["_lang", "_source"]).select(
        "_lang", "_source", "_term", share(F.col("_n"), F.col("_ng"), F.col("_v")).alias("_p"), share(F.col("_all"), F.col("_nl"), F.col("_v")).alias("_q"), "_p0"))

    # what a source's own terms add against another source's share of an absent term
    point = lambda df, v, m, item: df.select("_lang", "_source", v.alias("_x"), m.alias("_m"), item.alias("_item"))
    item = F.lit(None).cast("string")
    has = point(own.groupBy("_lang", "_source", "_p").agg(F.count("*").alias("_m")), F.col("_p"), F.col("_m"), item)
    other = groups.select(F.col("_lang").alias("_l"), F.col("_source").alias("_item"), F.col("_p0").alias("_o0"))
    met = groups.join(small(other, n), (F.col("_lang") == F.col("_l")) & (F.col("_source") != F.col("_item")))
    upto = Window.partitionBy("_lang", "_source").orderBy("_x").rangeBetween(Window.unboundedPreceding, 0)
    every = own.groupBy("_lang", "_source").agg(F.sum("_p").alias("_sum"))
    alone = has.unionAll(point(met, F.col("_o0"), F.lit(0), F.col("_item"))).withColumn("_below", F.sum("_m").over(upto)).withColumn(
        "_less", F.sum(F.col("_m") * F.col("_x")).over(upto)).where("_item is not null")
    x, kinds, total = F.col("_x"), F.col("_kinds"), F.coalesce("_sum", F.lit(0))
    alone = alone.join(small(groups.select("_lang", "_source", "_kinds", "_v", "_p0"), n), ["_lang", "_source"]).join(small(every, n), ["_lang", "_source"], "left")
    alone = alone.select(
        "_lang", F.least("_source", "_item").alias("_a"), F.greatest("_source", "_item").alias("_b"), "_v", F.abs(F.col("_p0") - x).alias("_empty"),
        (2 * (F.col("_below") * x - F.col("_less")) + total - kinds * x - kinds * F.abs(F.col("_p0") - x)).alias("_add"))

    # terms that both have
    a, b = (own.select("_lang", "_term", F.col("_source").alias(s), F.col("_p").alias(f"{s}p"), F.col("_p0").alias(f"{s}0")) for s in ("_a", "_b"))
    gap = lambda u, v: F.abs(F.col(u) - F.col(v))
    both = a.join(b, ["_lang", "_term"]).where("_a < _b").groupBy("_lang", "_a", "_b").agg(
        F.sum(gap("_ap", "_bp") - gap("_ap", "_b0") - gap("_a0", "_bp") + gap("_a0", "_b0")).alias("_add"))
    pairs = alone.groupBy("_lang", "_a", "_b").agg((F.first("_v") * F.first("_empty") + F.sum("_add")).alias("_add")).unionByName(both)
    pairs = pairs.groupBy("_lang", "_a", "_b").agg(F.sum("_add").alias("_value"))
    sides = F.explode(F.array(F.struct(F.col("_a").alias("s"), F.col("_b").alias("i")), F.struct(F.col("_b").alias("s"), F.col("_a").alias("i"))))
    found = pairs.select("_lang", "_value", sides.alias("_e")).select("_lang", F.col("_e.s").alias("_source"), F.lit("pair").alias("_part"), F.col("_e.i").alias("_item"), "_value")
    more = own.where("_p > _q").select("_lang", "_source", F.lit("term").alias("_part"), F.col("_term").alias("_item"), (F.col("_p") - F.col("_q")).alias("_value"))
    order = Window.partitionBy("_lang", "_source").orderBy(F.desc("_value"), "_item")
    ranked = lambda df: df.withColumn("_k", F.row_number().over(order))
    out = ranked(found).unionByName(ranked(more).where(F.col("_k") <= top))
    return out.select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_part").alias("part"), F.col("_item").alias("item"),
                      F.col("_value").cast("long").alias("value"), F.col("_k").cast("int").alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT lang, source, d, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, kept.term, kept.n AS all_n, coalesce(x.n, 0) AS n FROM g JOIN kept USING (lang)
      LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x USING (lang, source, term)),
s AS (SELECT c.*, sum(c.n) OVER (PARTITION BY lang, source)::HUGEINT AS gn FROM c),
p AS (SELECT s.lang, source, term, s.n, 1 + (1000000000::HUGEINT * (s.n + 5)) // (gn + 5 * v) AS p, 1 + (1000000000::HUGEINT * (all_n + 5)) // (v.n + 5 * v) AS q FROM s JOIN v USING (lang)),
r AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) f
    ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
