"""Operator 10, line dedup: a suffix array over the documents' line sequences, by distributed prefix doubling.

A text is the sequence of its lines with a word (split at \\n, compared as they are); a suffix starts at each line. A run of lines with
``min_words`` words or more together is deleted where the same run stands at an earlier place, by (key, line); its first copy stays.

1. Ranks. Suffixes are first ranked by their first line: the 128-bit digests of lines are counted, those that occur at two places
   are sorted by range over the cluster, and the place in this order is the rank.
2. Doubling. The rank by twice as many lines is that of the pair (rank at the line, rank as many lines further on), again by
   counting and sorting the distinct pairs. A suffix whose lines so far occur nowhere else shares no longer run with any
   other and leaves the array, so each round sorts only what still repeats. Suffixes of one rank are an interval of the array
   whose longest common prefix has at least as many lines as the round compares (``intervals``).
3. Runs. Of each suffix the shortest prefix of ``min_words`` words is asked for, and of each line the shortest run of so many words
   that ends with it; every line of a repeated run that long lies in one of the two. A run of n lines is named exactly by n and by its ranks, in the
   largest round of at most n lines, at its first line and that many lines before its end. A name at two places is a repeated run.
4. Every copy but the first loses its lines; runs that overlap or touch are joined, as (start, end), to maximal runs. Lines without words
   stay, and so do short lines that repeat on their own.

A line that a third of all documents have is one row after the partial aggregation, and the join back to its places
is an equi join (broadcast if few intervals are left) that adaptive execution splits. Null and empty texts have no lines and
stay as they are (null stays null). Rows that share key and text are one document: neither loses lines for the
other. Ties do not occur otherwise. Very long texts are sequences like others. An empty table gives an empty result. Other columns of the input are
kept by ``dedup``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaspan.llm.common import GAP_CHARS, documents, small, stored

MIN_WORDS = 50
CHUNK = 100_000  # rows that a task returns at once

PLACE = ["_key", "_h", "_at"]


def shortest_runs(words: list[int], least: int) -> tuple[list[int | None], list[int | None]]:
    """For each line, the lines of the shortest run of ``least`` words that starts with it, and of the one that ends with it (None: the text is too short)."""
    after, before = [None] * len(words), [None] * len(words)
    start = held = 0
    for end, n in enumerate(words):
        held += n
        while held >= least:
            after[start] = end - start + 1
            before[end] = end - start + 1  # the last start that still holds enough is the shortest
            held -= words[start]
            start += 1
        if before[end] is None and start:  # the run from the line before the start holds enough
            before[end] = end - start + 2
    return after, before


def line_rows(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """A row per line with words: _key, _h (hash of the text), _at (index among these lines), _name (digest), _after and _before (``shortest_runs``)."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]

            def rows():
                at = pa.array(out[0], pa.int64())
                ints = [pa.array(x, pa.int32()) for x in (out[1], out[3], out[4])]
                return pa.RecordBatch.from_arrays(
                    [batch.column("_key").take(at), batch.column("_h").take(at), ints[0], pa.array(out[2], pa.binary()), *ints[1:]],
                    [*PLACE, "_name", "_after", "_before"])

            for i, t in enumerate(batch.column("_text").cast(pa.binary()).to_pylist()):
                lines = [x for x in (t or b"").split(b"\n") if x and not x.isspace()]
                after, before = shortest_runs([len(x.split()) for x in lines], min_words)
                for at, x in enumerate(lines):
                    for values, value in zip(out, (i, at, hashlib.blake2b(x, digest_size=16).digest(), after[at], before[at])):
                        values.append(value)
                    if len(out[0]) >= CHUNK:
                        yield rows()
                        for values in out:
                            values.clear()
            yield rows()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, _h long, _at int, _name binary, _after int, _before int")


def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    """The values of ``by`` that stand at two places or more: ``by``, _first (a place), _copies."""
    me = F.struct(*PLACE)
    found = rows.groupBy(*by).agg(F.min(me).alias("_first"), F.max(me).alias("_last"), F.count("*").alias("_copies")).where(F.col("_first") != F.col("_last"))
    return found.select(*by, "_first", "_copies")


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """The repeated values of ``by`` in order, with _new, which grows with the order."""
    return stored(repeated(rows, by).orderBy(*by).withColumn("_new", F.monotonically_increasing_id()))


def first_round(lines: DataFrame) -> DataFrame:
    """A row per line that repeats: _key, _h, _at, _n (1), _rank, _first (its first place), _copies, _after, _before. Only these are moved on."""
    held = lines.join(small(ranked(lines, ["_name"])), "_name").dropDuplicates(PLACE)
    return stored(held.select(*PLACE, F.lit(1).alias("_n"), F.col("_new").alias("_rank"), "_first", "_copies", "_after", "_before"))


def rounds(first: DataFrame, most: int | None = None) -> DataFrame:
    """A row per suffix and round in which it shares its lines: _key, _h, _at, _n (lines, up to ``most``), _rank, _first (the interval's first place), _copies."""
    columns = [*PLACE, "_n", "_rank", "_first", "_copies"]
    n, out = 1, [first.select(*columns)]
    while most is None or 2 * n <= most:
        further = Window.partitionBy("_key", "_h").orderBy("_at").rangeBetween(n, n)
        pairs = stored(out[-1].select(*PLACE, "_rank", F.max("_rank").over(further).alias("_next")).where("_next is not null"))
        ranks = ranked(pairs, ["_rank", "_next"])
        if ranks.isEmpty():
            break
        n *= 2
        out.append(stored(pairs.join(small(ranks), ["_rank", "_next"]).select(*PLACE, F.lit(n).alias("_n"), F.col("_new").alias("_rank"), "_first", "_copies")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def intervals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The intervals of the whole array: ``rounds`` of the documents' lines until no run repeats."""
    return rounds(first_round(stored(line_rows(docs, key, text, MIN_WORDS))))


def removed_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row per maximal run of lines that a document loses: _key, _h, _start, _end (indices among its lines with words, the end not included)."""
    first = first_round(stored(line_rows(docs, key, text, min_words)))
    place = first.select("_key", "_h", F.explode(F.array(
        F.struct(F.col("_at"), F.col("_after").alias("_n")), F.struct((F.col("_at") - F.col("_before") + 1).alias("_at"), F.col("_before").alias("_n")))).alias("_r"))
    asked = place.where("_r._n is not null").select("_key", "_h", "_r.*")
    most = asked.agg(F.max("_n")).first()[0] or 0
    ranks = stored(rounds(first, most).select(*PLACE, F.col("_n").alias("_of"), "_rank"))
    asked = asked.withColumn("_of", F.expr("cast(shiftleft(1, cast(floor(log2(_n) + 1e-9) as int)) as int)"))
    at = lambda rows, shift, name: rows.join(
        ranks.select(F.col("_key").alias("_k"), F.col("_h").alias("_g"), F.col("_at").alias("_p"), F.col("_of").alias("_o"), F.col("_rank").alias(name)),
        F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_g")) & (F.col("_of") == F.col("_o")) & (F.col("_at") + shift == F.col("_p"))).drop("_k", "_g", "_p", "_o")
    named = stored(at(at(asked, F.lit(0), "_head"), F.col("_n") - F.col("_of"), "_tail").select(*PLACE, "_n", "_head", "_tail").distinct())
    by = ["_n", "_head", "_tail"]
    later = named.join(small(stored(repeated(named, by))), by).where(F.struct(*PLACE) != F.col("_first"))
    ends = later.groupBy(*PLACE).agg((F.col("_at") + F.max("_n")).alias("_to"))
    order = Window.partitionBy("_key", "_h").orderBy("_at")
    before = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = ends.withColumn("_new", (F.col("_at") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    return run.groupBy("_key", "_h", "_run").agg(F.min("_at").alias("_start"), F.max("_to").alias("_end")).drop("_run")


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per document that loses lines: _key, _h, _runs (maximal runs, in order), _gone (indices among its lines with words, each once)."""
    runs = removed_runs(docs, key, text, min_words).groupBy("_key", "_h").agg(F.array_sort(F.collect_list(F.struct("_start", "_end"))).alias("_runs"))
    return runs.select("_key", "_h", "_runs", F.flatten(F.transform("_runs", lambda r: F.sequence(r["_start"], r["_end"] - 1))).alias("_gone"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The input's columns and _kept_text, _n_lines (with words), _n_removed, _n_runs (maximal runs), _longest_run (lines)."""
    gone = removed_lines(docs, key, text, min_words)
    out = docs.withColumn("_hash", F.xxhash64(text)).join(gone, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_h")), "left")
    has_word = lambda x: F.translate(x, GAP_CHARS, "") != ""
    all_lines = F.split(F.col(text), "\n", -1)
    out = out.select(*docs.columns, "_gone", "_runs", F.transform(all_lines, lambda x: F.struct(x.alias("x"), has_word(x).alias("w"))).alias("_l"))
    word_at = F.filter(F.transform("_l", lambda x, i: F.when(x.w, i)), lambda i: i.isNotNull())
    out = out.withColumn("_word_at", word_at)
    drop = F.array_sort(F.transform("_gone", lambda g: F.get("_word_at", g)))
    out = out.withColumn("_drop", F.coalesce(drop, F.array().cast("array<int>"))).withColumn(
        "_n_keep", F.size("_l") - F.size("_drop"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("_drop"))
    text_kept = F.array_join(F.transform(keep, lambda i: F.get("_l", i).x), "\n")
    return out.select(
        *docs.columns, F.when(F.col(text).isNotNull(), F.when(F.size("_drop") == 0, F.col(text)).otherwise(text_kept)).alias("_kept_text"),
        F.coalesce(F.size("_word_at"), F.lit(0)).cast("long").alias("_n_lines"), F.size("_drop").cast("long").alias("_n_removed"),
        F.coalesce(F.size("_runs"), F.lit(0)).cast("long").alias("_n_runs"),
        F.coalesce(F.array_max(F.transform("_runs", lambda r: r["_end"] - r["_start"])), F.lit(0)).cast("long").alias("_longest_run"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_runs").alias("n_runs"),
        F.col("_longest_run").alias("longest_run"), F.md5(F.encode("_kept_text", "utf-8")).alias("kept_md5"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i,
         len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), c AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w
), seq AS (
  SELECT doc_id, list(line ORDER BY i) AS lines FROM c GROUP BY doc_id
), runs AS (
  SELECT a.doc_id, a.i, min(b.i) - a.i + 1 AS n FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY a.doc_id, a.i
  UNION SELECT b.doc_id, max(a.i), b.i - max(a.i) + 1 FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.i
), named AS (
  SELECT runs.*, md5(array_to_string(lines[i : i + n - 1], chr(10))) AS name FROM runs JOIN seq USING (doc_id)
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, name ORDER BY doc_id, i) AS k FROM named) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM later
), stretches AS (
  SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g
), counted AS (
  SELECT doc_id, count(*) AS n_runs, max(lines) AS longest_run FROM stretches GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, count(w.i) AS n_lines, count(gone.i) AS n_removed,
         string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.i IS NULL) AS t
  FROM l LEFT JOIN w ON w.doc_id = l.doc_id AND w.pos = l.pos LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run,
       CASE WHEN text IS NOT NULL THEN md5(coalesce(t, '')) END AS kept_md5
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN counted ON counted.doc_id = d.doc_id
"""
