"""Operator 11, importance resampling towards a target distribution, by word tries in each partition.

1. Totals. Each task keeps a trie of its words. A node is a run of 1 to ``longest`` words; it holds how often the run occurs and
   the CRC of its bytes so far, from which the CRC of a longer run goes on: a run's bytes are read once. When the trie has
   ``nodes`` nodes it is emptied into the totals by bucket; so a task needs bounded memory and sends at most ``buckets`` rows.
   The totals of source and target are summed over all tasks.
2. Gains. A bucket's gain is the floor of 1000 times the logarithm of its smoothed share in the target over that in the source.
3. Scores. A trie whose nodes hold their gain, attached when a path is walked for the first time, is walked with
   all runs of a document. Gumbel noise from a hash of the key is added.
4. Draw. Documents of ``least_words`` words or more are sorted by range over the cluster; a row's rank is its place in its
   partition plus the rows of the partitions before. The first ``percent`` percent are drawn: a draw without replacement by weight.

The driver holds one number for each bucket (``buckets`` of them, whatever the input's size). No key is ever grouped, so a hot source or text
costs nothing. Null and empty texts have no words: weight 0, never drawn. Very long texts are read in pieces. A null key is
hashed as an empty one. Rows that repeat key and text are scored and ranked each, in any order among themselves. An empty table
gives an empty result; without a target's words each bucket's share there is the same. Other columns are ignored.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaspan.llm.common import documents, small, stored
from lumaspan.llm.hashing import folded, word_lists
from lumaspan.tables import table

LONGEST = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
NODES = 200_000
LETTERS = folded("0123456789")


class Kids(dict):
    """What follows a run: nodes [CRC, value, Kids] by word. ``state`` is the CRC of the run and a space."""

    __slots__ = ("state", "trie")

    def __init__(self, trie: Trie, state: int):
        self.trie, self.state = trie, state

    def __missing__(self, word: bytes) -> list:
        crc = crc32(word, self.state)
        node = self[word] = [crc, self.trie.value(crc), None]
        self.trie.nodes.append(node)
        return node


class Trie:
    def __init__(self, longest: int, value):
        self.longest, self.value = longest, value
        self.clear()

    def clear(self) -> None:
        self.nodes: list[list] = []
        self.root = Kids(self, 0)

    def after(self, node: list) -> Kids:
        if node[2] is None:
            node[2] = Kids(self, crc32(b" ", node[0]))
        return node[2]

    def runs(self, words: list[bytes], seen: int):
        """The nodes of all runs that end behind the first ``seen`` words, a list for each length; all paths go on together."""
        at = [self.root[w] for w in words]
        yield at[seen:] if seen else at
        for n in range(2, self.longest + 1):
            at = [self.after(x)[w] for x, w in zip(at, words[n - 1 :], strict=False)]
            yield at[max(0, seen - n + 1) :]

    def walk(self, text: bytes | None):
        """The nodes of a text's runs, in lists. The number of words goes to ``words``."""
        tail, self.words = [], 0
        for words in word_lists(text or b"", LETTERS):
            self.words += len(words)
            yield from self.runs(tail + words, len(tail))
            tail = (tail + words)[-(self.longest - 1) :] if self.longest > 1 else []


def totals(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, nodes: int = NODES) -> DataFrame:
    """texts: _side, _text. Per side and bucket with features: _side, _bucket, _n."""

    def count(batches):
        found: dict = {}
        trie = Trie(longest, lambda crc: 0)

        def empty(side):
            at = np.fromiter((x[0] for x in trie.nodes), np.int64, len(trie.nodes)) % buckets
            n = np.fromiter((x[1] for x in trie.nodes), np.int64, len(trie.nodes))
            np.add.at(found.setdefault(side, np.zeros(buckets, np.int64)), at, n)
            trie.clear()

        for batch in batches:
            sides = batch.column("_side").to_pylist()
            for i, text in enumerate(batch.column("_text").cast(pa.large_binary())):
                for run in trie.walk(text.as_py()):
                    for node in run:
                        node[1] += 1
                    if len(trie.nodes) >= nodes:
                        empty(sides[i])
                if trie.nodes and (i + 1 == len(sides) or sides[i + 1] != sides[i]):
                    empty(sides[i])
        for side, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([side] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["_side", "_bucket", "_n"])

    return texts.mapInArrow(count, "_side int, _bucket int, _n long").groupBy("_side", "_bucket").agg(F.sum("_n").alias("_n"))


def gains(source: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket."""
    texts = source.select(F.lit(0).alias("_side"), F.col(text).alias("_text")).unionAll(target.select(F.lit(1).alias("_side"), F.col(text).alias("_text")))
    n = np.zeros((2, buckets))
    for side, bucket, count in totals(texts, longest, buckets).collect():  # 2 x ``buckets`` rows at most
        n[side, bucket] = count
    all_s, all_t = n.sum(axis=1).tolist()
    return [math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))) for s, t in zip(*n.tolist(), strict=True)]


def scored(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, nodes: int = NODES) -> DataFrame:
    """Per row: _key, n_features, _words, weight, score."""
    kind = docs.schema[key].dataType.simpleString()

    def score(batches):
        trie = Trie(longest, lambda crc: gain[crc % buckets])
        for batch in batches:
            features, words, weights = [], [], []
            for t in batch.column("_text").cast(pa.large_binary()):
                weight = 0
                for run in trie.walk(t.as_py()):
                    weight += sum([x[1] for x in run])
                    if len(trie.nodes) >= nodes:
                        trie.clear()
                words.append(trie.words)
                features.append(sum(max(0, trie.words - n) for n in range(longest)))
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *(pa.array(x, pa.int64()) for x in (features, words, weights))], ["_key", "n_features", "_words", "weight"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(score, f"_key {kind}, n_features long, _words long, weight long")
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))), "utf-8"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row: key, n_features, weight, score, rank (null: not drawn)."""
    rows = stored(scored(docs, gains(docs, target, text, longest, buckets), key, text, longest, buckets, seed))
    able = F.col("_words") >= least_words
    n = rows.where(able).count() * percent // 100
    at = F.monotonically_increasing_id()
    order = stored(rows.where(able).orderBy(F.desc("score"), F.col("_key").asc_nulls_last()).withColumn("_at", at))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = order.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition of the sort
    before = stored(sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")))
    rank = F.col("_before") + place + 1
    ranked = order.withColumn("_p", part).join(small(before), F.col("_p") == F.col("_part")).withColumn("rank", F.when(rank <= n, rank))
    out = [F.col("_key").alias(key), "n_features", "weight", "score"]
    return ranked.select(*out, "rank").unionByName(rows.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: CRC tables are made by their rule: a byte's value shifted out bit by bit over the reversed polynomial.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (
  SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), w AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), own AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM w)
), bucket AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2),
           lambda i: ((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM own, tab
), n AS (
  SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN bucket USING (f) GROUP BY b
), gain AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS g FROM n
), d AS (
  SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM w JOIN bucket USING (f) JOIN gain USING (b) WHERE side = 0 GROUP BY doc_id
), h AS (
  SELECT doc_id, list_reduce(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(sha256('2024:' || doc_id), i, 1)) - 1)::BIGINT), lambda a, b: a * 16 + b) AS h FROM documents
), s AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents JOIN h USING (doc_id) LEFT JOIN d USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM s WHERE n_features >= 20
)
SELECT s.*, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
