"""Operator 1, n-gram Jaccard join with token-combination prefixes.

A text's set is its distinct shingles of ``shingle`` words (A-Z lower-cased; with fewer words the whole sequence is one
shingle; without words the set is empty and links with nothing), as 64-bit hashes. Two sets link when
100 * intersection >= ``percent`` * union.

1. Texts with equal sets form a class; all further work is on classes, so a group of copies counts once.
2. Prefixes. Shingles have a global order: those whose hash falls in a fixed region (``REGION`` of all) by the number of
   texts they are in and then by hash, the others after them by hash. A class must share a signature with each class it
   links with if the signatures of its prefix survive any |set| - ceil(percent / 100 * |set|) missing shingles. Rare
   shingles are signatures of their own and add one to what a prefix survives; frequent ones are indexed as pairs
   within groups of shingles, and a group of g adds g - 1, so the prefix is extended for them. Classes that can
   link with no other size and lack nothing (less than 9 shingles at 90 percent) link with equal ones only and have no
   prefix; a set of 9 lacks nothing either, but links with one of 10 around it. Groups depend on the level (the binary
   size class); near a level's lower end a class is indexed at the level below as well, so linked classes have a level
   in common.
3. Stars. Each signature's classes are compared with one of them, the one with the largest share of shingles that others have: linear
   in the number of signatures, and enough to join most copies. Their components follow.
4. The rest. Within a signature, classes outside its most frequent component are compared with all classes in other
   components. In signatures of ``LARGE`` classes or more, pairs are made only where the shingles that the two share with
   the star's centre and those that any other class has could suffice. No pair that may link two components is left out.
5. All pairs are verified on the whole sets; components of the links give the result.

Only pairs that matter for components are formed; the number of partners has no cap. Null texts have empty sets.
Repeated rows and keys are placed each; a component's id is the least key in it (null keys only if there is no other).
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspan.llm.common import documents, small, stored
from lumaspan.operators.graph import components
from lumaspan.llm.hashing import Words, ascii_fold, gap_words, joined, mix, pieces, text_bytes

SHINGLE = 3
PERCENT = 90
REGION = 0.25
FREQUENT = 32  # texts from which on a shingle is indexed in pairs
PER_GROUP = 8
LARGE = 64
ID_ROWS = 500_000  # class ids that may be broadcast (a long each)


def sets(batch, text: str, k: int):
    """(row, sorted distinct shingle hashes) of each row of an Arrow batch."""
    data, at = text_bytes(batch.column(text))
    fold, is_word = ascii_fold(), gap_words()
    for i, j in pieces(at):
        w = Words(data, at, i, j, fold, is_word)
        sh, _ = w.shingles(k)
        first = w.first.tolist()
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if b - a >= k:
                yield i + r, np.unique(sh[a : b - k + 1])
            elif b > a:
                yield i + r, joined([w.hash[x : x + 1] for x in range(a, b)])
            else:
                yield i + r, np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A hash of a set, as a signed long."""
    with np.errstate(over="ignore"):
        return int((mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))


def missing(n: int, percent: int) -> int:
    """Shingles of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def only_equal(n: int, percent: int) -> bool:
    """A set of n links with equal sets alone: it may lack nothing, and no larger set may hold it."""
    return missing(n, percent) == 0 and 100 * n // percent == n


def levels(n: int, percent: int) -> list[int]:
    top = n.bit_length() - 1
    low = max(1, -(-percent * n // 100)).bit_length() - 1
    return [top] if low == top else [top, low]


def group_count(level: int, percent: int) -> int:
    return max(1, missing(1 << level, percent) // PER_GROUP)


def needed(n: int, percent: int) -> int:
    """Shingles that any prefix of a set of n has at most."""
    return missing(n, percent) + 1 + max(group_count(x, percent) for x in levels(n, percent))


def region_tokens(s: np.ndarray, percent: int, region: float) -> np.ndarray:
    """A set's shingles of the region, and more by hash where these may be too few for a prefix. s is sorted."""
    if not len(s):
        return s
    r = int(np.searchsorted(s, np.uint64(int(region * 2**64))))
    return s[: max(r, min(len(s), needed(len(s), percent)))]


def signatures(n: int, emitted: int, found: list[tuple[int, int]], percent: int, region: float) -> list[int]:
    """found: (number of texts, hash) of the emitted shingles that are in two texts or more."""
    limit = int(region * 2**64)
    inside = sorted((d, h) for d, h in found if h < limit)
    rest = sorted(h for _, h in found if h >= limit)
    short = emitted > 0 and (len(rest) > 0 or emitted <= needed(n, percent))
    out = []
    for level in levels(n, percent):
        groups, most = group_count(level, percent), missing(n, percent)
        survived = 0 if short else emitted - len(found)  # shingles of one text come first
        by_group: dict[int, list[int]] = {}
        for d, h in inside:
            if survived > most:
                break
            if d <= FREQUENT:
                survived += 1
                out.append((level, h))
                continue
            own = by_group.setdefault(h % groups, [])
            survived += len(own) > 0
            out += [(level, g, h) for g in own]
            own.append(h)
        if survived <= most:
            out += [(level, h) for h in rest]
    if not out:
        return []
    as_column = lambda k: np.array([x[k] if k < len(x) else 0 for x in out], np.uint64)
    return joined([as_column(0), as_column(1), as_column(2)]).view(np.int64).tolist()


def class_table(docs: DataFrame, key: str, text: str, k: int, percent: int, region: float) -> DataFrame:
    """Per row: _key, _n (set size), _class, _r (shingles that are prefix material)."""

    def run(batches):
        for batch in batches:
            got = [(len(s), set_id(s), len(region_tokens(s, percent, region))) for _, s in sets(batch, text, k)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([g[x] for g in got], pa.int64()) for x in range(3))], ["_key", "_n", "_class", "_r"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"_key {kind}, _n long, _class long, _r long")


def token_table(docs: DataFrame, text: str, k: int, percent: int, region: float) -> DataFrame:
    """_h, _class of each class's prefix material; classes once per task at least."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            hs, cs, lens = [], [], []
            for _, s in sets(batch, text, k):
                if not only_equal(len(s), percent) and (c := set_id(s)) not in seen:
                    seen.add(c)
                    t = region_tokens(s, percent, region)
                    hs.append(t)
                    cs.append(c)
                    lens.append(len(t))
            h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(np.array(cs, np.int64), lens))], ["_h", "_class"])

    return docs.select(text).mapInArrow(run, "_h long, _class long")


def signature_table(docs: DataFrame, classes: DataFrame, text: str, k: int, percent: int, region: float) -> DataFrame:
    """_sig, _class, _n, _own (share of the prefix material that no other text has), _many of signatures that _many > 1 classes have.

    classes: _class, _n, _r (prefix material), a row per class."""
    tokens = token_table(docs, text, k, percent, region)
    shared = tokens.groupBy("_h").agg(F.count("*").alias("_d")).where("_d > 1")
    found = tokens.join(shared, "_h").groupBy("_class").agg(F.collect_set(F.struct("_d", "_h")).alias("_found"))
    found = found.join(classes, "_class").where(
        (F.col("_r") - F.size("_found") <= F.col("_n") - F.ceil(F.col("_n") * percent / 100)) | (F.col("_r") <= F.col("_n") * (1 - percent / 100) * 1.25 + 3))

    def run(batches):
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("_class", "_n", "_r", "_found")), strict=True)
            for c, n, r, f in rows:
                pairs = [(x["_d"], x["_h"] & 0xFFFFFFFFFFFFFFFF) for x in f]
                own = (r - len(f)) / max(1, r)
                out += [(s, c, n, own) for s in set(signatures(n, r, pairs, percent, region))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["_sig", "_class", "_n", "_own"])

    made = stored(found.select("_class", "_n", "_r", "_found").mapInArrow(run, "_sig long, _class long, _n long, _own double"))
    several = made.groupBy("_sig").agg(F.count("*").alias("_many")).where("_many > 1")
    return stored(made.join(several, "_sig"))


def set_table(docs: DataFrame, reps: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """_class, _set (sorted hashes) of the classes in reps (_class, _rep: a row's key)."""
    n = reps.count()
    ids = reps.select(F.col("_rep").alias("_k"))
    rows = docs.select(key, text).join(F.broadcast(ids) if n <= ID_ROWS else ids, F.col(key).eqNullSafe(F.col("_k")), "left_semi")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            got = []
            for _, s in sets(batch, text, k):
                if (c := set_id(s)) not in seen:
                    seen.add(c)
                    got.append((c, s))
            flat = np.concatenate([s for _, s in got]) if got else np.zeros(0, np.uint64)
            at = np.concatenate(([0], np.cumsum([len(s) for _, s in got], dtype=np.int64))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], ["_class", "_set"])

    found = rows.mapInArrow(run, "_class long, _set array<long>")
    wanted = reps.select(F.col("_class").alias("_c"))
    return found.join(F.broadcast(wanted) if n <= ID_ROWS else wanted, F.col("_class") == F.col("_c"), "left_semi").dropDuplicates(["_class"])


def compared(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """pairs: _a, _b. Adds _both, the size of the intersection, and _links."""
    a, b = table.select(F.col("_class").alias("_a"), F.col("_set").alias("_sa")), table.select(F.col("_class").alias("_b"), F.col("_set").alias("_sb"))
    both = pairs.join(a, "_a").join(b, "_b").select("_a", "_b", F.size("_sa").alias("_na"), F.size("_sb").alias("_nb"), F.size(F.array_intersect("_sa", "_sb")).alias("_both"))
    return both.select("_a", "_b", "_both", (100 * F.col("_both") >= percent * (F.col("_na") + F.col("_nb") - F.col("_both"))).alias("_links"))


def near(n: str, m: str, percent: int):
    return (100 * F.col(n) >= percent * F.col(m)) & (100 * F.col(m) >= percent * F.col(n))


def bounded(index: DataFrame, table: DataFrame) -> DataFrame:
    """Adds _most, which no overlap of the class with another of a signature exceeds, and _hub, the signature's centre.

    For signatures of ``LARGE`` classes or more, _most counts the class's shingles that another class of such signatures
    has; else it is the set's size. The centre has the largest share of shingles that others have."""
    large = index.where(F.col("_many") >= LARGE).select("_class").distinct()
    tokens = table.join(large, "_class", "left_semi").select("_class", F.explode("_set").alias("_h"))
    shared = tokens.groupBy("_h").agg(F.count("*").alias("_d")).where("_d > 1")
    most = tokens.join(shared, "_h").groupBy("_class").agg(F.count("*").alias("_in"))
    most = stored(large.join(most, "_class", "left").select(F.col("_class").alias("_x"), F.coalesce("_in", F.lit(0)).alias("_in")))
    index = index.join(most, F.col("_class") == F.col("_x"), "left").withColumn(
        "_most", F.when(F.col("_many") >= LARGE, F.col("_in")).otherwise(F.col("_n")))
    share = F.when(F.col("_many") >= LARGE, F.col("_in") / F.col("_n")).otherwise(1 - F.col("_own"))
    index = stored(index.select("_sig", "_class", "_n", "_most", "_many", share.alias("_share")))
    hubs = index.groupBy("_sig").agg(F.max_by("_class", F.struct("_share", "_most", "_class")).alias("_hub"))
    return stored(index.join(hubs, "_sig").drop("_share"))


def remaining_pairs(index: DataFrame, stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with a signature in common that stars have not joined. Large signatures with one centre are taken together.

    There, x and y have at most min(|x & c|, |y & c|) shingles of the centre c in common and, besides, at most the
    smaller number of those of their other shingles that any class has too."""
    large = F.col("_many") >= LARGE
    index = index.where(~large | (F.col("_class") != F.col("_hub"))).join(labels, F.col("_class") == F.col("_node"), "left").select(
        F.when(large, F.col("_hub")).otherwise(F.col("_sig")).alias("_sig"), large.alias("_large"),
        "_class", "_n", "_most", F.coalesce("_root", "_class").alias("_label")).distinct()
    sizes = index.groupBy("_sig", "_large", "_label").agg(F.count("*").alias("_c"))
    split = sizes.groupBy("_sig", "_large").agg(F.count("*").alias("_labels"), F.max_by("_label", F.struct("_c", "_label")).alias("_major")).where("_labels > 1")
    index = index.join(split.select("_sig", "_large", "_major"), ["_sig", "_large"]).where(100 * F.col("_most") >= percent * F.col("_n"))
    centre = stars.select(F.col("_a").alias("_class"), F.col("_b").alias("_sig"), F.lit(True).alias("_large"), "_both")
    most = F.col("_most")
    index = stored(index.join(centre, ["_class", "_sig", "_large"], "left").select(
        "_sig", "_large", "_class", "_label", "_major",
        F.struct("_n", "_most", F.coalesce("_both", most).alias("_in"), F.when(F.col("_large"), most - F.coalesce("_both", F.lit(0))).otherwise(0).alias("_out")).alias("_s")))
    a = index.where("_label != _major").select("_sig", "_large", F.col("_class").alias("_a"), F.col("_label").alias("_la"), F.col("_s").alias("_x"))
    b = index.select("_sig", "_large", F.col("_class").alias("_b"), F.col("_label").alias("_lb"), F.col("_s").alias("_y"), (F.col("_label") == F.col("_major")).alias("_top"))
    bound = F.least("_x._most", "_y._most", F.least("_x._in", "_y._in") + F.least("_x._out", "_y._out"))
    fits = (100 + percent) * bound >= percent * (F.col("_x._n") + F.col("_y._n"))
    return a.join(b, ["_sig", "_large"]).where((F.col("_la") != F.col("_lb")) & (F.col("_top") | (F.col("_a") < F.col("_b"))) & near("_x._n", "_y._n", percent) & fits).select(
        F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, region: float = REGION) -> DataFrame:
    """Per row: key, n_shingles, component_id (least key of the component), class_id (least key of the texts with equal sets)."""
    docs = docs.select(key, text)
    rows = stored(class_table(docs, key, text, shingle, percent, region))
    classes = stored(rows.where("_n > 0").groupBy("_class", "_n", "_r").agg(F.min("_key").alias("_rep")))
    index = signature_table(docs, classes.select("_class", "_n", "_r"), text, shingle, percent, region)
    reps = stored(classes.join(index.select("_class").distinct(), "_class", "left_semi"))
    table = stored(set_table(docs, reps, key, text, shingle))
    index = bounded(index, table)
    sizes = index.select(F.col("_class").alias("_b"), F.col("_n").alias("_nb")).distinct()
    stars = index.where("_class != _hub").select(F.col("_class").alias("_a"), F.col("_n").alias("_na"), F.col("_hub").alias("_b")).distinct()
    stars = stars.join(sizes, "_b").where(near("_na", "_nb", percent)).select("_a", "_b")
    stars = stored(compared(stars, table, percent))
    links = stars.where("_links").select("_a", "_b")
    more = stored(compared(remaining_pairs(index, stars, stored(components(links)), percent), table, percent).where("_links").select("_a", "_b"))
    root = stored(components(links.unionAll(more)))
    least = root.join(classes, F.col("_node") == F.col("_class")).groupBy("_root").agg(F.min("_rep").alias("_least"))
    named = stored(root.join(least, "_root").select(F.col("_node").alias("_class"), "_least"))
    classes = stored(classes.join(named, "_class", "left").select(F.col("_class").alias("_c"), "_rep", F.coalesce("_least", "_rep").alias("_least")))
    return rows.join(classes, (F.col("_class") == F.col("_c")) & (F.col("_n") > 0), "left").select(
        F.col("_key").alias(key), F.col("_n").alias("n_shingles"), F.coalesce("_least", "_key").alias("component_id"), F.coalesce("_rep", "_key").alias("class_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
