"""Operator 2, removal of repeated byte strings by suffix sorting in buckets with a difference cover.

Every byte covered by a string of ``LENGTH`` bytes that starts at another place too (of this or another text) goes.

1. Buckets. The anchor of a string is its first place of least hash of ``GRAM`` bytes; equal strings have it at the same
   distance. A suffix belongs to the bucket of its string's anchor, by hash. Suffixes whose anchor occurs at one place only cannot
   repeat and are left out.
2. Blocks. Buckets are sorted one block of them at a time; a task holds the pieces of text of one block only. In a block the
   suffixes that start in a residue class of a difference cover modulo ``COVER`` are ranked first, by doubling. All
   suffixes are then sorted by their first bytes up to the cover suffix that starts next, and longer ties by its rank: equal
   strings are at the same distance from it. Neighbours in this order that agree in ``LENGTH`` bytes, compared
   byte by byte, repeat.
3. Buckets of more than ``SUB`` pieces are dealt to several sub-buckets by text; what repeats only across them is found by
   counting 128-bit digests of the strings' own bytes, one for each distinct string and sub-bucket.
4. The runs of repeated strings go back to their texts by an equi join.

Texts are handled once for each distinct text (by a 128-bit digest): a text that occurs twice and is long enough repeats as a
whole. A task passes a text on once, before any shuffle, so copies of a hot text do not travel. Null and shorter texts lose nothing (null: no bytes). Repeated rows are texts of their own that repeat each other. An empty
table gives an empty result. Very long texts are handled whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspan.llm.common import documents, stored, whole
from lumaspan.llm.hashing import mix, pieces, prefix_sums, text_bytes
from lumaspan.llm.hashing import _powers as powers

LENGTH = 400
GRAM = 32
COVER = 64
SUB = 1024
BLOCK_BYTES = 2 << 20


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each window of w values."""
    n = len(x)
    y = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(text: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Of texts side by side, a row per anchor: the text, the anchor's place in it, the first and the last string that it is the anchor of, its hash."""
    n, w = len(text), length - gram + 1
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    s, (_, q) = prefix_sums(text), powers(n + 1)
    with np.errstate(over="ignore"):
        full = mix((s[gram:] - s[: n - gram + 1]) * q[: n - gram + 1])
    key = (full & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(full), dtype=np.uint64)
    least = (sliding_min(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the first of the least hashes of each string
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes from here to the text's end
    start = np.flatnonzero(room[: len(least)] >= length)
    at = least[start]
    if not len(at):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    first, last, at = start[new], start[np.append(new[1:], len(start)) - 1], at[new]
    k = np.searchsorted(offsets, at, "right") - 1
    return [k, at - offsets[k], first - offsets[k], last - offsets[k], full[at]]


def cover(v: int) -> np.ndarray:
    """A difference cover modulo v: every difference occurs between two members."""
    r = int(np.ceil(np.sqrt(v)))
    return np.unique(np.concatenate((np.arange(r), np.arange(r, v, r))))


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows of keys, the first key counting most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_starts(texts: list[bytes], groups: np.ndarray, zero: np.ndarray, counts: np.ndarray, length: int, v: int):
    """Pieces of text with their bucket, the place of the bucket's anchor and the number of suffixes (from place 0 on).

    Returns, over all suffixes in order: the piece, the place, whether its string repeats here, and the number of its distinct string."""
    data = np.frombuffer(b"".join(texts) + bytes(length + 2 * v), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    words = np.zeros(len(data) - 8, np.uint64)
    for b in range(8):
        words = (words << np.uint64(8)) | data[b : len(data) - 8 + b]
    n = int(size.sum())
    piece = np.repeat(np.arange(len(texts)), size)
    rel = np.arange(n) - base[piece]
    residue = (rel - zero[piece]) % v
    in_cover = np.zeros(v, bool)
    in_cover[cover(v)] = True
    sample = np.flatnonzero(in_cover[residue])
    slot = np.full(n + 2 * length + 2 * v, -1, np.int64)
    slot[sample] = np.arange(len(sample))
    end = (base + size)[piece]
    rank = dense([words[sample + 8 * k] for k in range(v // 8)])
    h = v
    while h < length:
        after = np.where(sample + h < end[sample], slot[np.minimum(sample + h, len(slot) - 1)], -1)
        rank = dense([rank, np.where(after >= 0, rank[after], -1)])
        h *= 2
    to_next = np.array([next(d for d in range(v) if in_cover[(r + d) % v]) for r in range(v)])
    which = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    start = base[which] + place
    aligned = groups[which] * (2 * length) + zero[which] - place  # equal strings have the same anchor at the same distance
    follower = start + to_next[residue[start]]
    tie = rank[slot[follower]]
    order = np.lexsort([tie, *(words[start + 8 * k] for k in reversed(range(-(-max(to_next) // 8) or 1))), aligned])
    at, key = start[order], aligned[order]
    same = np.zeros(len(order), bool)
    maybe = np.flatnonzero((key[1:] == key[:-1]) & (words[at[1:]] == words[at[:-1]]) & (words[at[1:] + length - 8] == words[at[:-1] + length - 8])) + 1
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    for i in range(0, len(maybe), 1 << 14):
        m = maybe[i : i + (1 << 14)]
        same[m] = (strings[at[m]] == strings[at[m - 1]]).all(axis=1)
    repeats, number = np.zeros(len(order), bool), np.empty(len(order), np.int64)
    again = same.copy()
    again[:-1] |= same[1:]
    repeats[order] = again
    number[order] = np.cumsum(~same)
    return which, place, repeats, number, start, data


def runs(piece: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of neighbouring places: piece, first, last."""
    if not len(piece):
        return piece, place, place
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)
    a = np.flatnonzero(new)
    return piece[a], place[a], place[np.append(a[1:], len(piece)) - 1]


def anchor_table(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """texts: _t, _text. A row per anchor of each distinct text (of a task): _t, _p, _lo, _hi, _h."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            data, at = text_bytes(batch.column("_text"))
            ids = batch.column("_t")
            for i, j in pieces(at):
                k, *found = anchors(data[at[i] : at[j]], at[i : j + 1] - at[i], length, gram)
                fresh = np.array([t not in seen and not seen.add(t) for t in ids.slice(i, j - i).to_pylist()], bool)[k]
                p, lo, hi, h = (x[fresh] for x in found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + k[fresh])), *(pa.array(x) for x in (p, lo, hi, h.view(np.int64)))], ["_t", "_p", "_lo", "_hi", "_h"])

    return texts.mapInArrow(run, "_t binary, _p long, _lo long, _hi long, _h long")


def once(texts: DataFrame) -> DataFrame:
    """texts: _t, _text. Of each task's rows, the first of each text."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            yield batch.filter(pa.array([t not in seen and not seen.add(t) for t in batch.column("_t").to_pylist()], pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def piece_table(texts: DataFrame, length: int) -> DataFrame:
    """texts: _t, _text, _anchors (array of _p, _lo, _hi, _h, _m). The pieces of text of each bucket.

    Equal pieces of one text (as in a text of one repeated word) repeat as a whole: one of them stays, and the others are
    rows without a piece, known to repeat."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            data, at = text_bytes(batch.column("_text"))
            for k, (t, found) in enumerate(zip(batch.column("_t").to_pylist(), batch.column("_anchors").to_pylist(), strict=True)):
                if t in seen:
                    continue
                seen.add(t)
                own, alike = data[at[k] : at[k + 1]].tobytes(), {}
                for x in found:
                    piece = own[x["_lo"] : x["_hi"] + length]
                    row = (x["_h"], t, x["_lo"], x["_hi"], x["_p"], x["_m"])
                    if (same := alike.setdefault((x["_p"] - x["_lo"], piece), row)) is row:
                        rows.append((*row, piece))
                    else:
                        rows.append((*row, None))
                        if same:
                            rows.append((*same, None))
                            alike[x["_p"] - x["_lo"], piece] = ()
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["_h", "_t", "_lo", "_hi", "_p", "_m", "_piece"])

    return texts.mapInArrow(run, "_h long, _t binary, _lo long, _hi long, _p long, _m long, _piece binary")


def sorted_blocks(pieces_: DataFrame, length: int, v: int, sub: int) -> DataFrame:
    """Sorts the buckets block by block. Rows: _t, _a, _b, a run of repeated bytes; or _t, _a and _d, the digest of an open string."""

    def block(rows: list[tuple]):
        known = [r for r in rows if r[7] is None]
        rows = [r for r in rows if r[7] is not None]
        out = [(names([r[2] for r in known]), np.array([r[3] for r in known], np.int64), np.array([r[4] + length for r in known], np.int64), names([None] * len(known)))]
        if rows:
            out += suffixes(rows)
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], pa.binary())], ["_t", "_a", "_b", "_d"])

    def names(found: list) -> np.ndarray:
        out = np.empty(len(found), object)
        out[:] = found
        return out

    def suffixes(rows: list[tuple]):
        numbers, groups = {}, []
        for h, s, *_ in rows:
            groups.append(numbers.setdefault((h, s), len(numbers)))
        zero = np.array([p - lo for _, _, _, lo, _, p, _, _ in rows], np.int64)
        counts = np.array([hi - lo + 1 for _, _, _, lo, hi, _, _, _ in rows], np.int64)
        ts, los = names([r[2] for r in rows]), np.array([r[3] for r in rows], np.int64)
        which, place, repeats, number, start, data = repeated_starts([r[7] for r in rows], np.array(groups, np.int64), zero, counts, length, v)
        k, a, b = runs(which[repeats], place[repeats])
        out = [(ts[k], los[k] + a, los[k] + b + length, names([None] * len(k)))]
        split = np.array([r[6] > sub for r in rows], bool)
        if split.any():
            open_ = np.flatnonzero(split[which])
            _, first = np.unique(number[open_], return_index=True)
            open_ = open_[first]
            own = data.tobytes()
            d = names([hashlib.blake2b(own[x : x + length], digest_size=16).digest() for x in start[open_].tolist()])
            at = los[which[open_]] + place[open_]
            out.append((ts[which[open_]], at, np.where(repeats[open_], -1, at + length), d))
        return out

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("_h", "_s", "_t", "_lo", "_hi", "_p", "_m", "_piece"))
            for row in zip(*cols, strict=True):
                if row[:2] != last and size >= BLOCK_BYTES:
                    yield block(held)
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[7] or b"")
        if held:
            yield block(held)

    salted = pieces_.withColumn("_s", F.when(F.col("_m") > sub, F.pmod(F.xxhash64("_t"), F.ceil(F.col("_m") / sub))).otherwise(0))
    dealt = salted.repartition("_h", "_s").sortWithinPartitions("_h", "_s", "_t", "_p")
    return dealt.select("_h", "_s", "_t", "_lo", "_hi", "_p", "_m", "_piece").mapInArrow(run, "_t binary, _a long, _b long, _d binary")


def text_id(text: str) -> Column:
    return F.unhex(F.md5(F.encode(text, "utf-8")))


def repeated_runs(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, v: int = COVER, sub: int = SUB) -> DataFrame:
    """_t (digest of a text), _runs (bytes [_a, _b) that go, merged in ``remove``) of the texts that hold repeated strings."""
    texts = docs.where(F.octet_length(text) >= length).select(text_id(text).alias("_t"), F.col(text).alias("_text"))
    found = stored(anchor_table(texts, length, gram))
    me = F.struct("_t", "_p")
    again = found.groupBy("_h").agg(F.min(me).alias("_x"), F.max(me).alias("_y"), F.count("*").alias("_m")).where("_x != _y").select("_h", "_m")
    again = stored(again)  # so that the join is dealt by itself and hot anchors can be split
    held = stored(found.join(again, "_h").groupBy("_t").agg(F.collect_set(F.struct("_p", "_lo", "_hi", "_h", "_m")).alias("_anchors")))
    out = stored(sorted_blocks(piece_table(once(texts).join(held, "_t").select("_t", "_text", "_anchors"), length), length, v, sub))
    across = out.where("_d is not null")
    many = across.groupBy("_d").agg(F.count("*").alias("_k")).where("_k > 1").select("_d")
    across = across.where("_b >= 0").join(many, "_d").select("_t", "_a", "_b")
    return out.where("_d is null").select("_t", "_a", "_b").unionAll(across).groupBy("_t").agg(F.collect_set(F.struct("_a", "_b")).alias("_runs"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, v: int = COVER, sub: int = SUB) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), spans (removed [start, end))."""
    docs = docs.select(key, text)
    several = docs.where(F.octet_length(text) >= length).groupBy(text_id(text).alias("_t")).agg(F.count("*").alias("_c")).where("_c > 1")
    found = repeated_runs(docs, text, length, gram, v, sub)
    gone = stored(found.join(several.select("_t", F.lit(True).alias("_all")), "_t", "full_outer"))
    rows = docs.select(F.col(key), whole(F.col(text)).alias("_text"), text_id(text).alias("_t")).join(gone, "_t", "left")

    def run(batches):
        for batch in batches:
            data, at = text_bytes(batch.column("_text"))
            out = []
            for k, (spans, every) in enumerate(zip(batch.column("_runs").to_pylist(), batch.column("_all").to_pylist(), strict=True)):
                own = data[at[k] : at[k + 1]]
                if every:
                    cut = [(0, len(own))]
                else:
                    cut = merged([(x["_a"], x["_b"]) for x in spans or []])
                kept = own.tobytes()
                if cut:
                    edges = [0, *(x for c in cut for x in c), len(own)]
                    kept = b"".join(kept[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(own), len(own) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in cut]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.select(key, "_text", "_runs", "_all").mapInArrow(
        run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the counts and the digest, text: what is left of the document (a character cut in two shows as U+FFFD)."""
    return remove(documents(spark, sf_dir)).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
