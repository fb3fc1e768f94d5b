"""Operator 7, benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact verification.

Words are runs of letters and digits (characters beyond ASCII are letters), lower-cased. A text's features are its
shingles of ``shingle`` words with their counts (a shorter text is one shingle). For each length of benchmark items, in
words, the windows of a document with as many words (the whole document if it is shorter) get a 64-bit SimHash of their
weighted shingles. Fingerprints are cut into ``BLOCKS`` blocks: any two within ``radius`` bits differ by at most
``radius`` // ``BLOCKS`` bits in a block, so asking the blocks' tables for every value that near gives, as candidates, every item
of that length within the radius (guaranteed), and of random fingerprints one in twenty. What a window asks for does not grow
with the benchmark. Candidates are verified by the exact weighted Jaccard similarity (sum of smaller by sum of larger counts)
of ``similarity`` or more.

Windows that cannot reach that similarity with any item at all are not fingerprinted: a and b shingles need
similarity / (1 + similarity) * (a + b) in common, and a window has at most as many in common with an item as it has
shingles that occur anywhere in the benchmark. This bound loses none. SimHash itself may: a window of similarity 0.8 is
27 degrees from its item, 10 bits of 64 on average, and is missed if it is more than ``radius`` away. Items of fewer words than a
shingle are found in documents as short.

Items are sent to the executors in blocks of at most ``block_bytes`` of text, one pass over the documents for each block,
so that what a task holds does not grow with the benchmark. Documents are never shuffled.

Null and empty texts (of documents or items) have no words and match nothing. Repeated rows are matched each. Ties
between windows go to the first. Empty tables give an empty result. Other columns are kept by ``clean``.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lumaspan.llm.common import documents
from lumaspan.llm.hashing import Words, ascii_fold, joined, letter_words, pieces, text_bytes
from lumaspan.tables import table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4  # of 64 / BLOCKS bits
PROBES = 1 << 20  # values that are compared at once
BLOCK_BYTES = 8 << 20
STRETCH = 1 << 14  # windows that are fingerprinted at once


def bit_signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes of one text's word hashes."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return joined([words[i : i + 1] for i in range(len(words))])
    return joined([words[i : len(words) - k + 1 + i] for i in range(k)])


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


class Index:
    """Items by their number of words and by the blocks of their fingerprints, and the shingles of all of them."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        data, at = text_bytes(pc.utf8_lower(texts))
        self.ids, self.counts, self.prints, every = [], [], [], []
        width = 64 // BLOCKS
        self.shifts = [np.uint64(width * k) for k in range(BLOCKS)]
        self.mask = np.uint64((1 << width) - 1)
        every_bit = np.arange(1 << width, dtype=np.uint64)
        self.spread = radius // BLOCKS
        self.near = every_bit[np.bitwise_count(every_bit) <= self.spread]
        lengths: dict[int, list[int]] = {}  # number of words -> items
        fold, is_word = ascii_fold(), letter_words()
        for k, (item, _) in enumerate(items):
            w = Words(data, at, k, k + 1, fold, is_word).hash
            s = shingles_of(w, shingle)
            if not len(s):
                continue
            n, f = len(self.ids), int(fingerprints(bit_signs(s).sum(axis=0, keepdims=True))[0])
            self.ids.append(item)
            self.counts.append(Counter(s.tolist()))
            self.prints.append(f)
            every.append(s)
            lengths.setdefault(len(w), []).append(n)
        self.prints = np.array(self.prints, np.uint64)
        #: number of words -> for each block: its values in order, where each one's items begin, and the items
        self.tables = {length: [self.block_table(np.array(own), shift) for shift in self.shifts] for length, own in lengths.items()}
        self.shingles = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.shingles >> np.uint64(44)).astype(np.int64)] = True

    def block_table(self, items: np.ndarray, shift: np.uint64):
        bits = (self.prints[items] >> shift) & self.mask
        order = np.argsort(bits, kind="stable")
        values, first = np.unique(bits[order], return_index=True)
        return values, np.append(first, len(items)), items[order]

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Where the benchmark has the shingle."""
        at = np.flatnonzero(self.table[(shingles >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.shingles, shingles[at]), max(0, len(self.shingles) - 1))
        return at[self.shingles[k] == shingles[at]] if len(self.shingles) else at[:0]

    def pairs(self, words: int, prints: np.ndarray, radius: int):
        """(window, item, distance) arrays of the items of so many words within the radius of each fingerprint, by the blocks' tables.

        A block's values near a window's are found by asking for each value that near or, if the table has fewer, by comparing with each."""
        step = max(1, PROBES // len(self.near))
        for base in range(0, len(prints), step):
            own, found = prints[base : base + step], []
            for (values, first, items), shift in zip(self.tables[words], self.shifts, strict=True):
                bits = (own >> shift) & self.mask
                if len(values) <= len(self.near):
                    w, k = np.nonzero(np.bitwise_count(bits[:, None] ^ values) <= self.spread)
                else:
                    asked = bits[:, None] ^ self.near
                    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
                    w, n = np.nonzero(values[at] == asked)
                    k = at[w, n]
                size = first[k + 1] - first[k]
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                found.append(np.repeat(w, size) * len(self.prints) + items[np.repeat(first[k], size) + within])
            w, n = np.divmod(np.unique(np.concatenate(found)), len(self.prints))
            bits = np.bitwise_count(self.prints[n] ^ own[w])
            good = bits <= radius
            yield w[good] + base, n[good], bits[good]


def window_prints(shingles: np.ndarray, starts: np.ndarray, width: int):
    """(starts, fingerprints) of the windows of ``width`` shingles from each start on, a stretch of neighbouring windows at a time."""
    cut = np.flatnonzero((np.diff(starts) > width) | (np.diff(starts // STRETCH) > 0)) + 1
    for own in np.split(starts, cut):
        base, stop = own[0], own[-1] + width
        sums = np.zeros((stop - base + 1, 64), np.int32)
        np.cumsum(bit_signs(shingles[base:stop]), axis=0, out=sums[1:])
        yield own, fingerprints(sums[own - base + width] - sums[own - base])


def search(words: np.ndarray, index: Index, hits: np.ndarray, shingles: np.ndarray, k: int, similarity: float, radius: int):
    """Matches (item, window start, similarity, bits) of one document. hits: places of shingles that the benchmark has."""
    best: dict[int, tuple] = {}
    upto = np.zeros(len(shingles) + 1, np.int64)
    upto[hits + 1] = 1
    upto = np.cumsum(upto)
    for length in index.tables:
        if length < k <= len(words):
            continue
        width = max(1, min(length, len(words)) - k + 1)  # shingles of a window
        need = math.ceil(similarity / (1 + similarity) * (width + max(1, length - k + 1)) - 1e-9)
        if upto[-1] < need:
            continue
        starts = np.flatnonzero(upto[width:] - upto[:-width] >= need)
        for own, prints in window_prints(shingles, starts, width) if len(starts) else ():
            for at, items, bits in index.pairs(length, prints, radius):
                last = None
                for s, n, apart in zip(own[at].tolist(), items.tolist(), bits.tolist(), strict=True):
                    if s != last:
                        last, window = s, Counter(shingles[s : s + width].tolist())
                    sim = weighted_jaccard(index.counts[n], window)
                    if sim >= similarity and (n not in best or sim > best[n][2]):
                        best[n] = (index.ids[n], s, sim, apart)
    return sorted(best.values())


def _matches(batch, text: str, index: Index, k: int, similarity: float, radius: int):
    """(row, matches) of the rows of a batch that have any."""
    data, at = text_bytes(pc.utf8_lower(batch.column(text)))
    fold, is_word = ascii_fold(), letter_words()
    for i, j in pieces(at):
        w = Words(data, at, i, j, fold, is_word)
        sh, inside = w.shingles(k)
        rows = set()
        if len(sh):
            hit = index.hits(sh)
            hit = hit[inside[hit]]
            rows = set((np.searchsorted(w.first, hit, "right") - 1).tolist())
        rows |= set(np.flatnonzero((np.diff(w.first) < k) & (np.diff(w.first) > 0)).tolist())
        for r in sorted(rows):
            own = w.hash[w.first[r] : w.first[r + 1]]
            s = shingles_of(own, k)
            h = index.hits(s)
            if len(h) and (found := search(own, index, h, s, k, similarity, radius)):
                yield i + r, found


def item_blocks(items: DataFrame, key: str, text: str, block_bytes: int):
    """The items in lists of at most so many bytes (or one item)."""
    block, size = [], 0
    for item, t in items.select(key, text).toLocalIterator():
        n = len((t or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, t))
        size += n
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
          shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document and item found in it: key, item_id, similarity, window_start (in words), hamming."""
    out = None
    for block in [*item_blocks(items, item_key, item_text, block_bytes)] or [[]]:

        def run(batches, block=block):
            index = Index(block, shingle, radius)
            for batch in batches:
                rows, hits = [], []
                for r, found in _matches(batch, text, index, shingle, similarity, radius):
                    rows += [r] * len(found)
                    hits += found
                keys = batch.column(key).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([h[0] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64()),
                     pa.array([h[1] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int32())],
                    [key, "item_id", "similarity", "window_start", "hamming"])

        kind = docs.schema[key].dataType.simpleString()
        part = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, item_id long, similarity double, window_start long, hamming int")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no item is found, columns as they are."""
    for block in item_blocks(items, item_key, item_text, block_bytes):

        def run(batches, block=block):
            index = Index(block, shingle, radius)
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[r for r, _ in _matches(batch, text, index, shingle, similarity, radius)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
