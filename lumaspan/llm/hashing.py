"""Words and hashes of whole Arrow batches of texts, by NumPy on the batches' own bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_state: dict = {}
#: Text is worked on in pieces of about so many bytes, each of whole texts.
PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64, for i under n."""
    if len(_state.get("p", ())) < n:
        n = max(n, PIECE + (1 << 17))
        inverse = pow(_ODD, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, b in (("p", _ODD), ("q", inverse)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                _state[name] = np.multiply.accumulate(x)
    return _state["p"], _state["q"]


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    if "v" not in _state:
        _state["v"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return _state["v"]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and where each text starts in them; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE bytes together (one text at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of texts i to j: word hashes, byte spans relative to the piece, and first[k], the first word of text i + k."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, fold: np.ndarray, is_word: np.ndarray):
        own = data[offsets[i] : offsets[j]]
        text = np.empty(len(own) + (j - i), np.uint8)  # with a gap after each text
        starts = (offsets[i : j + 1] - offsets[i]) + np.arange(j - i + 1)
        for k in range(j - i):
            a, b = offsets[i + k] - offsets[i], offsets[i + k + 1] - offsets[i]
            text[starts[k] : starts[k] + (b - a)] = own[a:b]
        text[starts[1:] - 1] = 32
        text = fold[text]
        inside = is_word[text]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, starts)
        self.starts = starts
        self.hash = span_hash(text, self.start, self.end)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are in one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = joined([self.hash[d : n - k + 1 + d] for d in range(k)])
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)  # words from here to the text's end
        return h, left[: n - k + 1] >= k


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of a sequence of hashes."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + p)
    return h


def prefix_sums(text: np.ndarray) -> np.ndarray:
    p, _ = _powers(len(text) + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(byte_values()[text] * p[: len(text)], out=out[1:])
    return out


def span_hash(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of text[start:end] for each span."""
    s, (_, q) = prefix_sums(text), _powers(len(text) + 1)
    with np.errstate(over="ignore"):
        return mix((s[end] - s[start]) * q[start] + (end - start).astype(np.uint64))


def ascii_fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def gap_words() -> np.ndarray:
    """Bytes of words when words are what is not a space or a control of 9 to 13."""
    t = np.ones(256, bool)
    t[32] = False
    t[9:14] = False
    return t


def letter_words() -> np.ndarray:
    """Bytes of words of letters and digits; every byte of a character beyond ASCII counts as a letter."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


def folded(others: str) -> bytes:
    """A translation of bytes that lower-cases A-Z and makes each ASCII byte outside a-z and ``others`` a space."""
    t = bytearray(range(256))
    t[:128] = b" " * 128
    for c in "abcdefghijklmnopqrstuvwxyz" + others:
        t[ord(c)] = ord(c)
    for c in range(65, 91):
        t[c] = c + 32
    return bytes(t)


def word_lists(text: bytes, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``piece`` bytes of text each, so that a long text needs no more memory than others."""
    at = 0
    while at < len(text):
        some = text[at : at + piece].translate(table)
        if at + piece < len(text) and some[-1] != 32:  # up to the end of the word that is cut
            end = at + piece
            while end < len(text) and b" " not in (more := text[end : end + 4096].translate(table)):
                some, end = some + more, end + 4096
            if end < len(text):
                some += more[: more.index(b" ")]
        at += len(some)
        yield some.split()
