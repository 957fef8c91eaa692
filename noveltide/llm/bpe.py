"""Byte-level BPE encoding and decoding: a segment tree over byte positions picks the leftmost lowest pair rank.

Each leaf holds rank * length + position of the pair that starts there, so the root is the leftmost minimum. A merge
updates the pairs of the merged token and of its two live neighbours, each in logarithmic time: a piece of n bytes
costs O(n log n), also for very long pieces without white space. Short pieces that are new to a worker are merged
together, one row of a tree matrix each; a long piece has a tree of its own.

Defined cases: null text is empty and gives no ids. Rows are independent: null or repeated doc_ids pass through. An
empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, map_arrow

#: A stretch of white space with the text after it. No match of the splitting pattern runs from other text into white
#: space, so such chunks can be encoded one by one. \x1c-\x1f are white space for `re` but not for the pattern.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Where a chunk ends before white space: long texts are worked on in spans that end so.
BORDER = re.compile(r"[\S\x1c-\x1f](?=[^\S\x1c-\x1f])")
SPAN = 2_000_000
SHORT = 64
NONE = sys.maxsize


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: repeatedly joins the leftmost pair of lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            value = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == value:
                return
            tree[i] = value

    def pair(i: int, end: int) -> None:
        r = rank(piece[i:end])
        put(i, NONE if r is None else r * n + i)

    while tree[1] != NONE:
        i = tree[1] % n
        j = after[i]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            pair(i, after[k])
        else:
            put(i, NONE)
        put(j, NONE)
        if before[i] >= 0:
            pair(before[i], k)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pairs:
    """Rank of the token that two tokens join to, by both ids."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    found[a << 32 | b] = r
        #: Small vocabularies get 32-bit keys, which stay in the processor's cache.
        self.shift, kind = (16, np.uint32) if max(ranks.values(), default=0) < 1 << 16 else (32, np.uint64)
        order = sorted(found)
        self.ranks = np.array([found[k] for k in order], dtype=np.int32)
        self.keys = np.array([(k >> 32) << self.shift | k & 0xFFFFFFFF for k in order], dtype=kind)
        self.bytes = np.array([ranks.get(bytes([i]), 0) for i in range(256)], dtype=kind)
        self.none = np.int32(np.iinfo(np.int32).max)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << self.keys.dtype.type(self.shift)) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], self.none)


def merge_pieces(pieces: list[bytes], pairs: Pairs, size: int) -> list[bytes]:
    """Packed ids of many pieces of at most `size` bytes (a power of two): one tree a row, one merge a row and step."""
    n = np.array([len(p) for p in pieces], dtype=np.int64)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, size)
    token = pairs.bytes[raw]
    at = np.arange(size, dtype=np.int32)
    tree = np.full((len(pieces), 2 * size), pairs.none, dtype=np.int32)
    r = pairs.of(token[:, :-1], token[:, 1:])
    live = (at[:-1] + 1 < n[:, None]) & (r != pairs.none)
    tree[:, size : 2 * size - 1] = np.where(live, r * size + at[:-1], pairs.none)
    half = size
    while half > 1:
        level = tree[:, half : 2 * half]
        half //= 2
        tree[:, half : 2 * half] = np.minimum(level[:, ::2], level[:, 1::2])
    after = np.broadcast_to(at + 1, (len(pieces), size)).copy()
    before = np.broadcast_to(at - 1, (len(pieces), size)).copy()
    alive = at < n[:, None]
    rows = np.arange(len(pieces))

    def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        flat, base, i = tree.reshape(-1), rows * (2 * size), i + size
        flat[base + i] = value
        while i[0] > 1:  # all leaves have the same depth
            value = np.minimum(value, flat[base + (i ^ 1)])
            i = i >> 1
            flat[base + i] = value

    def joined(rows: np.ndarray, i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> np.ndarray:
        j = np.minimum(j, size - 1)
        r = pairs.of(token[rows, i], token[rows, j])
        return np.where(ok & (r != pairs.none), r * size + i, pairs.none)

    while True:
        best = tree[rows, 1]
        rows = rows[best != pairs.none]
        if not len(rows):
            break
        best = best[best != pairs.none]
        i = best % size
        j = after[rows, i]
        k = after[rows, j]
        token[rows, i] = best // size
        alive[rows, j] = False
        after[rows, i] = k
        inner = k < n[rows]
        before[rows[inner], k[inner]] = i[inner]
        put(rows, j, np.full(len(rows), pairs.none))
        put(rows, i, joined(rows, i, k, inner))
        p = before[rows, i]
        has = p >= 0
        if has.any():
            put(rows[has], p[has], joined(rows[has], p[has], i[has], np.ones(int(has.sum()), dtype=bool)))
    flat = token[alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(axis=1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder(dict):
    """Packed ids by chunk, remembered for chunks and pieces that come again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 350_000):
        import regex

        self.ranks, self.split, self.limit = ranks, regex.compile(pattern).findall, limit
        self.pairs = Pairs(ranks)

    def _long(self, text: str) -> bytes:
        return array("I", merge_piece(text.encode("utf-8"), self.ranks)).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        """A chunk that isn't kept: too long, or emptied meanwhile."""
        return b"".join(map(self._long, self.split(chunk)))

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks together and keeps them."""
        parts: dict[str, list[str]] = {}
        pieces: set[str] = set()
        for c in chunks:
            if len(c) > SHORT // 4:
                if len(c) > SHORT:
                    continue
                split = self.split(c)
            elif (c[1:] if c[0] == " " else c).isalpha():  # one piece: letters, with or without a space before them
                pieces.add(c)
                continue
            elif c[-1] in ".," and (c[1:-1] if c[0] == " " else c[:-1]).isalpha():
                split = [c[:-1], c[-1]]
            else:
                split = self.split(c)
            parts[c] = split
            pieces.update(split)
        got = self.merged(pieces)
        for c in chunks & pieces:
            self[c] = got[c]
        for c, split in parts.items():
            self[c] = b"".join([got[x] for x in split])

    def merged(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of pieces, those of about one length together."""
        got, new = {}, {8: [], 16: [], 32: [], SHORT: []}
        keep = self.get
        for p in pieces:
            old = keep(p)
            if old is not None:
                got[p] = old
                continue
            raw = p.encode("utf-8")
            n = len(raw)
            if n <= SHORT:
                new[8 if n <= 8 else 16 if n <= 16 else 32 if n <= 32 else SHORT].append((p, raw))
            else:
                got[p] = self._long(p)
        for size, some in new.items():
            for i in range(0, len(some), 8192):
                names, raws = zip(*some[i : i + 8192], strict=True)
                got.update(zip(names, merge_pieces(raws, self.pairs, size), strict=True))
        return got

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as little-endian unsigned 32-bit integers."""
        out, i = [], 0
        while i < len(texts):
            if len(texts[i]) > SPAN:
                out.append(b"".join(self._some(list(spans(texts[i])))))
                i += 1
                continue
            k, size = i, 0
            while k < len(texts) and size + len(texts[k]) <= SPAN:
                size += len(texts[k])
                k += 1
            out += self._some(texts[i:k])
            i = k
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        out = []
        if sum(map(len, texts)) > 2 * SPAN:
            for t in texts:
                out += self._some([t]) if len(t) <= 2 * SPAN else [b"".join(map(self.__getitem__, CHUNK.findall(t)))]
            return out
        chunks = [CHUNK.findall(t) for t in texts]
        here = set().union(*chunks)
        missing = here - self.keys()
        if len(self) + len(missing) > self.limit:
            self.clear()
            missing = here
        if missing:
            self.learn(missing)
        return [b"".join(map(self.__getitem__, c)) for c in chunks]


def spans(text: str):
    """A long text in spans of about SPAN characters that end where a chunk ends."""
    at = 0
    while at < len(text):
        m = BORDER.search(text, at + SPAN) if at + SPAN < len(text) else None
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


_encoders: dict[tuple[str, str], Encoder] = {}
_tokens: dict[str, list[bytes]] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def tokens(path: str) -> list[bytes]:
    if path not in _tokens:
        ranks = read_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        _tokens[path] = table
    return _tokens[path]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are packed little-endian unsigned 32-bit integers."""

    def run(part):
        ids = encoder(ranks_path, pattern).encode_all(as_text(part["text"]))
        return part["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with `decoded` (binary) added: the bytes that the ids stand for. Null ids are none."""

    def run(part):
        table = tokens(ranks_path).__getitem__
        out = [b"".join(map(table, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in part["ids"].to_pylist()]
        return part["doc_id"], part["n_tokens"], part["ids"], pa.array(out, pa.binary())

    return map_arrow(encoded.select("doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens long, ids binary, decoded binary")
