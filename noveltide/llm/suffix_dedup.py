"""Suffix-array dedup: bytes of strings of `length` bytes that also start in a document with a smaller doc_id go.

1. Documents are packed into chunks (one row each, about CHUNK bytes) and dealt once by chunk id; later joins find the
   chunks where they are.
2. Every window of `length` bytes has an anchor: its GRAM-byte substring with the smallest hash. Equal windows have
   equal anchors. The distinct anchors of a chunk go to buckets as packed hashes; the buckets answer with one bit an
   anchor: held by another document, or not. Only those go on.
3. The stretches of text whose windows share such an anchor (at most 2 * length - GRAM bytes) go to buckets by anchor,
   each different stretch of a chunk once, with its smallest doc_id. Stretches with one hash are one string there. Each
   that several documents hold, or that shares its anchor with another, goes into a suffix array once; rows of its
   later documents stand beside its own when the array is read. On its Burrows-Wheeler transform,
   breadth-first backward extension of intervals finds the common prefixes by increasing value and stops at `length`:
   what is still in one interval then shares `length` bytes. Windows that start in a smaller document are flagged, one
   bit a window.
4. The flags return to their chunks, where the covered bytes are dropped.

What moves is bounded per chunk and bucket, hot passages are folded in their chunk first, and no text but the
stretches of step 3 moves more than once.

Defined cases: null or empty text has no bytes. A null doc_id takes no part and its text stays. Rows with equal
doc_id are not smaller than each other. Hashes of anchors (40 bits in step 2) only choose what is looked at; stretches
are told apart by 64-bit hashes. An empty table gives an empty table. Extra columns are not read.
A text is never cut: one longer than CHUNK is a chunk of its own, and its task needs some tens of bytes for each of its bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_bytes, let_go, mix, owned, saved, shared_folder

CHUNK = 2_000_000
GRAM = 30
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0xD6E8FEB86659FD93)


_BACK = U64(pow(int(_BASE), -1, 1 << 64))
_POWERS = np.cumprod(np.concatenate([[U64(1)], np.full(63, _BASE)]))
BLOCK = 30_000  # windows at a time: their arrays stay in the processor's cache, and places fit 16 bits


def rolling(text: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all substrings of `width` bytes of a byte array, by doubling."""
    part, out, have, at = _BYTE[text], None, 0, 1
    while at <= width:
        if width & at:
            # out covers `have` bytes from each place; the next `at` bytes are appended
            n = len(text) - have - at + 1
            out = part.copy() if out is None else out[:n] * _POWERS[at] + part[have : have + n]
            have += at
        if at * 2 <= width:
            part = part[:-at] * _POWERS[at] + part[at:]
        at *= 2
    return mix(out[: len(text) - width + 1])


def span_keys(text: np.ndarray, first: np.ndarray, end: np.ndarray, most: int = 100_000) -> np.ndarray:
    """64-bit hashes of the substrings text[first:end], where `first` rises; about `most` bytes of text at a time.

    A hash is a sum over the substring's own places, so it does not depend on where the part begins.
    """
    out = np.empty(len(first), dtype=U64)
    if not len(first):
        return out
    n = min(len(text), most + int((end - first).max()))
    power = np.cumprod(np.concatenate([[U64(1)], np.full(n, _BASE)]))
    back = np.cumprod(np.concatenate([[U64(1)], np.full(n, _BACK)]))
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(first, first[at] + most)))
        a, b = first[at:to] - first[at], end[at:to] - first[at]
        part = _BYTE[text[first[at] : first[at] + b.max()]]
        total = np.concatenate([[U64(0)], np.cumsum(part * power[: len(part)])])
        out[at:to] = mix((total[b] - total[a]) * back[a] ^ mix((b - a).astype(U64)))
        at = to
    return out


def anchors(text: np.ndarray, length: int):
    """For each window of `length` bytes the place and the hash of its GRAM-byte substring of smallest hash, by BLOCK: (from, places, hashes)."""
    n = len(text) - length + 1
    width = length - GRAM + 1
    for start in range(0, n, BLOCK):
        m = min(BLOCK, n - start)
        hashes = rolling(text[start : start + m + length - 1], GRAM)
        # the low bits hold the place, so the first of equals is the smallest
        part = (hashes & ~U64(0xFFFF)) | np.arange(len(hashes), dtype=U64)
        out, have, at = None, 0, 1
        while at <= width:
            if width & at:
                k = len(hashes) - have - at + 1
                out = part if out is None else np.minimum(out[:k], part[have : have + k])
                have += at
            if at * 2 <= width:
                part = np.minimum(part[:-at], part[at:])
            at *= 2
        best = (out[:m] & U64(0xFFFF)).astype(np.int64)
        yield start, best + start, hashes[best]


class Chunk:
    """The documents of a chunk and the stretches of their windows with one anchor."""

    def __init__(self, ids: bytes, keys: bytes, known: bytes, sizes: bytes, text: bytes, length: int):
        self.ids, self.keys = np.frombuffer(ids, dtype="<i8"), np.frombuffer(keys, dtype="<i8")
        self.known = np.frombuffer(known, dtype=np.uint8).astype(bool)
        self.sizes = np.frombuffer(sizes, dtype="<i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.frombuffer(zstandard.decompress(text), dtype=np.uint8)
        self.length = length
        self._cut()

    def _cut(self) -> None:
        """first, count: the windows of each stretch; gram: its anchor's hash; doc: its document."""
        length, text = self.length, self.text
        none = np.zeros(0, dtype=np.int64)
        self.first, self.count, self.gram, self.doc = none, none, np.zeros(0, dtype=U64), none
        if len(text) < length:
            return
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        heads, last = [], (-1, False, -1)
        for start, best, gram in anchors(text, length):  # only the heads of a block's stretches are kept of it
            own = owner[start : start + len(best)]
            inside = (own == owner[start + length - 1 : start + length - 1 + len(best)]) & self.known[own]
            new = np.zeros(len(best), dtype=bool)
            for x, before in zip((best, inside, own), last, strict=True):
                new[0] |= x[0] != before
                new[1:] |= x[1:] != x[:-1]
            last = best[-1], inside[-1], own[-1]
            head = np.flatnonzero(new)
            heads.append((head + start, inside[head], gram[head], own[head]))
        head, keep, gram, doc = (np.concatenate(x) for x in zip(*heads, strict=True))
        count = np.diff(np.append(head, len(text) - length + 1))
        self.first, self.count, self.gram, self.doc = head[keep], count[keep], gram[keep], doc[keep]

    def stretch(self, i: int) -> tuple[int, int]:
        """From and to of the bytes of a stretch."""
        return int(self.first[i]), int(self.first[i] + self.count[i] + self.length - 1)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in rising order, the place of each stretch's among them, and whether two documents hold it."""
        unique, inverse = np.unique(self.gram, return_inverse=True)
        ids = self.ids[self.doc]
        low = np.full(len(unique), np.iinfo(np.int64).max)
        high = np.full(len(unique), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        return unique, inverse, low != high

    def picked(self, unique: np.ndarray, inverse: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different stretches with a flagged anchor: one place each, of the smallest doc_id, the stretch -> string map, and
        whether another document of the chunk has the string."""
        some = np.flatnonzero(flags[inverse]) if len(inverse) else np.zeros(0, dtype=np.int64)
        if not len(some):
            return some, some, some, some.astype(bool)
        first = self.first[some]
        key = span_keys(self.text, first, first + self.count[some] + self.length - 1)
        order = np.lexsort((self.ids[self.doc[some]], key))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        string = np.empty(len(some), dtype=np.int64)
        string[order] = np.cumsum(fresh) - 1
        ids = self.ids[self.doc[some]]
        several = np.zeros(int(fresh.sum()), dtype=bool)
        several[string[ids > ids[order[fresh]][string]]] = True
        return some, order[fresh], string, several


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> U64(40)) % U64(buckets)).astype(np.int64)


def pack_chunks(docs: DataFrame) -> DataFrame:
    """(chunk_id, ids, keys, known, sizes, texts): rows of about CHUNK bytes, in the order of the input's partitions."""

    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        ids, keys, texts, size = [], [], [], 0

        def flush():
            nonlocal n
            known = np.array([i is not None for i in ids], dtype=np.uint8)
            row = (
                (task << 32) + n,
                np.array([i or 0 for i in ids], dtype="<i8").tobytes(),
                np.array(keys, dtype="<i8").tobytes(),
                known.tobytes(),
                np.array([len(t) for t in texts], dtype="<i8").tobytes(),
                zstandard.compress(b"".join(texts), 1),
            )
            n += 1
            kinds = (pa.int64(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["chunk_id", "ids", "keys", "known", "sizes", "texts"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for i, k, t in zip(part["doc_id"].to_pylist(), part["text_key"].to_pylist(), as_bytes(part["text"]), strict=True):
                    ids.append(i)
                    keys.append(k)
                    texts.append(t)
                    size += len(t) + 8
                    if size >= CHUNK:
                        yield flush()
                        ids, keys, texts, size = [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "chunk_id long, ids binary, keys binary, known binary, sizes binary, texts binary")


def _chunks(part: pa.RecordBatch, length: int):
    let_go()
    for i in range(part.num_rows):
        row = {c: part[c][i].as_py() for c in ("chunk_id", "ids", "keys", "known", "sizes", "texts")}
        yield i, row["chunk_id"], Chunk(row["ids"], row["keys"], row["known"], row["sizes"], row["texts"], length)
        let_go()


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def _emit_anchors(length: int, buckets: int):
    def run(batches):
        for batch in batches:
            for _, chunk_id, chunk in _chunks(batch, length):
                unique, _, several = chunk.grams()
                if not len(unique):
                    continue
                bucket = bucket_of(unique, buckets)
                order = np.argsort(bucket, kind="stable")
                ends = np.cumsum(np.bincount(bucket, minlength=buckets))
                ids, blobs = [], []
                for b in np.flatnonzero(np.diff(np.append(0, ends))):
                    own = order[ends[b - 1] if b else 0 : ends[b]]
                    ids.append(int(b))
                    # 39 bits of the hash and one that says that two documents of the chunk hold it
                    five = (unique[own] << U64(1) & U64((1 << 40) - 1)) | several[own].astype(U64)
                    blobs.append(five.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                yield _rows({"bucket": (ids, pa.int32()), "chunk_id": ([chunk_id] * len(ids), pa.int64()), "found": (blobs, pa.binary())})

    return run


def _fives(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _answer_anchors(table: pa.Table) -> pa.Table:
    """One bucket: which anchors of each chunk are held by two documents or more."""
    blobs = [_fives(x) for x in table["found"].to_pylist()]
    flat = np.concatenate(blobs)
    anchor = flat >> U64(1)
    unique, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    many = counts > 1
    many[inverse[(flat & U64(1)).astype(bool)]] = True
    flags = many[inverse]
    ends = np.cumsum([len(b) for b in blobs])
    bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.table({"chunk_id": table["chunk_id"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


def _flags(chunk: Chunk, answers: list[tuple[int, bytes]], buckets: int):
    """The chunk's anchors again, with the buckets' answers put back in their order."""
    unique, inverse, _ = chunk.grams()
    flags = np.zeros(len(unique), dtype=bool)
    bucket = bucket_of(unique, buckets)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for b, bits in answers:
        own = order[ends[b - 1] if b else 0 : ends[b]]
        flags[own] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[: len(own)].astype(bool)
    return unique, inverse, flags


def _emit_strings(length: int, buckets: int):
    def run(batches):
        for batch in batches:
            for i, chunk_id, chunk in _chunks(batch, length):
                answers = [(x["bucket"], x["bits"]) for x in batch["answers"][i].as_py() or []]
                some, chosen, _, several = chunk.picked(*_flags(chunk, answers, buckets))
                if not len(chosen):
                    continue
                rows = some[chosen]
                gram = chunk.gram[rows]
                bucket = bucket_of(mix(gram), buckets)
                out = {"bucket": [], "chunk_id": [], "place": [], "docs": [], "several": [], "grams": [], "counts": [], "strings": []}
                for b in np.unique(bucket):
                    own = np.flatnonzero(bucket == b)
                    spans = [chunk.stretch(int(r)) for r in rows[own]]
                    text = b"".join(chunk.text[x:y].tobytes() for x, y in spans)
                    out["bucket"].append(int(b))
                    out["chunk_id"].append(chunk_id)
                    out["place"].append(own.astype("<i4").tobytes())
                    out["docs"].append(chunk.ids[chunk.doc[rows[own]]].astype("<i8").tobytes())
                    out["several"].append(several[own].astype(np.uint8).tobytes())
                    out["grams"].append(gram[own].astype("<u8").tobytes())
                    out["counts"].append(chunk.count[rows[own]].astype(np.uint8).tobytes())
                    out["strings"].append(zstandard.compress(text, 1))
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
                yield _rows({c: (v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    return run


MARKED = 32  # places are put in order by marking them where they are more than this share of all, else by a sort
PACKED = 7  # symbols of nine bits in the first key of suffix_order


def packed(symbols: np.ndarray) -> np.ndarray:
    """The first PACKED symbols of each suffix in one number, 0 behind the end."""
    n, key = len(symbols), np.zeros(len(symbols), dtype=np.int64)
    for k in range(PACKED):
        key <<= 9
        key[: max(n - k, 0)] |= symbols[k:] + 1 if k else symbols + 1
    return key


def suffix_order(symbols: np.ndarray, depth: int, key: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of an array of numbers below 512, ordered by at least `depth` symbols; key, if given, is packed(symbols).

    By doubling: the rank of a suffix is the first place of those with equal symbols so far, and only these are sorted on.
    """
    n, key = len(symbols), packed(symbols) if key is None else key
    have, rank = PACKED, np.empty(n, dtype=np.int32)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))
    while have < depth:
        slots = np.flatnonzero(~head | ~np.append(head[1:], True))
        if not len(slots):
            break
        some = order[slots]
        after = np.zeros(len(some), dtype=np.int64)
        inside = some < n - have
        after[inside] = rank[some[inside] + have] + 1
        key = rank[some].astype(np.int64) * (n + 1) + after
        by_key = np.argsort(key)
        order[slots], key = some[by_key], key[by_key]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        head[slots] = first
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        have *= 2
    return order


def transform(symbols: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform (the symbol before each suffix) and, for each row, how many symbols stand before its own.

    That is the count of smaller symbols plus the rank of the row among the rows of its symbol: where a row of the
    interval of x lies in the interval of c x, when c is its symbol.
    """
    before = symbols[order - 1].astype(np.uint16)
    by_symbol = np.argsort(before, kind="stable").astype(np.int32)
    onto = np.empty(len(order), dtype=np.int32)
    onto[by_symbol] = np.arange(len(order), dtype=np.int32)
    return before, onto


def equal_prefixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the number of its interval of suffixes with the same first `length` symbols, none of them 0.

    Breadth-first over the transform: the queue holds the intervals of strings of one length, at first those of PACKED
    symbols, which the first key of the sort gives (of the empty string, where length is less). Each interval is extended backwards by every symbol in it but 0, the separator. Where the right border
    of an extension is not known yet, the suffixes at its sides have exactly `level` symbols in common, and the extension
    enters the queue. So common prefixes come out by rising value, and those still unknown when the strings have
    `length` symbols are `length` or more: there the search stops.
    """
    key = packed(symbols)
    order = suffix_order(symbols, length, key)
    n = len(order)
    before, onto = transform(symbols, order)
    border = np.zeros(n + 1, dtype=bool)
    border[0] = border[n] = True
    low, high, known = np.zeros(1, dtype=np.int32), np.full(1, n, dtype=np.int32), 0
    if length > PACKED:
        key, known = key[order], PACKED
        border[1:n] = key[1:] != key[:-1]
        edges = np.flatnonzero(border).astype(np.int32)
        low, high = edges[:-1], edges[1:]
        # the queue gets strings whose right border has just been found: all symbols but the last in common, no separator
        last = np.append((key[high[:-1]] >> 9) == (key[low[:-1]] >> 9), False)
        for k in range(PACKED):
            last &= (key[low] >> 9 * k & 511) > 1
        low, high = low[last], high[last]
    marked, at = np.zeros(n, dtype=bool), np.empty(n, dtype=np.int32)
    for _ in range(known, length):
        width = high - low
        if not len(width):
            break
        count = int(width.sum())
        rows = np.repeat(low - np.cumsum(width, dtype=np.int32) + width, width) + np.arange(count, dtype=np.int32)
        of = np.repeat(np.arange(len(width), dtype=np.int32), width)
        symbol = before[rows]
        inner = symbol > 0
        place, of, symbol = onto[rows[inner]], of[inner], symbol[inner]
        # the rows of an interval with one symbol go to one run of places
        if len(place) > n // MARKED:
            marked[place], at[place] = True, np.arange(len(place), dtype=np.int32)
            place = np.flatnonzero(marked).astype(np.int32)
            marked[place] = False
            by_place = at[place]
        else:
            by_place = np.argsort(place)
            place = place[by_place]
        of, symbol = of[by_place], symbol[by_place]
        ends = np.flatnonzero(np.concatenate([(of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1]), [True]])) if len(of) else of
        right = place[ends] + 1
        left = place[np.concatenate([[0], ends[:-1] + 1])] if len(ends) else right
        new = ~border[right]
        border[right[new]] = True
        low, high = left[new], right[new]
    out = np.empty(n, dtype=np.int32)
    out[order] = np.cumsum(border[:n], dtype=np.int32) - 1
    return out


def repeated_windows(strings: list[bytes], docs: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the windows of different strings that also start in a smaller document: (of docs, of later documents).

    A string is sorted once; where later documents hold it too, their rows lie next to its own in the transform, so that the
    smallest document of an interval is read out for both.
    """
    total = sum(map(len, strings)) + len(strings)
    symbols = np.zeros(total, dtype=np.int16)
    starts, at = [], 0
    for s in strings:
        symbols[at : at + len(s)] = np.frombuffer(s, dtype=np.uint8).astype(np.int16) + 1
        starts.append(at)
        at += len(s) + 1
    group = equal_prefixes(symbols, length)
    first = np.cumsum(counts) - counts
    nth = np.arange(int(counts.sum())) - np.repeat(first, counts)
    own = group[np.repeat(np.array(starts), counts) + nth]
    doc = np.repeat(docs, counts)
    least = np.full(int(own.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, own, doc)
    mask = lambda who: np.bitwise_or.reduceat(np.where(least[own] < who, U64(1) << nth.astype(U64), U64(0)), first)
    return mask(doc), mask(np.iinfo(np.int64).max)


SUFFIXES = 400_000  # bytes of different strings in one suffix array, as far as anchors allow


def _answer_strings(length: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: for each string of each chunk two 32-bit masks of its windows to drop.

        The first is for the smallest document of the chunk with this string, the second for all others. Every string that
        others hold, or that shares its anchor with another string, goes into the transform, once.
        """
        let_go()
        cols = {c: table[c].to_pylist() for c in ("docs", "several", "grams", "counts", "strings")}
        docs = np.concatenate([np.frombuffer(x, dtype="<i8") for x in cols["docs"]])
        several = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in cols["several"]]).astype(bool)
        grams = np.concatenate([np.frombuffer(x, dtype="<u8") for x in cols["grams"]])
        counts = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in cols["counts"]]).astype(np.int64)
        sizes = counts + length - 1
        flat = np.frombuffer(b"".join(zstandard.decompress(x) for x in cols["strings"]), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        key_ = span_keys(flat, starts, starts + sizes)
        # equal strings are one, held by the smallest document
        order = np.lexsort((docs, key_, grams))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (key_[order][1:] != key_[order][:-1]) | (grams[order][1:] != grams[order][:-1])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(fresh) - 1
        holder = order[fresh]
        later = docs > docs[holder][number]
        shared = np.zeros(len(holder), dtype=bool)
        shared[number[later | several]] = True
        g = grams[holder]
        edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        own, others = np.zeros(len(holder), dtype=U64), np.zeros(len(holder), dtype=U64)
        todo, size = [], 0
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1 or shared[a]:
                todo += range(a, b)
                size += int(sizes[holder[a:b]].sum())
            if todo and (size >= SUFFIXES or b == len(holder)):
                todo = np.array(todo)
                rows = holder[todo]
                strings = [flat[starts[r] : starts[r] + sizes[r]].tobytes() for r in rows]
                own[todo], others[todo] = repeated_windows(strings, docs[rows], counts[rows], length)
                todo, size = [], 0
        first = np.where(later, others[number], own[number]).astype("<u4")
        rest = others[number].astype("<u4")
        ends = np.cumsum([len(x) // 8 for x in cols["docs"]])
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())
        return pa.table({"chunk_id": table["chunk_id"], "place": table["place"], "masks": cut(first), "others": cut(rest)})

    return run


def _sums(marks: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many marks each span has."""
    places = np.flatnonzero(marks)
    return np.searchsorted(places, end) - np.searchsorted(places, first)


def _drop(length: int, buckets: int, as_text: bool):
    def run(batches):
        for batch in batches:
            for i, _, chunk in _chunks(batch, length):
                answers = [(x["bucket"], x["bits"]) for x in batch["answers"][i].as_py() or []]
                some, chosen, string, _ = chunk.picked(*_flags(chunk, answers, buckets))
                mask, rest = np.zeros(len(chosen), dtype=U64), np.zeros(len(chosen), dtype=U64)
                for x in batch["verdicts"][i].as_py() or []:
                    at = np.frombuffer(x["place"], dtype="<i4")
                    mask[at], rest[at] = np.frombuffer(x["masks"], dtype="<u4"), np.frombuffer(x["others"], dtype="<u4")
                cover = np.zeros(len(chunk.text) + 1, dtype=np.int16)  # a place begins one window and ends one at most
                if len(some):
                    holder = chunk.ids[chunk.doc[some[chosen]]]
                    own = np.where(chunk.ids[chunk.doc[some]] > holder[string], rest[string], mask[string])
                    for k in range(int(chunk.count[some].max())):
                        at = chunk.first[some[(own >> U64(k)) & U64(1) == 1]] + k
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + length, -1)
                gone = np.cumsum(cover[:-1], dtype=np.int16) > 0
                # runs never cross documents: windows lie within one, but two may touch at a border
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                heads = chunk.starts[(chunk.sizes > 0)]
                begin[heads] = gone[heads]
                a, b = chunk.starts, chunk.starts + chunk.sizes
                removed, spans = _sums(gone, a, b), _sums(begin, a, b)
                kept = [chunk.text[x:y][~gone[x:y]].tobytes() for x, y in zip(a, b, strict=True)]
                ids = pa.array(chunk.ids, mask=~chunk.known)
                left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(chunk.sizes), pa.array(removed), pa.array(spans), left, pa.array(chunk.keys)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text_key"],
                )

    return run


def dedup_passages(docs: DataFrame, length: int = 50, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, text_key) for every row: kept is what stays of the text's bytes (binary).

    With as_text kept is a string, and characters of which a byte went go whole.
    text_key is xxhash64 of the text; rows of one doc_id and text have the same result.
    """
    if not GRAM + 2 <= length <= GRAM + 31:
        raise ValueError(f"length must be from {GRAM + 2} to {GRAM + 31}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * max(8, parts)
    # written once, bucketed: the joins below find the chunks where they are, and lost executors change nothing
    name = f"chunks_{uuid.uuid4().hex}"
    chunks = pack_chunks(docs).repartition(parts, "chunk_id").write.bucketBy(parts, "chunk_id").sortBy("chunk_id")
    owned(f"{shared_folder(spark)}/{name}")
    chunks.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name goes: the files are in a folder of their own
    sent = chunks.mapInArrow(_emit_anchors(length, buckets), "bucket int, chunk_id long, found binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer_anchors, "chunk_id long, bucket int, bits binary")
    answers = answers.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    told = chunks.join(saved(answers), "chunk_id", "left")
    strings = told.mapInArrow(
        _emit_strings(length, buckets), "bucket int, chunk_id long, place binary, docs binary, several binary, grams binary, counts binary, strings binary"
    )
    verdicts = strings.groupBy("bucket").applyInArrow(_answer_strings(length), "chunk_id long, place binary, masks binary, others binary")
    verdicts = verdicts.groupBy("chunk_id").agg(F.collect_list(F.struct("place", "masks", "others")).alias("verdicts"))
    judged = told.join(verdicts, "chunk_id", "left")
    kept = "string" if as_text else "binary"
    return judged.mapInArrow(_drop(length, buckets, as_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kept}, text_key long")
