"""LM scoring by partial matching: byte contexts with escapes and symbol exclusion, learned from the corpus.

Learning counts, over all whole training texts, every run of ORDER + 1 symbols (bytes, with an end symbol) and every
word. A task counts in sorted numpy arrays and sends them, packed, to buckets by the KEY symbols before the counted
one; a bucket merges what it gets as it streams in. All contexts of KEY symbols and more are then whole in one bucket,
so each bucket holds its part of the trie down to that length. The runs of KEY symbols (at most 257^KEY, in practice a
few ten thousand) are the trie's top, which every bucket gets.

The 2^SUPPORT most frequent runs are broadcast with their probabilities. A document's other runs are asked for: each
chunk of documents sends its distinct ones to their buckets, which look them up in their part of the trie and send the
probabilities back. Nothing that was counted is left out, at any size. Words of the base score go the same way.

A symbol's probability: from the longest context seen, the symbol's count over all counts and escapes; where it
is missing there, the escape's share times the same from the next shorter context, without the symbols already ruled
out; at last evenly over the symbols never seen.

Defined cases: null or empty text is the end symbol only. A null doc_id is scored but neither learned from nor held
out. Repeated rows are learned from and scored each. With no training text N and V are 0 and all symbols are equally
likely. Long texts are taken in pieces of SPAN bytes. Hashes of words have 64 bits and are taken as the words
themselves. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, as_bytes, forget, mix, saved, slices

ORDER = 6  # seven symbols of nine bits fill a long
KEY = 3
SUPPORT = 21
WORD_SUPPORT = 20
END, PAD, SYMBOLS = 256, 257, 257
END_TOKEN = 1  # stands for the hash of the end token
BITS = U64(9)
SPAN = 1_000_000  # bytes of text whose symbols are in memory at once
HELD = 3_000_000  # distinct codes that a counting task holds
CHUNK = 16_000_000  # bytes of the documents in a chunk
RUNS, WORDS = 0, 1
BREAK = re.compile(rb"[\x20\x09-\x0D]")


def low(symbols: int) -> np.uint64:
    """A mask of the last symbols of a code."""
    return U64((1 << 9 * symbols) - 1)


def codes_of(items: list[tuple[bytes, bytes, bool]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of order + 1 symbols for each byte and end of the items (bytes before or none, bytes, whether the text ends).

    Also gives where each item starts among the codes. The bytes before are `order` bytes, or none at a text's start.
    """
    joined = b"".join(x for lead, piece, ends in items for x in (lead or bytes(order), piece, b"\0" * ends))
    symbols = np.frombuffer(joined, dtype=np.uint8).astype(U64)
    sizes = np.array([order + len(piece) + ends for _, piece, ends in items], dtype=np.int64)
    stops = np.cumsum(sizes)
    fresh = (stops - sizes)[[not lead for lead, _, _ in items]]
    symbols[(fresh[:, None] + np.arange(order)).ravel()] = PAD
    symbols[stops[[ends for _, _, ends in items]] - 1] = END
    n = len(symbols) - order
    code = symbols[:n].copy()
    for k in range(1, order + 1):
        code <<= BITS
        code |= symbols[k : n + k]
    keep = np.ones(n, dtype=bool)
    keep[(stops[:-1, None] - order + np.arange(order)).ravel()] = False  # runs over the border of two items
    emitted = sizes - order
    return code[keep], np.cumsum(emitted) - emitted


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of order + 1 symbols for every byte and the end of each text, and where each text starts among them."""
    if not texts:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    return codes_of([(b"", t, True) for t in texts], order)


def portions(texts: list[bytes]) -> Iterator[tuple[list[int], list[tuple[bytes, bytes, bool]]]]:
    """(texts' numbers, items) of about SPAN bytes each; longer texts are cut."""
    owners, items, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t), 1), SPAN):
            piece = t[at : at + SPAN]
            owners.append(i)
            items.append((t[at - ORDER : at] if at else b"", piece, at + SPAN >= len(t)))
            size += len(piece) + ORDER
            if size >= SPAN:
                yield owners, items
                owners, items, size = [], [], 0
    if items:
        yield owners, items


def word_portions(texts: list[bytes], hashes: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts' numbers, hashes) of all tokens, ends included, in portions; long texts are cut between words."""
    owners, flat, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            cut = BREAK.search(t, at + SPAN) if len(t) - at > SPAN else None
            piece = t[at : cut.start()] if cut else t[at:] if at else t
            words = hashes.of(piece.lower().split())
            flat.append(words)
            owners.append(np.full(len(words) + (cut is None), i, dtype=np.int64))
            size += len(piece) + 8
            if cut is None:
                flat.append(np.array([END_TOKEN], dtype=U64))
            if size >= SPAN:
                yield np.concatenate(owners), np.concatenate(flat)
                owners, flat, size = [], [], 0
            if cut is None:
                break
            at = cut.start()
    if flat:
        yield np.concatenate(owners), np.concatenate(flat)


def squeeze(x: np.ndarray, rising: bool = False) -> bytes:
    """64-bit numbers as compressed byte planes; rising ones by their differences."""
    x = x.astype(U64)
    if rising and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    return zstandard.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def expand(blob: bytes, rising: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(8, -1).T).view(U64).reshape(-1)
    return np.cumsum(x, dtype=U64) if rising else x


def summed(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in rising order and the sums of their counts (1 each where none are given)."""
    if not len(codes):
        return codes.astype(U64), np.zeros(0, dtype=np.int64)
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes))) if counts is None else np.add.reduceat(counts, first)


def bucket_of(kind: int, codes: np.ndarray, buckets: int) -> np.ndarray:
    """Runs go by the KEY symbols before the last one, words by their hash."""
    by = (codes >> BITS) & low(KEY) if kind == RUNS else codes
    return (mix(by + U64(kind + 1)) % U64(buckets)).astype(np.int64)


def dealt(kind: int, codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of codes by bucket (rising codes in each), the buckets that have some, and where each starts."""
    bucket = bucket_of(kind, codes, buckets)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    return order, used, np.append(first, len(codes))


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


COUNTS = "kind int, bucket int, codes binary, counts binary"


def _counts(kind: list, bucket: list, codes: list, counts: list) -> pa.RecordBatch:
    return _batch({"kind": (kind, pa.int32()), "bucket": (bucket, pa.int32()), "codes": (codes, pa.binary()), "counts": (counts, pa.binary())})


class Held:
    """Counts of codes in memory: sorted arrays, merged when there are several."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.loose = 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((codes, counts))
        self.loose += len(codes)
        if len(self.parts) > 1 and self.loose > HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [summed(np.concatenate([a for a, _ in self.parts]), np.concatenate([b for _, b in self.parts]))]
        self.loose = 0
        return self.parts[0] if self.parts else (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))

    def full(self) -> bool:
        return bool(self.parts) and self.loose == 0 and len(self.parts[0][0]) > HELD


def gather(train: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, codes, counts): counts of all runs of symbols and of all tokens of the training texts, by bucket."""

    def run(batches):
        hashes, held = WordHashes(), {RUNS: Held(), WORDS: Held()}

        def flush(kind):
            codes, counts = held[kind].merge()
            held[kind] = Held()
            order, used, edge = dealt(kind, codes, buckets)
            codes, counts = codes[order], counts[order]
            yield _counts(
                [kind] * len(used),
                used.tolist(),
                [squeeze(codes[a:b], True) for a, b in zip(edge[:-1], edge[1:], strict=True)],
                [squeeze(counts[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)],
            )

        for part in slices(batches, 1000):
            texts = as_bytes(part["text"])
            for _, items in portions(texts):
                held[RUNS].add(*summed(codes_of(items)[0]))
                if held[RUNS].full():
                    yield from flush(RUNS)
            for _, words in word_portions(texts, hashes):
                held[WORDS].add(*summed(words))
                if held[WORDS].full():
                    yield from flush(WORDS)
        for kind in (RUNS, WORDS):
            yield from flush(kind)

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            for codes, counts in zip(batch["codes"], batch["counts"], strict=True):
                held.add(expand(codes.as_py(), True), expand(counts.as_py()).astype(np.int64))
        codes, counts = held.merge()
        yield _counts([key[0].as_py()], [key[1].as_py()], [squeeze(codes, True)], [squeeze(counts)])

    sent = train.select("text").mapInArrow(run, COUNTS)
    return saved(sent.groupBy("kind", "bucket").applyInArrow(merged, COUNTS))


@dataclass
class Trie:
    """A part of the trie, for each context length: sorted runs with log10 counts, and sorted contexts with what they share out."""

    order: int
    runs: list[np.ndarray] = field(default_factory=list)
    log_count: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    plain: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # log10 of the total, log10 of the escape's share
    after: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # the same in the next shorter context, without this one's symbols
    log_rest: float = 0.0

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each code."""
        out = np.zeros(len(code))
        open_ = np.arange(len(code))  # codes whose symbol is not found yet
        above = np.full(len(code), -1)  # their context one longer, where it is in the trie
        for k in range(self.order, -1, -1):
            if not len(open_) or not len(self.contexts[k]):
                continue
            g = code[open_] & low(k + 1)
            at = _find(self.contexts[k], g >> BITS)
            has = at >= 0
            run = _find(self.runs[k], g)
            total, escape = (x[at] for x in self.plain[k])
            if k < self.order and len(self.contexts[k + 1]):
                inside = above >= 0
                total = np.where(inside, self.after[k + 1][0][above], total)
                escape = np.where(inside, self.after[k + 1][1][above], escape)
            hit = has & (run >= 0)
            out[open_[hit]] += self.log_count[k][run[hit]] - total[hit]
            miss = has & ~hit
            out[open_[miss]] += escape[miss]
            open_, above = open_[~hit], np.where(has, at, -1)[~hit]
        out[open_] += self.log_rest
        return out


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in the sorted table, or -1."""
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def build(codes: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, np.ndarray], order: int = ORDER) -> Trie:
    """The trie of runs (sorted codes) whose contexts of KEY symbols are whole, below the runs of KEY symbols of all."""
    log = lambda x: np.log10(np.maximum(x, 1e-300))
    found = {order: (codes, counts)}
    for k in range(order - 1, KEY - 1, -1):
        found[k] = summed(found[k + 1][0] & low(k + 1), found[k + 1][1])
    for k in range(KEY - 1, -1, -1):
        found[k] = summed(top[0] & low(k + 1), top[1])
    trie, kept, kids = Trie(order), [], []
    for k in range(order + 1):
        codes, counts = found[k]
        ctx, inverse = np.unique(codes >> BITS, return_inverse=True)
        n = np.bincount(inverse, counts, len(ctx))
        d = np.bincount(inverse, minlength=len(ctx)).astype(float)
        trie.runs.append(codes)
        trie.log_count.append(log(counts))
        trie.contexts.append(ctx)
        trie.plain.append((log(n + d), log(d) - log(n + d)))
        kept.append((n, d))
        kids.append(inverse)
        if k == 0:
            trie.after.append((np.zeros(len(ctx)), np.zeros(len(ctx))))
            continue
        if not len(ctx):
            trie.after.append((np.zeros(0), np.zeros(0)))
            continue
        # what the same symbols have in the shorter context
        short = _find(trie.runs[k - 1], codes & low(k))
        took = np.bincount(inverse, found[k - 1][1][short], len(ctx))
        up = _find(trie.contexts[k - 1], ctx & low(k - 1))
        n1, e1 = kept[k - 1][0][up] - took, kept[k - 1][1][up] - d
        trie.after.append((log(n1 + e1), np.where(n1 + e1 > 0, log(e1) - log(n1 + e1), 0.0)))
    trie.log_rest = -float(np.log10(max(SYMBOLS - len(trie.runs[0]), 1)))
    return trie


def top_of(gathered: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The runs of KEY symbols with their counts: at most 257^KEY by what a symbol is, whatever the corpus."""

    def run(batches):
        for batch in batches:
            for codes, counts in zip(batch["codes"], batch["counts"], strict=True):
                short, n = summed(expand(codes.as_py(), True) & low(KEY), expand(counts.as_py()).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(short.view(np.int64)), pa.array(n)], names=["run", "n"])

    rows = gathered.where(F.col("kind") == RUNS).mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).toArrow()
    return summed(rows["run"].to_numpy().astype(np.int64).view(U64), rows["n"].to_numpy())


def frequent(gathered: DataFrame, kind: int, support: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sorted codes of the most frequent, at most 2^support, with the values of values_of; the sum of all counts; how many there are."""
    top = 1 << 16

    def count(batches):
        for batch in batches:
            for blob in batch["counts"]:
                n = expand(blob.as_py()).astype(np.int64)
                each, inverse, times = np.unique(np.minimum(n, top), return_inverse=True, return_counts=True)
                total = np.bincount(inverse, n, len(each)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(times), pa.array(total)], names=["n", "codes", "total"])

    own = gathered.where(F.col("kind") == kind)
    bins = own.mapInArrow(count, "n long, codes long, total long").groupBy("n").agg(F.sum("codes").alias("codes"), F.sum("total").alias("total"))
    bins = bins.toPandas().sort_values("n", ascending=False)  # at most 2^16 rows
    fit = bins[bins["codes"].cumsum() <= 1 << support]
    least = int(fit["n"].min()) if len(fit) else max(top, -(-int(bins["total"].sum()) // (1 << support)))

    def pick(batches):
        for batch in batches:
            for codes, counts in zip(batch["codes"], batch["counts"], strict=True):
                codes, counts = expand(codes.as_py(), True), expand(counts.as_py()).astype(np.int64)
                often = counts >= least
                if often.any():
                    yield _batch({"codes": ([squeeze(codes[often], True)], pa.binary()), "values": ([values_of(kind, codes, counts)[often].tobytes()], pa.binary())})

    rows = own.mapInArrow(pick, "codes binary, values binary").collect()  # at most 2^support codes
    codes = np.concatenate([np.zeros(0, dtype=U64), *(expand(bytes(r["codes"]), True) for r in rows)])
    values = np.concatenate([np.zeros(0), *(np.frombuffer(r["values"]) for r in rows)])
    order = np.argsort(codes)
    return codes[order], values[order], int(bins["total"].sum()), int(bins["codes"].sum())


def values_of(kind: int, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For all runs of whole contexts their log10 probabilities; for words log10(n + 0.5)."""
    if kind == WORDS:
        return np.log10(counts + 0.5)
    context = codes >> BITS
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: len(codes)])
    size = np.diff(np.append(first, len(codes)))
    total = np.add.reduceat(counts, first) + size
    return np.log10(counts) - np.repeat(np.log10(total), size)


class Memo:
    """Values of codes met before, one in each slot; nan for a code that is not in the table."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, bits: int = 20):
        self.codes, self.known, self.shift = codes, values, U64(64 - bits)
        self.keys, self.values = np.full(1 << bits, ~U64(0)), np.zeros(1 << bits)

    def of(self, code: np.ndarray) -> np.ndarray:
        slot = (code * U64(0x9E3779B97F4A7C15)) >> self.shift
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != code)
        if len(miss):
            new, inverse = np.unique(code[miss], return_inverse=True)
            values = np.full(len(new), np.nan)
            if len(self.codes):
                at = _find(self.codes, new)
                values[at >= 0] = self.known[at[at >= 0]]
            out[miss] = values[inverse]
            slot = (new * U64(0x9E3779B97F4A7C15)) >> self.shift
            self.keys[slot] = new
            self.values[slot] = values
        return out


@dataclass
class Chunk:
    """Documents of one task: what is known of their scores, and the codes to ask for by document."""

    doc: list = field(default_factory=list)
    training: list = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)  # tokens, hits, common, score by document
    asked: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=lambda: {RUNS: [], WORDS: []})
    size: int = 0

    def row(self, chunk_id: int, buckets: int) -> pa.RecordBatch:
        sums = np.concatenate(self.sums) if self.sums else np.zeros((0, 4))
        out = {
            "chunk_id": ([chunk_id], pa.int64()), "doc_id": ([self.doc], pa.list_(pa.int64())), "training": ([self.training], pa.list_(pa.bool_())),
            "sums": ([sums.tobytes()], pa.binary()),
        }
        requests = []
        for kind in (RUNS, WORDS):
            codes = np.concatenate([np.zeros(0, dtype=U64), *(c for _, c in self.asked[kind])])
            owner = np.concatenate([np.zeros(0, dtype=np.int64), *(o for o, _ in self.asked[kind])])
            distinct, inverse = np.unique(codes, return_inverse=True)
            order, used, edge = dealt(kind, distinct, buckets)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            distinct = distinct[order]
            requests += [{"kind": kind, "bucket": int(b), "codes": squeeze(distinct[x:y], True)} for b, x, y in zip(used, edge[:-1], edge[1:], strict=True)]
            out[f"owner{kind}"] = ([squeeze(owner, True)], pa.binary())
            out[f"place{kind}"] = ([squeeze(place[inverse])], pa.binary())
        out["requests"] = ([requests], pa.list_(pa.struct([("kind", pa.int32()), ("bucket", pa.int32()), ("codes", pa.binary())])))
        return _batch(out)


CHUNKS = (
    "chunk_id long, doc_id array<long>, training array<boolean>, sums binary, owner0 binary, place0 binary, owner1 binary, place1 binary, "
    "requests array<struct<kind: int, bucket: int, codes: binary>>"
)


def _first_pass(runs, words, buckets: int):
    """Rows of documents to chunks: scores by the broadcast tables, and requests for what these do not hold."""

    def run(batches):
        from pyspark import TaskContext

        hashes, memo, known = WordHashes(), Memo(*runs.value), Memo(*words.value, bits=16)
        task, n, chunk = TaskContext.get().partitionId(), 0, Chunk()
        for part in slices(batches, 1000):
            texts = as_bytes(part["text"])
            base = len(chunk.doc)
            chunk.doc += part["doc_id"].to_pylist()
            chunk.training += part["training"].to_pylist()
            sums = np.zeros((len(texts), 4))

            def ask(kind, owner, codes, base=base, chunk=chunk):
                chunk.asked[kind].append((owner + base, codes))

            for owners, items in portions(texts):
                codes, starts = codes_of(items)
                value = memo.of(codes)
                apart = np.isnan(value)
                np.add.at(sums[:, 3], owners, np.add.reduceat(np.where(apart, 0.0, value), starts))
                owner = np.repeat(np.array(owners), np.diff(np.append(starts, len(codes))))
                ask(RUNS, owner[apart], codes[apart])
            for owner, tokens in word_portions(texts, hashes):
                value = known.of(tokens)
                apart = np.isnan(value)
                sums[:, 0] += np.bincount(owner, minlength=len(texts))
                sums[:, 1] += np.bincount(owner, ~apart, len(texts))
                sums[:, 2] += np.bincount(owner, np.where(apart, 0.0, value), len(texts))
                ask(WORDS, owner[apart], tokens[apart])
            chunk.sums.append(sums)
            chunk.size += sum(map(len, texts)) + 8 * len(texts)
            if chunk.size >= CHUNK:
                yield chunk.row((task << 32) + n, buckets)
                n, chunk = n + 1, Chunk()
        if chunk.doc:
            yield chunk.row((task << 32) + n, buckets)

    return run


def _answer(top):
    """One bucket: the values of the codes that each chunk asks for."""

    def run(key, held: pa.Table, asked: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        codes, counts = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        for a, b in zip(held["codes"], held["counts"], strict=True):  # one row a bucket
            codes, counts = expand(a.as_py(), True), expand(b.as_py()).astype(np.int64)
        trie, out = None, []
        for blob in asked["codes"]:
            wanted = expand(blob.as_py(), True)
            if kind == RUNS:
                trie = trie or build(codes, counts, top.value)
                values = trie.log10(wanted)
            else:
                at = _find(codes, wanted) if len(codes) else np.full(len(wanted), -1)
                values = np.full(len(wanted), np.nan)  # nan: a word that training has not
                values[at >= 0] = values_of(WORDS, codes, counts[at[at >= 0]])
            out.append(squeeze(values.view(U64)))
        return pa.table({"chunk_id": asked["chunk_id"], "kind": asked["kind"], "bucket": asked["bucket"], "values": pa.array(out, pa.binary())})

    return run


def _finish(key, chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a chunk with the values that came back."""
    row = {c: chunk[c][0].as_py() for c in chunk.column_names}
    sums = np.frombuffer(row["sums"]).reshape(-1, 4).copy()
    back = sorted(zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), range(answers.num_rows), strict=True))
    for kind in (RUNS, WORDS):
        parts = [expand(answers["values"][i].as_py()).view(np.float64) for k, _, i in back if k == kind]
        if not parts:
            continue
        owner = expand(row[f"owner{kind}"], True).astype(np.int64)
        value = np.concatenate(parts)[expand(row[f"place{kind}"]).astype(np.int64)]
        if kind == RUNS:
            sums[:, 3] += np.bincount(owner, value, len(sums))
        else:
            known = ~np.isnan(value)
            sums[:, 1] += np.bincount(owner, known, len(sums))
            sums[:, 2] += np.bincount(owner, np.where(known, value, np.log10(0.5)), len(sums))
    whole = sums[:, :2].astype(np.int64)
    columns = [pa.array(row["doc_id"], pa.int64()), pa.array(row["training"], pa.bool_()), whole[:, 0].copy(), whole[:, 1].copy(), sums[:, 2].copy(), sums[:, 3].copy()]
    return pa.table([pa.array(x) for x in columns], names=["doc_id", "training", "n_tokens", "n_known", "common", "score"])


def score(docs: DataFrame, is_training, support: int = SUPPORT, word_support: int = WORD_SUPPORT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); is_training: a boolean column of docs."""
    spark = docs.sparkSession
    buckets = 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(is_training, F.lit(False)).alias("training"))
    gathered = gather(rows.where("training"), buckets)
    share = spark.sparkContext.broadcast
    top = share(top_of(gathered))
    codes, values, _, _ = frequent(gathered, RUNS, support)
    runs = share((codes, values))
    codes, values, n, v = frequent(gathered, WORDS, word_support)
    words = share((codes, values))
    chunks = saved(rows.mapInArrow(_first_pass(runs, words, buckets), CHUNKS))
    asked = chunks.select("chunk_id", F.explode("requests").alias("r")).select("chunk_id", "r.kind", "r.bucket", "r.codes")
    by = ["kind", "bucket"]
    answers = gathered.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_answer(top), "chunk_id long, kind int, bucket int, values binary")
    schema = "doc_id long, training boolean, n_tokens long, n_known long, common double, score double"
    done = saved(chunks.drop("requests").groupBy("chunk_id").cogroup(answers.groupBy("chunk_id")).applyInArrow(_finish, schema))
    forget(chunks)
    forget(gathered)
    return done.select(
        "doc_id",
        "training",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("common") - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))).alias("base_score"),
        "score",
    )
