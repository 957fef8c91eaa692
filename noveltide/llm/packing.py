"""Best-fit packing of token pieces into sequences.

Documents become pieces of at most `capacity` tokens. Only the histogram of lengths (at most `capacity` numbers) comes
to the driver. There a configuration linear program over it (each configuration is a multiset of lengths that fits in a
sequence, and all pieces of all lengths have to be covered by as few sequences as possible) is solved by
multiplicative weights: each length starts with the weight length / capacity, which falls as it gets covered; a
knapsack dynamic program over the weights prices the configurations, its best value bounds the optimum from below, and
configurations for the lengths covered least are taken from its table. The solution is rounded to whole sequences, and
what rounding leaves over is laid out by best fit decreasing. The layout is a table of runs (length, ranks from..to ->
sequences, place) whose size does not grow with the input, and the pieces find their run by their length and a block of
ranks. Ranks are prefix sums over hash buckets, so a length that a third of all pieces share is never in one task.

Defined cases: null text is empty and gives one piece with the end id only. Rows are independent, so null and repeated
doc_ids are packed as they are. Equal lengths take places in the order of a hash, doc_id and piece. An empty table
gives an empty table. Extra columns are not read. A document's ids are in memory at once, however long it is.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, held, map_arrow, saved

BUCKETS = 256
#: Words as the tokenizer sees them: \x1c-\x1f are white space for str.split() but not for it.
WORD = re.compile(r"[\S\x1c-\x1f]+")
ODD = re.compile(r"[\x1c-\x1f]")
#: What the tokenizer cuts words into (a fixed value: the pattern in its file), and the same for lower-cased words of
#: the characters in PLAIN, for which its normalisation is lower-casing alone.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
PIECE = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z\xdf-\xf6\xf8-\xff0-9]+")
#: Texts of such words, which can be cut into pieces at once: pieces never reach over white space.
PLAIN_TEXT = re.compile(r"[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
KEPT = 48  # characters of a word or piece that is kept for later texts


class WordIds(dict):
    """Packed token ids by white-space-separated word; the tokenizer drops white space and never joins over it.

    Where its file says that words are cut by CUTS and that a token's name tells whether it ends such a piece, ids are put
    together from those of pieces, of which there are fewer, encoded many at a time: for plain texts without looking at
    words, in others for the unknown plain words. Pieces go once as many as `limit` others have been asked for since.
    """

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        end = told["model"].get("end_of_word_suffix")
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])[:1]]
        self.ends = None
        if end and steps == ["NFC", "Replace", "Lowercase"] and cuts == [CUTS]:
            self.ends = np.zeros(max(told["model"]["vocab"].values()) + 1, dtype=bool)
            self.ends[[i for t, i in told["model"]["vocab"].items() if t.endswith(end)]] = True
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def rest(self) -> None:
        """Drops the pieces not asked for lately: the worker may wait beside stages that need the memory."""
        self.older = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, new: list[str]):
        """(piece, ids) of pieces."""
        for i in range(0, len(new), 1000):
            some = new[i : i + 1000]
            ids = self._ids([" ".join(some)])[0]
            ends = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, dtype="<u4")]) + 4).tolist()
            if len(ends) == len(some):
                yield from zip(some, (ids[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True)
            else:
                yield from zip(some, self._ids(some), strict=True)

    def joined(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces."""
        wanted = set().union(*cut)
        missing = wanted.difference(self.pieces)
        if len(self.pieces) + len(missing) > self.limit:
            self.older, self.pieces, missing = self.pieces, {}, wanted
        known, older = self.pieces, self.older
        new = missing.difference(older)
        known.update((p, older[p]) for p in missing.difference(new))
        known.update(self._encoded(list(new)))
        found = [b"".join(map(known.__getitem__, c)) for c in cut]
        for p in [p for p in new if len(p) > KEPT]:
            del known[p]
        return found

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encodes words not known yet; gives those too long to keep."""
        plain = [w for w in words if PLAIN.fullmatch(w)] if self.ends is not None else []
        rest = list(words.difference(plain)) if len(plain) < len(words) else []
        found = dict(zip(rest, self._ids(rest), strict=True)) if rest else {}
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            found.update(zip(some, self.joined([PIECE.findall(w.lower()) for w in some]), strict=True))
        if len(self) + len(found) > self.limit:
            self.clear()
        long = {w: found.pop(w) for w in [w for w in found if len(w) > KEPT]}
        self.update(found)
        return long

    def by_words(self, texts: list[str]) -> list[bytes]:
        split = [WORD.findall(x) if ODD.search(x) else x.split() for x in texts]
        words = set().union(*split)
        table = self
        missing = words.difference(self)  # looks words up; subtracting keys() would go through all of them
        if missing:
            keep = {w: self[w] for w in words if w in self} if len(self) + len(missing) > self.limit else {}
            long = self.learn(missing)
            self.update(keep)
            table = {**{w: self[w] for w in words if w in self}, **long} if long else self
        return [b"".join(map(table.__getitem__, s)) for s in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.ends is not None and PLAIN_TEXT.fullmatch(x) is not None for x in texts]
        found = iter(self.joined([PIECE.findall(x.lower()) for x, ok in zip(texts, plain, strict=True) if ok]))
        others = iter(self.by_words([x for x, ok in zip(texts, plain, strict=True) if not ok]))
        return [next(found if ok else others) for ok in plain]


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut at `capacity`."""

    key = ("words", path)

    def run(part):
        words = held(key, lambda: WordIds(path))
        end = np.array([end_id], dtype="<u4").tobytes()
        out = [[] for _ in range(6)]
        texts = as_text(part["text"])
        for i in range(0, len(texts), 250):
            for doc, ids in zip(part["doc_id"].slice(i, 250).to_pylist(), words.encode(texts[i : i + 250]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, k, at // 4, len(cut) // 4, zlib.crc32(cut), cut), strict=True):
                        column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
        return [pa.array(x, kind) for x, kind in zip(out, kinds, strict=False)]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema, keep=key)


def price(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """For each room up to capacity the largest value of lengths that fit, with at most about `most` of each length."""
    best = np.zeros(capacity + 1)
    for s, v, k in zip(sizes.tolist(), values.tolist(), np.minimum(most, capacity // sizes).astype(int).tolist(), strict=True):
        while k > 0 and s <= capacity:  # 1, 2, 4 ... pieces at a time
            np.maximum(best[s:], best[:-s] + v, out=best[s:])
            s, v, k = 2 * s, 2 * v, k // 2
    return best


def filled(room: int, best: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> Counter:
    """A most valuable filling of the room, by going back through the table; of equals the longest first."""
    found = Counter()
    while True:
        n = int(np.searchsorted(sizes, room, side="right"))
        if not n:
            return found
        total = (best[room - sizes[:n]] + values[:n])[::-1]
        s = int(sizes[n - 1 - int(total.argmax())])
        found[s] += 1
        room -= s


@dataclass
class Solution:
    """Amounts by configuration; `bound` is a lower bound of any solution's number of sequences."""

    amounts: dict[tuple, float]
    bound: float

    def gap(self) -> float:
        return sum(self.amounts.values()) / self.bound - 1 if self.bound else 0.0


def configurations(counts: np.ndarray, capacity: int, leads: tuple = (4.0, 1.0), tolerance: float = 0.003, **how) -> Solution:
    """The configuration linear program for so many pieces of each length, all but those of full length.

    Solved with each lead until the gap is within the tolerance; the solution with fewest sequences counts.
    """
    best = None
    for lead in leads:
        found = covered_by(counts, capacity, lead, **how)
        if best is None or sum(found.amounts.values()) < sum(best.amounts.values()):
            best = Solution(found.amounts, max(found.bound, best.bound if best else 0.0))
        if best.gap() <= tolerance:
            break
    return best


def covered_by(counts: np.ndarray, capacity: int, lead: float, rounds: int = 400, seeds: int = 64, step: float = 0.5, fall: float = 1.0, columns: int = 48) -> Solution:
    """Multiplicative weights until every length is covered.

    Each round sets the weights, prices all lengths for the bound, and takes a configuration for each of `seeds` lengths:
    the length and the most valuable filling of the rest of its room by a random draw of `columns` lengths, drawn by the
    pieces that are left of them (partial pricing). Taken are the lengths covered least, where the longest may be `lead`
    ahead. A configuration covers at most the share `step` of a length at a time.
    """
    sizes = np.flatnonzero(counts[:capacity])
    need = counts[sizes].astype(float)
    place = {int(s): i for i, s in enumerate(sizes)}
    left, bound = need.copy(), float((need * sizes).sum() / capacity)
    amounts: dict[tuple, float] = {}
    rng = np.random.default_rng(11)
    for n in range(rounds):
        open_ = np.flatnonzero(left > 0)
        if not len(open_):
            break
        covered = 1 - left / need
        weights = sizes / capacity * np.exp(-fall * (covered - covered[open_].min()))
        if n % 8 == 0:  # the weights over the best price are feasible duals
            bound = max(bound, float((need * weights).sum() / price(sizes, weights, need, capacity)[capacity]))
        order = np.argsort(np.round(covered[open_], 2) - lead * sizes[open_] / capacity, kind="stable")
        for i in open_[order[:seeds]]:
            seed, best_config, room = int(sizes[i]), None, capacity + 1
            if left[i] <= 0:
                continue
            for _ in range(3):
                drawn = np.flatnonzero(left > 0)
                if len(drawn) > columns:
                    drawn = np.sort(drawn[np.argpartition(rng.exponential(size=len(drawn)) / left[drawn], columns)[:columns]])
                own, worth = sizes[drawn], weights[drawn]
                table = price(own, worth, np.ceil(left[drawn] / 8), capacity - seed)
                config = filled(capacity - seed, table, own, worth)
                config[seed] += 1
                free = capacity - sum(s * k for s, k in config.items())
                if free < room:
                    best_config, room = config, free
                if room <= capacity // 1000:
                    break
            at = np.array([place[s] for s in best_config])
            k = np.fromiter(best_config.values(), dtype=float)
            amount = float((left[at] / k).min())
            if amount > 1:  # never less than a sequence that there are pieces for
                amount = max(1.0, min(amount, float((step * need[at] / k).min())))
            left[at] -= k * amount
            left[left < 1e-9 * need] = 0.0
            key = tuple(sorted(best_config.items()))
            amounts[key] = amounts.get(key, 0.0) + amount
    return Solution(amounts, bound)


def rounded(amounts: dict[tuple, float], counts: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """Whole numbers of sequences by configuration: rounded down, then up where pieces are left, largest fraction first.

    Configurations that leave a fiftieth of a sequence free or more are left to best fit.
    """
    left = counts.copy()
    full = {c: x + 1e-6 for c, x in amounts.items() if 50 * (capacity - sum(s * k for s, k in c)) < capacity}
    whole = {c: int(x) for c, x in full.items()}
    for config, times in whole.items():
        for s, k in config:
            left[s] -= k * times
    for config, x in sorted(full.items(), key=lambda y: y[1] % 1, reverse=True):
        if x - whole[config] > 1e-3 and all(left[s] >= k for s, k in config):
            whole[config] += 1
            for s, k in config:
                left[s] -= k
    return [(Counter(dict(c)), n) for c, n in whole.items() if n]


def layout(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, copies in a sequence, place) that hold every piece once."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        counts[s] = n
    runs, used, sequence = [], np.zeros_like(counts), 0

    def put(config: Counter, times: int) -> None:
        nonlocal sequence
        place = 0
        for s, k in sorted(config.items(), reverse=True):
            runs.append((s, int(used[s]), int(used[s]) + k * times, sequence, k, place))
            used[s] += k * times
            place += s * k
        sequence += times

    if counts[capacity]:
        put(Counter({capacity: 1}), int(counts[capacity]))
    for config, times in rounded(configurations(counts, capacity).amounts, counts, capacity):
        put(config, times)
    # best fit decreasing over what rounding left: kinds of open sequences by free room, with their numbers
    room: dict[int, Counter] = {}  # free room -> how many sequences of each content
    rooms: list[int] = []
    for s in range(capacity, 0, -1):
        left = int(counts[s] - used[s])
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                fit = capacity // s  # new sequences hold as many as fit; later smaller ones fill the rest
                full, rest = divmod(left, fit)
                new = [((s,) * fit, full)] * (full > 0) + [((s,) * rest, 1)] * (rest > 0)
                for content, times in new:
                    _open(room, rooms, capacity - s * len(content), content, times)
                break
            free = rooms[i]
            content, times = next(iter(room[free].items()))
            take = min(left, times)
            _open(room, rooms, free, content, -take)
            _open(room, rooms, free - s, (*content, s), take)
            left -= take
    final = Counter()
    for kinds in room.values():
        final.update(kinds)
    for content, times in final.items():
        put(Counter(content), times)
    return runs


def _open(room: dict[int, Counter], rooms: list[int], free: int, content: tuple, times: int) -> None:
    if free not in room:
        room[free] = Counter()
        insort(rooms, free)
    room[free][content] += times
    if room[free][content] == 0:
        del room[free][content]
    if not room[free]:
        del room[free]
        rooms.remove(free)


def place_pieces(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """found (pieces with `length`) with sequence_id and offset added; the other columns are kept."""
    spark = found.sparkSession
    names = [c for c in found.columns if c not in ("sequence_id", "offset")]
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS))
    rows = saved(found.select(*names).withColumn("_b", spread))
    counts = rows.groupBy("length", "_b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {x["length"]: x["n"] for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, widths = blocks(layout(histogram, capacity))
    inner = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.join(counts.select("length", "_b", "_before"), ["length", "_b"]).withColumn("_rank", F.col("_before") + F.row_number().over(inner) - 1)
    # a row for each length
    ranked = ranked.join(F.broadcast(spark.createDataFrame(widths)), "length").withColumn("_block", F.expr("_rank div _width"))
    # bounded by the number of configurations and of what they leave over, whatever the number of documents; a piece
    # meets the few runs of its length near its rank
    hit = ranked.join(F.broadcast(spark.createDataFrame(table)), ["length", "_block"]).where("_rank >= _from and _rank < _to")
    nth = F.col("_rank") - F.col("_from")
    return hit.select(
        *names,
        (F.col("_seq") + F.floor(nth / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_place") + (nth % F.col("_copies")) * F.col("length")).cast("long").alias("offset"),
    )


def blocks(runs: list[tuple[int, int, int, int, int, int]]) -> tuple[pa.Table, pa.Table]:
    """The runs once for each block of ranks that they touch, and by length how many ranks a block has.

    A length has about as many blocks as runs, so there are at most about twice as many rows as runs.
    """
    x = np.array(runs, dtype=np.int64).reshape(-1, 6)
    top = int(x[:, 0].max(initial=0)) + 1
    n, ranks = np.bincount(x[:, 0], minlength=top), np.bincount(x[:, 0], x[:, 2] - x[:, 1], top).astype(np.int64)
    width = np.maximum(1, -(-ranks // np.maximum(n, 1)))
    own = width[x[:, 0]]
    first, last = x[:, 1] // own, (x[:, 2] - 1) // own
    times = last - first + 1
    row = np.repeat(np.arange(len(x)), times)
    block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[row]
    names = ["length", "_from", "_to", "_seq", "_copies", "_place"]
    table = pa.table([*(x[row, k].copy() for k in range(6)), block], names=[*names, "_block"])
    used = np.flatnonzero(n)
    return table, pa.table([used, width[used]], names=["length", "_width"])


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of all pieces of all documents."""
    return place_pieces(pieces(docs, path, capacity, end_id, with_ids), capacity)
