"""Phrase collocation mining by Rabin-Karp fingerprints.

Texts are cut into blocks of one language that end between pieces. In each block numpy prefix polynomials over the bytes
hash every word and prefix polynomials over the words hash every n-gram; a block sends each of its fingerprints once, with
its count and the place of one occurrence, to a bucket of the fingerprint range. What is frequent there goes back to the
blocks that asked. Words and pairs go first; longer n-grams are only sent where all their pairs are frequent, which loses
none. At last each block takes the frequent n-grams from its text at their places, holds every occurrence against the
words there, and counts occurrences that differ (collisions of fingerprints, in a block or between blocks) by their own
words. So only frequent phrases are written out, and counts are of texts and not of fingerprints.

Defined cases: a null text is empty and a null lang is `und`. Repeated rows count as often as they stand there. A piece
longer than a block is cut between words, with the next words as look-ahead, so that each n-gram counts once; a single
word is never cut. An empty table gives an empty table. doc_id and extra columns are not read.
"""

from __future__ import annotations

import uuid
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, as_bytes, forget, mix, owned, saved, shared_folder, slices

BLOCK = 2 << 20
BUCKET = 4 << 20  # bytes of text for each bucket of fingerprints
PARTS = 64  # keys that a language's phrases are dealt over ahead of the last ranking
BITS = 40  # of a fingerprint that move: fewer only make more collisions, whose occurrences count by their own words
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse among 64-bit words
#: Fixed values of the contract: what ends a piece, and what parts words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
KIND = np.array([2 if b in ENDS else 1 if b in GAPS else 0 for b in range(256)], dtype=np.uint8)
BYTES = mix(np.arange(1, 257, dtype=U64))


_kept: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i up to n, modulo 2^64; kept for the next call."""
    if not _kept or len(_kept[0]) <= n:
        _kept[:] = [np.cumprod(np.append(U64(1), np.full(max(n, BLOCK) + 1, b, dtype=U64))) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _kept[0][: n + 1], _kept[1][: n + 1]


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], from prefix sums."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Block:
    """The words of a block, their hashes and its n-grams."""

    def __init__(self, lang: str, text: bytes, own: int, bits: int = 64):
        raw = np.frombuffer(text, dtype=np.uint8)
        kind = KIND[raw]
        word = np.zeros(len(raw) + 2, dtype=bool)
        word[1:-1] = kind == 0
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends, self.text, self.bits = edge[::2], edge[1::2], text, bits
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        self.own = int(np.searchsorted(self.starts, own))  # words that begin later are look-ahead
        self.hashes = mix(ranges(BYTES[raw], self.starts, self.ends) + (self.ends - self.starts).astype(U64))
        name = BYTES[np.frombuffer(b"lang " + lang.encode(), dtype=np.uint8)]
        self.raw, self.seed = raw, ranges(name, np.array([0]), np.array([len(name)]))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, fingerprints) of all n-grams that begin in the block's own part, places being numbers of words."""
        last = min(self.own, len(self.starts) - n + 1)
        if last <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        at = np.flatnonzero(self.piece[:last] == self.piece[n - 1 : n - 1 + last])
        prints = mix(ranges(self.hashes, at, at + n) + self.seed * U64(2 * n + 1))
        return at, (prints >> U64(64 - self.bits)) << U64(64 - self.bits)

    def numbers(self) -> np.ndarray:
        """A number for each different word: by hash, then held against the bytes of one occurrence."""
        _, first, number = np.unique(self.hashes, return_index=True, return_inverse=True)
        sizes = self.ends - self.starts
        other = first[number]
        wrong = sizes != sizes[other]
        same = np.flatnonzero(~wrong)
        same = same[other[same] != same]
        for part in np.array_split(same, 1 + int(sizes[same].sum()) // (1 << 18)):  # some bytes at a time
            n = sizes[part]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differs = self.raw[np.repeat(self.starts[part], n) + within] != self.raw[np.repeat(self.starts[other[part]], n) + within]
            wrong[np.repeat(part, n)[differs]] = True
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(wrong):
            number[i] = more.setdefault(self.text[self.starts[i] : self.ends[i]], len(first) + len(more))
        return number

    def phrase(self, place: int, n: int) -> str:
        return b" ".join(self.text[self.starts[place] : self.ends[place + n - 1]].split()).decode("utf-8", "replace")


def cut_text(text: bytes, most: int, words: int):
    """(part, own) of a text: parts of at most about `most` bytes that end between pieces; inside one, between words."""
    if len(text) <= most:
        yield text, len(text)
        return
    kind = KIND[np.frombuffer(text, dtype=np.uint8)]
    ends = np.flatnonzero(kind == 2) + 1
    word = np.append(kind == 0, False)
    heads = np.flatnonzero(word[:-1] & np.append(True, ~word[:-2]))
    begin = 0
    while begin < len(text):
        if len(text) - begin <= most:
            yield text[begin:], len(text) - begin
            return
        k = int(np.searchsorted(ends, begin + most, "right"))
        if k and ends[k - 1] > begin:
            yield text[begin : ends[k - 1]], int(ends[k - 1]) - begin
            begin = int(ends[k - 1])
            continue
        k = int(np.searchsorted(heads, begin + most, "right"))
        k += bool(k and heads[k - 1] <= begin)  # a word longer than a part stays whole
        upto = int(heads[k - 1]) if k and k <= len(heads) and heads[k - 1] > begin else len(text)
        beyond = int(np.searchsorted(heads, upto)) + words
        ahead = int(heads[beyond]) if beyond < len(heads) else len(text)
        yield text[begin:ahead], upto - begin
        begin = upto


def _blocks(size: int, words: int):
    def run(batches):
        from pyspark import TaskContext

        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32
        names = ["block", "lang", "own", "text"]

        def row(lang: str, text: bytes, own: int):
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([own]), pa.array([text], pa.binary())], names=names)

        for batch in slices(batches):
            for lang, whole in zip(batch["lang"].to_pylist(), as_bytes(batch["text"]), strict=True):
                lang = "und" if lang is None else lang
                for part, own in cut_text(whole.translate(LOWER), size, words):
                    if own < len(part):
                        yield row(lang, part, own)
                        continue
                    while sizes.get(lang, 0) + len(part) >= size and lang in sizes or sum(sizes.values()) >= 2 * size:
                        full = lang if sizes.get(lang, 0) + len(part) >= size and lang in sizes else max(sizes, key=sizes.get)
                        text = b"\n".join(held.pop(full))
                        yield row(full, text, len(text))
                        del sizes[full]
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
        for lang, parts in held.items():
            text = b"\n".join(parts)
            yield row(lang, text, len(text))

    return run


def by_planes(x: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all second ones, and so on: bytes that are alike stand together and compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def of_planes(blobs: list[bytes], kind: str) -> np.ndarray:
    """The numbers of several by_planes(), one after another."""
    size = np.dtype(kind).itemsize
    parts = [np.frombuffer(x, dtype=np.uint8).reshape(size, -1).T for x in blobs]
    return np.concatenate(parts).reshape(-1).view(kind) if parts else np.zeros(0, dtype=kind)


def bucket_of(fp: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each fingerprint; rises with it."""
    return ((fp >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


#: One occurrence a fingerprint, by planes: fps rise; counts; places are 8 * word + n.
SENT = "bucket int, block long, fps binary, counts binary, places binary"


def _sent(block: int, found: list[tuple[int, np.ndarray, np.ndarray]], buckets: int) -> pa.Table:
    prints, counts, places = [], [], []
    for n, at, fp in found:
        u, first, c = np.unique(fp, return_index=True, return_counts=True)
        prints.append(u)
        counts.append(c)
        places.append(at[first] * 8 + n)
    fp, c, p = (np.concatenate(x) if x else np.zeros(0, dtype=U64) for x in (prints, counts, places))
    order = np.argsort(fp, kind="stable")
    fp, c, p = fp[order], c[order].astype("<u4"), p[order].astype("<u4")
    number = bucket_of(fp, buckets)
    some, starts = np.unique(number, return_index=True)
    ends = np.append(starts, len(fp))[1:]
    cut = lambda x: pa.array([by_planes(x[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())
    return pa.table({"bucket": pa.array(some, pa.int32()), "block": pa.array(np.full(len(some), block), pa.int64()), "fps": cut(fp), "counts": cut(c), "places": cut(p)})


def _read(table: pa.Table, bits: int) -> Block:
    return Block(table["lang"][0].as_py(), table["text"][0].as_py(), table["own"][0].as_py(), bits)


def _short(buckets: int, bits: int):
    """Words and pairs of a block."""

    def run(table: pa.Table) -> pa.Table:
        b = _read(table, bits)
        return _sent(table["block"][0].as_py(), [(n, *b.grams(n)) for n in (1, 2)], buckets)

    return run


def _long(buckets: int, bits: int, most: int):
    """N-grams of three words and more of which all pairs are frequent."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, [], buckets)
        b, (prints, _) = _read(table, bits), _known(known)
        at, fp = b.grams(2)
        good = np.zeros(len(b.starts) + most, dtype=bool)
        good[at[np.isin(fp, prints)]] = True
        found = []
        for n in range(3, most + 1):
            at, fp = b.grams(n)
            ok = np.ones(len(at), dtype=bool)
            for k in range(n - 1):
                # a pair that begins in the look-ahead is judged by another block
                ok &= good[at + k] | (at + k >= b.own)
            found.append((n, at[ok], fp[ok]))
        return _sent(table["block"][0].as_py(), found, buckets)

    return run


def _frequent(least: int):
    """In a bucket: the fingerprints found at least `least` times, back to each block that sent them."""

    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: of_planes(table[name].to_pylist(), kind)
        fp, counts, places = join("fps", "<u8"), join("counts", "<u4"), join("places", "<u4")
        order = np.argsort(fp, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(fp[order]) != 0))
        sums = np.add.reduceat(counts[order].astype(np.int64), heads)
        stays = np.zeros(len(fp), dtype=bool)
        stays[order] = np.repeat(sums >= least, np.diff(np.append(heads, len(fp))))
        ends = np.cumsum([len(x) // 8 for x in table["fps"].to_pylist()])
        cut = lambda x: pa.array([by_planes(x[a:b][stays[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())
        return pa.table({"block": table["block"], "fps": cut(fp), "places": cut(places)})

    return run


def _known(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints in order, places) that came back to a block."""
    fp, places = of_planes(table["fps"].to_pylist(), "<u8"), of_planes(table["places"].to_pylist(), "<u4")
    order = np.argsort(fp, kind="stable")
    return fp[order], places[order]


#: A block's phrases of one bucket in order, as zstd of lines; their numbers of words and counts, by planes.
FOUND = "bucket int, lang string, size int, phrases binary, words binary, counts binary"


def _materialise(bits: int, most: int, buckets: int):
    """The texts of frequent fingerprints of a block, each with its count; no words and no text has the number of words."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes, int]] = []
        if table.num_rows:
            b, (prints, places) = _read(table, bits), _known(known)
            number = b.numbers()
            rows.append((0, 0, b"", b.own))
            for n in range(1, most + 1):
                at, fp = b.grams(n)
                mine = np.flatnonzero(places % 8 == n)
                if not len(mine) or not len(at):
                    continue
                keys = prints[mine]
                i = np.minimum(np.searchsorted(keys, fp), len(keys) - 1)
                hit = keys[i] == fp
                at, i = at[hit], i[hit]
                place = (places[mine] // 8).astype(np.int64)
                same = np.ones(len(at), dtype=bool)
                for k in range(n):
                    same &= number[at + k] == number[place[i] + k]
                f = np.bincount(i[same], minlength=len(keys))
                to = bucket_of(keys, buckets)
                rows += [(to[j], n, b.phrase(place[j], n).encode(), f[j]) for j in np.flatnonzero(f)]
                rows += [(to[j], n, b.phrase(p, n).encode(), 1) for p, j in zip(at[~same], i[~same], strict=True)]  # collisions, each by its own words
        rows.sort()
        lang = table["lang"][0].as_py() if table.num_rows else None
        out = [[] for _ in range(6)]
        for bucket, some in groupby(rows, key=lambda x: x[0]):
            _, n, phrases, f = zip(*some, strict=True)
            lines = b"\n".join(phrases)  # a newline parts words and pieces, so no phrase has one
            row = (bucket, lang, len(lines), pa.compress(lines, "zstd", asbytes=True), bytes(n), by_planes(np.array(f, dtype="<i8")))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["bucket", "lang", "size", "phrases", "words", "counts"])

    return run


def _summed(least: int):
    """(lang, n, phrase, f) in a bucket: phrases found at least `least` times, and the numbers of words."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for row in table.to_pylist():
            phrases = pa.decompress(row["phrases"], row["size"], "zstd", asbytes=True).decode().split("\n")
            n, f = np.frombuffer(row["words"], dtype=np.uint8).astype(np.int32), of_planes([row["counts"]], "<i8")
            parts.append(pa.table({"lang": pa.array([row["lang"]] * len(n), pa.string()), "n": n, "phrase": pa.array(phrases, pa.string()), "f": f}))
        found = pa.concat_tables(parts).group_by(["lang", "n", "phrase"]).aggregate([("f", "sum")])
        stays = pc.or_(pc.greater_equal(found["f_sum"], least), pc.equal(found["n"], 0))
        return found.filter(stays).rename_columns(["lang", "n", "phrase", "f"])

    return run


def count_phrases(docs: DataFrame, least: int, most: int = 4, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(lang, n, phrase, f): all phrases of 1 to `most` words found at least `least` times; n = 0 has the number of words."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    owned(path)
    made = docs.select("lang", "text").mapInArrow(_blocks(block, most - 1), "block long, lang string, own long, text binary")
    # written once, bucketed: every pass finds the texts where they are, and only fingerprints move
    made.repartition(parts, "block").write.bucketBy(parts, "block").sortBy("block").option("path", path).saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name goes: the files are in a folder of their own
    blocks.saved_path = path
    size = blocks.agg(F.sum("own")).first()[0] or 0
    buckets = max(parts, -(-size // BUCKET))
    groups = blocks.groupBy("block")
    back = "block long, fps binary, places binary"
    short = saved(groups.applyInArrow(_short(buckets, bits), SENT).groupBy("bucket").applyInArrow(_frequent(least), back))
    longer = groups.cogroup(short.groupBy("block")).applyInArrow(_long(buckets, bits, most), SENT)
    longer = saved(longer.groupBy("bucket").applyInArrow(_frequent(least), back))
    texts = groups.cogroup(short.union(longer).groupBy("block")).applyInArrow(_materialise(bits, most, buckets), FOUND)
    counts = saved(texts.groupBy("bucket").applyInArrow(_summed(least), "lang string, n int, phrase string, f long"))
    for table in (blocks, short, longer):
        forget(table)
    return counts


def collocations(docs: DataFrame, least: int = 30, most: int = 4, share: int = 80, top: int = 2000, scale: int = 2_000_000, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `most` words.

    score is floor(scale * a / (l + r)) for the cut into two parts where that is lowest, the first of equals. Phrases that
    stand in a longer candidate with at least `share` percent of their occurrences are dropped. Numbers are exact: products
    are decimals of 38 digits.
    """
    counts = count_phrases(docs, least, most, bits, block)
    words = counts.where("n = 0").groupBy("lang").agg(F.sum("f").alias("words"))
    known = counts.where("n > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("held"))
    wide = lambda c: c.cast("decimal(19,0)")
    candidate = counts.where("n > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidate.select("lang", "phrase", "n", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    first = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k")))
    rest = F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")))
    cuts = cuts.select("lang", "phrase", "n", "a", "k", first.alias("first"), rest.alias("rest"))
    cuts = cuts.join(known.withColumnsRenamed({"part": "first", "held": "l"}), ["lang", "first"])
    cuts = cuts.join(known.withColumnsRenamed({"part": "rest", "held": "r"}), ["lang", "rest"])
    by_cut = cuts.withColumn("top", wide(F.col("a")) * F.lit(scale).cast("decimal(18,0)")).withColumn("sum", wide(F.col("l")) + wide(F.col("r")))
    by_cut = by_cut.select("lang", "phrase", "n", "a", F.struct(F.expr("top div sum").alias("score"), "k", "l", "r").alias("cut"))
    scored = by_cut.groupBy("lang", "phrase", "n", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "n", "a", "cut.score", "cut.l", "cut.r")
    # the longest count of what stands around each phrase
    inside = candidate.where("n > 2").select("lang", "n", "f", "w", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m"))
    inside = inside.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("at"))
    inside = inside.groupBy("lang", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("m"))).alias("phrase")).agg(F.max("f").alias("around"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("around").isNull() | (wide(F.col("around")) * 100 < wide(F.col("a")) * share))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    found = best.join(words, "lang")
    return found.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("words").alias("n"), F.col("score").cast("long"))
