"""Ranked lexical search: an inverted index by blocks of documents, searched by a hybrid of term-at-a-time and document-at-a-time.

build_index writes, for each block of documents, one row a term with its postings and one row with the documents' ids and
numbers of terms. search joins the terms of the queries to the index, so that only lists that are asked for move, and meets
each block with each group of queries once. In a block, a query's short lists are summed term by term into accumulators;
these are then one more iterator, bounded by their largest sum, beside the long lists in a walk over documents: lists whose
bounds together can't reach the query's last place so far are only looked up, and windows of documents whose bounds can't
reach it are skipped. Each block gives its first documents, and the first of all blocks are the result. All is exact.

Defined cases: a null text has no terms; documents without terms are in no count. Rows of one doc_id are documents of
their own. A null doc_id comes after all others among equal scores. Texts of one item_id are one query; a query without
terms, or whose terms no document holds, has no rows. Long texts are read in parts cut between terms, of whatever length.
Empty tables give an empty table. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, saved, slices

BLOCK = 16 << 20
PART = 1 << 20
WINDOW = 1024
#: Fixed values of the contract: what is no part of a term becomes a space, A-Z is lower-cased.
TERMS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
INDEX = "block long, term string, docs binary, counts binary, ids array<long>, lengths array<long>"


def terms_of(text: bytes):
    """Lists of a text's terms, part by part."""
    text, begin = text.translate(TERMS), 0
    while begin < len(text):
        end = text.find(b" ", begin + PART) if len(text) - begin > PART else -1
        end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


class _Numbers(dict):
    """A number for each term, in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """values of four bytes, cut at starts, as a binary column."""
    offsets = (np.append(starts, len(values)) * 4).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values.astype("<u4")))])


def _block(number: int, ids: list, lengths: list[int], numbers: _Numbers, terms: list[np.ndarray]) -> list[pa.RecordBatch]:
    """The rows of a block; its documents are numbered in the order of their ids."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    key = np.concatenate(terms).astype(np.int64) << 32 | np.repeat(place, lengths)
    key, counts = np.unique(key, return_counts=True)
    starts = np.flatnonzero(np.append(True, np.diff(key >> 32) != 0))
    names = ["block", "term", "docs", "counts", "ids", "lengths"]
    none = lambda n, kind: pa.nulls(n, kind)
    lists, many = pa.list_(pa.int64()), len(starts)
    words = pa.array(list(numbers), pa.binary()).cast(pa.string())
    postings = [pa.array(np.full(many, number)), words, _binary(key & 0xFFFFFFFF, starts), _binary(counts, starts), none(many, lists), none(many, lists)]
    of_docs = [[number], none(1, pa.string()), none(1, pa.binary()), none(1, pa.binary()), pa.array([[ids[i] for i in order]], lists), pa.array([[lengths[i] for i in order]], lists)]
    return [pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, list) else x for x in cols], names=names) for cols in (of_docs, postings)]


def _index(size: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, lengths, numbers, terms, held = [], [], _Numbers(), [], 0
        for batch in slices(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"]), strict=True):
                found = [np.fromiter(map(numbers.__getitem__, part), dtype=np.int32, count=len(part)) for part in terms_of(text)]
                n = sum(map(len, found))
                if not n:
                    continue
                ids.append(doc)
                lengths.append(n)
                terms += found
                held += len(text)
                if held >= size:
                    yield from _block(number, ids, lengths, numbers, terms)
                    number, held = number + 1, 0
                    ids, lengths, numbers, terms = [], [], _Numbers(), []
        if ids:
            yield from _block(number, ids, lengths, numbers, terms)

    return run


def build_index(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The inverted index of docs (doc_id, text), written to the shared folder: lists by block and term, and documents by block."""
    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index(block), INDEX))


def _asked(batches):
    for batch in slices(batches):
        items, terms = [], []
        for item, text in zip(batch["item_id"].to_pylist(), as_bytes(batch["text"]), strict=True):
            for part in terms_of(text):
                items += [item] * len(part)
                terms += part
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string())], names=["item_id", "term"])


def _largest(docs: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The `top` highest scores, the smaller document of equals."""
    best = np.lexsort((docs, -scores))[:top]
    return docs[best], scores[best]


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, top: int, short: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the `top` highest sums over lists of (rising documents, scores).

    Lists are short, the shortest first, as long as together they have at most `short` postings. seen, if given, gets
    the number of postings of long lists that were read in the walk and the number that they have.
    """
    lists = sorted(lists, key=lambda x: len(x[0]))
    total = np.cumsum([len(d) for d, _ in lists])
    few = int(np.searchsorted(total, short, "right"))
    walk, best, floor = lists[few:], (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), 0
    if few:
        docs, scores = (np.concatenate([x[k] for x in lists[:few]]) for k in (0, 1))
        order = np.argsort(docs, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(docs[order]) != 0))
        sums = np.add.reduceat(scores[order], heads)
        if not walk:
            return _largest(docs[order][heads], sums, top)
        walk = [(docs[order][heads], sums), *walk]
        if len(sums) >= top:  # sums only grow, so the last place has at least this
            floor = int(np.partition(sums, -top)[-top])
    walk.sort(key=lambda x: int(x[1].max()))
    bounds = np.cumsum([int(s.max()) for _, s in walk])
    read = 0
    for low in range(0, n_docs, WINDOW):
        rest = int(np.searchsorted(bounds, floor))  # those before can't reach the floor, even together
        if rest == len(walk):
            break
        size = min(WINDOW, n_docs - low)
        parts = []
        for docs, scores in walk[rest:]:
            a, b = np.searchsorted(docs, (low, low + size))
            if a < b:
                parts.append((docs[a:b] - low, scores[a:b]))
        beside = int(bounds[rest - 1]) if rest else 0
        if not parts or sum(int(s.max()) for _, s in parts) + beside < floor:
            continue
        held, some = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
        for docs, scores in parts:
            held[docs] += scores
            some[docs] = True
            read += len(docs)
        found = np.flatnonzero(some)
        held = held[found]
        for k in range(rest - 1, -1, -1):
            stays = held + bounds[k] >= floor
            found, held = found[stays], held[stays]
            docs, scores = walk[k]
            at = np.minimum(np.searchsorted(docs, found + low), len(docs) - 1)
            held = held + np.where(docs[at] == found + low, scores[at], 0)
            read += len(found)
        best = _largest(np.append(best[0], found + low), np.append(best[1], held), top)
        if len(best[1]) == top:
            floor = max(floor, int(best[1][-1]))
    if seen is not None:
        seen.append((read, sum(len(d) for d, _ in walk)))
    return best


def _ranked(n: int, total: int, top: int, short_share: int):
    """The first documents of one block for each item of a group."""

    def run(lists: pa.Table, of_docs: pa.Table) -> pa.Table:
        out = {"item_id": [], "doc_id": [], "score": []}
        if lists.num_rows and of_docs.num_rows:
            ids = of_docs["ids"][0].as_py()
            m = 75 + 25 * np.array(of_docs["lengths"][0].as_py(), dtype=np.int64) * n // total
            known, items = [], {}
            for docs, counts, weight, uses in zip(*(lists[c].to_pylist() for c in ("docs", "counts", "weight", "uses")), strict=True):
                docs, tf = np.frombuffer(docs, dtype="<u4").astype(np.int64), np.frombuffer(counts, dtype="<u4").astype(np.int64)
                known.append((docs, weight * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))))
                for use in uses:
                    items.setdefault(use["item_id"], []).append((len(known) - 1, use["times"]))
            for item, terms in items.items():
                own = [(known[k][0], known[k][1] * times) for k, times in terms]
                docs, scores = best_documents(own, len(ids), top, max(top, len(ids) // short_share))
                docs, scores = docs[scores > 0], scores[scores > 0]
                out["item_id"] += [item] * len(docs)
                out["doc_id"] += [ids[d] for d in docs]
                out["score"] += scores.tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def search(index: DataFrame, queries: DataFrame, top: int = 20, group: int = 256, short_share: int = 8) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` highest-scoring documents of the index for each of queries (item_id, text).

    Queries are dealt into groups of about `group` by hash; a posting list goes once to each group that asks for it.
    """
    documents = index.where("term is null").select("block", "ids", "lengths")
    counted = documents.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
    n, total = counted["n"] or 0, counted["total"] or 1
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_asked, "item_id long, term string")
    asked = saved(asked.groupBy("item_id", "term").agg(F.count("*").alias("times")))
    groups = -(-asked.select("item_id").distinct().count() // group) or 1
    wanted = saved(index.where("term is not null").select("block", "term", "docs", "counts").join(asked.select("term").distinct(), "term", "left_semi"))
    held = wanted.groupBy("term").agg(F.sum(F.octet_length("docs") / 4).cast("long").alias("held"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2.0) / (F.col("held") * 2 + 1))).cast("long")
    uses = asked.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int").alias("group"), "term").agg(F.collect_list(F.struct("item_id", "times")).alias("uses"))
    uses = uses.join(held.select("term", weight.alias("weight")), "term")
    lists = wanted.join(uses, "term").select("block", "group", "docs", "counts", "weight", "uses")
    every = documents.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = lists.groupBy("block", "group").cogroup(every.groupBy("block", "group")).applyInArrow(_ranked(n, total, top, short_share), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
