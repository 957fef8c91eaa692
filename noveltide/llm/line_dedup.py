"""Line dedup: range-partitioned line hashes, streamed in (hash, document, position) order into keep bitmaps.

Every long enough line becomes a narrow record (128-bit hash, document, position). The records are range-partitioned
on all four fields and sorted, so even one line that stands in a third of all documents spreads over many tasks. A
task streams its runs of equal hashes; the few runs that touch a border of its range are settled by a small aggregate
afterwards. What comes back per document is a compressed bitmap of lines to keep, never text.

Defined cases: null or empty text is one empty line. A null doc_id never counts as a holder and its lines all stay.
Rows with equal doc_id count as one document; each of their texts loses lines as that document does. Extra columns
are carried through untouched, whatever their names (n_lines and n_dropped are replaced). An empty table gives an empty table.
A text is read whole at any length; its lines are one row's bitmap.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, forget, free_name, let_go, map_arrow, saved, slices

RECORD = "h1 long, h2 long, doc_id long, text_key long, pos int"


def line_records(docs: DataFrame, min_chars: int) -> DataFrame:
    """One record per line whose key has at least min_chars code points."""

    def run(part):
        h, doc, key, pos = [], [], [], []
        for d, k, text in zip(part["doc_id"].to_pylist(), part["text_key"].to_pylist(), as_bytes(part["text"]), strict=True):
            for i, line in enumerate(text.split(b"\n")):
                if len(line) < min_chars:
                    continue
                line = line.strip(SPACE).lower()
                if len(line) >= min_chars and (line.isascii() or len(line.decode("utf-8", "replace")) >= min_chars):
                    h.append(xxhash.xxh3_128_digest(line))
                    doc.append(d)
                    key.append(k)
                    pos.append(i)
        h = np.frombuffer(b"".join(h), dtype="<i8").reshape(-1, 2)
        return h[:, 0].copy(), h[:, 1].copy(), pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(pos, pa.int32())

    keyed = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")
    )
    return map_arrow(keyed, run, RECORD)


def _stream(min_docs: int):
    """Walks sorted records; gives those to drop, and those of border runs as open."""

    def settle(run: pd.DataFrame, edge: bool) -> pd.DataFrame:
        if edge:
            return run.assign(is_open=True)
        if run["doc_id"].nunique() < min_docs:
            return run.iloc[:0].assign(is_open=False)
        return run[run["doc_id"] != run["doc_id"].iat[0]].assign(is_open=False)

    def walk(parts):
        # the run not ended; no run ended yet; (hash, largest document) of a run already decided, and its first documents
        tail, first, hot, sample = None, True, None, None
        for pdf in parts:
            if hot is not None:
                same = (pdf["h1"] == hot[0]) & (pdf["h2"] == hot[1])
                yield pdf[same & (pdf["doc_id"] != hot[2])].assign(is_open=False)
                pdf = pdf[~same]
                if pdf.empty:
                    continue
                hot = None
            if tail is not None:
                pdf = pd.concat([tail, pdf], ignore_index=True)
            if pdf.empty:
                continue
            h1, h2 = pdf["h1"].to_numpy(), pdf["h2"].to_numpy()
            new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            last = new[-1] if len(new) else 0
            if len(new):
                start = new[0] if first else 0
                if first:
                    yield settle(pdf.iloc[:start], True)
                    first = False
                body = pdf.iloc[start:last]
                if len(body):
                    top = body.groupby(["h1", "h2"], sort=False)["doc_id"]
                    yield body[(top.transform("nunique") >= min_docs) & (body["doc_id"] != top.transform("max"))].assign(is_open=False)
            tail = pdf.iloc[last:]
            if first and tail["doc_id"].nunique() >= min_docs:  # it may go on on either side: leave it open, keep nothing
                yield settle(tail, True)
                tail = tail.iloc[:0]
            elif not first and tail["doc_id"].nunique() >= min_docs:
                # a long run: decided from here on. Should it reach the end of the range, the next range has to learn
                # of its largest document and that there are enough documents
                hot = (tail["h1"].iat[0], tail["h2"].iat[0], tail["doc_id"].iat[0])
                sample = tail.drop_duplicates("doc_id").iloc[:min_docs]
                yield tail[tail["doc_id"] != hot[2]].assign(is_open=False)
                tail = None
        if hot is not None:
            yield sample.assign(is_open=True)
        if tail is not None and len(tail):
            yield settle(tail, True)

    def run(batches):
        let_go()

        def frames():
            for part in slices(batches, 20_000):
                yield part.to_pandas()

        for out in walk(frames()):
            if len(out):
                yield pa.RecordBatch.from_pandas(out[["h1", "h2", "doc_id", "text_key", "pos", "is_open"]], preserve_index=False)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_key, pos) of every line that goes."""
    order = ["h1", "h2", F.col("doc_id").desc(), "pos"]
    records = saved(line_records(docs, min_chars))
    ranged = records.repartitionByRange(*order).sortWithinPartitions(*order)
    found = saved(ranged.mapInArrow(_stream(min_docs), RECORD + ", is_open boolean"))
    forget(records)
    edge = found.where("is_open")
    # at most three runs a range are open, so this holds at most three times as many keys as there are partitions
    verdict = (
        edge.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    )
    late = edge.join(F.broadcast(verdict), ["h1", "h2"]).where("doc_id <> keep")
    out = ["doc_id", "text_key", "pos"]
    return found.where("not is_open").select(out).union(late.select(out))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_key, keep_bits) for documents that lose lines: zlib over one bit a line, up to the last line lost."""

    def pack(part):
        bits = []
        for gone in part["gone"].to_pylist():
            keep = np.ones(-(-(max(gone) + 1) // 8) * 8, dtype=bool)  # whole bytes; lines beyond stay
            keep[gone] = False
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
        return part["doc_id"], part["text_key"], pa.array(bits, pa.binary())

    gone = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone"))
    return map_arrow(gone, pack, "doc_id long, text_key long, keep_bits binary")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with every repeated line dropped from `text` (all other columns kept), plus n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space and with A-Z lowered. Keys of at least min_chars code
    points in at least min_docs documents lose all lines except those in the largest doc_id that holds the key.
    """
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    doc, key, keep_bits = (free_name(docs.columns, x) for x in ("_doc", "_key", "_keep_bits"))
    bits = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).toDF(doc, key, keep_bits)
    left = docs.select(*names, "text")
    both = left.join(bits, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left").select(*names, "text", keep_bits)
    schema = left.select(*names, "text", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema

    def run(batches):
        let_go()
        for part in slices(batches):
            texts, lines, dropped = [], [], []
            for text, packed in zip(as_bytes(part["text"]), part[keep_bits].to_pylist(), strict=True):
                n, gone = text.count(b"\n") + 1, 0
                if packed is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8)).astype(bool)
                    all_lines = text.split(b"\n")
                    stay = np.ones(n, dtype=bool)
                    stay[: len(keep)] = keep[:n]
                    gone = int(n - stay.sum())
                    text = b"\n".join(x for x, k in zip(all_lines, stay, strict=True) if k)
                texts.append(text)
                lines.append(n)
                dropped.append(gone)
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [part[c] for c in names] + [kept, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_lines", "n_dropped"])
        part = texts = kept = columns = None
        let_go()

    return both.mapInArrow(run, schema)
