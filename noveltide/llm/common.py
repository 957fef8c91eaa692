"""Shared pieces of the training-data operators: durable intermediates, Arrow slices, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the word contracts; also what bytes.split() and bytes.strip() use.
SPACE = b" \t\n\x0b\x0c\r"
U64 = np.uint64
_owned: list[list[str]] = []  # paths written inside each open scratch()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    back = saved_outside(df)
    owned(back.saved_path)
    return back


def owned(path: str) -> None:
    """The innermost open scratch(), if there is one, deletes this folder at its end."""
    if _owned:
        _owned[-1].append(path)


def saved_outside(df: DataFrame) -> DataFrame:
    """saved() for a result that outlives the scratch() it is made in."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # what was shuffled for the table is not needed once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_path = path
    return back


@contextmanager
def scratch(spark: SparkSession):
    """Owns the intermediates: what saved() writes inside is deleted at the end. Write the result before that.

        with scratch(spark):
            dedup_lines(docs).write.parquet(path)
    """
    _owned.append([])
    try:
        yield
    finally:
        for name in _owned.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a saved() or components() table; only where every user has itself been saved."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `rows` rows, so that Python objects of one slice stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """A string column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def map_arrow(df: DataFrame, fn: Callable, schema: str, keep: object = None) -> DataFrame:
    """mapInArrow where fn(slice) gives the columns of `schema` in order, for slices of at most 1000 rows.

    Of what is held in a worker only `keep` is there for fn; a worker that waits for its next task keeps no freed memory.
    """
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches):
        let_go(keep)
        for part in slices(batches):
            arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(part)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        arrays = part = None
        let_go(keep)

    return df.mapInArrow(run, schema)


_held: dict = {}


def held(key: object, make: Callable):
    """What make() gives, kept by this worker for its next tasks until let_go(). Its rest(), if it has one, drops what it can spare between tasks."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def let_go(keep: object = None) -> None:
    """Drops what earlier tasks of other operators left in this worker, but for the key `keep`, ahead of work that needs much memory.

    Freed memory goes back to the system as well: the C library else keeps it, and a worker stays as large as it ever was.
    """
    for key in [k for k in _held if k != keep]:
        del _held[key]
    for kept in _held.values():
        getattr(kept, "rest", lambda: None)()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # no glibc: its own rules hold


def free_name(columns: list[str], name: str) -> str:
    """A column name like `name` that is not among the columns (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, kept between calls and emptied when too many."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, in order and with repeats; shorter sequences give one for the whole."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, dtype=U64)
    for k in range(width):
        out = (out ^ words[k : len(words) - width + 1 + k]) * U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
    return mix(out)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list, as (id, component_id) with the smallest id reachable.

    Alternates large-star and small-star joins until the edges no longer change; each round is written to the
    shared folder. Ids that are only their own component (or have no edge) are not returned. Nulls are ignored.
    """
    e = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v and u is not null and v is not null")
        .distinct()
    )
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        )
        before, e = e, saved(small.select("col.*").where("u <> v").distinct())
        forget(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            found = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            found.saved_path = e.saved_path
            return found
        mark = now
