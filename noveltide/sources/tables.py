"""Tables that change safely: several together by versions, and one by keys."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .files import _exists

BUCKETS = 64
BUCKET = "key_bucket"


class Tables:
    """Named Parquet tables under one root that change together.

    commit writes new tables to folders of their own and then one small file with the next number, which names the folder of
    every table. Until that file is there, all readers see the version before, whatever fails; a reader of a version stays on
    it. Two writers can't take one number: the file is created only where there is none. Old folders stay until vacuum.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, folder = self._path("versions")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()) if fs.exists(folder) else []

    def entry(self, version: int) -> dict | None:
        """What a version says; null for one whose file is not whole."""
        fs, path = self._path("versions", f"{version:09d}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def history(self) -> list[tuple[int, dict]]:
        """(version, entry) of all whole versions, oldest first."""
        return [(n, e) for n in self._numbers() if (e := self.entry(n)) is not None]

    def current(self) -> tuple[int, dict]:
        """The last whole version and its entry; 0 and no tables at first."""
        for n in reversed(self._numbers()):
            if (e := self.entry(n)) is not None:
                return n, e
        return 0, {"tables": {}}

    def read(self, name: str, version: int | None = None, schema=None) -> DataFrame:
        """A table as of a version, the last by default; with a schema, a table that is not there is empty."""
        entry = self.current()[1] if version is None else self.entry(version)
        if name not in entry["tables"]:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{entry['tables'][name]}")

    def commit(self, changed: dict[str, DataFrame | None], base: int | None = None, **notes) -> int:
        """A version with the changed tables (None drops one) over those of `base`, the last by default; its number.

        With base, the commit fails if another version came after it.
        """
        now, entry = self.current()
        if base is not None and base != now:
            raise RuntimeError(f"version {base} is not the last: {now} is")
        tables = dict(entry["tables"])
        for name, df in changed.items():
            tables.pop(name, None)
            if df is not None:
                tables[name] = f"data/{uuid.uuid4().hex}/{name}"
                df.write.parquet(f"{self.root}/{tables[name]}")
        return self._publish({"tables": tables, **notes}, now)

    def restore(self, version: int, **notes) -> int:
        """All tables as they were in an older version, as one new version; nothing is copied."""
        return self._publish({"tables": self.entry(version)["tables"], **notes}, self.current()[0])

    def _publish(self, entry: dict, base: int) -> int:
        numbers = self._numbers()
        if [n for n in numbers if n > base and self.entry(n) is not None]:
            raise RuntimeError(f"another version came after {base}")
        number = max([base, *numbers]) + 1  # numbers of files that are not whole are not taken again
        fs, path = self._path("versions", f"{number:09d}")
        stream = fs.create(path, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        return number

    def vacuum(self, keep: int = 2) -> None:
        """Deletes folders that none of the last `keep` versions has."""
        used = {folder.split("/")[1] for _, e in self.history()[-keep:] for folder in e["tables"].values()}
        fs, data = self._path("data")
        for x in fs.listStatus(data) if fs.exists(data) else []:
            if x.getPath().getName() not in used:
                fs.delete(x.getPath(), True)


def upsert(rows: DataFrame, path: str, key: list[str], newest: list[str] | None = None, kind: str = "parquet", buckets: int = BUCKETS) -> None:
    """Puts rows into a table with one row a key; of several rows of one key the last by `newest` stays.

    Without newest, what is there stays, and of new rows the smallest. The table lies in folders by a hash of the key; only
    those that get rows are read and written again. Running it again with the same rows changes nothing.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in key]
    number = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    fresh = rows.select(*key, *rest, F.lit(1).alias("_new"))
    if _exists(spark, path):
        touched = [r[0] for r in rows.select(number).distinct().collect()]  # at most `buckets` numbers
        schema = StructType([*rows.schema.fields]).add(BUCKET, IntegerType())
        there = spark.read.format(kind).schema(schema).load(path).where(F.col(BUCKET).isin(touched))
        fresh = there.select(*key, *rest, F.lit(0).alias("_new")).union(fresh)
    whole = F.struct(*([] if newest else ["_new"]), *rest)
    best = F.max_by(whole, F.struct(*newest, "_new", *[c for c in rest if c not in newest])) if newest else F.min(whole)
    one = fresh.groupBy(*key).agg(best.alias("_row")).select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns], number.alias(BUCKET))
    one.repartition(F.col(BUCKET)).write.format(kind).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).save(path)
