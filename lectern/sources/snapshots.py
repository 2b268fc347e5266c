"""Versioned Parquet tables in buckets: a write makes new folders for the buckets it touches, and a version names all in force.

A version is a small JSON file, made only if it isn't there: of two writers that began from the same version one wins, and the
other's write fails and leaves nothing. Readers of the last versions aren't disturbed; folders that none of these name are
removed. Paths may be on any file system that Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, KEEP = 32, 2


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


class SnapshotTable:
    """key tells rows apart; rows of one key always have the same value of ``within``, by which buckets are made."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", within: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.within, self.buckets = spark, path.rstrip("/"), key, within or key, buckets

    # -- versions ------------------------------------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.path}/_versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The version in force; 0 if nothing was written."""
        return max(self._numbers(), default=0)

    def _current(self, version: int) -> dict[int, str]:
        """Bucket -> the write whose folder is in force."""
        if not version:
            return {}
        raw = self.spark.sparkContext.wholeTextFiles(f"{self.path}/_versions/{version}.json").first()[1]
        return {int(k): v for k, v in json.loads(raw).items()}

    def _commit(self, before: int, current: dict[int, str], written: str | None) -> int:
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.path}/_versions"))
        try:
            out = fs.create(path(f"{self.path}/_versions/{before + 1}.json"), False)
        except Exception as e:
            if written:
                fs.delete(path(f"{self.path}/{written}"), True)
            raise Conflict(f"version {before + 1} of {self.path} was made by another writer") from e
        out.write(json.dumps(current).encode())
        out.close()
        self._clear()
        return before + 1

    def _clear(self) -> None:
        fs, path = self._fs()
        numbers = self._numbers()
        used = {w for n in numbers[-KEEP:] for w in self._current(n).values()}
        for n in numbers[:-KEEP]:
            for w in set(self._current(n).values()) - used:
                fs.delete(path(f"{self.path}/{w}"), True)
            fs.delete(path(f"{self.path}/_versions/{n}.json"), False)

    # -- reading -------------------------------------------------------------------------------------------------------

    def _open(self, current: dict[int, str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{w}/__b={b}" for b, w in sorted(current.items())])

    def read(self) -> DataFrame | None:
        """The rows in force; None before the first write. A table whose rows are all deleted keeps its columns."""
        v = self.version()
        if not v:
            return None
        current = self._current(v)
        if current:
            return self._open(current)
        return self.spark.read.schema(self._schema(v)).parquet(f"{self.path}/_empty") if self._schema(v) else None

    def _schema(self, version: int) -> str | None:
        fs, path = self._fs()
        place = f"{self.path}/_meta/schema.txt"
        if not fs.exists(path(place)):
            return None
        fs.mkdirs(path(f"{self.path}/_empty"))
        return self.spark.sparkContext.wholeTextFiles(place).first()[1]

    def count(self) -> int:
        rows = self.read()
        return rows.count() if rows is not None else 0

    def get(self, key: str) -> dict | None:
        rows = self.read()
        row = rows.where(F.col(self.key) == key).first() if rows is not None else None
        return row.asDict(recursive=True) if row else None

    def page(self, where: Column | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        rows = self.read()
        rows = (rows if where is None else rows.where(where)).orderBy("seq").offset(offset)
        return rows if limit is None else rows.limit(limit)

    # -- writing -------------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.within), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, before: int, current: dict[int, str], touched: list[int]) -> int:
        """rows take the place of all rows of the touched buckets."""
        written = f"w-{uuid.uuid4().hex}"
        rows.withColumn("__b", self._bucket()).repartition("__b").sortWithinPartitions("__b", self.key).write.partitionBy("__b").parquet(f"{self.path}/{written}")
        fs, path = self._fs()
        made = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{written}"))]
        new = {b: w for b, w in current.items() if b not in touched} | {int(n.split("=")[1]): written for n in made if n.startswith("__b=")}
        if not new:
            out = fs.create(path(f"{self.path}/_meta/schema.txt"), True)
            out.write(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema).encode())
            out.close()
        return self._commit(before, new, written)

    def replace(self, rows: DataFrame) -> int:
        return self._write(rows, self.version(), {}, [])

    def merge(self, rows: DataFrame, on: str | None = None, gone: DataFrame | None = None) -> int:
        """rows in place of those that have one of their (or of ``gone``'s) values of ``on``: the key, or what buckets go by."""
        on, before = on or self.key, self.version()
        drop = rows.select(on).distinct() if gone is None else rows.select(on).unionByName(gone.select(on)).distinct()
        touched = sorted(r[0] for r in (drop if on == self.within else rows).select(self._bucket().alias("b")).distinct().collect())  # at most BUCKETS
        current = self._current(before)
        held = {b: w for b, w in current.items() if b in touched}
        if held:
            rows = self._open(held).join(drop, on, "left_anti").unionByName(rows, allowMissingColumns=True)
        return self._write(rows, before, current, touched) if touched else before

    def upsert(self, rows: DataFrame) -> int:
        return self.merge(rows.dropDuplicates([self.key]))

    def delete(self, condition: Column) -> int:
        before = self.version()
        old, hit = self.read(), F.coalesce(condition, F.lit(False))
        touched = sorted(r[0] for r in old.where(hit).select(self._bucket().alias("b")).distinct().collect()) if old is not None else []
        if not touched:
            return before
        current = self._current(before)
        return self._write(self._open({b: current[b] for b in touched}).where(~hit), before, current, touched)

    def delete_ids(self, ids: list[str]) -> int:
        return self.delete(F.col(self.key).isin(ids)) if ids else self.version()


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """The latest row of each key."""
    both = old.unionByName(new)
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), order).alias("r"))
    return latest.select("r.*")
