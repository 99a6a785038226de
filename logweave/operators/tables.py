"""Tables that are changed in place: copy-on-write of the touched buckets, and a manifest that is added last.

Rows are dealt over buckets by a hash of their keys. A change reads the buckets that it touches, writes them anew in a folder
of its own and then adds a manifest, a small file that names the folder of every bucket. Readers take the latest manifest
that is whole: they see a change wholly or not at all, and a change that fails before its manifest leaves nothing but an
unnamed folder. Two writers that began from one version want the same number: the later one gets Conflict and begins again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweave.errors import ConfigError
from logweave.scratch import written

BUCKETS = 64


class Conflict(RuntimeError):
    """Another change was made since this one began."""


def same(left: Iterable[Column], right: Iterable[Column]) -> Column:
    return reduce(Column.__and__, [a.eqNullSafe(b) for a, b in zip(left, right, strict=True)])


class Table:
    """A table in a folder of any file system; buckets hold for its whole life."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | StructType, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        if not keys or not set(keys) <= set(self.schema.names):
            raise ConfigError(f"{path}: keys are columns of the table")

    # -- manifests

    def _files(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read_text(self, name: str) -> str:
        fs, path = self._files(name)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self) -> tuple[int, dict[int, str]]:
        """(version, folder of each bucket that has rows); version 0 is the empty table."""
        fs, path = self._files(f"{self.path}/manifests")
        numbers = sorted((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(path)), reverse=True) if fs.exists(path) else []
        for n in numbers:
            try:
                found = json.loads(self._read_text(f"{self.path}/manifests/{n:012d}.json"))
                return n, {int(k): v for k, v in found["buckets"].items()}
            except (ValueError, KeyError):  # still being written
                continue
        return 0, {}

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        fs, path = self._files(f"{self.path}/manifests/{version:012d}.json")
        if fs.exists(path):
            raise Conflict(f"{self.path}: version {version} is there already")
        try:
            stream = fs.create(path, False)
        except Exception as e:  # of another writer, between the question and the creation
            if fs.exists(path):
                raise Conflict(f"{self.path}: version {version} is there already") from e
            raise
        stream.write(bytearray(json.dumps({"buckets": {str(k): v for k, v in sorted(folders.items())}}).encode()))
        stream.close()

    # -- reading

    def bucket(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: Iterable[str]) -> DataFrame:
        folders = list(folders)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """The rows of the latest version."""
        return self._rows(self.manifest()[1].values())

    # -- changes

    def _rewrite(self, version: int, folders: dict[int, str], touched: list[int], rows: DataFrame) -> int:
        """Puts rows in place of the touched buckets; the new version's number."""
        if not touched:
            return version
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        dealt = rows.select(*self.schema.names, self.bucket(*[F.col(k) for k in self.keys]).alias("_bucket"))
        dealt.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(folder)
        fs, path = self._files(folder)
        there = {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if f.getPath().getName().startswith("_bucket=")}
        left = {k: v for k, v in folders.items() if k not in touched} | {k: f"{folder}/_bucket={k}" for k in there}
        self._commit(version + 1, left)
        return version + 1

    def upsert(self, new: DataFrame, merged: dict[str, Callable[[Column, Column], Column]] | None = None) -> int:
        """Adds rows, one for each key; where the key is there, a column gets merged[column](old, new), or else the new
        value. Columns that new does not have are null in rows that are added, and stay in others."""
        merged = merged or {}
        version, folders = self.manifest()
        new = written(new.select(*[F.col(c) for c in self.schema.names if c in new.columns]).dropDuplicates(self.keys), "upsert")
        touched = [r[0] for r in new.select(self.bucket(*[F.col(k) for k in self.keys])).distinct().collect()]  # at most the buckets
        old = self._rows(folders[k] for k in touched if k in folders)
        old = old.select(*[F.col(c).alias(f"_o_{c}") for c in self.schema.names], F.lit(True).alias("_o"))
        add = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_n"))
        met = old.join(add, same([F.col(f"_o_{k}") for k in self.keys], [F.col(f"_n_{k}") for k in self.keys]), "full_outer")
        out = []
        for f in self.schema:
            was = F.col(f"_o_{f.name}")
            value = F.col(f"_n_{f.name}").cast(f.dataType) if f.name in new.columns else None
            both = was if value is None else merged[f.name](was, value) if f.name in merged else value
            only = F.lit(None).cast(f.dataType) if value is None else value
            out.append(F.when(F.col("_n").isNull(), was).when(F.col("_o").isNull(), only).otherwise(both).cast(f.dataType).alias(f.name))
        return self._rewrite(version, folders, touched, met.select(*out))

    def change(self, where: Column, values: dict[str, Column] | None) -> int:
        """Sets values in the rows that fit, or deletes these if values is None. Keys cannot be set."""
        if values and set(values) & set(self.keys):
            raise ConfigError("keys cannot be set")
        version, folders = self.manifest()
        hit = F.coalesce(where, F.lit(False))
        rows = self._rows(folders.values())
        touched = [r[0] for r in rows.where(hit).select(self.bucket(*[F.col(k) for k in self.keys])).distinct().collect()]
        rows = self._rows(folders[k] for k in touched)
        if values is None:
            rows = rows.where(~hit)
        else:
            rows = rows.withColumn("_hit", hit)
            rows = rows.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()})
        return self._rewrite(version, folders, touched, rows)

    def delete(self, where: Column) -> int:
        return self.change(where, None)
