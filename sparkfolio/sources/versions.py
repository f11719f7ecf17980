"""Tables of a folder under one pointer: a commit changes several of them at once, and a reader sees it whole or not at all.

Each table's rows lie in Parquet files that hold a range of keys each.  A commit that replaces keys writes anew the files whose
ranges hold one of them, and no other; what it wrote is named by a list of all tables' files, whose last version counts.  Old
files stay until ``vacuum``, so whoever opened an earlier version goes on reading it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "name string, path string, low string, high string, key string, rows long, fields string"


class Conflict(RuntimeError):
    """Another commit came between."""


@dataclass(frozen=True)
class Change:
    """What a commit does to a table.  key: the column by which its rows are replaced; rows: new rows, or None; replaced: rows (key)
    whose rows go, those of the new rows' keys too; everything: all rows go."""

    key: str
    rows: DataFrame | None = None
    replaced: DataFrame | None = None
    everything: bool = False


@dataclass(frozen=True)
class Snapshot:
    """The tables as a commit left them; -1: nothing was committed yet."""

    spark: SparkSession = field(repr=False)
    root: str
    version: int

    def files(self, name: str | None = None) -> DataFrame:
        """Rows (name, path, low, high, key, rows, fields): a table without rows has one without a path."""
        if self.version < 0:
            return self.spark.createDataFrame([], LIST)
        rows = self.spark.read.schema(LIST).parquet(f"{self.root}/_versions/{self.version}")
        return rows if name is None else rows.where(F.col("name") == name)

    def table(self, name: str) -> DataFrame:
        """Rows of a table."""
        from pyspark.sql.types import StructType

        found = self.files(name).select("path", "fields").collect()
        if not found:
            raise KeyError(name)
        import json

        schema = StructType.fromJson(json.loads(found[0].fields))
        paths = [r.path for r in found if r.path]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def names(self) -> list[str]:
        return sorted(r.name for r in self.files().select("name").distinct().collect())


def _folder(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that were committed and not cleared away."""
    path, fs = _folder(spark, f"{root}/_versions")
    if not fs.exists(path):
        return []
    done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(_folder(spark, f"{root}/_versions/{s.getPath().getName()}/_SUCCESS")[0])]
    return sorted(int(n) for n in done if n.isdigit())


def opened(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The last version, or an earlier one."""
    known = versions(spark, root)
    if version is not None and version not in known:
        raise KeyError(version)
    return Snapshot(spark, root, version if version is not None else max(known, default=-1))


def _written(df: DataFrame, root: str, name: str, key: str) -> DataFrame:
    """Writes rows dealt by ranges of the key; rows of the list of files."""
    spark, path = df.sparkSession, f"{root}/{name}/{uuid.uuid4().hex}"
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(path)
    ordered = F.col(key)
    files = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(ordered).cast("string").alias("low"), F.max(ordered).cast("string").alias("high"), F.count("*").alias("rows"))
    return files.select(F.lit(name).alias("name"), "path", "low", "high", F.lit(key).alias("key"), "rows", F.lit(df.schema.json()).alias("fields"))


def _touched(files: DataFrame, keys: DataFrame, key: str) -> list[str]:
    """Files whose range of keys holds one of the keys; a list of files is small, the keys need not be."""
    kind = keys.schema[key].dataType
    ranges = F.broadcast(files.where("path is not null").select("path", F.col("low").cast(kind).alias("low"), F.col("high").cast(kind).alias("high")))
    met = keys.join(ranges, F.col(key).between(F.col("low"), F.col("high")) | (F.col(key).isNull() & F.col("low").isNull())).select("path").distinct()
    return [r.path for r in met.collect()]


def commit(base: Snapshot, changes: dict[str, Change]) -> Snapshot:
    """Writes the changes of all tables and then, at once, the list that makes them count.

    A table that a change names for the first time is made.  If another commit came after ``base``, nothing counts and Conflict is
    raised.  Nulls are keys like others.
    """
    spark, root = base.spark, base.root
    parts = [base.files().where(~F.col("name").isin(list(changes)))] if changes else [base.files()]
    for name, change in changes.items():
        files, key = base.files(name), change.key
        known = files.head(1)
        if change.rows is None and not known:
            raise KeyError(name)
        schema = change.rows.schema if change.rows is not None else base.table(name).schema
        kept, rows = files.where(F.lit(False)), change.rows
        if known and not change.everything:
            keys = [f.select(key) for f in (change.rows, change.replaced) if f is not None]
            gone = (keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])).distinct()
            paths = _touched(files, gone, key)
            kept = files.where(F.col("path").isNotNull() & ~F.col("path").isin(paths)) if paths else files.where("path is not null")
            if paths:
                renamed = gone.withColumnRenamed(key, "_gone")
                stay = spark.read.schema(schema).parquet(*paths)
                stay = stay.join(renamed, stay[key].eqNullSafe(renamed["_gone"]), "left_anti")
                rows = stay if rows is None else stay.unionByName(rows.select(*stay.columns))
        parts.append(kept)
        if rows is not None:
            parts.append(_written(rows, root, name, key))
        # A row without a path keeps the fields of a table that has no rows.
        parts.append(spark.createDataFrame([(name, None, None, None, key, 0, schema.json())], LIST))
    listed = parts[0]
    for more in parts[1:]:
        listed = listed.unionByName(more)
    if max(versions(spark, root), default=-1) != base.version:
        raise Conflict(f"{root}: version {base.version} isn't the last one any more")
    try:
        listed.coalesce(1).write.mode("errorifexists").parquet(f"{root}/_versions/{base.version + 1}")
    except AnalysisException as e:
        raise Conflict(str(e)) from e
    return Snapshot(spark, root, base.version + 1)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Clears away versions but the last ``keep``, and files that none of these names; the number of folders that went."""
    known = versions(spark, root)
    staying = [opened(spark, root, v) for v in known[-keep:]]
    used = {r.path.rsplit("/", 1)[0].rsplit("/", 1)[1] for s in staying for r in s.files().where("path is not null").select("path").distinct().collect()}
    gone = 0
    path, fs = _folder(spark, root)
    for table in fs.listStatus(path):
        if table.getPath().getName() == "_versions":
            continue
        for folder in fs.listStatus(table.getPath()):
            if folder.getPath().getName() not in used:
                fs.delete(folder.getPath(), True)
                gone += 1
    for v in known[:-keep]:
        fs.delete(_folder(spark, f"{root}/_versions/{v}")[0], True)
    return gone
