"""Care of a stored lake: sizes, checksums, registering, deleting, stale files, and migrations with a way back."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..operators import calendar, catalog, migrate
from . import store

BACKUP = ".backup-"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def storage_used(spark: SparkSession, root: str) -> DataFrame:
    """``n_files`` and ``n_bytes`` of the Parquet files under the root; contents aren't read."""
    return store.files(spark, root, checksums=False).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("n_bytes"))


def checksums(spark: SparkSession, root: str, cache: DataFrame) -> DataFrame:
    """The checksum cache brought up to date: only files whose path, size or time changed are read again.

    Paths that are gone leave the cache.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root)
    now = listed.where(~F.col("path").contains(".tmp.")).select(F.col("path").alias("partition_path"), F.col("length").alias("file_size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    key = ["partition_path", "file_size_bytes", "mtime_ns"]
    kept = now.join(cache.select(*key, "checksum_sha256"), key, "left")
    missed = [r[0] for r in kept.where("checksum_sha256 is null").select("partition_path").toLocalIterator()]  # names only, as the reader itself lists them
    known = kept.where("checksum_sha256 is not null")
    if not missed:
        return known
    fresh = spark.read.format("binaryFile").load(missed).select(F.col("path").alias("partition_path"), F.col("length").alias("file_size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("checksum_sha256"))
    return known.unionByName(fresh)


def register_missing(spark: SparkSession, root: str, partitions: DataFrame, version: str = schema.VERSION) -> DataFrame:
    """``partitions`` with a row for each stored file that it lacks: rows, first and last time, size and checksum."""
    files = store.files(spark, root)
    lacking = catalog.reconcile(partitions, files).where("drift = 'A'").select("partition_path").join(files, "partition_path")
    rows = store.scan(spark, root).select(*store.KEYS, "timestamp_ns", F.col("_metadata.file_path").alias("__file"))
    base = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    held = rows.groupBy(F.substring_index("__file", base, -1).alias("partition_path"), *store.KEYS).agg(F.count("*").alias("row_count"), F.min("timestamp_ns").alias("first_ts_ns"), F.max("timestamp_ns").alias("last_ts_ns"))
    new = lacking.join(held, "partition_path").withColumns({"schema_version": F.lit(version), "day": F.nullif("day", F.lit(store.MONTH))})
    types = {f.name: f.dataType for f in partitions.schema}
    return partitions.unionByName(new.select(*((F.col(c) if c in new.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items())))


def delete_partition(spark: SparkSession, root: str, partitions: DataFrame, path: str) -> DataFrame:
    """Deletes a stored partition and returns the registry without it; paths that leave the root are refused."""
    parts = path.split("/")
    if not path or path.startswith("/") or ":" in path or ".." in parts or "." in parts or "" in parts:
        raise ValueError(f"not a path below the root: {path!r}")
    store.delete(spark, f"{root.rstrip('/')}/{path}")
    return partitions.where(~((F.col("partition_path") == path) | F.col("partition_path").startswith(path + "/")))


def remove_stale(spark: SparkSession, root: str, older_s: float = 300.0) -> list[str]:
    """Deletes temporary files (``.tmp.``) of at least this age that broken writers left; returns their names."""
    fs, p = _fs(spark, root)
    gone, files = [], fs.listFiles(p, True) if fs.exists(p) else None
    while files is not None and files.hasNext():
        f = files.next()
        if ".tmp." in f.getPath().getName() and time.time() - f.getModificationTime() / 1000 >= older_s:
            fs.delete(f.getPath(), False)
            gone.append(f.getPath().getName())
    return gone


def _old_schema():
    from pyspark.sql import types as T

    names = ("buy_agent_name", "sell_agent_name", "trade_type_name")
    return T.StructType([f for f in store._file_schema().fields if f.name not in names])


def migrate_store(spark: SparkSession, root: str, start: str, end: str = schema.VERSION, run: str = "") -> str:
    """Migrates the whole lake beside itself, verifies each partition's rows, then swaps; returns the backup's path.

    A run that broke off goes on from its finished staging folder.  If the counts differ, the lake stays as it was.
    """
    root = root.rstrip("/")
    staged, backup = f"{root}.migrating-{end}", f"{root}{BACKUP}{run or int(time.time())}"
    old = spark.read.schema(_old_schema() if start == "1.0.0" else store._file_schema()).parquet(root)
    if not store.exists(spark, f"{staged}/_SUCCESS"):
        keep = [c for c in old.columns if c not in store.KEYS[2:]]
        store.routed(migrate.migrate(old.select(*keep), start, end), root).write.mode("overwrite").partitionBy(*store.KEYS).parquet(staged)
    count = lambda df, name: df.groupBy(*store.KEYS).agg(F.count("*").alias(name))
    both = count(old, "a").join(count(spark.read.schema(store._file_schema()).parquet(staged), "b"), store.KEYS, "full_outer")
    if not both.where("not (a <=> b)").isEmpty():
        store.delete(spark, staged)
        raise RuntimeError("the migrated partitions don't hold the rows of the old ones")
    fs, p = _fs(spark, root)
    fs.rename(p, _fs(spark, backup)[1])
    fs.rename(_fs(spark, staged)[1], p)
    return backup


def rollback(spark: SparkSession, root: str, backup: str) -> None:
    """Puts a backup back in the place of the migrated lake."""
    if not store.exists(spark, backup):
        raise ValueError(f"no backup {backup}")
    store.delete(spark, root)
    fs, p = _fs(spark, backup)
    fs.rename(p, _fs(spark, root)[1])


def clean_backups(spark: SparkSession, root: str, older_days: float = 30.0) -> list[str]:
    """Deletes the lake's backups of at least this age; returns their names."""
    fs, p = _fs(spark, root.rstrip("/"))
    gone = []
    for f in fs.listStatus(p.getParent()):
        name = f.getPath().getName()
        if name.startswith(p.getName() + BACKUP) and time.time() - f.getModificationTime() / 1000 >= older_days * 86400:
            fs.delete(f.getPath(), True)
            gone.append(name)
    return gone


def compact_if_complete(spark: SparkSession, root: str, out: str, exchange: str, symbol: str, year: int, month: int, days: DataFrame, ledger: DataFrame, compactions: DataFrame) -> tuple[int | None, DataFrame]:
    """Compacts a month whose business days (``days``) the ledger all has as done; returns its rows and the compactions.

    An incomplete month yields None and leaves the compactions as they are.
    """
    inside = days.where((F.year("day") == year) & (F.month("day") == month))
    own = ledger.where((F.col("symbol") == symbol) & (F.col("exchange") == exchange))
    complete = calendar.month_complete(inside, own).where(F.col("complete"))
    if complete.isEmpty():
        return None, compactions
    began = spark.sql("SELECT localtimestamp() AS t").first()[0]
    n = store.compact(spark, root, out, exchange, symbol, year, month)
    done = spark.sql("SELECT localtimestamp() AS t").first()[0]
    line = spark.createDataFrame([(symbol, exchange, year, month, began, done, "completed")], compactions.schema)
    return n, catalog.upsert(compactions, line, catalog.TABLES["compactions"][1])


def health(spark: SparkSession, root: str, free_bytes: int = 1 << 30) -> DataFrame:
    """Checks of an installation, one row each: the lake is there, its columns are the schema's, space is left, nothing is stale."""
    there = store.exists(spark, root)
    fs, p = _fs(spark, root)
    left = fs.getStatus(p if there else p.getParent()).getRemaining()
    odd = sorted(set(spark.read.option("mergeSchema", "true").parquet(root).columns) - set(store._file_schema().names)) if there else []
    stale, files = 0, fs.listFiles(p, True) if there else None
    while files is not None and files.hasNext():
        stale += ".tmp." in files.next().getPath().getName()
    rows = [("store", there, root), ("columns", not odd, ", ".join(odd)), ("space", left >= free_bytes, f"{left} bytes left"), ("stale_files", stale == 0, str(stale))]
    return spark.createDataFrame(rows, "check string, passed boolean, detail string")
