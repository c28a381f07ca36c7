"""Partitioned Parquet store: writing, reading, merging, compacting, checksums."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema
from ..functions.timeutil import day_of, to_ns
from ..operators import ingest

#: Rows one partition may hold.
ROW_LIMIT = 50_000_000
KEYS = ["exchange", "symbol", "year", "month", "day"]
#: Day key of the one partition that a compacted month has in place of its days.
MONTH = 0


def with_keys(df: DataFrame) -> DataFrame:
    day = day_of(F.col("timestamp_ns"))
    return df.withColumns({"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)})


def compacted(spark: SparkSession, root: str) -> DataFrame:
    """Months that lie as one partition: exchange, symbol, year and month.  Only footers of these are read."""
    return scan(spark, root).where(F.col("day") == MONTH).select(*KEYS[:4]).distinct()


def routed(rows: DataFrame, root: str) -> DataFrame:
    """Trades with the keys of the partition that each belongs to: its month's where that is compacted, else its day's."""
    months = compacted(rows.sparkSession, root).withColumn("__whole", F.lit(True))
    day = F.when(F.col("__whole"), MONTH).otherwise(F.col("day"))
    return with_keys(rows).join(months, KEYS[:4], "left").withColumn("day", day).select(*rows.columns, *KEYS[2:])


def _file_schema():
    from pyspark.sql import types as T

    return T.StructType([*schema.TRADE.fields, *(T.StructField(k, T.IntegerType()) for k in KEYS[2:])])


def exists(spark: SparkSession, root: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All trades under the root with their partition keys, of days and compacted months; a missing root is an empty, typed frame."""
    if not exists(spark, root):
        return spark.createDataFrame([], _file_schema())
    return spark.read.schema(_file_schema()).parquet(root)


def read(spark: SparkSession, root: str, symbol: str, start: datetime | date, end: datetime | date, *, exchange: str = "F", columns: list[str] | None = None) -> DataFrame:
    """Trades of a symbol in [start, end], in order.

    The range also becomes conditions on the partition keys, which prune files.  Unknown names in ``columns`` are
    ignored; if none is known, all columns come.
    """
    if exchange not in schema.EXCHANGES:
        raise ValueError(f"exchange must be one of {schema.EXCHANGES}")
    lo, hi = to_ns(start), to_ns(end, end=True)
    if lo > hi:
        raise ValueError("start is after end")
    first, last = (x if not isinstance(x, datetime) else x.date() for x in (start, end))
    month = F.col("year") * 100 + F.col("month")
    inside = (month * 100 + F.col("day")).between(first.year * 10000 + first.month * 100 + first.day, last.year * 10000 + last.month * 100 + last.day)
    whole = (F.col("day") == MONTH) & month.between(first.year * 100 + first.month, last.year * 100 + last.month)
    rows = scan(spark, root).where((F.col("exchange") == exchange) & (F.col("symbol") == symbol) & (inside | whole)).where(F.col("timestamp_ns").between(lo, hi))
    return project(rows.select(*schema.TRADE.names, "sequence_within_ns").select(*schema.TRADE.names).orderBy("timestamp_ns", "sequence_within_ns"), columns)


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    return df.select(*([c for c in columns or [] if c in df.columns] or df.columns))


def count(spark: SparkSession, root: str, symbol: str, *, exchange: str = "F") -> int:
    return scan(spark, root).where((F.col("exchange") == exchange) & (F.col("symbol") == symbol)).count()


def prepare(raw: DataFrame, *, ingested_ns: int, version: str, chunk: str | None = None) -> DataFrame:
    """Guard, validate, enrich, sequence and dedup a batch (with ``arrival``): the order is part of the contract."""
    schema.guard(raw.drop("arrival"))
    rows = ingest.validate(schema.canonical(raw).withColumn("arrival", F.lit(0)) if "arrival" not in raw.columns else raw)
    return ingest.dedup(ingest.sequence(ingest.enrich(rows, ingested_ns=ingested_ns, version=version, chunk=chunk)))


def write(df: DataFrame, root: str, *, row_limit: int = ROW_LIMIT) -> DataFrame:
    """Overwrites the days that the frame holds, and only these; returns what was written per partition.

    A day of a compacted month can't be overwritten alone and is refused; ``merge_write`` adds to such months.
    """
    rows = with_keys(schema.canonical(df))
    months = compacted(df.sparkSession, root)
    if not months.isEmpty() and not months.join(rows, KEYS[:4], "left_semi").isEmpty():
        raise ValueError("the frame holds days of a compacted month")
    return _write(rows, root, row_limit)


def _write(rows: DataFrame, root: str, row_limit: int = ROW_LIMIT) -> DataFrame:
    summary = rows.groupBy(*KEYS).agg(F.count("*").alias("row_count"), F.min("timestamp_ns").alias("first_ts_ns"), F.max("timestamp_ns").alias("last_ts_ns"))
    most = summary.agg(F.max("row_count")).first()[0] or 0
    if most > row_limit:
        raise ValueError(f"a partition of {most} rows; the limit is {row_limit}")
    sorted_rows = stamped(rows).repartition(*KEYS).sortWithinPartitions(*KEYS, "timestamp_ns", "sequence_within_ns")
    sorted_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*KEYS).parquet(root)
    return summarise(rows.sparkSession, root, summary.select(*KEYS))


def stamped(rows: DataFrame, **marks: str) -> DataFrame:
    """The rows with key-values for the footers of the files they go to.

    Spark's writer puts the metadata of columns into each footer; ``footer`` and ``versions`` read them from there.
    """
    return rows.withMetadata("timestamp_ns", {"schema_version": schema.VERSION} | marks)


def summarise(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """What the store holds now in the partitions named."""
    stored = spark.read.schema(_file_schema()).parquet(root).join(keys, KEYS, "left_semi")
    return stored.groupBy(*KEYS).agg(F.count("*").alias("row_count"), F.min("timestamp_ns").alias("first_ts_ns"), F.max("timestamp_ns").alias("last_ts_ns"))


def merge_write(new: DataFrame, root: str) -> DataFrame:
    """Merges a prepared batch (with ``arrival``) into the stored days and compacted months it touches; stored rows win.

    The result is staged first, since a plan must not overwrite what it reads.
    """
    spark = new.sparkSession
    days = routed(new, root).select(*KEYS).distinct()
    stored = scan(spark, root).join(days, KEYS, "left_semi").select(*schema.TRADE.names).withColumn("arrival", F.monotonically_increasing_id())
    merged = ingest.merge(stored, new.select(*schema.TRADE.names, "arrival"))
    staging = f"{root}.staging-{uuid.uuid4().hex}"
    schema.canonical(merged.drop("arrival")).write.parquet(staging)
    try:
        _write(routed(spark.read.schema(schema.TRADE).parquet(staging), root), root)
    finally:
        delete(spark, staging)
    return summarise(spark, root, routed(new, root).select(*KEYS).distinct())  # listed anew: the files before are gone


def compact(spark: SparkSession, root: str, out: str, exchange: str, symbol: str, year: int, month: int) -> int:
    """Writes a month's days as one sorted file; returns its rows."""
    days = scan(spark, root).where((F.col("exchange") == exchange) & (F.col("symbol") == symbol) & (F.col("year") == year) & (F.col("month") == month))
    rows = ingest.dedup(days.select(*schema.TRADE.names).withColumn("arrival", F.struct("timestamp_ns", "sequence_within_ns"))).drop("arrival")
    stamped(rows).coalesce(1).sortWithinPartitions("timestamp_ns", "sequence_within_ns").write.mode("overwrite").parquet(out)
    return spark.read.schema(schema.TRADE).parquet(out).count()


def month_path(spark: SparkSession, root: str, exchange: str, symbol: str, year: int, month: int) -> str:
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{root.rstrip('/')}/exchange={escape(exchange)}/symbol={escape(symbol)}/year={year}/month={month}"


def adopt(spark: SparkSession, root: str, out: str, exchange: str, symbol: str, year: int, month: int) -> None:
    """Puts a month that ``compact`` wrote (on the lake's file system) in the place of its days.

    The days go first, so that no read counts a trade twice; a run that broke off is done again, since ``out`` holds the
    whole month until it is moved.
    """
    if not exists(spark, f"{out}/_SUCCESS"):
        raise ValueError(f"no finished month in {out}")
    at = month_path(spark, root, exchange, symbol, year, month)
    delete(spark, at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(at))
    if not fs.rename(path(out), path(f"{at}/day={MONTH}")):
        raise OSError(f"{out} could not be moved")


def adopted(spark: SparkSession, root: str, exchange: str, symbol: str, year: int, month: int) -> bool:
    """Whether the month lies as one partition and has no days beside it."""
    at = month_path(spark, root, exchange, symbol, year, month)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path(at)) and [f.getPath().getName() for f in fs.listStatus(path(at))] == [f"day={MONTH}"]


def files(spark: SparkSession, root: str, checksums: bool = True) -> DataFrame:
    """Parquet files under the root with their path below it, size and SHA-256; temporary files are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root).where(~F.col("path").contains(".tmp."))
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    path = F.substring_index(F.col("path"), base.split("://")[-1].removeprefix("file:").rstrip("/") + "/", -1)
    return rows.select(path.alias("partition_path"), F.col("length").alias("file_size_bytes"), *([F.sha2("content", 256).alias("checksum_sha256")] if checksums else []))


def _footers(spark: SparkSession, root: str) -> DataFrame:
    """``path`` and ``marks`` (a map) per Parquet file; executors read the files' tails only."""

    def run(batches):
        import json

        import pandas as pd
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        def marks(path: str) -> dict[str, str]:
            scheme, _, rest = path.partition(":")
            if scheme == "file" or not rest:  # names are taken as they are: symbols may hold signs that URIs escape
                fs, at = pafs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
            else:
                host, _, at = rest.lstrip("/").partition("/")
                fs, base = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
                at = f"{base.rstrip('/')}/{at}"
            with fs.open_input_file(at) as f:
                pairs = {k.decode(): v.decode("utf-8", "replace") for k, v in (pq.read_metadata(f).metadata or {}).items()}
            for field in json.loads(pairs.get("org.apache.spark.sql.parquet.row.metadata", "{}")).get("fields", []):
                pairs |= {k: str(v) for k, v in field["metadata"].items()}
            return pairs

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "marks": [marks(p) for p in pdf["path"]]})

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root)
    return listed.select("path").mapInPandas(run, "path string, marks map<string,string>")


def footer(spark: SparkSession, root: str) -> DataFrame:
    """Footer key-values of the files under the root, those that ``stamped`` gave them included."""
    return _footers(spark, root).select("path", F.explode("marks").alias("key", "value"))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The schema version in each file's footer; null where it names none."""
    return _footers(spark, root).select("path", F.try_element_at("marks", F.lit("schema_version")).alias("schema_version"))
