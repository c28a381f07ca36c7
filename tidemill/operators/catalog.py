"""The catalog: small tables as DataFrames, upserts, drift and job views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeutil import day_of

#: Tables and their keys.
TABLES = {
    "downloads": ("job_id string, symbol string, exchange string, requested_start timestamp_ntz, requested_end timestamp_ntz, actual_start timestamp_ntz, actual_end timestamp_ntz, status string, trades_count bigint, started_at timestamp_ntz, completed_at timestamp_ntz, error string, dll_version string, cli_invocation string", ["job_id"]),
    "partitions": ("partition_path string, symbol string, exchange string, year int, month int, day int, row_count bigint, first_ts_ns bigint, last_ts_ns bigint, schema_version string, checksum_sha256 string, file_size_bytes bigint, written_at timestamp_ntz, job_id string", ["partition_path"]),
    "gaps": ("symbol string, exchange string, gap_start timestamp_ntz, gap_end timestamp_ntz, reason string, detected_at timestamp_ntz, resolved_at timestamp_ntz", ["symbol", "gap_start", "gap_end"]),
    "contracts": ("symbol_root string, contract_code string, vigent_from date, vigent_until date, validated_at date, validation_source string, notes string", ["symbol_root", "contract_code"]),
    "chunk_ledger": ("symbol string, exchange string, chunk_date date, job_id string, status string, trades_count bigint, written_at timestamp_ntz", ["symbol", "exchange", "chunk_date"]),
    "compactions": ("symbol string, exchange string, year int, month int, started_at timestamp_ntz, completed_at timestamp_ntz, status string", ["symbol", "exchange", "year", "month"]),
    "_checksum_cache": ("partition_path string, file_size_bytes bigint, mtime_ns bigint, checksum_sha256 string", ["partition_path"]),
    "_pending_commits": ("partition_path string, job_id string, started_at timestamp_ntz", ["partition_path"]),
    "_migration_log": ("run_id string, partition_path string, status string, finished_at timestamp_ntz", ["run_id", "partition_path"]),
    "_schema_meta": ("key string, value string", ["key"]),
}
JOB_STATES = {"pending": {"in_progress", "cancelled"}, "in_progress": {"completed", "failed", "partial", "cancelled"}, "partial": {"in_progress", "cancelled"}, "failed": {"in_progress"}, "completed": set(), "cancelled": set()}


def may_move(old: str, new: str) -> bool:
    return new in JOB_STATES[old]


def upsert(base: DataFrame, new: DataFrame, key: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace stored ones of the same key; named columns keep their stored value where the new one is null."""
    side = new.select(*key, F.struct(*(c for c in new.columns if c not in key)).alias("__new"))
    rows = base.withColumn("__old", F.lit(True)).join(side, key, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"__new.{c}"), F.col(c)) if c in keep_if_null else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c))
    return rows.select(*(F.col(c) if c in key else pick(c).alias(c) for c in base.columns))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key the row that comes last."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("__rn = 1").drop("__rn")


def reconcile(partitions: DataFrame, files: DataFrame) -> DataFrame:
    """Drift of each path: A on disk only, B in the catalog only, C checksums differ, null in step."""
    c = partitions.select("partition_path", F.col("checksum_sha256").alias("expected"), F.lit(True).alias("in_catalog"))
    d = files.select("partition_path", F.col("checksum_sha256").alias("actual"), F.lit(True).alias("on_disk"))
    drift = F.when(F.col("in_catalog").isNull(), "A").when(F.col("on_disk").isNull(), "B").when(~F.col("expected").eqNullSafe(F.col("actual")), "C")
    return c.join(d, "partition_path", "full_outer").select("partition_path", drift.alias("drift"))


def partition_summary(partitions: DataFrame, downloads: DataFrame) -> DataFrame:
    """Partitions with their job, coverage, size and density."""
    minutes = F.nullif((F.col("last_ts_ns") - F.col("first_ts_ns")) / 1e9 / 60, F.lit(0.0))
    return partitions.join(downloads.select("job_id", F.col("dll_version").alias("dll_version"), F.col("status").alias("download_status")), "job_id", "left").withColumns({
        "has_data": F.coalesce(F.col("last_ts_ns") > F.col("first_ts_ns"), F.lit(False)), "file_size_mb": F.col("file_size_bytes") / 1024.0 / 1024.0, "rows_per_minute": F.col("row_count") / minutes,
    })


def jobs(downloads: DataFrame, statuses: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Latest first by completion or else start; jobs with neither come last."""
    rows = downloads if statuses is None else downloads.where(F.col("status").isin(*statuses))
    rows = rows.orderBy(F.coalesce("completed_at", "started_at").desc_nulls_last(), "job_id")
    return rows if limit is None else rows.limit(limit)


def partition_filter(partitions: DataFrame, text: str = "", exchange: str | None = None) -> DataFrame:
    """Listing by part of the symbol, in any case, and by exchange."""
    rows = partitions.where(F.upper("symbol").contains(text.upper()))
    return (rows if exchange is None else rows.where(F.col("exchange") == exchange)).orderBy("exchange", "symbol", "year", "month", "day")


def totals(partitions: DataFrame) -> DataFrame:
    return partitions.agg(F.count("*").alias("n_partitions"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("n_rows"), (F.coalesce(F.sum("file_size_bytes"), F.lit(0)) / 1024.0 / 1024.0).alias("mb"))


def job_status(ledger: DataFrame) -> DataFrame:
    """Per job: completed, partial or failed, by its chunks."""
    done, all_ = F.count_if(F.col("status").isin("completed", "no_trades")), F.count("*")
    return ledger.groupBy("job_id").agg(F.when(done == all_, "completed").when(done > 0, "partial").otherwise("failed").alias("status"), F.sum("trades_count").alias("trades_count"))


def compaction_recovery(compactions: DataFrame, partitions: DataFrame) -> DataFrame:
    """For compactions in flight: complete those whose monthly file holds at least the daily rows (and any), else revert."""
    key = ["symbol", "exchange", "year", "month"]
    rows = partitions.groupBy(*key).agg(F.sum(F.when(F.col("day").isNull(), F.col("row_count"))).alias("monthly"), F.sum(F.when(F.col("day").isNotNull(), F.col("row_count"))).alias("daily"))
    ok = (F.coalesce("monthly", F.lit(0)) >= F.coalesce("daily", F.lit(0))) & (F.coalesce("monthly", F.lit(0)) > 0)
    return compactions.where("completed_at is null").join(rows, key, "left").select(*key, F.when(ok, "complete").otherwise("revert").alias("action"))


def density(partitions: DataFrame) -> DataFrame:
    """Rows and rows a MB of each symbol."""
    rows = partitions.groupBy("symbol").agg(F.sum("row_count").alias("n_rows"), F.sum("file_size_bytes").alias("b"))
    return rows.select("symbol", "n_rows", (F.col("n_rows") / F.nullif(F.col("b") / 1048576.0, F.lit(0.0))).alias("rows_per_mb"))


def resumable(downloads: DataFrame, key: list[str]) -> DataFrame:
    """Of each key (as symbol, exchange and the exact range) the unfinished job started last."""
    rows = downloads.where(F.col("status").isin("partial", "failed", "in_progress") & F.col("started_at").isNotNull())
    return rows.groupBy(*key).agg(F.max_by("job_id", F.struct("started_at", "job_id")).alias("job_id"))


def probe(contracts: DataFrame, trades: DataFrame, first_hour: int = 9, last_hour: int = 18) -> DataFrame:
    """Contracts with ``valid``: whether their code has trades between these hours of a day inside their validity."""
    hour = F.expr("timestamp_ns div 3600000000000 % 24")
    days = trades.where(hour.between(first_hour, last_hour - 1)).select("symbol", day_of(F.col("timestamp_ns")).alias("day")).groupBy("symbol", "day").agg(F.count("*").alias("n"))
    c = contracts.select("symbol_root", "contract_code", "vigent_from", "vigent_until")
    hit = c.join(days, (F.col("contract_code") == F.col("symbol")) & F.col("day").between(F.col("vigent_from"), F.col("vigent_until")), "left")
    return hit.groupBy(*c.columns).agg((F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("valid"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_trades"))


def gap_listing(gaps: DataFrame, symbol: str | None = None, unresolved: bool = False) -> DataFrame:
    """Gaps by symbol and start; on request of one symbol, or open ones alone."""
    rows = gaps if symbol is None else gaps.where(F.col("symbol") == symbol)
    return (rows.where("resolved_at is null") if unresolved else rows).orderBy("symbol", "gap_start", "gap_end")


def contract_listing(contracts: DataFrame, root: str | None = None) -> DataFrame:
    """Contracts by root and beginning."""
    rows = contracts if root is None else contracts.where(F.col("symbol_root") == root)
    return rows.orderBy("symbol_root", "vigent_from", "contract_code")
