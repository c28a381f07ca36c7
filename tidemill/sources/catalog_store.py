"""The stored catalog: small tables in versions, with jobs, partitions, gaps, contracts, ledger and compactions.

Each change of a table writes its next version whole and is in force once Spark's commit mark stands; readers take the
latest version that has one, so a writer that breaks off leaves the table as it was.  One writer at a time is assumed,
as the catalog's rows come from one orchestrating process.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import calendar, catalog
from . import store
from .maintenance import _fs

#: Versions of the catalog's tables, and what each brought.
DDL = [("1.0", ["downloads", "partitions", "gaps", "contracts", "_schema_meta"]), ("1.1", ["chunk_ledger", "_pending_commits"]), ("1.2", ["compactions", "_checksum_cache"]), ("1.3", ["_migration_log"])]
KEEP = 2


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- tables ---

    def _versions(self, table: str) -> list[int]:
        fs, p = _fs(self.spark, f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and store.exists(self.spark, f"{self.root}/{table}/{n}/_SUCCESS"))

    def read(self, table: str) -> DataFrame:
        shape, done = catalog.TABLES[table][0], self._versions(table)
        if not done:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(f"{self.root}/{table}/v{done[-1]}")

    def write(self, table: str, rows: DataFrame) -> None:
        done = self._versions(table)
        number = done[-1] + 1 if done else 1
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{table}/v{number}")  # a catalog table is small
        for old in done[: -KEEP + 1]:
            store.delete(self.spark, f"{self.root}/{table}/v{old}")

    def upsert(self, table: str, rows: list[dict] | DataFrame, keep_if_null: tuple[str, ...] = ()) -> None:
        shape, key = catalog.TABLES[table]
        if isinstance(rows, list):
            names = [f.split()[0] for f in shape.split(", ")]
            rows = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], shape)
        self.write(table, catalog.upsert(self.read(table), rows, key, keep_if_null))

    # --- versions of the catalog itself ---

    def version(self) -> str:
        row = self.read("_schema_meta").where("key = 'version'").first()
        return row.value if row else "0"

    def migrate(self, target: str = DDL[-1][0]) -> list[str]:
        """Creates what the versions after the present one bring, in order; returns them.  Done again, it does nothing."""
        at = [int(x) for x in self.version().split(".")]
        todo = [(v, tables) for v, tables in DDL if at < [int(x) for x in v.split(".")] <= [int(x) for x in target.split(".")]]
        for v, tables in todo:
            for t in tables:
                if not self._versions(t):
                    self.write(t, self.spark.createDataFrame([], catalog.TABLES[t][0]))
            self.upsert("_schema_meta", [{"key": "version", "value": v}])
        return [v for v, _ in todo]

    # --- jobs ---

    def register_job(self, job_id: str, symbol: str, exchange: str, start: datetime, end: datetime, **more) -> None:
        if not self.read("downloads").where(F.col("job_id") == job_id).isEmpty():
            raise ValueError(f"job {job_id} is registered")
        self.upsert("downloads", [{"job_id": job_id, "symbol": symbol, "exchange": exchange, "requested_start": start, "requested_end": end, "status": "pending", **more}])

    def job(self, job_id: str):
        return self.read("downloads").where(F.col("job_id") == job_id).first()

    def update_job(self, job_id: str, **changes) -> None:
        """Changes fields of a job; a status may only move as the states allow."""
        row = self.job(job_id)
        if row is None:
            raise ValueError(f"no job {job_id}")
        new = changes.get("status")
        if new is not None and new != row.status and not catalog.may_move(row.status, new):
            raise ValueError(f"a job can't go from {row.status} to {new}")
        self.upsert("downloads", [row.asDict() | changes])

    def jobs(self, statuses: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return catalog.jobs(self.read("downloads"), statuses, limit)

    def resumable(self, symbol: str, exchange: str, start: datetime, end: datetime) -> str | None:
        """The unfinished job of exactly this range that was started last."""
        same = self.read("downloads").where((F.col("symbol") == symbol) & (F.col("exchange") == exchange) & (F.col("requested_start") == F.lit(start)) & (F.col("requested_end") == F.lit(end)))
        row = catalog.resumable(same, ["symbol", "exchange"]).first()
        return row.job_id if row else None

    # --- partitions, in two phases ---

    def begin_partition(self, path: str, job_id: str, now: datetime) -> None:
        """Says that a file is about to be written; what stays here after a crash names the files to look at."""
        self.upsert("_pending_commits", [{"partition_path": path, "job_id": job_id, "started_at": now}])

    def commit_partition(self, row: dict) -> None:
        """Registers the written file, then takes it off the open commits; the job stays known where the new row names none."""
        self.upsert("partitions", [row], ("job_id",))
        self.write("_pending_commits", self.read("_pending_commits").where(F.col("partition_path") != row["partition_path"]))

    def recover_commits(self, files: DataFrame) -> list[str]:
        """Open commits whose file isn't there are dropped; those whose file is there stay to be registered, and are returned."""
        open_ = self.read("_pending_commits")
        there = open_.join(files.select("partition_path"), "partition_path", "left_semi")
        names = sorted(r.partition_path for r in there.select("partition_path").collect())  # commits of one process
        self.write("_pending_commits", open_.where(F.col("partition_path").isin(names)))
        return names

    # --- gaps, ledger, contracts ---

    def register_gaps(self, symbol: str, exchange: str, gaps: list[tuple[datetime, datetime, str]], now: datetime) -> None:
        self.upsert("gaps", [{"symbol": symbol, "exchange": exchange, "gap_start": a, "gap_end": b, "reason": why, "detected_at": now} for a, b, why in gaps])

    def resolve_gap(self, symbol: str, start: datetime, end: datetime, now: datetime) -> None:
        hit = (F.col("symbol") == symbol) & (F.col("gap_start") == F.lit(start)) & (F.col("gap_end") == F.lit(end))
        self.write("gaps", self.read("gaps").withColumn("resolved_at", F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("resolved_at"))))

    def gaps(self, symbol: str | None = None, unresolved: bool = False) -> DataFrame:
        return catalog.gap_listing(self.read("gaps"), symbol, unresolved)

    def record_chunk(self, symbol: str, exchange: str, day: date, job_id: str, status: str, n: int, now: datetime) -> None:
        self.upsert("chunk_ledger", [{"symbol": symbol, "exchange": exchange, "chunk_date": day, "job_id": job_id, "status": status, "trades_count": n, "written_at": now}])

    def completed_days(self, symbol: str, exchange: str) -> list[date]:
        """Days that are done; a failed one isn't, one without trades is."""
        rows = self.read("chunk_ledger").where((F.col("symbol") == symbol) & (F.col("exchange") == exchange) & F.col("status").isin("completed", "no_trades"))
        return sorted(r.chunk_date for r in rows.select("chunk_date").collect())  # at most the days of a calendar

    def resume_plan(self, days: DataFrame, symbol: str, exchange: str) -> DataFrame:
        """Business days of ``days`` that are still to do."""
        done = self.read("chunk_ledger").where((F.col("symbol") == symbol) & (F.col("exchange") == exchange) & F.col("status").isin("completed", "no_trades"))
        return days.join(done.select(F.col("chunk_date").alias("day")), "day", "left_anti").orderBy("day")

    def add_contract(self, **row) -> None:
        if row["vigent_from"] > row["vigent_until"]:
            raise ValueError("a contract must not end before it begins")
        self.upsert("contracts", [row], ("validated_at", "validation_source", "notes"))

    def contracts(self, root: str | None = None) -> DataFrame:
        return catalog.contract_listing(self.read("contracts"), root)

    # --- compaction with a mark, and its recovery ---

    def compact(self, lake: str, out: str, exchange: str, symbol: str, year: int, month: int, days: DataFrame, now: datetime, replace: bool = False) -> int | None:
        """Compacts a month that the ledger has whole.  The mark stands before the work begins and is closed after it.

        ``replace`` puts the month in the place of its days, so that scans of the lake read it.
        """
        inside = days.where((F.year("day") == year) & (F.month("day") == month))
        own = self.read("chunk_ledger").where((F.col("symbol") == symbol) & (F.col("exchange") == exchange))
        if calendar.month_complete(inside, own).where("complete").isEmpty():
            return None
        line = {"symbol": symbol, "exchange": exchange, "year": year, "month": month, "started_at": now}
        self.upsert("compactions", [line | {"status": "in_flight"}])
        n = store.compact(self.spark, lake, out, exchange, symbol, year, month)
        if replace:
            store.adopt(self.spark, lake, out, exchange, symbol, year, month)
        self.upsert("compactions", [line | {"status": "completed", "completed_at": now}])
        return n

    def recover_compactions(self, lake: str, out_of, now: datetime, replace: bool = False) -> dict[tuple, str]:
        """Closes what a crash left in flight: a monthly file with all rows of the days counts, any other is deleted.

        ``out_of``: the month's folder for (symbol, exchange, year, month).  Nothing of the days is touched, unless
        ``replace`` says that finished months take their place, as they would have without the crash.
        """
        found = {}
        for r in self.read("compactions").where("completed_at is null").collect():  # months in flight
            key = (r.symbol, r.exchange, r.year, r.month)
            at = out_of(*key)
            daily = store.scan(self.spark, lake).where((F.col("exchange") == r.exchange) & (F.col("symbol") == r.symbol) & (F.col("year") == r.year) & (F.col("month") == r.month)).count()
            monthly = self.spark.read.parquet(at).count() if store.exists(self.spark, f"{at}/_SUCCESS") else 0
            moved = replace and not monthly and store.adopted(self.spark, lake, r.exchange, r.symbol, r.year, r.month)
            found[key] = "complete" if moved or monthly >= daily and monthly > 0 else "revert"
            if replace and not moved and found[key] == "complete":
                store.adopt(self.spark, lake, at, r.exchange, r.symbol, r.year, r.month)
            if found[key] == "revert":
                store.delete(self.spark, at)
            self.upsert("compactions", [r.asDict() | {"status": {"complete": "completed", "revert": "reverted"}[found[key]], "completed_at": now}])
        return found
