"""The batch transforms on a stream: micro-batches merge into the daily store."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..functions.timeutil import day_of
from ..operators import ingest
from ..sources import store
from .progress import Metrics, Progress


def raw_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw trades from Parquet files as they come; the limit holds back, nothing is dropped."""
    return spark.readStream.schema(schema.RAW).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest_stream(
    raw: DataFrame, root: str, checkpoint: str, *, version: str = "0", agents: DataFrame | None = None, on_batch: Callable | None = None, job: str = "stream", clock: Callable[[], int] = time.time_ns, stop: Callable[[], bool] | None = None, progress: Progress | None = None, metrics: Metrics | None = None,
) -> StreamingQuery:
    """Runs what is there to its end; batches replayed after a failure change nothing, since merging is idempotent.

    Rows go through the rules of the batch path.  Those a source skips (sentinels, prices of nothing) are counted; those that break
    a rule are kept under ``<root>.quarantine`` with the rule's name, and nothing of them reaches the store.  Each batch
    writes its days to the ledger under ``<root>.ledger``; both folders have one part a batch, which a replay overwrites.
    ``on_batch`` gets the batch number, what its partitions now hold and the counts.  ``stop`` is asked before each
    batch; if it says so, the batch is not begun, and the next run starts with it (a ``Switch`` can also hold it back).
    ``progress`` and ``metrics`` are told of a batch once all of it is committed.
    """
    root = root.rstrip("/")

    def commit(batch: DataFrame, number: int) -> None:
        if stop is not None and stop():
            raise Stopped(f"before batch {number}")
        batch.persist()
        begun = time.monotonic()
        try:
            kept, skipped = ingest.source_filter(batch)
            marked = ingest.with_violation(ingest.to_canonical(kept, agents, version=version, ingested_ns=clock(), chunk=f"{job}-{number}"))
            marked.where("violation is not null").write.mode("overwrite").parquet(f"{root}.quarantine/job={job}/batch={number}")
            trades = marked.where("violation is null").drop("violation")
            written = store.merge_write(ingest.dedup(ingest.sequence(trades)), root)
            days = trades.groupBy("symbol", "exchange", day_of(F.col("timestamp_ns")).alias("chunk_date")).agg(F.count("*").alias("trades_count"))
            line = days.select("symbol", "exchange", "chunk_date", F.lit(f"{job}-{number}").alias("job_id"), F.lit("completed").alias("status"), "trades_count", F.expr("localtimestamp()").alias("written_at"))
            line.write.mode("overwrite").parquet(f"{root}.ledger/job={job}/batch={number}")
            if on_batch or metrics:
                counts = skipped.first().asDict() | {"quarantined": marked.where("violation is not null").count()}
            if on_batch:
                on_batch(number, written, counts)
            if progress or metrics:
                n = trades.count()
            if metrics:
                for name, by in (counts | {"trades": n, "batches": 1}).items():
                    metrics.count(f"stream_{name}_total", by, job=job)
                metrics.observe("stream_batch_seconds", time.monotonic() - begun, job=job)
            if progress:
                progress.batch(n)
        finally:
            batch.unpersist()

    return raw.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Stopped(RuntimeError):
    """A stream was asked to stop between batches."""


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The days that streams have committed, with the trades each batch brought."""
    at = f"{root.rstrip('/')}.ledger"
    if not store.exists(spark, at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(at).select(*(f.split()[0] for f in LEDGER.split(", ")))


LEDGER = "symbol string, exchange string, chunk_date date, job_id string, status string, trades_count bigint, written_at timestamp_ntz"


def bar_stream(trades: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 minute") -> DataFrame:
    """Bars by event time with a watermark: an addition of this engine."""
    return trades.withWatermark(ts, late).groupBy(F.window(ts, size), "symbol").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.sum("quantity").alias("volume"))


def dedup_stream(trades: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """First arrival of each short key within the watermark: an addition of this engine."""
    return trades.withWatermark(ts, late).dropDuplicatesWithinWatermark(["symbol", "timestamp_ns", "trade_id"])
