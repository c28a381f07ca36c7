"""Contract validity, and continuous series stitched over contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeutil import DAY_NS, date_to_ns

def slices(contracts: DataFrame, start_ns: int, end_ns: int, until_mode: str = "end_of_day") -> DataFrame:
    """``contract_code``, ``lo``, ``hi`` (inclusive ns) of each contract that overlaps the range, without overlaps.

    A contract begins after the last end of all before it.  ``until_mode``: "end_of_day" keeps the last day of
    validity whole, "midnight" ends at its first ns (and leaves the rest of that day to nobody).
    """
    eod = F.when(date_to_ns(F.col("vigent_until")) > F.lit((1 << 63) - 1 - DAY_NS), F.lit((1 << 63) - 1)).otherwise(date_to_ns(F.col("vigent_until")) + F.lit(DAY_NS - 1))
    end = eod if until_mode == "end_of_day" else date_to_ns(F.col("vigent_until"))
    order = Window.partitionBy("symbol_root").orderBy("vigent_from", "contract_code")
    some = contracts.withColumn("from_ns", date_to_ns(F.col("vigent_from"))).withColumn("eod", eod).withColumn("end", end).where((F.col("eod") >= start_ns) & (F.col("from_ns") <= end_ns))
    latest = F.max("eod").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = some.withColumn("latest", latest).withColumn("floor", F.when(F.col("latest") < F.lit((1 << 63) - 1), F.col("latest") + 1).otherwise(F.col("latest")))
    cut = cut.where(F.col("latest").isNull() | (F.col("latest") < F.lit((1 << 63) - 1)))  # after an open end nothing is left
    return cut.select("symbol_root", "contract_code", F.greatest("from_ns", F.coalesce("floor", "from_ns"), F.lit(start_ns)).alias("lo"), F.least("end", F.lit(end_ns)).alias("hi")).where("lo <= hi")


def stitch(trades: DataFrame, cuts: DataFrame) -> DataFrame:
    """Trades of each contract inside its slice, with ``_contract_code``: an equality on the code, then the range; its size decides how the join runs."""
    return trades.join(cuts.select("contract_code", "lo", "hi"), (F.col("symbol") == F.col("contract_code")) & F.col("timestamp_ns").between(F.col("lo"), F.col("hi"))).drop("lo", "hi").withColumnRenamed("contract_code", "_contract_code")


def firsts(stitched: DataFrame) -> DataFrame:
    """First trade of each contract: (time, sequence, hash of the row, which parts those that tie)."""
    return stitched.groupBy("_contract_code").agg(F.min(F.struct("timestamp_ns", "sequence_within_ns", F.xxhash64(*sorted(stitched.columns)).alias("row"))).alias("first"))


def rollover_flags(stitched: DataFrame) -> DataFrame:
    """``_rollover_event``: true on the first trade of each contract but the first one.

    Contracts don't overlap, so their first trades tell; no window runs over all rows.  Of trades that tie in time and sequence one
    is marked (rows equal in every column, which a deduplicated store doesn't hold, share the mark).
    """
    starts = firsts(stitched)
    lead = starts.agg(F.min("first").alias("lead"))  # one row
    marks = starts.join(F.broadcast(lead)).where("first > lead").select(F.col("_contract_code").alias("__code"), F.col("first.timestamp_ns").alias("__ts"), F.col("first.sequence_within_ns").alias("__seq"), F.col("first.row").alias("__row"))
    same = (F.col("_contract_code") == F.col("__code")) & (F.col("timestamp_ns") == F.col("__ts")) & (F.col("sequence_within_ns") == F.col("__seq")) & (F.xxhash64(*sorted(stitched.columns)) == F.col("__row"))
    return stitched.join(marks, same, "left").withColumn("_rollover_event", F.col("__code").isNotNull()).drop("__code", "__ts", "__seq", "__row")


def transitions(stitched: DataFrame) -> DataFrame:
    """One row per contract change: from, to, time of the first trade after it, and the pause before it."""
    ends = stitched.groupBy("_contract_code").agg(F.min("timestamp_ns").alias("boundary_ts_ns"), F.max("timestamp_ns").alias("last_ts_ns"))
    order = Window.orderBy("boundary_ts_ns")  # one row per contract
    return ends.select(F.lag("_contract_code").over(order).alias("from_contract"), F.col("_contract_code").alias("to_contract"), "boundary_ts_ns", (F.col("boundary_ts_ns") - F.lag("last_ts_ns").over(order)).alias("gap_ns")).where("from_contract is not null")


def read_continuous(trades: DataFrame, contracts: DataFrame, root: str, start_ns: int, end_ns: int, until_mode: str = "end_of_day") -> DataFrame:
    """The continuous series of a root, in order, with its contract and rollover flag."""
    cuts = slices(contracts.where(F.col("symbol_root") == root), start_ns, end_ns, until_mode)
    return rollover_flags(stitch(trades.where(F.col("timestamp_ns").between(start_ns, end_ns)), cuts)).orderBy("timestamp_ns", "sequence_within_ns")


def vigent(dates: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contract valid on each (symbol_root, day); where several are, the one that began last."""
    c = contracts.select(F.col("symbol_root").alias("__root"), "contract_code", "vigent_from", "vigent_until")
    hit = dates.join(c, (F.col("symbol_root") == F.col("__root")) & F.col("day").between(F.col("vigent_from"), F.col("vigent_until")))
    return hit.groupBy("symbol_root", "day").agg(F.max(F.struct("vigent_from", "contract_code")).alias("c")).select("symbol_root", "day", "c.contract_code")
