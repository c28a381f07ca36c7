"""Integrity checks as one report frame: check, severity, passed, n_bad."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeutil import DAY_NS
from .ingest import violations

RANK = {"critical": 2, "high": 1}


def duplicate_keys(trades: DataFrame) -> DataFrame:
    """Keys that occur more than once; typed columns, never joined text."""
    return trades.groupBy("symbol", "timestamp_ns", "trade_id", "price", "quantity", "buy_agent_id", "sell_agent_id", "sequence_within_ns").agg(F.count("*").alias("n")).where("n > 1")


def regressions(trades: DataFrame, order: list[str], group: list[str]) -> DataFrame:
    """Rows whose time is before that of the row ahead of them in ``order``; groups keep the window distributed."""
    prev = F.lag("timestamp_ns").over(Window.partitionBy(*group).orderBy(*order))
    return trades.withColumn("prev_ts_ns", prev).where("timestamp_ns < prev_ts_ns")


def _line(df: DataFrame, check: str, severity: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_bad")).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), (F.col("n_bad") == 0).alias("passed"), "n_bad")


def report(
    trades: DataFrame, partitions: DataFrame | None = None, files: DataFrame | None = None, strict: bool = True, *, physical: tuple[list[str], list[str]] | None = None,
    gaps: DataFrame | None = None, pending: DataFrame | None = None, versions: list[str] | None = None,
    footers: DataFrame | None = None,
) -> DataFrame:
    """INT-1 to INT-12 as far as the inputs allow; an empty table passes all.

    ``physical``: columns that give the order in which rows are stored, and those of its runs (files): INT-3 then looks at
    that order; without it times are compared in their logical order (symbol and day), which finds nothing but broken sorts.
    ``gaps``: unexpected gaps (INT-9); ``pending``: open commits (INT-10); ``versions``: library versions approved (INT-11);
    ``footers``: the schema versions that files hold, by which INT-1 goes instead of by those registered.
    """
    bad = violations()
    exchange = ~F.col("exchange").isin("F", "B") | (F.col("exchange").isNull() if strict else F.lit(False))
    rules = [("INT-4", "critical", bad["price"] | bad["quantity"]), ("INT-5", "critical", exchange), ("INT-12", "high", F.col("ingestion_ts_ns") + 1_000_000_000 < F.col("timestamp_ns"))]
    if versions is not None:
        rules.append(("INT-11", "high", F.col("dll_version").isNull() | ~F.col("dll_version").isin(*versions)))
    # what a row alone can say is counted in one pass
    counts = trades.agg(*(F.count_if(rule).alias(name) for name, _, rule in rules))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), (F.col(f"`{n}`") == 0).alias("passed"), F.col(f"`{n}`").alias("n_bad")) for n, s, _ in rules))).alias("x")).select("x.*")
    if physical is None:
        by_day = trades.withColumn("__day", F.expr(f"timestamp_ns div {DAY_NS}"))
        turned = regressions(by_day, ["timestamp_ns", "sequence_within_ns"], ["symbol", "__day"])
    else:
        turned = regressions(trades, *physical)
    lines = [rows, _line(duplicate_keys(trades), "INT-2", "critical"), _line(turned, "INT-3", "high")]
    named = footers if footers is not None else partitions
    if named is not None:
        lines.append(_line(named.where(~F.col("schema_version").rlike(r"^[12]\.") | F.col("schema_version").isNull()), "INT-1", "critical"))
    if partitions is not None:
        lines.append(_line(partitions.where("first_ts_ns > last_ts_ns"), "INT-8", "high"))
    if partitions is not None and files is not None:
        from .catalog import reconcile

        drift = reconcile(partitions, files)
        seen = drift.agg(F.count("drift").alias("n_bad"), F.count_if(F.col("drift") == "A").alias("n_a"))
        lines.append(seen.select(F.lit("INT-6").alias("check"), F.when(F.col("n_bad") > F.col("n_a"), "critical").otherwise("high").alias("severity"), (F.col("n_bad") == 0).alias("passed"), "n_bad"))
        lines.append(_line(drift.where("drift = 'C'"), "INT-7", "critical"))
    if gaps is not None:
        lines.append(_line(gaps, "INT-9", "high"))
    if pending is not None:
        lines.append(_line(pending, "INT-10", "high"))
    return reduce(DataFrame.unionByName, lines).orderBy("check")


def roll_up(lines: DataFrame) -> DataFrame:
    """All passed, worst severity that failed, and a short hash of the outcome."""
    rank = F.when(~F.col("passed"), F.when(F.col("severity") == "critical", 2).otherwise(1)).otherwise(0)
    marks = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "check", F.when(F.col("passed"), "P").otherwise("F")))), "|")
    return lines.agg(F.bool_and("passed").alias("passed"), F.element_at(F.array(F.lit("none"), F.lit("high"), F.lit("critical")), F.max(rank) + 1).alias("worst"), F.substring(F.sha2(marks, 256), 1, 16).alias("report_hash"))
