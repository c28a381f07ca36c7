"""Business days, gaps and chunk plans."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.timeutil import DAY_NS, date_to_ns


def easter(year: int) -> date:
    """Gregorian Easter Sunday by the usual golden-number computation."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    epact -= epact // 28 * (1 - 29 // (epact + 1) * ((21 - golden) // 11))
    weekday = (year + year // 4 + epact + 2 - century + century // 4) % 7
    n = epact - weekday
    return date(year, 3 + (n + 40) // 44, n + 28 - 31 * ((3 + (n + 40) // 44) // 4))


def exchange_holidays(first: int = 2020, last: int = 2030) -> list[date]:
    """Full-day holidays of the exchange: fixed dates, and those that move with Easter; 20 November since 2024."""
    fixed = [(1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (12, 25)]
    out = []
    for y in range(first, last + 1):
        e = easter(y)
        out += [date(y, m, d) for m, d in fixed] + [e + timedelta(n) for n in (-48, -47, -2, 60)] + ([date(y, 11, 20)] if y >= 2024 else [])
    return sorted(out)


def holidays(spark: SparkSession, extra: DataFrame | None = None, first: int = 2020, last: int = 2030) -> DataFrame:
    """Column ``day``: the rule's holidays and those of a file."""
    base = spark.createDataFrame([(d,) for d in exchange_holidays(first, last)], "day date")
    return base if extra is None else base.union(extra.select("day")).distinct()


def business_days(spark: SparkSession, start: str, end: str, closed: DataFrame) -> DataFrame:
    """Weekdays of the range (both ends included) without the closed days; an inverted range has none."""
    days = spark.sql(f"SELECT explode(CASE WHEN DATE'{start}' <= DATE'{end}' THEN sequence(DATE'{start}', DATE'{end}') ELSE array() END) AS day")
    return days.where(F.dayofweek("day").between(2, 6)).join(F.broadcast(closed), "day", "left_anti")  # a calendar


def gaps(days: DataFrame, symbols: DataFrame, trade_days: DataFrame) -> DataFrame:
    """Business days without trades, per symbol; bounds in ns."""
    expected = symbols.select("symbol").distinct().join(F.broadcast(days))
    missing = expected.join(trade_days.select("symbol", "day").distinct(), ["symbol", "day"], "left_anti")
    return missing.select("symbol", "day", date_to_ns(F.col("day")).alias("gap_start_ns"), (date_to_ns(F.col("day")) + (DAY_NS - 1)).alias("gap_end_ns"), F.lit(1).alias("business_days_missing"), F.lit("missing_download").alias("classification"))


def chunk_plan(days: DataFrame, size: int) -> DataFrame:
    """Runs of ``size`` business days: first and last day of each chunk."""
    numbered = days.withColumn("chunk", F.expr(f"(row_number() OVER (ORDER BY day) - 1) div {int(size)}"))  # a calendar
    return numbered.groupBy("chunk").agg(F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.count("*").alias("n_days"))


def month_complete(days: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per symbol and month: whether the ledger has every business day as completed or without trades."""
    done = ledger.where(F.col("status").isin("completed", "no_trades")).select("symbol", F.col("chunk_date").alias("day"), F.lit(True).alias("done")).distinct()
    expected = ledger.select("symbol").distinct().join(F.broadcast(days))
    marked = expected.join(done, ["symbol", "day"], "left")
    return marked.groupBy("symbol", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("complete"), F.count_if(F.col("done").isNull()).alias("n_missing"))


def pending(days: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned days that the ledger doesn't have as done."""
    done = ledger.where(F.col("status").isin("completed", "no_trades")).select("symbol", F.col("chunk_date").alias("day")).distinct()
    return ledger.select("symbol").distinct().join(F.broadcast(days)).join(done, ["symbol", "day"], "left_anti")


def pending_months(days: DataFrame, ledger: DataFrame) -> DataFrame:
    """Months of the plan, per symbol, of which a business day is still to do."""
    left = pending(days, ledger)
    return left.groupBy("symbol", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.count("*").alias("n_days"))


def holidays_by_year(closed: DataFrame) -> DataFrame:
    """Closed days and closed weekdays of each year."""
    return closed.groupBy(F.year("day").alias("year")).agg(F.count("*").alias("n_days"), F.count_if(F.dayofweek("day").between(2, 6)).alias("n_weekdays"))
