"""Bars, averages, signals and exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeutil import DAY_NS, MINUTE_NS, bucket, day_of

MONEY = "decimal(18,2)"


def _notional() -> Column:
    """Price times quantity, summed exactly: doubles would depend on the order of rows."""
    return F.sum((F.col("price").cast(MONEY) * F.col("quantity").cast("decimal(18,0)")).cast("decimal(38,2)"))


def bars(trades: DataFrame, size: int = MINUTE_NS) -> DataFrame:
    """Open, high, low, close, volume and count per symbol and bucket; ties in time go by sequence."""
    at = F.struct("timestamp_ns", "sequence_within_ns")
    return trades.groupBy("symbol", bucket(F.col("timestamp_ns"), size).alias("bar_ns")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("n_trades"))


def vwap(trades: DataFrame, *by: str) -> DataFrame:
    """Volume-weighted price; NaN where no volume is."""
    sums = trades.groupBy(*by).agg(_notional().cast("double").alias("s"), F.sum("quantity").cast("double").alias("q"))
    return sums.select(*by, F.when(F.coalesce("q", F.lit(0.0)) == 0, F.lit(float("nan"))).otherwise(F.col("s") / F.nullif("q", F.lit(0.0))).alias("vwap"))


def ema(trades: DataFrame, period: int = 20) -> DataFrame:
    """Recursive average per symbol and day, begun with the day's first price.

    A step is a linear map of the average so far, and so are many in a row: each minute's trades fold into one
    (its first price, their number and what they add), and a day folds its 1,440 minutes at most.
    """
    alpha = 2.0 / (period + 1)
    order = F.sort_array(F.collect_list(F.struct("timestamp_ns", "sequence_within_ns", "price")))
    minutes = trades.groupBy("symbol", day_of(F.col("timestamp_ns")).alias("day"), bucket(F.col("timestamp_ns"), MINUTE_NS).alias("minute")).agg(order.alias("t"))
    adds = F.aggregate("t", F.lit(0.0), lambda a, x: F.lit(alpha) * x["price"] + F.lit(1 - alpha) * a)
    folded = minutes.select("symbol", "day", F.struct("minute", F.element_at("t", 1)["price"].alias("first"), F.pow(F.lit(1 - alpha), F.size("t")).alias("keeps"), adds.alias("adds")).alias("m"))
    days = folded.groupBy("symbol", "day").agg(F.sort_array(F.collect_list("m")).alias("m"))
    fold = F.aggregate("m", F.element_at("m", 1)["first"], lambda a, m: m["adds"] + m["keeps"] * a)
    return days.select("symbol", "day", fold.alias("ema"))


def signals(minute_closes: DataFrame, n: int = 10) -> DataFrame:
    """Rolling mean and deviation over ``n`` closes per symbol, z-score, change and the next change."""
    order = Window.partitionBy("symbol").orderBy("bar_ns")
    last = order.rowsBetween(-(n - 1), 0)
    full = F.count("close").over(last) == n
    return minute_closes.withColumns({"mean_n": F.when(full, F.avg("close").over(last)), "std_n": F.when(full, F.stddev_samp("close").over(last)), "change": F.col("close") - F.lag("close").over(order), "next_change": F.lead("close").over(order) - F.col("close")}).withColumn("zscore", (F.col("close") - F.col("mean_n")) / F.nullif("std_n", F.lit(0.0)))


def resample_ffill(trades: DataFrame, size: int = MINUTE_NS) -> DataFrame:
    """Last price per bucket, buckets without trades carrying the one before.

    Each day with trades is filled by itself, from its first bucket to the one before the next such day's first: its first
    bucket has a price, so nothing is carried in from elsewhere, and a symbol's history needn't meet in one task.
    """
    closes = bars(trades, size).select("symbol", "bar_ns", "close")
    days = closes.groupBy("symbol", F.expr(f"bar_ns div {DAY_NS}").alias("day")).agg(F.min("bar_ns").alias("a"), F.max("bar_ns").alias("b"))
    until = F.coalesce(F.lead("a").over(Window.partitionBy("symbol").orderBy("day")) - size, F.col("b"))  # one row per symbol and day
    spine = days.withColumn("until", until).select("symbol", "day", F.explode(F.sequence("a", "until", F.lit(size).cast("long"))).alias("bar_ns"))
    filled = F.last("close", ignorenulls=True).over(Window.partitionBy("symbol", "day").orderBy("bar_ns"))
    return spine.join(closes, ["symbol", "bar_ns"], "left").withColumn("close", filled).drop("day")


def notional_breaches(trades: DataFrame, root: Column, limit: float) -> DataFrame:
    """Turnover by root and whether it is over the limit."""
    return trades.groupBy(root.alias("root")).agg(_notional().cast("double").alias("notional")).withColumn("breach", F.col("notional") > limit)


def trades_per_day(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol", day_of(F.col("timestamp_ns")).alias("day")).agg(F.count("*").alias("n_trades"))


def completeness(events: DataFrame, ok: Column, error: Column, *by: str) -> DataFrame:
    """100 n / (n + errors), 100 where there is neither."""
    return events.groupBy(*by).agg(F.count_if(ok).alias("n_ok"), F.count_if(error).alias("n_error")).withColumn("pct", F.coalesce(100.0 * F.col("n_ok") / F.nullif(F.col("n_ok") + F.col("n_error"), F.lit(0)), F.lit(100.0)))


def volume_band(days: DataFrame, low: float = 0.8, high: float = 1.5) -> DataFrame:
    """Each day's count against the symbol's mean: below, within or above the band."""
    mean = F.avg("n_trades").over(Window.partitionBy("symbol"))
    return days.withColumn("ratio", F.col("n_trades") / mean).withColumn("band", F.when(F.col("ratio") < low, "low").when(F.col("ratio") > high, "high").otherwise("ok"))


def histogram(df: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """Cumulative bucket counts as metrics keep them."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)), F.count("*").alias("le_inf"), F.sum(F.col(value).cast(MONEY)).cast("double").alias("total"))
