"""From raw trades to canonical, validated, enriched, sequenced and deduplicated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema
from ..functions.timeutil import format_ns


class TradeError(ValueError):
    """A batch holds trades that break a rule."""


#: Rules in the order they are judged; each says what a bad value looks like.
def violations() -> dict[str, Column]:
    price, quantity, exchange, ns = (F.col(c) for c in ("price", "quantity", "exchange", "timestamp_ns"))
    return {
        "price": price.isNull() | F.isnan(price) | (price <= 0),
        "quantity": quantity.isNull() | (quantity <= 0),
        "exchange": exchange.isNull() | ~exchange.isin(*schema.EXCHANGES),
        "timestamp_ns": ns.isNull() | (ns <= 0),
    }


def with_violation(df: DataFrame) -> DataFrame:
    """Adds ``violation``: the first rule that the row breaks, or null."""
    return df.withColumn("violation", F.coalesce(*(F.when(bad, name) for name, bad in violations().items())))


def first_offenders(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Per rule: how many rows break it and the first of them in arrival order."""
    rules = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("rule"), bad.alias("bad")) for i, (n, bad) in enumerate(violations().items())))).alias("v")
    return df.select(arrival, rules).where("v.bad").groupBy("v.place", "v.rule").agg(F.count("*").alias("n_bad"), F.min(arrival).alias("first_arrival")).orderBy("place").drop("place")


def validate(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Raises on the first rule, in their order, that any row breaks; one pass."""
    row = df.agg(*(F.min(F.when(bad, F.col(arrival))).alias(n) for n, bad in violations().items())).first()
    for rule in violations():
        if row[rule] is not None:
            raise TradeError(f"{rule} is invalid, first in the row that arrived as {row[rule]}")
    return df


def source_filter(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows a source may pass on, and counts of the sentinels and prices dropped."""
    sentinel, price = F.col("timestamp_ns") < 0, F.col("price") <= 0
    kept = raw.where(~F.coalesce(sentinel | price, F.lit(False)))
    return kept, raw.agg(F.count_if(sentinel).alias("sentinel_skips"), F.count_if(~sentinel & price).alias("invalid_price_skips"), F.count_if(F.col("flags").bitwiseAND(schema.IS_EDIT) != 0).alias("edits"))


def to_canonical(raw: DataFrame, agents: DataFrame | None = None, *, source: str = "history_v2", version: str = "0", ingested_ns: int = 0, chunk: str | None = None) -> DataFrame:
    """Raw rows as trades: non-positive numbers and agent 0 become null, names are looked up; keeps ``arrival``."""
    df = raw
    for side in ("buy", "sell"):
        df = df.withColumn(f"{side}_agent_id", F.when(F.col(f"{side}_agent_id") != 0, F.col(f"{side}_agent_id")))
        if agents is None:
            df = df.withColumn(f"{side}_agent_name", schema.agent_name(F.col(f"{side}_agent_id")))
        else:
            names = agents.select(F.col("agent_id").alias(f"{side}_agent_id"), F.col("agent_name").alias(f"__{side}"))
            df = df.join(names, f"{side}_agent_id", "left").withColumn(f"{side}_agent_name", schema.agent_name(F.col(f"{side}_agent_id"), F.col(f"__{side}")))
    df = df.withColumns({
        "trade_id": F.when(F.col("trade_number") > 0, F.col("trade_number")), "timestamp_str": format_ns(F.col("timestamp_ns")), "source_callback": F.lit(source), "side": F.lit(None).cast("smallint"),
        "ingestion_ts_ns": F.lit(ingested_ns).cast("long"), "chunk_id": F.lit(chunk).cast("string"), "dll_version": F.lit(version), "sequence_within_ns": F.lit(0), "trade_type_name": schema.trade_type_name(F.col("trade_type")),
    })
    return df.select(*schema.TRADE.names, "arrival")


def enrich(df: DataFrame, *, ingested_ns: int, version: str, chunk: str | None = None) -> DataFrame:
    """Sets missing ingestion times and chunks, overwrites the library version, fills names."""
    return df.withColumns({"ingestion_ts_ns": F.coalesce("ingestion_ts_ns", F.lit(ingested_ns).cast("long")), "dll_version": F.lit(version), "chunk_id": F.coalesce("chunk_id", F.lit(chunk)), "trade_type_name": schema.trade_type_name(F.col("trade_type"))})


def sequence(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """``sequence_within_ns``: place, from 0, among the trades of a symbol at the same time, in arrival order."""
    return df.withColumn("sequence_within_ns", (F.row_number().over(Window.partitionBy("symbol", "timestamp_ns").orderBy(arrival)) - 1).cast("int"))


def dedup(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The first arrival of each trade stays, in one shuffle.

    With a trade id the key is (symbol, time, id); without one it is (symbol, time, price, quantity, agents, sequence), where
    nulls equal each other.
    """
    no_id = F.col("trade_id").isNull()
    long_key = [F.when(no_id, F.col(c)) for c in ("price", "quantity", "buy_agent_id", "sell_agent_id", "sequence_within_ns")]
    window = Window.partitionBy("symbol", "timestamp_ns", "trade_id", *long_key).orderBy(arrival)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def merge(existing: DataFrame, new: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Stored rows precede new ones; duplicates go by the stored sequence."""
    both = existing.withColumn("__prio", F.lit(0)).unionByName(new.withColumn("__prio", F.lit(1)), allowMissingColumns=True)
    return dedup(both.withColumn("__order", F.struct("__prio", arrival)), "__order").drop("__order", "__prio")


def new_rows(batch: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch whose key, nulls included, isn't stored yet."""
    keys = existing.select(*(F.col(k).alias(f"__{k}") for k in key))
    on = None
    for k in key:
        on = F.col(k).eqNullSafe(F.col(f"__{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return batch.join(keys, on, "left_anti")
