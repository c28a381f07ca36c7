"""Holiday files, contract seeds and synthetic trades."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema

#: Exchange codes in holiday files that mean the home exchange.
HOME_CODES = ("35", "66", "70", "88", "99")


def holidays_file(spark: SparkSession, path: str) -> DataFrame:
    """``day`` of full-day home holidays from lines ``EE:DATE:OPEN:CLOSE:DESC``; ``//`` lines are comments.

    Raises on a line of another shape or with an impossible date.
    """
    line = F.trim(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r$", ""))
    shape = r"^(\d+):(\d{8})\d+:(\d*):(\d*):(.*)$"
    rows = spark.read.text(path).select(line.alias("line")).where("line <> '' and not startswith(line, '//')")
    rows = rows.select(F.when(F.col("line").rlike(shape), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("bad holiday line: "), "line"))).alias("line"))
    home = rows.where(F.regexp_extract("line", shape, 1).isin(*HOME_CODES) & (F.regexp_extract("line", shape, 3) == ""))
    return home.select(F.to_date(F.regexp_extract("line", shape, 2), "yyyyMMdd").alias("day")).distinct()


def contract_seed(spark: SparkSession, markdown: str) -> DataFrame:
    """Contracts from the first fenced ``contracts:`` list of a document."""
    items: list[dict[str, str]] = []
    for raw in markdown.partition("contracts:")[2].partition("```")[0].splitlines():
        text = raw.strip()
        if not text or text.startswith("#"):
            continue
        if text.startswith("- "):
            items.append({})
            text = text[2:]
        key, _, value = text.partition(":")
        value = value.strip()
        value = value[1 : value.index('"', 1)] if value.startswith('"') else value.partition("#")[0].strip()
        items[-1][key.strip()] = value
    as_date = lambda x: None if x in (None, "", "null") else date.fromisoformat(x)
    rows = [(i["symbol_root"], i["contract_code"], as_date(i["vigent_from"]), as_date(i["vigent_until"]), as_date(i.get("validated_at")), i.get("validation_source"), i.get("notes")) for i in items]
    return spark.createDataFrame(rows, "symbol_root string, contract_code string, vigent_from date, vigent_until date, validated_at date, validation_source string, notes string")


def synthetic_trades(spark: SparkSession, n: int, symbol: str = "WDOJ26", start_ns: int = 1_700_000_000_000_000_000, seed: int = 42, null_id: float = 0.1, duplicates: float = 0.01) -> DataFrame:
    """Raw trades from hashes of the row number: the same for any partitioning."""
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1e6
    base = spark.range(n)
    of = F.when(u("dup") < duplicates, F.greatest(F.col("id") - 1, F.lit(0))).otherwise(F.col("id"))
    base = base.select(F.col("id").alias("arrival"), of.alias("id"))
    return base.select(F.lit(symbol).alias("symbol"), F.lit("F").alias("exchange"), (F.lit(start_ns) + F.col("id") * 1_000_000).alias("timestamp_ns"), (F.lit(5300.0) + F.round((u("p") - 0.5) * 400) * 0.5).alias("price"), (F.floor(u("q") * 100) + 1).alias("quantity"), F.when(u("n") < null_id, 0).otherwise(F.col("id") + 1).cast("long").alias("trade_number"), F.lit(2).cast("smallint").alias("trade_type"), F.floor(u("b") * 50).cast("int").alias("buy_agent_id"), F.floor(u("s") * 50).cast("int").alias("sell_agent_id"), F.lit(0).cast("long").alias("flags"), "arrival").select(*schema.RAW.names)
