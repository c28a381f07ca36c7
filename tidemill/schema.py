"""The trade schema: fixed, versioned, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

VERSION = "1.1.0"
_FIELDS = """symbol string!, exchange string!, timestamp_ns bigint!, timestamp_str string!, price double!, quantity bigint!,
trade_id bigint, trade_type smallint!, buy_agent_id int, sell_agent_id int, flags bigint!, source_callback string!, side smallint,
ingestion_ts_ns bigint!, chunk_id string, dll_version string!, sequence_within_ns int!,
buy_agent_name string, sell_agent_name string, trade_type_name string"""
_PARSED = [f.split() for f in _FIELDS.replace("\n", " ").split(",")]
REQUIRED = [n for n, t in _PARSED if t.endswith("!")]
_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "double": T.DoubleType()}
TRADE = T.StructType([T.StructField(n, _TYPES[t.rstrip("!")], True) for n, t in _PARSED])
TRADE_V1_0 = T.StructType(TRADE.fields[:17])
_RAW = "symbol string, exchange string, timestamp_ns bigint, price double, quantity bigint, trade_number bigint, trade_type smallint, buy_agent_id int, sell_agent_id int, flags bigint, arrival bigint"
RAW = T.StructType([T.StructField(f.split()[0], _TYPES[f.split()[1]], True) for f in _RAW.split(", ")])

#: Names of the trade types 0 to 13.
TRADE_TYPES = ["Zero", "CrossTrade", "AgressionBuy", "AgressionSell", "Auction", "Surveillance", "Expit", "OptionsExercise", "OverTheCounter", "DerivativeTerm", "Index", "BTC", "OnBehalf", "RLP"]
EXCHANGES = ("F", "B")
IS_EDIT, LAST_PACKET = 1, 2


class SchemaError(ValueError):
    """A frame doesn't match the trade schema."""


def trade_type_name(c: Column) -> Column:
    """Name of a trade type; null for an unknown one."""
    return F.element_at(F.create_map(*(x for i, n in enumerate(TRADE_TYPES) for x in (F.lit(i), F.lit(n)))), c.cast("int"))


def agent_name(c: Column, names: Column | None = None) -> Column:
    """``Agent#id`` where no name is known; null for a null id."""
    fallback = F.concat(F.lit("Agent#"), c.cast("string"))
    return fallback if names is None else F.when(c.isNotNull(), F.coalesce(names, fallback))


def guard(df: DataFrame, allowed: T.StructType = TRADE) -> DataFrame:
    """Raises on columns outside the schema: nothing is dropped silently."""
    extra = sorted(set(df.columns) - set(allowed.names))
    if extra:
        raise SchemaError(f"columns outside the schema: {extra}")
    return df


def canonical(df: DataFrame, schema: T.StructType = TRADE) -> DataFrame:
    """Columns in order and type of the schema; missing nullable ones become null, missing required ones raise."""
    missing = [n for n in REQUIRED if n in schema.names and n not in df.columns]
    if missing:
        raise SchemaError(f"required columns are missing: {missing}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def assert_not_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One aggregate over the required columns; raises with the counts of nulls."""
    columns = [c for c in (columns or REQUIRED) if c in df.columns]
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    bad = {c: row[c] for c in columns if row[c]}
    if bad:
        raise SchemaError(f"nulls in required columns: {bad}")
    return df
