"""Symbols, contract codes and partition paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Month letters of futures, January to December.
MONTH_LETTERS = "FGHJKMNQUVXZ"
FUTURE_ROOTS = ("WDO", "WIN", "IND", "DOL")
CHUNK_DAYS: dict[str, int] = {}
DEFAULT_CHUNK_DAYS = 1


def month_letter(month: Column) -> Column:
    return F.when(month.between(1, 12), F.substring(F.lit(MONTH_LETTERS), month.cast("int"), F.lit(1)))


def month_of_letter(letter: Column) -> Column:
    """1 to 12; null for letters (I, L, ...) that name no month."""
    at = F.instr(F.lit(MONTH_LETTERS), F.upper(letter))
    return F.when((F.length(letter) == 1) & (at > 0), at)


def contract_code(root: Column, year: Column, month: Column) -> Column:
    return F.concat(root, month_letter(month), F.lpad((year % 100).cast("string"), 2, "0"))


def assumed_validity(year: Column, month: Column) -> tuple[Column, Column]:
    """From day 26 of the month before to day 28 of the contract's month."""
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(F.add_months(first, -1), 25), F.date_add(first, 27)


def resolve_alias(symbol: Column) -> Column:
    """Upper case without blanks; a bare futures root becomes its continuous symbol."""
    s = F.trim(F.upper(symbol))
    return F.when(s.isin(*FUTURE_ROOTS), F.concat(s, F.lit("FUT"))).otherwise(s)


def is_dated_contract(symbol: Column) -> Column:
    return symbol.rlike(f"^({'|'.join(FUTURE_ROOTS)})[{MONTH_LETTERS}][0-9]{{2}}$")


def is_equity(symbol: Column) -> Column:
    return symbol.rlike("^[A-Z]{4}[0-9]$")


def looks_like_root(symbol: Column) -> Column:
    return (F.length(symbol) < 4) | ~symbol.rlike("[0-9]{2}$")


def chunk_days(symbol: Column, table: dict[str, int] | None = None, default: int = DEFAULT_CHUNK_DAYS) -> Column:
    """Business days per chunk by the longest prefix in the table."""
    out = F.lit(default)
    for prefix, days in sorted((CHUNK_DAYS if table is None else table).items(), key=lambda x: len(x[0])):
        out = F.when(F.upper(symbol).startswith(prefix), days).otherwise(out)
    return out


def partition_path(exchange: Column, symbol: Column, year: Column, month: Column, day: Column | None = None) -> Column:
    base = F.concat_ws("/", exchange, symbol, F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"))
    return F.concat(base, F.lit(".parquet")) if day is None else F.concat(base, F.lit("/"), F.lpad(day.cast("string"), 2, "0"), F.lit(".parquet"))


def parse_partition_path(path: Column) -> Column:
    """Struct of exchange, symbol, year, month and day (null for monthly files); null fields if it is no such path."""
    shape = r"^([FB])/([^/]+)/(\d{4})/(0[1-9]|1[0-2])(?:/(0[1-9]|[12]\d|3[01]))?\.parquet$"
    part = lambda i: F.nullif(F.regexp_extract(path, shape, i), F.lit(""))
    return F.struct(part(1).alias("exchange"), part(2).alias("symbol"), part(3).cast("int").alias("year"), part(4).cast("int").alias("month"), part(5).cast("int").alias("day"))


def semver_at_least(a: Column, b: str) -> Column:
    return F.split(a, r"\.").cast("array<int>") >= F.split(F.lit(b), r"\.").cast("array<int>")


def number_pt(c: Column, decimals: int = 0) -> Column:
    """Brazilian style: points between thousands, a decimal comma."""
    return F.translate(F.format_number(c, decimals), ",.", ".,")


def duration(seconds: Column) -> Column:
    """Hours in as many digits as they take, minutes and seconds; null for null."""
    s = seconds.cast("long")
    text = F.format_string("%02d:%02d:%02d", F.call_function("div", s, F.lit(3600).cast("long")), F.call_function("div", s % 3600, F.lit(60).cast("long")), s % 60)
    return F.when(s.isNotNull(), text)  # the format writes nulls as a word


def retry_delay(attempt: Column, base: float = 1.0, factor: float = 2.0, cap: float = 60.0) -> Column:
    """Seconds before jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(cap))
