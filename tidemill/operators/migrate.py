"""Schema migrations: a graph of versions, a plan, and the 1.0.0 to 1.1.0 transform."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, functions as F

from .. import schema


def v1_0_to_v1_1(df: DataFrame) -> DataFrame:
    """Adds agent and type names where they are missing; a migrated frame stays as it is."""
    for side in ("buy", "sell"):
        if f"{side}_agent_name" not in df.columns:
            df = df.withColumn(f"{side}_agent_name", schema.agent_name(F.col(f"{side}_agent_id")))
    if "trade_type_name" not in df.columns:
        df = df.withColumn("trade_type_name", F.coalesce(schema.trade_type_name(F.col("trade_type")), F.concat(F.lit("TradeType#"), F.col("trade_type").cast("string"))))
    return schema.canonical(df)


MIGRATIONS = {("1.0.0", "1.1.0"): v1_0_to_v1_1}


def path(start: str, end: str, edges=None) -> list[tuple[str, str]]:
    """Shortest chain of migrations, breadth first; raises if there is none."""
    edges, seen, todo = list(MIGRATIONS if edges is None else edges), {start}, deque([(start, [])])
    while todo:
        at, steps = todo.popleft()
        if at == end:
            return steps
        for a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                todo.append((b, [*steps, (a, b)]))
    raise ValueError(f"no migration from {start} to {end}")


def plan(partitions: DataFrame, target: str = schema.VERSION, mb_s: float = 50.0) -> DataFrame:
    """Partitions to migrate, their bytes and the time that takes."""
    return partitions.where(F.col("schema_version") != target).agg(F.count("*").alias("n_partitions"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("n_bytes")).withColumn("eta_s", F.col("n_bytes") / (mb_s * 1024 * 1024))


def migrate(df: DataFrame, start: str, end: str = schema.VERSION) -> DataFrame:
    for step in path(start, end):
        df = MIGRATIONS[step](df)
    return df
