"""Sharding by extendible hashing.

A directory indexed by hash-prefix bits: a bucket over its byte limit splits on one more bit, the others stay.  The
directory is built from byte sums per prefix, a few bits deeper each round and only for the buckets still too large, so
rows are never gathered by bucket.  Built-in expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ._common import Scratch

#: Bits from the key's hash, then as many from the row's number, which part rows that share a key.
KEY_BITS, ROW_BITS = 60, 60
#: Bits a round looks ahead.
STEP = 6


def _bits(digest: Column) -> Column:
    """The first 60 bits of a hex digest as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(digest, 1, 15), 16, 2), 60, "0")


def shard(docs: DataFrame, limit: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``shard`` (its prefix bits; empty: one shard holds all), ``depth``, ``shard_bytes`` of every row.

    Every shard's UTF-8 text bytes stay within ``limit``, unless a single row exceeds it, which then is a shard alone
    or with rows of zero bytes.  Null text has zero bytes; null ids hash like the empty text.  Rows that share an id (a third
    of all, say) have its hash in common; their row numbers' bits follow it and part them.
    An empty table gives no rows.  Columns named in ``carry`` come back as fields of the struct ``rest``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    rest = [F.struct(*carry).alias("rest")] if carry else []
    more = ["rest"] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), *rest)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("bits", F.concat(_bits(key), _bits(F.md5(F.col("row").cast("string").cast("binary"))))).drop("row")
    rows = scratch.save(rows, "rows")
    total, n = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    if total <= limit:
        return rows.select("doc_id", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(total).cast("long").alias("shard_bytes"), *more)
    low, high = 0, min(KEY_BITS + ROW_BITS, math.ceil(math.log2(total / limit)) + 3)
    open_rows, leaves, done = rows, [], None
    while True:
        # byte sums of all prefixes from the last depth on, from one partial aggregation at the finest
        fine = open_rows.groupBy(F.substring("bits", 1, high).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        depths = F.explode(F.sequence(F.lit(low), F.lit(high)))
        nodes = fine.select("prefix", "bytes", "rows", depths.alias("depth")).groupBy(F.col("depth"), F.expr("substring(prefix, 1, depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        nodes = scratch.save(nodes, f"nodes{high}")
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") == KEY_BITS + ROW_BITS)
        split = nodes.where(~fits)
        parents = split.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        ok = nodes.where(fits).withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
        tops = ok.where(F.col("depth") == low) if low else ok.limit(0)
        leaf = ok.join(parents, ["depth", "parent"], "left_semi").select("depth", "prefix", "bytes")
        if low:
            leaf = leaf.unionByName(tops.select("depth", "prefix", "bytes"))
        leaf = scratch.save(leaf, f"leaves{high}")
        # each row's leaf, if it has one by now: by the finest prefix, which belongs to one leaf at most
        owner = fine.select("prefix", depths.alias("depth")).withColumn("p", F.expr("substring(prefix, 1, depth)"))
        owner = owner.join(leaf.withColumnRenamed("prefix", "p"), ["depth", "p"]).select("prefix", F.col("p").alias("shard"), "depth", F.col("bytes").alias("shard_bytes"))
        owner = scratch.save(owner, f"owner{high}")
        placed = open_rows.withColumn("prefix", F.substring("bits", 1, high)).join(owner, "prefix", "left").drop("prefix")
        placed = scratch.save(placed, f"placed{high}")
        out = placed.where("shard is not null").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", *more)
        done = out if done is None else done.unionByName(out)
        left = placed.where("shard is null")
        if left.isEmpty():
            return done
        open_rows = left.select("doc_id", "n_bytes", "bits", *more)
        low, high = high + 1, min(KEY_BITS + ROW_BITS, high + STEP)


def write_shards(docs: DataFrame, path: str, limit: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all rows, null and repeated ids included, in one folder per shard."""
    placed = shard(docs, limit, id_col, text_col, carry=docs.columns).select("rest.*", "shard")
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
