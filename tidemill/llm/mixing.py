"""Mixing sources to target weights by Poisson replication.

A document of a source with mean repetition rate r occurs Poisson(r) times: its id and the seed hash to a uniform
number, which the distribution function inverts.  Every copy then gets a hashed place in one global order.
Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rates above this are split into equal parts, whose counts add up to a Poisson count again.
PART = 16.0
#: Up to this many sources, their rates are broadcast; beyond, documents and rates are joined by shuffle.
BROADCAST_SOURCES = 20_000
SALTS = 32


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 over seed and parts."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, source_col: str = "source") -> DataFrame:
    """``source`` and mean repetition ``rate`` for a mix of ``total`` times the rows.

    ``weights``: target share by source (others get none); by default a source's share goes with the root of its rows,
    which lifts small sources without emptying the large ones.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        share = F.sqrt("n_docs")
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(name), F.lit(float(w))).otherwise(share)
    counts = counts.withColumn("share", share)
    sums = counts.agg(F.sum("share").alias("shares"), F.sum("n_docs").alias("docs"))  # one row
    return counts.join(F.broadcast(sums)).select("source", "n_docs", F.when(F.col("shares") > 0, F.col("share") / F.col("shares") * F.col("docs") * F.lit(float(total)) / F.col("n_docs")).otherwise(0.0).alias("rate"))


def poisson_count(rate: Column, seed: str, *key: Column) -> Column:
    """The count whose distribution function first exceeds the key's uniform number; large rates in equal parts."""
    parts = F.greatest(F.lit(1), F.ceil(rate / PART)).cast("int")
    each = rate / parts
    steps = F.sequence(F.lit(1), F.lit(80))  # beyond 80 a rate of 16 leaves less than 1e-25
    # terms of the distribution, then sums: a list of [term, sum] folded over the steps
    start = F.struct(F.exp(-each).alias("term"), F.exp(-each).alias("sum"), F.lit(0).alias("n"))

    def draw(j: Column) -> Column:
        def step(u: Column):
            def at(s: Column, k: Column) -> Column:
                term = s["term"] * each / k
                over = u >= s["sum"]
                return F.struct(F.when(over, term).otherwise(s["term"]).alias("term"), F.when(over, s["sum"] + term).otherwise(s["sum"]).alias("sum"), F.when(over, k).otherwise(s["n"]).alias("n"))

            return at

        # a lambda's variable holds the hash, so that it isn't computed anew at each step
        return F.transform(F.array(uniform(seed, *key, j.cast("string"))), lambda u: F.aggregate(steps, start, step(u), lambda s: s["n"]))[0]

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0), lambda a, x: a + x)


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as its Poisson count says, with ``copy`` (from 1), ``rate`` and ``place`` (hex hash).

    Null is a source like any other; a null id hashes as the empty text, and rows that repeat an id repeat its count.
    Only these three columns are added; a column of ``docs`` with such a name is replaced.
    """
    rates = source_rates(docs.select(source_col), weights, total, source_col).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    base = docs.drop("copy", "rate", "place")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = base.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col("__source")))
    else:  # hot sources are spread over salts
        salted = base.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        every = rates.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(every, F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__salt2"))).drop("__salt", "__salt2")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    counted = joined.withColumn("__n", poisson_count(F.col("__rate"), seed, key)).where("__n > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return copies.withColumn("rate", F.col("__rate")).withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), key, F.col("copy")).cast("binary"))).drop("__source", "__rate", "__n")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``replicate``, dealt out and sorted by ``place``: one global shuffle.

    The hash is uniform, so its leading hex digits deal even ranges without sampling the rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = replicate(docs, **options)
    part = F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * parts
    return copies.withColumn("__part", F.shiftright(part, 32).cast("int")).repartitionById(parts, "__part").sortWithinPartitions("place").drop("__part")
