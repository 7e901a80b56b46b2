"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import unused, written

#: A Poisson count of a greater mean is summed from pieces of this mean at most, each with its own hash.
PIECE = 8.0
#: Terms of the inverse distribution of a piece; the mass beyond is below the grain of a hash.
TERMS = 60
#: Target weight of a source, when none are given: its share of the rows to this power.
TEMPER = 0.5


def uniform(key: Column, salt: Column | str, seed: int) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of key, salt and seed."""
    digest = F.md5(F.concat_ws(":", key, salt if isinstance(salt, Column) else F.lit(salt), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """(source, rate): the mean number of copies of a row so that sources come to their weights in ``size`` times the rows.

    Sources without a weight get none. A null source is a source of its own (key '').
    """
    rows = docs.groupBy("source").agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        rows = rows.withColumn("w", F.pow("n", F.lit(TEMPER)))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        rows = rows.join(F.broadcast(table), "source", "left").fillna(0.0, ["w"])  # as large as the caller's dictionary
    rows = written(rows)
    total = rows.agg(F.sum("n").alias("total_n"), F.sum("w").alias("total_w"))
    return rows.crossJoin(F.broadcast(total)).select("source", (F.col("w") / F.greatest(F.col("total_w"), F.lit(1e-300)) * F.col("total_n") * size / F.col("n")).alias("rate"))


def poisson(rate: Column, key: Column, seed: int) -> Column:
    """The Poisson count whose distribution function first exceeds the hash of ``key``; pure in its arguments."""
    pieces = F.greatest(F.lit(1), F.ceil(rate / PIECE).cast("int"))
    mean = rate / pieces
    step = F.expr(f"sequence(1, {TERMS})")

    def count(i: Column) -> Column:
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"), uniform(key, i.cast("string"), seed).alias("u"))
        return F.aggregate(
            step,
            start,
            lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["cdf"] + s["p"] * mean / k).alias("cdf"), F.when(s["cdf"] <= s["u"], k).otherwise(s["k"]).alias("k"), s["u"].alias("u")),
            lambda s: s["k"],
        )

    return F.aggregate(F.transform(F.sequence(F.lit(1), pieces), count), F.lit(0), lambda a, b: a + b)


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, any further columns), each as often as its Poisson count says, shuffled globally.

    Adds replica (from 0) and shuffle_key, a hash that deals rows to partitions
    and orders them there; so partition and place give a global shuffle without
    a pass over the texts for range borders. The count depends on doc_id, seed and the source's rate alone: the same row gives the same
    copies wherever it lies, and repeated rows are replicated alike. A null
    source is a source; null doc_ids hash as an empty one, so all of a source draw
    the same count; texts are carried, never read. An empty table stays empty. ``docs`` columns named replica,
    shuffle_key or rate are replaced.

    The rate table has a row for each source and is joined as Spark finds fit: a
    broadcast only under autoBroadcastJoinThreshold, else a join whose skewed
    keys adaptive execution splits.
    """
    docs = docs.drop("replica", "shuffle_key", "rate")
    own, rate, n = unused(docs.columns, "_source", "_rate", "_n")
    table = written(rates(docs, weights, size)).select(F.col("source").alias(own), F.col("rate").alias(rate))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    out = docs.join(table, docs["source"].eqNullSafe(table[own])).drop(own)
    out = out.withColumn(n, poisson(F.col(rate), key, seed)).where(f"{n} > 0")
    out = out.withColumn("replica", F.explode(F.expr(f"sequence(0, {n} - 1)"))).drop(n, rate)
    out = out.withColumn("shuffle_key", F.xxhash64(key, "replica", F.lit(seed)))
    return out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
