"""Samples in proportion to strata, repeatable by hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified_sample(rows: DataFrame, stratum: str, key: str, limit: int, seed: int = 42, cut: bool = True) -> DataFrame:
    """About ``limit`` rows: of each stratum (null is one) its share, one at least, in the order of a hash; then shuffled and cut at ``limit``.

    Shares are rounded up, so all together may be more than ``limit``; without ``cut`` all of them stay, in no order.

    Spark ranks before the exchange too (window group limit), so only the quota
    of each stratum moves.
    """
    order = lambda s: F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(s))))
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_cnt"))
    total = rows.agg(F.count("*").alias("_total"))
    quotas = counts.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.ceil(F.col("_cnt").cast("double") * limit / F.col("_total"))).alias("_quota"))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(order(seed), key))).where(F.col("_rn") <= limit)
    quotas = quotas.withColumnRenamed(stratum, "_stratum")
    taken = ranked.join(quotas, F.col(stratum).eqNullSafe(F.col("_stratum"))).where("_rn <= _quota").select(*rows.columns)
    return taken.orderBy(order(seed + 1), key).limit(limit) if cut else taken
