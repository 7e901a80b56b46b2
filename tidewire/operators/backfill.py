"""Work through a backlog in ranges of its key, so that a run that was cut is taken up where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import exists


def ranges(rows: DataFrame, key: str, size: int) -> list[tuple[int, int]]:
    """Half-open ranges [lo, hi) of an integer key with about ``size`` rows each, that cover all rows; as many as the rows over ``size``.

    Bounds are approximate quantiles; a key that more than ``size`` rows share stays in one range.
    """
    total, least, most = rows.agg(F.count(key), F.min(key), F.max(key)).first()
    if not total:
        return []
    parts = max(1, -(-total // size))
    inner = rows.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted({least, *(int(x) for x in inner), most + 1})
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def progress(spark: SparkSession, root: str) -> DataFrame | None:
    """(lo, hi, processed, results) of the ranges that are done."""
    return spark.read.parquet(f"{root}/progress/*") if exists(spark, f"{root}/progress") else None


def backfill(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], root: str, size: int = 5000, exclude: str | None = "SEC EDGAR%", limit: int | None = None) -> dict[str, int]:
    """``work`` over all of ``rows`` whose source is not like ``exclude``; results in folders by range, and what was done in this run.

    Ranges are fixed by the first run and kept beside the results, so later runs
    take up the same. A range's results are written before its progress row: a
    run that ends in between does that range again, into the same folder. After
    ``limit`` rows no further range begins.
    """
    spark = rows.sparkSession
    if exclude is not None:
        rows = rows.where(F.coalesce(~F.col("source").like(exclude), F.lit(True)))
    plan = f"{root}/ranges"
    if not exists(spark, plan):
        found = ranges(rows, key, size)
        spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(found)], "nth int, lo long, hi long").coalesce(1).write.mode("overwrite").parquet(plan)
    done = progress(spark, root)
    finished = {r.lo for r in done.select("lo").collect()} if done is not None else set()  # a row for each range
    did = {"ranges": 0, "processed": 0, "results": 0}
    for r in spark.read.parquet(plan).orderBy("nth").collect():
        if r.lo in finished:
            continue
        if limit is not None and did["processed"] >= limit:
            break
        part, out = rows.where((F.col(key) >= r.lo) & (F.col(key) < r.hi)), f"{root}/results/range={r.nth}"
        work(part).write.mode("overwrite").parquet(out)
        n, m = part.count(), spark.read.parquet(out).count()
        spark.createDataFrame([(r.lo, r.hi, n, m)], "lo long, hi long, processed long, results long").coalesce(1).write.mode("overwrite").parquet(f"{root}/progress/range={r.nth}")
        did = {"ranges": did["ranges"] + 1, "processed": did["processed"] + n, "results": did["results"] + m}
    return did


def results(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/results").parquet(f"{root}/results").drop("range")
