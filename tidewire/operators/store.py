"""Append-only tables: inserts without duplicates, upserts, annotations of which the latest counts.

Rows are annotated, never changed; every function is pure and returns the new
snapshot, which the caller writes beside the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_if_absent(inbox: DataFrame, target: DataFrame, key: str, arrival: str) -> DataFrame:
    """The rows to append: of each key the first to arrive, unless the target has the key."""
    rest = [c for c in inbox.columns if c != key]
    first = inbox.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(arrival, *[c for c in rest if c != arrival])).alias("_r")).select(key, "_r.*")
    return first.join(target.select(key), key, "left_anti").select(*inbox.columns)


def not_in(rows: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """NOT IN: nothing if ``other`` holds a NULL, rows whose value is NULL only if it is empty."""
    seen = other.select(F.col(other_column).alias("_v"))
    facts = seen.agg(F.count("*").alias("_n"), F.count_if(F.col("_v").isNull()).alias("_nulls"))
    kept = rows.join(seen.where("_v is not null").distinct(), F.col(column) == F.col("_v"), "left_anti")
    return kept.crossJoin(F.broadcast(facts)).where((F.col("_n") == 0) | (F.col("_nulls") == 0) & F.col(column).isNotNull()).drop("_n", "_nulls")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], greatest: list[str] | None = None) -> DataFrame:
    """New values replace old ones of the same key; columns in ``greatest`` keep the larger value."""
    greatest = greatest or []
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_o"))
    b = new.select(*keys, F.struct(*values).alias("_n"))
    both = a.join(b, keys, "full")
    pick = {c: F.greatest(f"_o.{c}", f"_n.{c}") if c in greatest else F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")) for c in values}
    return both.select(*[F.col(c) if c in keys else pick[c].alias(c) for c in old.columns])


def with_latest(base: DataFrame, notes: DataFrame, key: str, at: str) -> DataFrame:
    """``base`` with the latest annotation of each row, NULL where there is none."""
    values = [c for c in notes.columns if c not in (key, at)]
    latest = notes.groupBy(key).agg(F.max_by(F.struct(*values), at).alias("_r")).select(key, "_r.*")
    return base.join(latest, key, "left")


def delete(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (so also where it is NULL)."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def update_from(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Values of ``changes`` where it has the key and the value is not NULL."""
    values = [c for c in changes.columns if c not in keys]
    joined = rows.join(changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values]), keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in rows.columns])


def mark(rows: DataFrame, done: DataFrame, ids: DataFrame, key: str, stamp: Column) -> DataFrame:
    """Annotations to append for ``ids`` that have none yet."""
    return ids.select(key).distinct().join(done.select(key), key, "left_anti").join(rows.select(key), key, "left_semi").withColumn("at", stamp)


def merge_report(staging: DataFrame, target: DataFrame, key: str, arrival: str) -> DataFrame:
    """How many rows were staged, how many are new, how many the target has then."""
    new = insert_if_absent(staging, target, key, arrival).agg(F.count("*").alias("inserted"))
    one = staging.agg(F.count("*").alias("staged")).crossJoin(new).crossJoin(target.agg(F.count("*").alias("_t")))
    return one.select("staged", "inserted", (F.col("_t") + F.col("inserted")).alias("total"))


def delta(before: DataFrame, after: DataFrame, key: str, at: str) -> DataFrame:
    """(at, n, lo, hi): count and range of both tables, and how many keys were lost and gained; the keys are compared in one full join."""
    both = before.select(F.col(key), F.col(at).alias("_b"), F.lit(True).alias("_old")).join(after.select(F.col(key), F.col(at).alias("_a"), F.lit(True).alias("_new")), key, "full")
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    row = lambda name, n, lo=None, hi=None: F.struct(F.lit(name).alias("at"), n.alias("n"), (lo if lo is not None else F.min(F.when(F.lit(False), F.col("_b")))).alias("lo"), (hi if hi is not None else F.min(F.when(F.lit(False), F.col("_b")))).alias("hi"))
    found = both.agg(F.array(row("before", F.count_if(old), F.min("_b"), F.max("_b")), row("after", F.count_if(new), F.min("_a"), F.max("_a")), row("lost", F.count_if(old & ~new)), row("gained", F.count_if(new & ~old))).alias("x"))
    return found.select(F.explode("x").alias("x")).select("x.*")


def check_counts(before: DataFrame, after: DataFrame) -> int:
    """The number of rows lost; 0 in an archive that only annotates."""
    return before.count() - after.count()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any store that Spark reads."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
