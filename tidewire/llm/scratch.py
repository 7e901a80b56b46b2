"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder is made only where that is unset in local mode (tests).

    Elsewhere executors would not share that folder, so an unset one is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"tidewire-{uuid.uuid4().hex}")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    A lost executor costs at most a rerun of the tasks that were writing; later
    reads take the files. Reading forgets the partitioning, so a join on it
    exchanges both sides and adaptive execution can split skewed keys.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names`` for internal columns, lengthened where ``columns`` of a caller (whatever their case) would clash with them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
