"""New vectors matched to the centroids of their day, which are the stream's state; and noise clustered again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import clustering as C

OUTPUT = "day long, id long, centroid_id long, distance double, is_centroid boolean"


def matched(ids: np.ndarray, vectors: np.ndarray, known_ids: list[int], known: np.ndarray, threshold: float) -> tuple[pd.DataFrame, list[int]]:
    """Rows of one day and batch: the nearest known centroid if near enough (first id of equals), else clusters among the rest; and the places of new centroids.

    Rows alone are centroids of themselves, so a later one can still join them.
    """
    order = np.argsort(ids, kind="stable")
    ids, unit = ids[order], C.unit_rows(pd.Series(list(vectors[order])))
    target, distance, own = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.zeros(len(ids), bool)
    free = np.arange(len(ids))
    if len(known_ids):
        by_id = np.argsort(known_ids, kind="stable")
        sim = np.round(unit @ known[by_id].T, 12)
        best = sim.argmax(1)
        near = sim[np.arange(len(ids)), best] >= threshold
        target[near], distance[near] = np.array(known_ids)[by_id][best[near]], 1 - sim[near, best[near]]
        free = np.flatnonzero(~near)
    if len(free):
        sim = unit[free] @ unit[free].T
        similar = sim >= threshold
        np.fill_diagonal(similar, True)
        out = C._assigned(ids[free], sim, C.greedy_labels(similar, 2))
        label, centre = out["cluster_label"].to_numpy(), out["is_centroid"].to_numpy()
        heads = {k: ids[free][i] for i, k in enumerate(label) if k >= 0 and centre[i]}
        target[free] = [heads[k] if k >= 0 else ids[free][i] for i, k in enumerate(label)]
        distance[free], own[free] = out["distance_to_centroid"], centre
    found = pd.DataFrame({"id": ids, "centroid_id": target, "distance": np.round(distance, 9), "is_centroid": own})
    return found, order[own].tolist()


class DayCentroids(StatefulProcessor):
    """State of a day: its centroids (id, unit vector); a timer drops them ``keep_hours`` after the last arrival of the day's rows."""

    def __init__(self, threshold: float, keep_hours: int):
        self.threshold, self.keep_hours = threshold, keep_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.centroids = handle.getListState("centroids", "id long, vector array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))  # what one batch brings for a day, which maxFilesPerTrigger bounds
        state = list(self.centroids.get())
        vectors = np.array(batch["vector"].tolist(), np.float64).reshape(len(batch), -1)
        known = np.array([s[1] for s in state], np.float64).reshape(len(state), vectors.shape[1])
        found, heads = matched(batch["id"].to_numpy(), vectors, [s[0] for s in state], known, self.threshold)
        if heads:
            unit = C.unit_rows(pd.Series(list(vectors[heads])))
            self.centroids.appendList([(int(batch["id"].iloc[i]), u.tolist()) for i, u in zip(heads, unit, strict=True)])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(batch["arrived"].max().timestamp() * 1000) + self.keep_hours * 3_600_000)
        found.insert(0, "day", int(key[0]))
        yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.centroids.clear()
        return iter([])

    def close(self) -> None:
        pass


def by_day(rows: DataFrame) -> DataFrame:
    """(day, id, vector, arrived) of ``rows`` (id, vector, at, fetched_at): the day of at, counted from 1970; rows without one share the day -1."""
    day = F.coalesce(F.datediff(F.to_date("at"), F.lit("1970-01-01")).cast("long"), F.lit(-1).cast("long"))
    return rows.select(day.alias("day"), "id", "vector", F.col("fetched_at").cast("timestamp").alias("arrived"))


def day_stream(rows: DataFrame, out: str, checkpoint: str, threshold: float, keep_hours: int = 96) -> StreamingQuery:
    """Assignments (day, id, centroid_id, distance, is_centroid) of a stream of ``rows`` (id, vector, at, fetched_at), appended to ``out``.

    Only the state of days that a batch touches is read; after a restart it is
    that of the last finished batch. Time is arrival, so news of an old day is
    never late; it begins a new state if the day's has gone. The session needs
    the RocksDB state store.
    """
    timed = by_day(rows).withWatermark("arrived", f"{keep_hours} hours")
    found = timed.groupBy("day").transformWithStateInPandas(statefulProcessor=DayCentroids(threshold, keep_hours), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def recluster_noise(assigned: DataFrame, vectors: DataFrame, threshold: float, days: int = 2) -> DataFrame:
    """New assignments for rows that stayed alone: those of ``days`` consecutive days are clustered together, whichever batch they came in.

    ``assigned`` has the columns of ``day_stream``, ``vectors`` (id, vector). Only rows that found company are returned.
    """
    sizes = assigned.groupBy("centroid_id").agg(F.count("*").alias("n"))
    alone = assigned.where("is_centroid").join(sizes.where("n = 1"), "centroid_id").select("id", "day")
    rows = alone.join(vectors, "id").select("id", "vector", F.expr(f"day div {days}").alias("block"), "day")
    found = C.cluster_vectors(rows, threshold).where("cluster_label >= 0")
    heads = found.where("is_centroid").select("block", "cluster_label", F.col("id").alias("centroid_id"))
    out = found.join(heads, ["block", "cluster_label"]).join(alone, "id")
    return out.select("day", "id", "centroid_id", F.round("distance_to_centroid", 9).alias("distance"), "is_centroid")
