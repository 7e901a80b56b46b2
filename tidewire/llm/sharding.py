"""Shards that all match the mixture of sources: proportional stratified interleaving, with equal texts kept together."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Rows of a bin that one task sorts: this many times the root of the row count, so bins and rows of a bin grow alike.
BIN = 4
#: Groups of equal texts above this part of a shard are packed one by one; there are shards / LARGE of them at most.
LARGE = 1 / 8


def bin_rows(total: int) -> int:
    return max(256, int(BIN * total**0.5))


def numbered(rows: DataFrame, key: str, size: Column, total: int) -> DataFrame:
    """``rows`` with nth, their place from 0 on among the ``size`` rows of their key, in the order of h, then of tie.

    h is a 64-bit hash. Each key has so many bins of its range that one holds
    about ``bin_rows`` rows; places come from the counts of bins and the places
    inside a bin, so no task sorts a whole key. Rows equal in h and tie are
    interchangeable.
    """
    bins = F.ceil(size / F.lit(float(bin_rows(total))))
    rows = rows.withColumn("bin", F.least(F.floor(F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63)) * bins), bins - 1).cast("int"))
    counts = rows.groupBy(key, "bin").agg(F.count("*").alias("c"))
    # One row for each bin: a window over a key is in proportion to the root of its size.
    before = written(counts.withColumn("before", F.sum("c").over(Window.partitionBy(key).orderBy("bin")) - F.col("c")).drop("c"))
    inside = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key, "bin").orderBy("h", "tie")))
    return inside.join(before, [key, "bin"]).withColumn("nth", F.col("before") + F.col("nth") - 1).drop("bin", "before")


def interleaved(rows: DataFrame, seed: int = 29) -> DataFrame:
    """``rows`` (id, source, tie, any further columns but s, h, n, nth, at, cut) with pos, their place from 0 on when sources are interleaved in proportion.

    Each source's rows are ranked in a seeded random order of their ids; rank r
    of n stands at (r + 1/2) / n; all rows are sorted by that, so any stretch of
    the result holds every source in proportion to within one row. Neither a hot
    source nor the whole table is ever sorted by one task.
    """
    own = rows.columns
    rows = rows.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    sizes = written(rows.groupBy("s").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    ranked = numbered(rows.join(sizes, "s"), "s", F.col("n"), total)
    cuts = max(1, -(-total // bin_rows(total)))
    ranked = ranked.withColumn("at", (F.col("nth") + 0.5) / F.col("n"))
    ranked = written(ranked.withColumn("cut", F.floor(F.col("at") * cuts).cast("long")).select(*own, "s", "at", "cut"))
    upto = ranked.groupBy("cut").agg(F.count("*").alias("c"))
    # One row for each cut: a window over all of them is in proportion to the root of the row count.
    upto = written(upto.withColumn("base", F.sum("c").over(Window.orderBy("cut")) - F.col("c")).drop("c"))
    placed = ranked.withColumn("p", F.row_number().over(Window.partitionBy("cut").orderBy("at", "s", "tie")))
    return placed.join(upto, "cut").select(*own, (F.col("base") + F.col("p") - 1).alias("pos"))


def packed(groups: list[tuple[int, str]], room: list[int], whole: list[int]) -> list[tuple[str, int, int, int]]:
    """(text, rows, shard, first slot) of the ``groups`` (rows, text) that fit, the largest first, each into the shard with most ``room`` left of its ``whole``; the room is taken."""
    heap = [(-free, s) for s, free in enumerate(room)]
    heapq.heapify(heap)
    out = []
    for k, text in sorted(groups, key=lambda g: (-g[0], g[1])):
        free, s = heap[0]
        if k <= -free:
            heapq.heapreplace(heap, (free + k, s))
            out.append((text, k, s, whole[s] + free))
            room[s] -= k
    return out


def together(groups: DataFrame, room: list[int], seed: int) -> tuple[DataFrame, list[int]]:
    """(text, k, shard, base) of each of ``groups`` (text, k, source) that lies whole in a shard, from slot base on, and the rows that each shard holds so.

    ``room`` is the shards' row counts. Large groups are packed by the driver
    (LARGE bounds their number). The others are interleaved by source and cut
    where the shards' free rows say, each going where it begins; those that would
    overfill a shard there, one for a shard at most, are packed at last.
    """
    spark, shards, whole = groups.sparkSession, len(room), list(room)
    limit = max(1, int(min(room) * LARGE))
    large = [(r.k, r.text) for r in groups.where(f"k > {limit} and k <= {max(room)}").collect()]
    schema = "text string, k long, shard int, base long"
    rows = spark.createDataFrame(packed(large, room, whole), schema)
    small = groups.where(f"k <= {limit}").select(F.col("text").alias("id"), "source", F.col("text").alias("tie"), "k")
    ordered = written(interleaved(small, seed))
    count = ordered.count()
    if count:
        step = bin_rows(count)
        ordered = ordered.withColumn("bin", F.floor(F.col("pos") / step).cast("long"))
        bins = ordered.groupBy("bin").agg(F.sum("k").alias("c"))
        bins = written(bins.withColumn("before", F.sum("c").over(Window.orderBy("bin")) - F.col("c")).drop("c"))  # one row for each bin
        inside = ordered.withColumn("x", F.sum("k").over(Window.partitionBy("bin").orderBy("pos")) - F.col("k"))
        ordered = inside.join(bins, "bin").withColumn("x", F.col("x") + F.col("before"))
        total, free, ends, seen = ordered.agg(F.sum("k")).first()[0], max(1, sum(room)), [], 0
        for r in room:
            ends.append(-(-total * seen // free))
            seen += r
        ends.append(total)
        ordered = written(ordered.withColumn("shard", _bucket(F.col("x"), ends[:-1])).withColumn("over", F.col("x") + F.col("k") > F.element_at(F.array(*map(F.lit, ends)), F.col("shard") + 2)))
        taken = {r.shard: (r.first, r.rows) for r in ordered.groupBy("shard").agg(F.min("x").alias("first"), F.sum("k").alias("rows")).collect()}  # a row for each shard
        crowded = [s for s, (_, n) in taken.items() if n > room[s]]
        last = F.col("over") & F.col("shard").isin(crowded)
        late = [(r.k, r.id) for r in ordered.where(last).collect()]  # one for a shard at most
        ordered = ordered.where(~last)
        base = F.element_at(F.array(*[F.lit(whole[s] - room[s] - taken.get(s, (0, 0))[0]) for s in range(shards)]), F.col("shard") + 1)
        small_held = written(ordered.select(F.col("id").alias("text"), "k", "shard", (F.col("x") + base).alias("base")))
        rows = rows.unionByName(small_held)
        for r in small_held.groupBy("shard").agg(F.sum("k").alias("k")).collect():  # a row for each shard
            room[r.shard] -= r.k
        rows = rows.unionByName(spark.createDataFrame(packed(late, room, whole), schema))
    return written(rows), [a - b for a, b in zip(whole, room, strict=True)]


def _bucket(x: Column, starts: list[int]) -> Column:
    """The last of the ascending ``starts`` that is not above x."""
    return (F.size(F.filter(F.array(*[F.lit(int(s)) for s in starts]), lambda c: c <= x)) - 1).cast("int")


def sharded(rows: DataFrame, shards: int, seed: int = 29) -> DataFrame:
    """``rows`` (id, source, tie, text: a digest or null, any further columns but those named here and in ``interleaved``) with shard and slot.

    Row counts of shards differ by one at most. Rows of equal text lie in one
    shard if they fit there; a group that is larger than a shard is interleaved
    like rows without copies.
    """
    own, total = rows.columns, rows.count()
    room = [total // shards + (s < total % shards) for s in range(shards)]
    counts = rows.where("text is not null").groupBy("text").agg(F.count("*").alias("k"), F.min_by("source", F.struct("id", "source")).alias("source"))
    groups = written(counts.where(f"k > 1 and k <= {max(room)}"))
    held, filled = together(groups, list(room), seed)
    rows = written(rows.join(held, "text", "left"))
    grouped = rows.where("shard is not null").withColumn("h", F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    grouped = numbered(grouped, "text", F.col("k"), total).withColumn("slot", F.col("base") + F.col("nth")).select(*own, "shard", "slot")
    starts = [0]
    for n, f in zip(room, filled, strict=True):
        starts.append(starts[-1] + n - f)
    loose = interleaved(rows.where("shard is null").select(*own), seed).withColumn("shard", _bucket(F.col("pos"), starts[:-1]))
    first = F.element_at(F.array(*[F.lit(f - s) for f, s in zip(filled, starts[:-1], strict=True)]), F.col("shard") + 1)
    return grouped.unionByName(loose.withColumn("slot", F.col("pos") + first).select(*own, "shard", "slot"))


def shard_table(docs: DataFrame, shards: int = 40, seed: int = 29) -> DataFrame:
    """(doc_id, source, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs`` (doc_id, text, source, any further columns).

    The law is ``rows``: shards hold as many rows, to within one, and each the
    mixture of sources. Equal texts form a group, which lies in one shard unless
    it is larger than a shard; the group of a text belongs to the source of its
    smallest doc_id. size is the UTF-8 bytes of the text plus 16 (a null text
    has none and a null checksum, and is in no group). Null sources are a
    source; repeated rows get places of their own; an empty table gives an empty
    one. Columns of any other name are ignored.
    """
    rows = docs.select(
        F.col("doc_id").alias("id"),
        "source",
        F.substring(F.sha2("text", 256), 1, 32).alias("text"),
        F.struct((F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc")).alias("tie"),
    )
    out = sharded(rows, shards, seed)
    return out.select(F.col("id").alias("doc_id"), "source", F.col("tie.size").alias("size"), F.col("tie.crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
