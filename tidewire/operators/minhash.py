"""MinHash clusters as an index of bands gives them: rows that share a band are neighbours, and the first to come take their neighbours."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import copies

#: Hashes and permutations are modulo this prime; products stay below 2^62.
PRIME = (1 << 31) - 1
#: Shingles hashed under all permutations at a time.
STEP = 1 << 13


def coefficients(permutations: int = 128) -> list[tuple[int, int]]:
    """(a, b) of each permutation a * h + b modulo PRIME, from MD5 of its number, so SQL can make them too."""
    of = lambda letter, k: int(md5(f"{letter}{k}".encode()).hexdigest()[:8], 16) % (PRIME - 1)
    return [(of("a", k) + 1, of("b", k)) for k in range(permutations)]


def bands_for(threshold: float, permutations: int = 128) -> tuple[int, int]:
    """(bands, rows of a band) for which the least weight lies on the wrong side of ``threshold`` under the curve 1 - (1 - s^rows)^bands."""
    s = (np.arange(1000) + 0.5) / 1000
    below = s < threshold
    best = (np.inf, 1, 1)
    for rows in range(1, permutations + 1):
        for bands in range(1, permutations // rows + 1):
            found = 1 - (1 - s**rows) ** bands
            best = min(best, (found[below].sum() + (1 - found[~below]).sum(), bands, rows))
    return best[1], best[2]


def buckets(rows: DataFrame, threshold: float, permutations: int = 128, k: int = 3) -> DataFrame:
    """(id, bucket) of ``rows`` (id, text): one bucket for each band of the signature; rows without words have none."""
    bands, height = bands_for(threshold, permutations)
    a, b = (np.array(x, np.int64) for x in zip(*coefficients(permutations), strict=True))

    @F.pandas_udf("array<string>")
    def signed(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            least = np.full(len(a), PRIME, np.int64)
            for lo in range(0, len(h), STEP):
                least = np.minimum(least, ((h[lo : lo + STEP, None] * a + b) % PRIME).min(0))
            out.append([f"{j}:" + ",".join(map(str, least[j * height : (j + 1) * height])) for j in range(bands)])
        return pd.Series(out)

    hashed = F.transform(T.shingles("text", k), lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % F.lit(PRIME))
    sets = rows.select("id", hashed.alias("h")).where("size(h) > 0")
    return sets.select("id", F.explode(signed("h")).alias("band")).select("id", F.md5("band").alias("bucket"))


def pairs(placed: DataFrame) -> DataFrame:
    """(i, j) with i < j of all rows that share a bucket: as many as the square of a bucket, so for small tables; ``clusters`` needs none."""
    a, b = (placed.select(F.col("id").alias(c), "bucket") for c in "ij")
    return a.join(b, "bucket").where("i < j").select("i", "j").distinct()


def text_pairs(rows: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame], permutations: int = 128, k: int = 3) -> DataFrame:
    """``pairs`` of the buckets of ``rows`` (id, text): those of different words are found between one row of each, copies are expanded last."""
    heads, chunks = copies.classes(rows, keep)
    return copies.expanded(keep(pairs(buckets(heads, threshold, permutations, k))), chunks, {})


def clusters(rows: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame], permutations: int = 128, k: int = 3) -> DataFrame:
    """(id, label) of each of ``rows`` (id, text): candidates are not verified.

    Rows come in the order of id: one that has a neighbour and no label yet
    starts a cluster with all neighbours that have none. label is the id that
    started it, -1 for rows alone. No pairs are made: in each round the least
    open row of all its buckets starts one, and every row of those buckets is
    closed. A bucket that most rows share costs one row each, combined before
    it is shuffled; there are as many rounds as the longest chain of rows that
    wait for one another. ``keep`` cuts lineage.
    """
    placed = keep(buckets(rows, threshold, permutations, k))
    shared = keep(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    placed = keep(placed.join(shared, "bucket", "left_semi"))
    open_, seeds = keep(placed.select("id").distinct()), None
    while not open_.isEmpty():
        here = keep(placed.join(open_, "id", "left_semi"))
        least = here.groupBy("bucket").agg(F.min("id").alias("first"))
        start = here.join(least, "bucket").groupBy("id").agg(F.min("first").alias("f")).where("f = id").select("id")
        start = keep(start)
        seeds = start if seeds is None else keep(seeds.unionByName(start))
        closed = keep(placed.join(start, "id", "left_semi").select("bucket").distinct())
        taken = keep(here.join(closed, "bucket", "left_semi").select("id").distinct())
        open_ = keep(open_.join(taken, "id", "left_anti"))
    if seeds is None:
        return rows.select("id", F.lit(-1).cast("long").alias("label"))
    heads = placed.join(seeds, "id", "left_semi").groupBy("bucket").agg(F.min("id").alias("head"))
    labels = placed.join(heads, "bucket").groupBy("id").agg(F.min("head").alias("label"))
    return rows.select("id").join(labels, "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


def buckets_sql(table: str, threshold: float, permutations: int = 128) -> str:
    """The same buckets as common table expressions for DuckDB, over ``table`` (id, w: words)."""
    bands, height = bands_for(threshold, permutations)
    return rf"""sets AS (SELECT id, unnest(CASE WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM {table} WHERE len(w) > 0),
hashes AS (SELECT id, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) % {PRIME} AS h FROM sets),
permuted AS (SELECT k, CAST('0x' || substr(md5('a' || k), 1, 8) AS BIGINT) % {PRIME - 1} + 1 AS a, CAST('0x' || substr(md5('b' || k), 1, 8) AS BIGINT) % {PRIME - 1} AS b FROM range({permutations}) t(k)),
least AS (SELECT id, k, min((a * h + b) % {PRIME}) AS v FROM hashes, permuted WHERE k < {bands * height} GROUP BY id, k),
buckets AS (SELECT id, md5((k // {height}) || ':' || string_agg(CAST(v AS VARCHAR), ',' ORDER BY k)) AS bucket FROM least GROUP BY id, k // {height})"""
