"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids is a
cell. A query takes the cells in the order of its summed inner products with
both centroids, from the greatest on, until they hold its share of the rows,
and only rows of these cells are scored. The share is set when the index is
built: it is the least that reaches a target recall on the sample which fits
the codebooks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Rows of the sample that fits the codebooks and their rounds; queries sent to the executors at a time; centroids of a half.
FIT_ROWS, ROUNDS, BLOCK, LEAST_CENTROIDS, MOST_CENTROIDS = 16_000, 12, 8192, 64, 1024
#: Share of the sample's true neighbours that the visited cells shall hold, and queries of the sample that measure it.
TARGET, PROBES = 0.95, 256
#: Cells of a side of a tile; pairs that are kept before they are merged.
TILE, PENDING = 16, 1 << 20


def usable(column: str) -> str:
    """SQL that is true for vectors that take part: not null or zero, all components finite."""
    bad = f"exists({column}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return f"{column} is not null and not {bad} and exists({column}, x -> x <> 0)"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def centroids_for(rows: int) -> int:
    """Centroids of a half: a power of two, about 0.6 times the root of the row count, between LEAST_CENTROIDS and MOST_CENTROIDS.

    More of them make the share to visit smaller and the walk through the cells longer.
    """
    return int(np.clip(1 << int(round(np.log2(max(2, rows)) / 2 - 0.7)), LEAST_CENTROIDS, MOST_CENTROIDS))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centroids of the rows of ``x``; at most ``k``, fewer if there are fewer distinct rows."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    x = np.unique(x, axis=0)
    centre = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)] if len(x) else x
    for _ in range(rounds if len(x) > k else 0):
        near = nearest(x, centre)
        n, total = np.bincount(near, minlength=len(centre)), np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The closest centroid of each row, in pieces of bounded size."""
    parts = [((centre**2).sum(1) - 2 * x[lo : lo + 4096] @ centre.T).argmin(1) for lo in range(0, len(x), 4096)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


@dataclass
class MultiIndex:
    """Codebooks of the two halves, how many rows lie in each pair of centroids, and the share of rows to visit."""

    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    share: float = 1.0

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.halves[0].shape[1]
        return x[:, :at], x[:, at:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The pair of centroids of each vector, as one number."""
        a, b = (nearest(p, c) for p, c in zip(self.parts(x), self.halves, strict=True))
        return a * len(self.halves[1]) + b

    def products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of each query's halves with the centroids."""
        a, b = (p @ c.T for p, c in zip(self.parts(x), self.halves, strict=True))
        return a, b

    def radius(self, a: np.ndarray, b: np.ndarray, rows: int) -> float:
        """The least summed product of the cells a query visits: best first, until they hold ``rows`` rows.

        The multi-sequence algorithm, tile by tile: both sides are sorted, a
        heap yields tiles of the sorted grid by their best corner, and the walk
        ends when no tile left can hold a cell better than the last one needed.
        """
        ia, ib = (-a).argsort(kind="stable"), (-b).argsort(kind="stable")
        sa, sb = a[ia], b[ib]
        grid = self.counts.reshape(len(a), len(b))
        heap, score, size, held, last = [(-(sa[0] + sb[0]), 0, 0)], [], [], 0, -np.inf
        while heap and (held < rows or -heap[0][0] >= last):
            _, i, j = heapq.heappop(heap)
            n = grid[np.ix_(ia[i : i + TILE], ib[j : j + TILE])].ravel()
            score.append((sa[i : i + TILE, None] + sb[None, j : j + TILE]).ravel())
            size.append(n)
            before, held = held, held + int(n.sum())
            if before < rows <= held:
                last = self._cut(score, size, rows)
            if j + TILE < len(sb):
                heapq.heappush(heap, (-(sa[i] + sb[j + TILE]), i, j + TILE))
            if j == 0 and i + TILE < len(sa):
                heapq.heappush(heap, (-(sa[i + TILE] + sb[0]), i + TILE, 0))
        return -np.inf if held < rows else self._cut(score, size, rows)

    @staticmethod
    def _cut(score: list[np.ndarray], size: list[np.ndarray], rows: int) -> float:
        s, n = np.concatenate(score), np.concatenate(size)
        order = np.argsort(-s, kind="stable")
        return float(s[order[np.searchsorted(np.cumsum(n[order]), rows)]])


def calibrated(index: MultiIndex, x: np.ndarray, k: int, target: float) -> float:
    """The least share of rows whose cells hold ``target`` of the k nearest rows of sampled queries, all within the sample ``x``."""
    if len(x) < 4 * k or target >= 1:
        return 1.0
    probe = np.random.default_rng(5).choice(len(x), min(PROBES, len(x)), replace=False)
    cell = index.cells(x)
    a, b = index.products(x[probe])
    n = len(index.halves[1])
    needed = []
    for j, p in enumerate(probe):
        score = x @ x[p]
        score[p] = -np.inf
        best = np.argpartition(-score, k)[:k]
        order = a[j][cell // n] + b[j][cell % n]
        needed.append((len(x) - np.searchsorted(np.sort(order), order[best], "left")) / len(x))
    return float(min(1.0, np.quantile(np.concatenate(needed), target, method="higher")))


def build(vectors: DataFrame, centroids: int | None = None, k: int = 20, target: float = TARGET) -> tuple[MultiIndex, DataFrame]:
    """The index of ``vectors`` (vec_id, embedding; all usable and as long), and its lists: vec_id, embedding, cell.

    Codebooks are fitted on a sample of about FIT_ROWS rows chosen by a hash of
    vec_id, and the share of rows to visit is measured there; every row is
    assigned to a cell. Lists are written once, ordered by cell; a cell of many
    rows spans several files. Only the counts of the cells (centroids squared)
    come to the driver.
    """
    n = vectors.count()
    place = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 40)) / float(1 << 40)
    sample = vectors.where(place < FIT_ROWS / max(1, n)).select("vec_id", "embedding").limit(4 * FIT_ROWS).toArrow() if n else None
    if sample is None or not len(sample):
        sample = vectors.limit(FIT_ROWS).select("vec_id", "embedding").toArrow()
    x = matrix(sample["embedding"].take(np.argsort(sample["vec_id"].to_numpy(), kind="stable"))) if len(sample) else np.zeros((0, 2))
    half = max(1, x.shape[1] // 2)
    many = centroids or centroids_for(n)
    index = MultiIndex((kmeans(x[:, :half], many), kmeans(x[:, half:], many)), np.zeros(0, np.int64))
    share = calibrated(index, x, k, target) if len(x) else 1.0
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.cells(matrix(batch.column(1))))], names=["vec_id", "embedding", "cell"])

    placed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, embedding array<double>, cell long")
    lists = written(written(placed).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id"))  # ids split a hot cell
    counts = np.zeros(max(1, len(index.halves[0]) * len(index.halves[1])), np.int64)
    for r in lists.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each cell
        counts[r.cell] = r.n
    return MultiIndex(index.halves, counts, share), lists


class Best:
    """The k best rows of each query so far: pairs wait until there are PENDING of them."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.floor = np.full(len(ids), -np.inf)  # of each query, the score of its k-th row
        self.query, self.score, self.vec = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pairs = 0

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        self.waiting.append((query, score, vec))
        self.pairs += len(query)
        if self.pairs >= PENDING:
            self.merge()

    def merge(self) -> None:
        q, s, v = (np.concatenate([x, *y]) for x, y in zip((self.query, self.score, self.vec), zip(*self.waiting, strict=True), strict=True)) if self.waiting else (self.query, self.score, self.vec)
        order = np.lexsort((v, -s, q))
        q = q[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < self.k
        self.query, self.score, self.vec = q[keep], s[order][keep], v[order][keep]
        last = nth[keep] == self.k - 1
        self.floor[self.query[last]] = self.score[last]
        self.waiting, self.pairs = [], 0


def rerank(index: MultiIndex, ids: np.ndarray, x: np.ndarray, radius: np.ndarray, batches: Iterator[pa.RecordBatch], k: int) -> tuple[Best, int]:
    """The best rows of ``batches`` (vec_id, embedding, cell) for each query, and how many inner products that took.

    Rows of a cell are multiplied with the queries that visit it, and with no others.
    """
    a, b = index.products(x)
    radius = radius - 1e-9 * np.maximum(1, np.where(np.isfinite(radius), np.abs(radius), 1))  # the products may differ in their last bits from those of the walk
    best, done, width = Best(ids, k), 0, len(index.halves[1])
    for batch in batches:
        if not batch.num_rows or not len(ids):
            continue
        vec, e, cell = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
        order = np.argsort(cell, kind="stable")
        vec, e, cell = vec[order], e[order], cell[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for lo, hi in zip(first, np.append(first[1:], len(cell)), strict=True):
            visit = np.flatnonzero(a[:, cell[lo] // width] + b[:, cell[lo] % width] >= radius)
            for at in range(lo, hi if len(visit) else lo, 512):
                rows = slice(at, min(at + 512, hi))
                rough = x[visit] @ e[rows].T
                done += rough.size
                floor = best.floor[visit]
                i, j = np.nonzero(rough >= (floor - 1e-9 * np.maximum(1, np.abs(floor)))[:, None])  # sums in another order may differ by less than the margin
                q, r = visit[i], at + j
                other = vec[r] != ids[q]
                q, r = q[other], r[other]
                best.add(q, (e[r] * x[q]).sum(1), vec[r])
    best.merge()
    return best, done


def search(index: MultiIndex, lists: DataFrame, queries: DataFrame, k: int = 20, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` (vec_id, embedding) its k rows of greatest inner product, itself left out.

    Executors find how far each query has to go through the cells. Queries then
    go to all tasks in blocks of BLOCK, chosen by hash; every task scores the
    rows of visited cells in double precision on the original vectors and passes
    on k rows of each query at most, which are merged by query. Ties go to the
    smaller vec_id. ``share`` (the index's own by default) is the share of rows
    whose cells a query visits at least; 1 is an exact search.
    """
    spark, total = lists.sparkSession, int(index.counts.sum())
    rows = max(50 * k, int(np.ceil((index.share if share is None else share) * total)))
    shared = spark.sparkContext.broadcast(index)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = shared.value.products(matrix(batch.column(1))) if batch.num_rows else ((), ())
            radius = [shared.value.radius(p, q, rows) if rows < total else -np.inf for p, q in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(radius, pa.float64())], names=["vec_id", "embedding", "radius"])

    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = written(queries.mapInArrow(walk, "vec_id long, embedding array<double>, radius double"))
    count = max(1, -(-asked.count() // BLOCK))
    found = None
    for block in range(count):
        held = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(count)) == block).toArrow()  # about BLOCK rows
        if not len(held):
            continue
        sent = spark.sparkContext.broadcast((held["vec_id"].to_numpy(), matrix(held["embedding"]), held["radius"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, x, radius = sent.value
            best, _ = rerank(shared.value, ids, x, radius, batches, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.score), pa.array(best.vec)], names=["query_id", "score", "vec_id"])

        part = lists.mapInArrow(run, "query_id long, score double, vec_id long")
        # A query has k rows of each task here at most.
        nearest_k = part.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("n"))
        out = nearest_k.select("query_id", F.posexplode("n").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
        out = written(out) if count > 1 else out
        found = out if found is None else found.unionByName(out)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float | None = None) -> DataFrame:
    """``search`` of ``queries`` in the index of ``vectors`` (vec_id, embedding, any further columns).

    Vectors that are null, zero, or hold null or non-finite components take no
    part, and neither do rows without vec_id or of another length than most.
    Repeated vec_ids are rows of their own, but none is a neighbour of its own
    id; repeated queries answer once. Fewer than k candidates give fewer rows.
    """
    good = vectors.where("vec_id is not null").where(usable("embedding")).select("vec_id", "embedding")
    length = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    length = length.d if length else 0
    good = good.where(F.size("embedding") == length)
    asked = queries.where("vec_id is not null").where(usable("embedding")).where(F.size("embedding") == length).dropDuplicates(["vec_id"])
    index, lists = build(good, k=k)
    return search(index, lists, asked, k, share)
