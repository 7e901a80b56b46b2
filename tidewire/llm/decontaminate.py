"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import textkit as tk
from .scratch import unused, written

#: Words of a seed; a seed in more than RARE of the documents, and over four times as many as the item's rarest that occurs, is frequent unless the item would have fewer than LEAST others.
SEED, RARE, LEAST = 4, 1e-3, 8
#: Alignment: match, mismatch and gap; score by which a passage counts as the item's, as a share of a full match.
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.5
#: Words of all items that one block of them holds; blocks are searched one after the other.
BLOCK_WORDS = 1_000_000


@dataclass
class Items:
    """A block of test items and their seeds."""

    ids: np.ndarray
    tokens: list[np.ndarray]
    seeds: np.ndarray  # sorted
    first: np.ndarray  # of each seed, where its places begin
    item: np.ndarray  # of each place
    at: np.ndarray
    rare: np.ndarray  # of each place, whether its seed is

    @staticmethod
    def of(ids: list[int], texts: list[str], n: int = SEED) -> Items:
        tokens, grams, item, at = [], [], [], []
        for k, text in enumerate(texts):
            h = tk.words(*tk.utf8(pa.array([text])), tk.ALNUM)[0]
            tokens.append(h)
            g = tk.ngrams(h, n) if len(h) >= n else tk.ngrams(h, len(h)) if len(h) else np.zeros(0, tk.U)
            grams.append(g)
            item.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
        gram, item, at = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((tk.U, grams), (np.int64, item), (np.int64, at)))
        order = np.argsort(gram, kind="stable")
        seeds, first = np.unique(gram[order], return_index=True)
        return Items(np.array(ids, np.int64), tokens, seeds, np.append(first, len(gram)), item[order], at[order], np.ones(len(gram), bool))

    @property
    def sizes(self) -> list[int]:
        """Lengths of n-gram that occur as seeds: SEED, and whole items that are shorter."""
        return sorted({min(SEED, len(t)) for t in self.tokens if len(t)})

    def keep(self, counts: np.ndarray, documents: int) -> Items:
        """With the seeds that occur, told apart by how rare they are; an item that has few rare ones counts its rarest as such."""
        times = np.repeat(counts, np.diff(self.first))
        which = np.repeat(np.arange(len(self.seeds)), np.diff(self.first))[times > 0]
        item, at, times = self.item[times > 0], self.at[times > 0], times[times > 0]
        order = np.lexsort((at, times, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        least = np.full(len(self.ids), np.iinfo(np.int64).max // 4)
        np.minimum.at(least, item, times)
        rare = times <= np.maximum(max(2, RARE * documents), 4 * least[item])  # copies of the item make all its seeds frequent
        rare[order[place < LEAST]] = True
        kept, first = np.unique(which, return_index=True)
        return Items(self.ids, self.tokens, self.seeds[kept], np.append(first, len(which)), item, at, rare)


class Finder:
    """Seeds in blocks of texts; a bit table turns most places away before the search."""

    def __init__(self, items: Items) -> None:
        self.items = items
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(items.seeds >> tk.U(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words where a seed begins, and which."""
        place, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.items.sizes:
            g = tk.ngrams(h, n)
            i = np.flatnonzero(self.bits[(g >> tk.U(44)).astype(np.int64)])
            i = i[row[i] == row[i + n - 1]]
            s = np.minimum(np.searchsorted(self.items.seeds, g[i]), max(0, len(self.items.seeds) - 1))
            same = self.items.seeds[s] == g[i] if len(self.items.seeds) else np.zeros(len(i), bool)
            place.append(i[same])
            seed.append(s[same])
        return np.concatenate(place), np.concatenate(seed)

    def passages(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, first and last word of each passage to align: one for each item and band of diagonals with a seed.

        One without a rare seed counts only if half of the item's words occur in it, without which no alignment reaches THRESHOLD.
        """
        place, seed = self.hits(h, row)
        x = self.items
        many = x.first[seed + 1] - x.first[seed]
        entry = np.repeat(x.first[seed] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        place, item = np.repeat(place, many), x.item[entry]
        size = np.array([len(t) for t in x.tokens], np.int64)[item] if len(item) else item
        starts = np.searchsorted(row, row[place])
        width = np.maximum(16, size // 2)
        band = (place - starts - x.at[entry]) // width  # of where the item would begin
        found, which = np.unique(np.column_stack([row[place], item, band]), axis=0, return_inverse=True) if len(place) else (np.zeros((0, 3), np.int64), place)
        row_of, item, band = found.T
        rare = np.zeros(len(found), bool)
        rare[which.ravel()[x.rare[entry]]] = True
        size = np.array([len(t) for t in x.tokens], np.int64)[item] if len(item) else item
        width = np.maximum(16, size // 2)
        pad = np.maximum(8, size // 4)
        base, end = np.searchsorted(row, row_of), np.searchsorted(row, row_of, "right")
        lo = np.clip(base + band * width - pad, base, end)
        hi = np.clip(base + (band + 1) * width + size + pad, lo, end)
        fine = rare.copy()
        doubtful = np.flatnonzero(~rare)
        for part in np.array_split(doubtful, 1 + int((size + hi - lo)[doubtful].sum()) // (1 << 21)):
            fine[part] = self._common(h, item[part], lo[part], hi[part]) >= THRESHOLD * size[part]
        return row_of[fine], item[fine], lo[fine], hi[fine]

    def _common(self, h: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many words of each item occur in its passage."""
        if not len(item):
            return np.zeros(0, np.int64)
        size, own = np.array([len(self.items.tokens[k]) for k in item], np.int64), tk.mix(np.arange(1, len(item) + 1).astype(tk.U))
        words = np.concatenate([self.items.tokens[k] for k in item]) ^ np.repeat(own, size)
        long = hi - lo
        there = h[np.repeat(lo - (np.cumsum(long) - long), long) + np.arange(long.sum())] ^ np.repeat(own, long)
        return np.bincount(np.repeat(np.arange(len(item)), size), np.isin(words, there), len(item))


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each (item, passage), and the passage word after its end; many at once, row by row."""
    best, end = np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    while order:
        part = [order.pop()]
        a, b = (max(1, len(x)) for x in pairs[part[0]])
        while order and (len(part) + 1) * max(b, len(pairs[order[-1]][1])) * 8 <= cells and len(pairs[order[-1]][0]) * 2 >= a:
            part.append(order.pop())
            b = max(b, len(pairs[part[-1]][1]))
        item, text = np.zeros((len(part), a), tk.U), np.ones((len(part), b), tk.U)
        for k, p in enumerate(part):
            item[k, : len(pairs[p][0])] = pairs[p][0]
            text[k, : len(pairs[p][1])] = pairs[p][1]
        slope = np.arange(1, b + 1) * -GAP
        last, top, where = np.zeros((len(part), b + 1)), np.zeros(len(part)), np.zeros(len(part), np.int64)
        for i in range(a):
            now = np.maximum(last[:, :-1] + np.where(text == item[:, i, None], MATCH, MISMATCH), last[:, 1:] + GAP)
            now = np.maximum(np.maximum.accumulate(np.maximum(now, 0) + slope, axis=1) - slope, 0)
            j = now.argmax(1)
            m = now[np.arange(len(part)), j]
            better = m > top
            top[better], where[better] = m[better], j[better] + 1
            last[:, 1:] = now
        best[part], end[part] = top, where
    return best, end


def _seed_counts(texts: DataFrame, items: Items) -> np.ndarray:
    """In how many rows each seed occurs; counts are summed where they are found, then by seed."""
    shared = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, total = Finder(shared.value), np.zeros(len(shared.value.seeds), np.int64)
        for batch in batches:
            for _, _, data, offsets in tk.texts(batch.column(0)):
                h, row, _, _ = tk.words(data, offsets, tk.ALNUM)
                place, seed = finder.hits(h, row)
                np.add.at(total, np.unique(np.column_stack([row[place], seed]), axis=0)[:, 1], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["seed", "n"])

    counts = np.zeros(len(items.seeds), np.int64)
    for r in texts.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():  # a row for each seed of the block at most
        counts[r.seed] = r.n
    return counts


def _matches(docs: DataFrame, items: Items, names: list[str]) -> DataFrame:
    """All columns of ``docs`` with four called ``names``: the item of its best passage among the block's, score, first and last word."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        x = shared.value
        for batch in batches:
            for lo, hi, data, offsets in tk.texts(batch.column(at)):
                h, row, _, _ = tk.words(data, offsets, tk.ALNUM)
                row_of, item, a, b = finder.passages(h, row)
                score, end = smith_waterman([(x.tokens[i], h[p:q]) for i, p, q in zip(item, a, b, strict=True)])
                size = np.array([len(x.tokens[i]) for i in item], np.int64)
                share = score / (MATCH * np.maximum(1, size))
                base = np.searchsorted(row, row_of)
                n = hi - lo
                best = [np.full(n, -1, np.int64), np.zeros(n), np.full(n, -1, np.int64), np.full(n, -1, np.int64)]
                order = np.lexsort((a, x.ids[item], -share, row_of))
                one = order[np.flatnonzero(np.r_[True, row_of[order][1:] != row_of[order][:-1]])] if len(order) else order
                for column, value in zip(best, (x.ids[item], share, np.maximum(a, a + end - size) - base, a + end - base), strict=True):
                    column[row_of[one]] = value[one]
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, best)], names=[*part.schema.names, *names])

    kinds = [StructField(name, kind) for name, kind in zip(names, (LongType(), DoubleType(), LongType(), LongType()), strict=True)]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *kinds]))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of ``docs`` (text, any further columns) with item_id, score, first_word, last_word, contaminated.

    Words are runs of letters and digits, lower case for A-Z. Seeds are the
    4-word n-grams of the test items (an item with fewer words is one seed).
    Which are rare is counted over all documents and measured by the item's own
    rarest seeds that occur, of which 8 are rare at least. A passage with
    frequent seeds only is left out if it lacks half of the item's words, since
    its score is then below 0.5; so a much copied item, or edited or partial
    copy of one, is found too.
    Around each seed the item is aligned with the passage (Smith-Waterman); score
    is the best alignment as a share of a full match, item_id the item that has
    it (the smallest of equals), first_word and last_word bound the passage.
    contaminated says score >= 0.5. Null and empty texts, and rows near no item,
    have score 0 and null item_id. Items without words or id are left out;
    repeated items count once; without items nothing is contaminated.

    Items come in blocks of about BLOCK_WORDS words (or one longer item), each
    sent to the executors and held against all rows, so what is broadcast has a
    bound. Columns of any other name pass through.
    """
    added = ["item_id", "score", "first_word", "last_word", "contaminated"]
    docs = docs.drop(*added)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    documents = docs.count()
    count = max(1, -(-words // BLOCK_WORDS))
    items = written(items.withColumn("_b", F.pmod(F.xxhash64("item_id"), F.lit(count))))
    out = docs.withColumns({"item_id": F.lit(None).cast("long"), "score": F.lit(0.0), "first_word": F.lit(None).cast("long"), "last_word": F.lit(None).cast("long")})
    for b in range(count):
        rows = sorted((r.item_id, r.text) for r in items.where(F.col("_b") == b).collect())  # bounded by BLOCK_WORDS
        block = Items.of([i for i, _ in rows], [t for _, t in rows])
        if not len(block.seeds):
            continue
        block = block.keep(_seed_counts(docs.select("text"), block), documents)
        names = unused(out.columns, "_item", "_score", "_first", "_last")
        found = _matches(out, block, names)
        item, score = names[:2]
        better = F.expr(f"{score} > score or {score} = score and {score} > 0 and {item} < item_id")
        new = dict(zip(("item_id", "score", "first_word", "last_word"), names, strict=True))
        out = found.withColumns({k: F.when(better, F.col(v)).otherwise(F.col(k)) for k, v in new.items()}).drop(*new.values())
    return out.withColumn("contaminated", F.col("score") >= THRESHOLD)
