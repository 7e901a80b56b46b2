"""Documents packed into sequences without padding: whole ones by cutting-stock patterns, the few left over cut to fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cutting import plan
from .membership import bit_table, split
from .scratch import written
from .sharding import numbered
from .tokens import encoder

#: Tokens of a sequence.
CAPACITY = 2048
#: Bytes of ids after which a task hands on its rows.
HANDED = 1 << 24
#: More than there are pieces of one length; a length times this fits 64 bits.
RANKS = 1 << 44

PIECES = "doc_id {kind}, start long, length long, doc_tokens long, crc long, ids binary"


@dataclass
class Packing:
    """``tokens`` (piece, doc_id, start, length, doc_tokens, crc, ids): each document's pieces before leftovers are cut, ids as little-endian unsigned 32-bit integers.
    ``pieces`` (piece, doc_id, start, length, doc_tokens, crc, sequence_id, offset): what lies where; a cut piece has several rows, its crc is of the row's own ids.
    """

    tokens: DataFrame
    pieces: DataFrame

    def sequences(self) -> DataFrame:
        """(sequence_id, n_tokens, ids, doc_ids, starts) of each sequence: its ids, and which document begins a piece where. No group is larger than a sequence."""
        base = self.tokens.select("piece", F.col("start").alias("base"), "ids")
        own = self.pieces.join(base, "piece").withColumn("ids", F.expr("substring(ids, int(4 * (start - base) + 1), int(4 * length))"))
        parts = own.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("x"))
        return parts.select("sequence_id", F.expr("aggregate(x.length, 0L, (a, b) -> a + b)").alias("n_tokens"), F.expr("aggregate(x.ids, cast('' as binary), (a, b) -> concat(a, b))").alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.offset").alias("starts"))


def tokenised(docs: DataFrame, definition: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, doc_tokens, crc, ids) of each document's ids and an ``end``: whole sequences of ``capacity`` first, then the rest."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(definition)

        def rows_of(held: list) -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "crc", "ids"])

        for batch in batches:
            held, size = [], 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    body = ids[start : start + capacity].tobytes()
                    held.append((doc_id, start, len(body) // 4, len(ids), zlib.crc32(body), body))
                    size += len(body)
                    if size >= HANDED:
                        yield rows_of(held)
                        held, size = [], 0
            if held:
                yield rows_of(held)

    return docs.mapInArrow(scan, PIECES.format(kind=docs.schema["doc_id"].dataType.simpleString()))


class Layout:
    """Where the pieces of each length go, by their rank among those of that length: arrays in proportion to the number of patterns, which lengths bound."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        patterns, _ = plan({x: n for x, n in histogram.items() if x < capacity}, capacity)
        self.capacity = capacity
        if histogram.get(capacity):
            patterns = [({capacity: 1}, histogram[capacity]), *patterns]
        taken, segments, sequence = dict.fromkeys(histogram, 0), [], 0
        for copies, times in patterns:
            offset = 0
            for length in sorted(copies, reverse=True):
                n = copies[length]
                segments.append((length, taken[length], n, sequence, offset))
                taken[length] += n * times
                offset += n * length
            sequence += times
        segments.sort()
        self.lengths, self.starts, self.copies, self.sequences, self.offsets = np.array(segments or np.zeros((0, 5)), np.int64).T
        self.keys = self.lengths * RANKS + self.starts
        self.taken = np.zeros(capacity + 1, np.int64)
        self.pool = np.zeros(capacity + 1, np.int64)  # where the leftovers of each length begin, laid end to end
        self.cut_from, total = sequence, 0
        for length in sorted(histogram):
            self.taken[length], self.pool[length] = taken[length], total
            total += (histogram[length] - taken[length]) * length
        # Leftovers fill sequences of the capacity, and the last tokens ones whose lengths are powers of two.
        self.whole = total // capacity
        rest, ends = total % capacity, [self.whole * capacity]
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                ends.append(ends[-1] + (1 << bit))
        self.tail = np.array(ends, np.int64)

    def placed(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and offset of each piece that stays whole, and which do."""
        whole = rank < self.taken[length]
        if not len(self.lengths):
            return np.zeros_like(length), np.zeros_like(length), whole
        # Lengths and ranks in one ascending number: segments of each length begin at its rank 0.
        at = np.searchsorted(self.keys, length * RANKS + rank, "right") - 1
        at = np.maximum(at, 0)
        nth = rank - self.starts[at]
        return self.sequences[at] + nth // self.copies[at], self.offsets[at] + nth % self.copies[at] * length, whole

    def cut(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the parts of a piece that is left over."""
        at = int(self.pool[length]) + (rank - int(self.taken[length])) * length
        start, end = at, at + length
        while at < end:
            if at < self.whole * self.capacity:
                k = at // self.capacity
                first, last = k * self.capacity, (k + 1) * self.capacity
            else:
                i = int(np.searchsorted(self.tail, at, "right")) - 1
                k, first, last = self.whole + i, int(self.tail[i]), int(self.tail[i + 1])
            stop = min(end, last)
            yield at - start, stop - at, self.cut_from + k, at - first
            at = stop


def packed(docs: DataFrame, definition: str, end: int, capacity: int = CAPACITY) -> Packing:
    """All of ``docs`` (doc_id, text; further columns are ignored) in sequences of at most ``capacity`` ids.

    ``definition`` is the JSON of a ``tokenizers`` file; each document's ids are
    followed by ``end``. Stretches of ``capacity`` ids are sequences of their
    own. The histogram of what remains, at most ``capacity`` - 1 lengths, goes to
    the driver's linear programs (see ``cutting``); the pieces of each length are
    ranked in a random order, in bins that hold like numbers of rows, so no
    length, however common, is sorted by one task; ranks say which pattern each
    goes to. Pieces that no pattern takes are laid end to end and cut: every
    sequence is full, but for the last few, whose lengths are powers of two.

    A null or empty text is its ``end`` alone; null doc_ids and repeated rows are
    documents each; an empty table gives no pieces. Ids are written once and move
    only for the pieces that are cut.
    """
    tokens = written(tokenised(docs, definition, end, capacity).withColumn("piece", F.monotonically_increasing_id()), "zstd")
    sizes = written(tokens.groupBy("length").agg(F.count("*").alias("n")))  # a row for each length
    histogram = {r.length: r.n for r in sizes.collect()}
    layout = Layout(histogram, capacity)
    narrow = tokens.select("piece", "doc_id", "start", "length", "doc_tokens", "crc").withColumns({"h": F.xxhash64("piece", F.lit(37)), "tie": F.col("piece")})
    ranked = numbered(narrow.join(F.broadcast(sizes), "length"), "length", F.col("n"), sum(histogram.values()))
    ranked = ranked.select("piece", "doc_id", "start", "length", "doc_tokens", "crc", "nth")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in (3, 6))
            sequence, offset, whole = layout.placed(length, rank)
            kept = batch.filter(pa.array(whole))
            parts = [[*kept.columns[:3], kept.column(3), *kept.columns[4:6], pa.array(sequence[whole]), pa.array(offset[whole]), pa.array(np.zeros(int(whole.sum()), bool))]]
            rows, cuts = [], []
            for i in np.flatnonzero(~whole).tolist():
                for cut in layout.cut(int(length[i]), int(rank[i])):
                    rows.append(i)
                    cuts.append(cut)
            if rows:
                some = batch.take(pa.array(rows))
                start, n, k, at = (pa.array(x, pa.int64()) for x in zip(*cuts, strict=True))
                parts.append([some.column(0), some.column(1), pc.add(some.column(2), start), n, some.column(4), some.column(5), k, at, pa.array([True] * len(rows))])
            for columns in parts:
                yield pa.RecordBatch.from_arrays(columns, names=["piece", "doc_id", "start", "length", "doc_tokens", "crc", "sequence_id", "offset", "cut"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = written(ranked.mapInArrow(place, f"piece long, doc_id {kind}, start long, length long, doc_tokens long, crc long, sequence_id long, offset long, cut boolean"))
    cut = placed.where("cut").drop("crc", "cut")
    # Only ids that may be of a piece that was cut leave their place.
    near, _ = split(tokens.select("piece", F.col("start").alias("base"), "ids"), "piece", bit_table(cut.select("piece"), "piece"))
    cut = cut.join(near, "piece").withColumn("crc", F.expr("crc32(substring(ids, int(4 * (start - base) + 1), int(4 * length)))"))
    columns = ["piece", "doc_id", "start", "length", "doc_tokens", "crc", "sequence_id", "offset"]
    return Packing(tokens, placed.where("not cut").select(*columns).unionByName(cut.select(*columns)))
