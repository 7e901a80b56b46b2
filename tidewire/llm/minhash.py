"""Near-duplicate groups by min-max hashing.

Each permutation gives two signature values, the least and the greatest hash of
a set, so 264 values cost 132 hash evaluations per shingle. 44 bands of 6 values
propose links (a pair at similarity 0.8 is missed with a chance of 2e-6); a
parity bitmap rules out proposals that cannot reach the threshold, and full
shingle sets confirm the others. Rows are told apart by their place in the
written signatures, so rows that share a doc_id keep their own texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from . import textkit as tk
from .graph import components
from .membership import bit_table, split
from .scratch import unused, written

BANDS, ROWS, BITS = 44, 6, 1024
PERMUTATIONS = BANDS * ROWS // 2
_A = np.random.default_rng(7).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * tk.U(2) + tk.U(1)
_B = np.random.default_rng(8).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signature(items: np.ndarray, step: int = 2048) -> np.ndarray:
    """The least, then the greatest value of ``items`` under each permutation."""
    least, most = np.full(PERMUTATIONS, ~tk.U(0)), np.zeros(PERMUTATIONS, tk.U)
    for lo in range(0, len(items), step):
        h = items[lo : lo + step, None] * _A + _B
        np.minimum(least, h.min(0), out=least)
        np.maximum(most, h.max(0), out=most)
    return np.concatenate([least, np.roll(most, PERMUTATIONS // ROWS)])  # so no band holds both values of a permutation


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; band j takes every BANDS-th value from the j-th on, all of different permutations."""
    keys = np.broadcast_to(np.arange(BANDS, dtype=tk.U) * tk.U(0x9E3779B97F4A7C15) + tk.U(1), (len(signatures), BANDS))
    for r in range(ROWS):
        keys = tk.mix(keys * tk.U(0xD6E8FEB86659FD93) + signatures[:, r * BANDS : (r + 1) * BANDS])
    return keys


def parity(items: np.ndarray) -> np.ndarray:
    """A bitmap in which each item flips one bit: two of them differ in no more bits than their sets in items."""
    bits = np.bincount((items >> tk.U(20)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def prints(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits of BLAKE2 of each whole set, as two columns: equal for equal sets only."""
    found = np.array([np.frombuffer(blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in sets], np.int64).reshape(-1, 2)
    return [pa.array(found[:, 0]), pa.array(found[:, 1])]


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.texts(batch.column(1)):
                sets = tk.word_sets(data, offsets, n)
                size = np.array([len(s) for s in sets], np.int64)
                keys = band_keys(np.array([signature(s) for s in sets]))
                at = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(size),
                        *prints(sets),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys[size > 0].ravel().view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate([parity(s) for s in sets]))),
                    ],
                    names=["doc_id", "n_shingles", "p", "q", "bands", "bits"],
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.texts(batch.column(1)):
                sets = tk.word_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *prints(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "p", "q", "items"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), tk.U), np.frombuffer(y.as_buffer(), tk.U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok))

    return run


def _confirmed(docs: DataFrame, pairs: DataFrame, keys: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``pairs`` (u, v) whose full shingle sets are similar enough; ``keys`` (id, doc_id, p, q) tells whose set an id is."""
    ids = written(keys.join(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi"))
    texts, _ = split(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", bit_table(ids, "doc_id"))
    sets = texts.mapInArrow(_sets(n), "doc_id long, p long, q long, items binary").join(ids, ["doc_id", "p", "q"])
    sets = written(sets.dropDuplicates(["doc_id", "p", "q"]).select("id", "items"))
    left = written(pairs.join(sets.select(F.col("id").alias("v"), F.col("items").alias("y")), "v"))
    both = left.join(sets.select(F.col("id").alias("u"), F.col("items").alias("x")), "u").select("u", "v", "x", "y")
    return written(both.mapInArrow(_confirm(percent), "u long, v long"))


def _classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(row, doc_id, n_shingles, p, q, g, many): the similarity class g of each row, and whether another row may share it.

    Equal sets are grouped first by their digest, so hot groups of copies become
    one representative. Each representative is held against the first one of its
    buckets; afterwards only buckets that still span several components are
    looked at, and there only pairs across components, so a bucket of near
    copies costs one comparison for each of its members.
    """
    schema = "doc_id long, n_shingles long, p long, q long, bands array<long>, bits array<long>"
    sketched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketches(n), schema)
    sketched = written(sketched.withColumn("row", F.monotonically_increasing_id()))  # fixed by the one attempt of each task that is committed
    usable = "doc_id is not null and n_shingles > 0"
    copies = written(sketched.where(usable).groupBy("p", "q").agg(F.min_by("row", F.struct("doc_id", "row")).alias("first"), F.count("*").alias("many")).where("many > 1").drop("many"))
    own = F.when(F.expr(usable), F.col("first"))
    classed = written(sketched.join(copies, ["p", "q"], "left").select("row", "doc_id", "n_shingles", "p", "q", "bands", "bits", F.coalesce(own, "row").alias("node"), own.isNotNull().alias("copied")))

    firsts = classed.where(usable).where("row = node").select(F.col("row").alias("id"), F.col("n_shingles").alias("n"), "bits", "bands", "doc_id", "p", "q")
    bands = firsts.select("id", "doc_id", F.explode("bands").alias("key"))
    # The smallest doc_id leads a bucket: the same row leads in all buckets it shares with others, however rows are dealt to tasks.
    buckets = written(bands.groupBy("key").agg(F.min(F.struct("doc_id", "id")).alias("head"), F.count("*").alias("many")).where("many > 1").drop("many"))
    members = written(bands.drop("doc_id").join(buckets, "key"))
    traits = written(firsts.drop("bands").join(members.select("id").distinct(), "id", "left_semi"))
    keys, traits = traits.select("id", "doc_id", "p", "q"), traits.select("id", "n", "bits")

    def near(a: str, b: str) -> str:
        """Whether sizes and bitmaps allow the similarity; never false for a link."""
        differ = " + ".join(f"bit_count({a}.bits[{k}] ^ {b}.bits[{k}])" for k in range(BITS // 64))
        return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {100 + percent} * ({differ}) <= {100 - percent} * ({a}.n + {b}.n)"

    def holding(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that may be links."""
        left = written(pairs.join(traits.select(F.col("id").alias("u"), F.struct("n", "bits").alias("x")), "u"))
        return left.join(traits.select(F.col("id").alias("v"), F.struct("n", "bits").alias("y")), "v").where(near("x", "y")).select(*pairs.columns)

    stars = members.where("id <> head.id").select(F.col("head.id").alias("u"), F.col("head.doc_id").alias("lead"), F.col("id").alias("v")).distinct()
    stars = written(holding(stars).groupBy("v").agg(F.min_by("u", F.struct("lead", "u")).alias("u")).select("u", "v"))
    links = _confirmed(docs, stars, keys, n, percent)
    groups = components(links)

    placed = written(members.select("key", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"))
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
    mixed = written(sizes.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("cs")).where("cs > 1").drop("cs"))
    placed = written(placed.join(mixed, "key").join(traits, "id"))
    x = placed.where("c <> main").select("key", F.struct("id", "n", "bits", "c").alias("x"))
    y = placed.select("key", "main", F.struct("id", "n", "bits", "c").alias("y"))
    across = x.join(y, "key").where(f"x.c <> y.c and (y.c = main or x.id < y.id) and {near('x', 'y')}")
    across = across.select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v")).distinct().join(stars, ["u", "v"], "left_anti")
    more = _confirmed(docs, written(across), keys, n, percent)
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    found = classed.drop("bands", "bits").join(groups, "node", "left")
    return written(found.select("row", "doc_id", "n_shingles", "p", "q", F.coalesce("component", "node").alias("g"), (F.col("copied") | F.col("component").isNotNull()).alias("many")))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, any further columns).

    A set holds the distinct n-word shingles of the whole text (A-Z lowered,
    words without ASCII white space); shorter texts are one shingle; texts that
    are null, empty or without words have none and no link. Two rows are linked
    if 100 * intersection >= percent * union, or if they share a doc_id,
    whatever their texts; component_id is the smallest doc_id reachable, kept
    says that it is the row's own. A row whose doc_id is null is kept, has no
    links and a null component_id. An empty table gives an empty result. Columns
    of any other name are ignored.
    """
    rows = _classes(docs, n, percent)
    twice = written(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("g").alias("u"), F.max("g").alias("v")).where("u < v"))
    if not twice.isEmpty():  # ids with different texts link the classes of these
        joined = components(rows.join(twice.select("doc_id", "u"), "doc_id").select("u", F.col("g").alias("v")).distinct())
        rows = rows.join(joined.withColumnRenamed("node", "g"), "g", "left")
        rows = written(rows.select("doc_id", "n_shingles", F.coalesce("component", "g").alias("g"), (F.col("many") | F.col("component").isNotNull()).alias("many")))
    least = rows.where("many").groupBy("g").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "g", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _ordered(kind: DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, StructType):
        return all(_ordered(f.dataType) for f in kind)
    return not isinstance(kind, MapType) and kind.typeName() != "variant"


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of similar texts stays, with all their columns.

    Groups are those of the texts alone (see ``near_duplicates``): a text that
    is like no other stays whatever its doc_id, also if another row has the
    same. Of a group the row of the smallest doc_id stays, of rows of equal
    doc_id and shingles the first in the order of their columns (maps, which
    have no order, left out). Rows whose doc_id is null stay. Columns of any
    name and type pass through.
    """
    rows = _classes(docs, n, percent).where("doc_id is not null")
    best = rows.where("many").groupBy("g").agg(F.min(F.struct("doc_id", "p", "q")).alias("best"))
    stays = F.coalesce(F.struct("doc_id", "p", "q") == F.col("best"), F.lit(True))
    texts = rows.join(best, "g", "left").groupBy("doc_id", "p", "q").agg(F.max(stays).alias("stays"), F.count("*").alias("times"))
    texts = written(texts)
    ids = written(texts.groupBy("doc_id").agg(F.min("stays").alias("all"), F.max("stays").alias("stays"), F.sum("times").alias("times"), F.count("*").alias("texts")).where("not all or times > 1"))
    rest, sure = split(docs, "doc_id", bit_table(ids, "doc_id"))  # what surely stays is not shuffled
    columns = docs.columns
    row, key, p, q, stay, times, several = unused(["doc_id"], "_row", "_key", "_p", "_q", "_stays", "_times", "_texts")
    rest = rest.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row), F.col("doc_id").cast("long").alias(key))
    told = ids.select(F.col("doc_id").alias(key), F.col("stays").alias(stay), F.col("times").alias(times), (F.col("texts") > 1).alias(several))
    rest = rest.join(told, key, "left")
    unpacked = [F.col(row).getField(c).alias(c) for c in columns]
    out = sure.unionByName(rest.where(f"{stay} is null or {stay} and not {several} and {times} = 1").select(*unpacked))
    again = written(ids.where("stays and times > 1"))
    if again.isEmpty():
        return out
    rest = rest.where(f"{stay} and {times} > 1").select(row, key)
    at = rest.schema[row].dataType.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.texts(pa.array(batch.column(0).field(at))):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *prints(tk.word_sets(data, offsets, n))], names=[row, key, p, q])

    kinds = StructType(list(rest.schema.fields)).add(p, "long").add(q, "long")
    rest = rest.mapInArrow(run, kinds).join(texts.where("stays").select(F.col("doc_id").alias(key), F.col("p").alias(p), F.col("q").alias(q)), [key, p, q], "left_semi")
    order = F.struct(*[F.col(row).getField(f.name) for f in docs.schema if _ordered(f.dataType)])
    return out.unionByName(rest.groupBy(key, p, q).agg(F.min_by(row, order).alias(row)).select(*unpacked))
