"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import written

#: UTF-16 units of a gram, packed into a long: the last one in its lowest 16 bits.
ORDER, UNIT = 4, 16
UNITS = 1 << UNIT
#: Quantiles of trusted documents' perplexity in a language between which a document is kept.
LOW, HIGH = 0.005, 0.995
#: Trusted documents that measure instead of teaching: a model knows the texts it was taught, and bounds taken from those alone would reject new ones.
HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"
#: Ids of trusted documents that are sent to every task (64 MB); more are joined.
MOST_IDS = 8_000_000
#: Grams whose probabilities are sent to every task (32 MB with their hash table), the most frequent ones; all others are joined by shards.
MOST_GRAMS = 1 << 20
#: Distinct grams that a counting task holds before it passes them on.
HELD = 1 << 21

_FOLD = np.arange(UNITS, dtype=np.uint64)  # A-Z are lowered, white space is one symbol
_FOLD[65:91] += np.uint64(32)
_FOLD[[*range(0x09, 0x0E)]] = 0x20


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each UTF-16 unit of the UTF-8 texts the gram that it ends (zeros stand before a text), and the texts' offsets in units."""
    n = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data & 0xC0) != 0x80).astype(np.int64) + (data >= 0xF0), out=n[1:])
    at = n[offsets]
    c = _FOLD[np.frombuffer(data.tobytes().decode().encode("utf-16-le"), np.uint16)]
    place = np.arange(len(c)) - np.repeat(at[:-1], np.diff(at))
    code = c.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(c)
        before[k:] = c[:-k] if len(c) > k else 0
        before[place < k] = 0
        code |= before << np.uint64(UNIT * k)
    return code.view(np.int64), at


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)


def gram_counts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(gram, n) over the whole texts of ``docs`` (doc_id, text) whose id is in ``ids`` (distinct): counted in each task, then summed in shards by gram.

    Up to MOST_IDS ids go to every task as a sorted array, so texts stay where
    they are; beyond that texts are joined with the ids by a shuffle.
    """
    rows = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    shared = None
    if ids.count() <= MOST_IDS:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(ids.select(F.col("doc_id").cast("long")).toArrow()["doc_id"].to_numpy()))
    else:
        rows = rows.join(ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            if shared is not None:
                own, known = batch.column(0).to_numpy(), shared.value
                at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                batch = batch.filter(pa.array(known[at] == own if len(known) else np.zeros(len(own), bool)))
            for _, _, data, offsets in tk.texts(batch.column(1)):
                parts.append(np.unique(grams(data, offsets)[0], return_counts=True))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(a) for a in parts[0]], names=["gram", "n"])
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in _merged(parts)], names=["gram", "n"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _context(gram: Column | str) -> Column:
    return F.shiftrightunsigned(gram, UNIT)


def _ending(gram: Column | str, size: int) -> Column:
    """The last ``size`` units of a gram."""
    return (F.col(gram) if isinstance(gram, str) else gram).bitwiseAND(F.lit((1 << UNIT * size) - 1))


class Model:
    """Interpolated modified Kneser-Ney probabilities of the last unit of a gram, given the others, in written tables.

    The highest order has raw counts, each lower one the number of distinct
    units seen before its gram; discounts for counts of 1, 2 and more come from
    the counts of counts of an order. ``seen[k]`` holds (gram, p) of every gram of
    k units, ``back[k]`` (context, rest): what a context leaves to the order below.
    Single units and contexts of one unit have 65,536 rows at most and are
    broadcast; longer ones are joined by shuffles. Without counts every unit has
    a probability of 1 / 65,536.
    """

    def __init__(self, counts: DataFrame) -> None:
        table = {ORDER: written(counts)}
        for k in range(ORDER - 1, 0, -1):
            table[k] = written(table[k + 1].groupBy(_ending("gram", k).alias("gram")).agg(F.count("*").alias("n")))
        self.seen: dict[int, DataFrame] = {}
        self.back: dict[int, DataFrame] = {}
        self.rest = 1.0
        p: DataFrame | None = None
        for k in range(1, ORDER + 1):
            now = table[k].agg(*(F.count_if(F.col("n") == c).alias(f"n{c}") for c in (1, 2, 3, 4)), F.sum("n").alias("total")).first()
            n = [max(1.0, float(now[f"n{c}"])) for c in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            cuts = [min(max(c - (c + 1) * y * n[c] / n[c - 1], 0.05), c - 0.05) for c in (1, 2, 3)]
            cut = F.when(F.col("n") == 1, cuts[0]).when(F.col("n") == 2, cuts[1]).otherwise(cuts[2])
            if p is None:
                left = table[k].agg(F.sum(cut).alias("cut")).first()["cut"]
                self.rest = float(left) / now["total"] if now["total"] else 1.0
                p = table[k].select("gram", ((F.col("n") - cut) / F.lit(float(now["total"] or 1)) + self.rest / UNITS).alias("p"))
            else:
                ends = table[k].groupBy(_context("gram").alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
                self.back[k] = written(ends.select("context", "total", (F.col("cut") / F.col("total")).alias("rest")))
                lower, ends = self.seen[k - 1].withColumnRenamed("gram", "shorter"), self.back[k]
                if k == 2:
                    lower, ends = F.broadcast(lower), F.broadcast(ends)
                rows = table[k].withColumns({"context": _context("gram"), "shorter": _ending("gram", k - 1)})
                p = rows.join(ends, "context").join(lower, "shorter").select("gram", *(["n"] if k == ORDER else []), ((F.col("n") - cut) / F.col("total") + F.col("rest") * F.col("p")).alias("p"))
            self.seen[k] = written(p)

    def bits(self, asked: DataFrame) -> DataFrame:
        """(gram, bits) for distinct grams of ORDER units: -log2 of the probability, by way of the longest ending that was seen."""
        out, p = asked.select("gram"), F.lit(self.rest / UNITS)
        for k in range(1, ORDER + 1):
            known = self.seen[k].select(F.col("gram").alias(f"e{k}"), F.col("p").alias(f"p{k}"))
            out = out.join(F.broadcast(known) if k == 1 else known, _ending("gram", k) == F.col(f"e{k}") if k < ORDER else F.col("gram") == F.col(f"e{k}"), "left")
            if k > 1:
                ends = self.back[k].select(F.col("context").alias(f"c{k}"), F.col("rest").alias(f"r{k}"))
                out = out.join(F.broadcast(ends) if k == 2 else ends, _ending(_context("gram"), k - 1) == F.col(f"c{k}"), "left")
                p = F.coalesce(F.col(f"r{k}"), F.lit(1.0)) * p
            p = F.coalesce(F.col(f"p{k}"), p)
        return out.select("gram", (-F.log2(p)).alias("bits"))

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent grams, MOST_GRAMS at most, in order, and their bits; which they are makes no difference to any result."""
        step = F.floor(F.log2("n") * 4).cast("int")  # 252 steps at most
        steps = sorted(((r["step"], r["count"]) for r in self.seen[ORDER].groupBy(step.alias("step")).count().collect()), reverse=True)
        least, held = None, 0
        for at, n in steps:
            held += n
            if held > MOST_GRAMS:
                break
            least = at
        if least is None:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        some = self.seen[ORDER].where(step >= least).select("gram", "p").toArrow()
        gram, p = some["gram"].to_numpy(), some["p"].to_numpy()
        order = np.argsort(gram)
        return gram[order], -np.log2(p[order])


def _slots(keys: np.ndarray) -> np.ndarray:
    """A table from hashes to places in ``keys``; of keys that share a hash it holds one."""
    slots = np.zeros(1 << 22, np.int32)
    slots[_hash(keys)] = np.arange(len(keys))
    return slots


def _hash(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


def _found(keys: np.ndarray, slots: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The place of each gram in the sorted ``keys``, -1 where it is none of them."""
    if not len(keys):
        return np.full(len(gram), -1)
    at = slots[_hash(gram)].astype(np.int64)
    rest = np.flatnonzero(keys[at] != gram)
    some = np.minimum(np.searchsorted(keys, gram[rest]), len(keys) - 1)
    at[rest] = np.where(keys[some] == gram[rest], some, -1)
    return at


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, perplexity) of each row of ``docs``; that of a unit of the whole text, null without text.

    Frequent grams are looked up where the text lies. The others of a document
    stay with it as distinct (gram, n); their distinct grams over all documents
    are joined with the model by shards, and the answers summed by document.
    """
    spark = docs.sparkSession
    keys, values = model.frequent()
    shared = spark.sparkContext.broadcast((keys, values, _slots(keys)))  # MOST_GRAMS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, slots = shared.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in tk.texts(batch.column(2)):
                gram, at = grams(data, offsets)
                place = _found(keys, slots, gram)
                missed = np.flatnonzero(place < 0)
                value = values[place] if len(keys) else np.zeros(len(gram))
                value[missed] = 0
                sums = np.concatenate([[0], np.cumsum(value, dtype=np.float64)])[at]
                row = np.searchsorted(at, missed, "right") - 1
                order = np.lexsort((gram[missed], row))
                g, r = gram[missed][order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])) if len(g) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(g)))
                ends = pa.array(np.searchsorted(r[first], np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (g[first], n.astype(np.int32))]
                names = ["key", "doc_id", "lang", "size", "bits", "gram", "n"]
                own = [pa.array(np.arange(key, key + hi - lo)), batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)), pa.array(np.diff(sums)), *lists], names=names)
                key += hi - lo

    kinds = f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang {docs.schema['lang'].dataType.simpleString()}, size long, bits double, gram array<long>, n array<int>"
    rows = written(docs.select("doc_id", "lang", "text").mapInArrow(run, kinds))
    missed = rows.where("size(gram) > 0").select("key", F.explode(F.arrays_zip("gram", "n")).alias("m")).select("key", "m.gram", "m.n")
    answers = written(model.bits(written(missed.groupBy("gram").agg(F.lit(1).alias("one")))))
    more = missed.join(answers, "gram").groupBy("key").agg(F.sum(F.col("n") * F.col("bits")).alias("more"))
    mean = (F.col("bits") + F.coalesce("more", F.lit(0.0))) / F.col("size")
    return rows.select("key", "doc_id", "lang", "size", "bits").join(more, "key", "left").select("doc_id", "lang", F.when(F.col("size") > 0, F.round(F.exp(mean * float(np.log(2))), 6)).alias("perplexity"))


def quality(docs: DataFrame, trusted_ids: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, lang, perplexity, low, high, kept) of each row of ``docs`` (doc_id, text, lang, any further columns).

    The model is trained on the whole texts of all ``trusted_ids`` (doc_id) that
    are not HELD_OUT (of all, and all measure, where that leaves none to teach or
    none to measure). low is a quantile of all trusted documents' perplexity in
    the row's language, high one of the held out documents' (of every language
    where the row's, or null, has none). kept says that the perplexity lies
    between them. Null and empty texts have no perplexity and are not kept;
    without trusted text every other row is kept. Repeated ids of trusted
    documents count once; repeated rows are rows.
    """
    own = docs.select("doc_id", "lang", "text")
    ids = written(trusted_ids.where("doc_id is not null").select("doc_id").distinct())
    parts = ids.agg(F.count("*").alias("every"), F.count_if(F.expr(HELD_OUT)).alias("held")).first()
    held = F.expr(HELD_OUT) if 0 < parts["held"] < parts["every"] else F.lit(True)
    teach = ids.where(~held) if 0 < parts["held"] < parts["every"] else ids
    scored = written(perplexities(own, Model(gram_counts(own, teach))))
    model = scored.join(ids, "doc_id", "left_semi").where("perplexity is not null")
    ends = [F.percentile_approx("perplexity", low, 10000).alias("lo"), F.percentile_approx(F.when(held, F.col("perplexity")), high, 10000).alias("hi")]
    every = model.agg(*ends).first()
    limits = written(model.where("lang is not null").groupBy("lang").agg(*ends))
    out = scored.join(limits, "lang", "left")
    lo, hi = (F.coalesce(F.col(c), F.lit(default if found is None else float(found))) for c, default, found in (("lo", 0.0, every["lo"]), ("hi", float("inf"), every["hi"])))
    return out.select("doc_id", "lang", "perplexity", lo.alias("low"), hi.alias("high"), F.coalesce(F.col("perplexity").between(lo, hi), F.lit(False)).alias("kept"))
