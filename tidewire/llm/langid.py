"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import textkit as tk
from .scratch import unused

#: Bounds of the training sample of a language: about so many rows, of so many bytes at most, and so many symbols of their text.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_SYMBOLS = 100, 1 << 15, 48_000
#: Symbols that are parsed at a stretch.
PIECE = 256
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"

_SYMBOL = np.full(256, 27, np.uint8)  # 1-26 letters, 27 a gap between words, from 28 on bytes over 127
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(28, 156)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of whole texts with one gap between words, and each row's offsets in them."""
    if not len(data):
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    data = data.copy()
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    data[upper] += 0x20  # accented Latin capitals
    s = _SYMBOL[data]
    gap = s == 27
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    total = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], total[offsets]


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``text``: a row for each state (0 is nowhere, 1 the root), a column for each symbol."""
    step: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in text.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.zeros((len(step), width), np.int32)
    for k, row in enumerate(step):
        if row:
            table[k, list(row)] = list(row.values())
    return table


@dataclass
class Model:
    """Automata of all languages in one table; places[l] is where language l's states begin."""

    languages: list[str]
    column: np.ndarray  # symbol -> column, 0 for symbols no language knows
    table: np.ndarray
    root: np.ndarray
    bits: np.ndarray  # of a phrase: log2 of the size of the language's text

    @staticmethod
    def of(texts: dict[str, np.ndarray]) -> Model:
        known = np.unique(np.concatenate([np.zeros(0, np.uint8), *texts.values()]))
        column = np.zeros(156, np.int64)
        column[known] = np.arange(1, len(known) + 1)
        tables, roots, at = [], [], 0
        for text in texts.values():
            t = automaton(column[text], len(known) + 1)
            t[t > 0] += at
            tables.append(t)
            roots.append(at + 1)
            at += len(t)
        table = np.concatenate(tables) if tables else np.zeros((0, 1), np.int32)
        return Model(list(texts), column, table, np.array(roots, np.int64), np.log2([max(2, len(t)) for t in texts.values()]))

    def phrases(self, s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases each language needs for each row: the text is cut greedily into longest matches, PIECE symbols at a stretch."""
        size = np.diff(offsets)
        many = -(-size // PIECE)
        row = np.repeat(np.arange(len(size)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, length = offsets[row] + nth * PIECE, np.minimum(PIECE, size[row] - nth * PIECE)
        order = np.argsort(-length, kind="stable")
        start, length, row = start[order], length[order], row[order]
        width, flat = self.table.shape[1], self.table.ravel()
        after = self.table[self.root].astype(np.int64)  # where a phrase's first symbol leads; an unknown symbol is a phrase (and leads nowhere)
        c = self.column[s]
        state = np.broadcast_to(self.root[:, None], (len(self.root), len(start))).copy()
        count = np.ones((len(self.root), len(start)), np.int32)
        for t in range(int(length[0]) if len(length) else 0):
            k = int(np.searchsorted(-length, -t))  # pieces longer than t
            now = c[start[:k] + t]
            to = flat[state[:, :k] * width + now]
            cut = to == 0
            state[:, :k] = np.where(cut, after[:, now], to)
            if t:
                count[:, :k] += cut
            else:
                count[:, :k] = 1
        return np.array([np.bincount(row, x, minlength=len(size)) for x in count]).reshape(len(self.root), len(size))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each row, and how surely it is that one (0 to 1)."""
        s, at = symbols(data, offsets)
        cost = self.phrases(s, at) * self.bits[:, None]
        best = cost.argmin(0)
        gap = np.minimum(60, (cost - cost.min(0)) / np.log2(2 * PIECE))
        return best, 1 / np.exp2(-gap).sum(0)


def train(docs: DataFrame, held_out: str = HELD_OUT) -> Model:
    """Automata of a bounded sample of labelled rows (lang and text not null, not ``held_out``), chosen by a hash of doc_id."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(f"not ({held_out})")
    rows = rows.where(f"octet_length(text) <= {SAMPLE_BYTES}")
    share = {r.lang: SAMPLE_ROWS / r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not share:
        return Model.of({})
    rate = F.create_map(*[F.lit(x) for k in sorted(share) for x in (k, float(share[k]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    sample = sorted((r.lang, r.h, r.doc_id, r.text) for r in rows.select("lang", "doc_id", "text", place.alias("h")).where(F.col("h") < rate[F.col("lang")]).collect())
    texts: dict[str, np.ndarray] = {}
    for lang in sorted(share):
        own = list(dict.fromkeys(t for k, _, _, t in sample if k == lang))
        texts[lang] = symbols(*tk.utf8(pa.array(own, pa.large_string())))[0][:SAMPLE_SYMBOLS]
    return Model.of({k: t for k, t in texts.items() if len(t)})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score, read off whole texts.

    A language's cost is the number of phrases of the text's cross-parsing
    against its automaton times the bits of a phrase (the logarithm of the
    training text's size), so texts of other sizes compare; the least cost wins,
    the alphabetically first of equals. score is the winner's share of 2 ** -cost
    gaps. A text that is null or has no letter is ``und`` with score 0, as is
    every text if the model has no language. Further columns pass through;
    columns named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    marked = docs.withColumn(unused(docs.columns, "_letters")[0], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, "und"], object)
        for batch in batches:
            for lo, hi, data, offsets in tk.texts(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                letters = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                best, score = shared.value.predict(data, offsets) if len(names) > 1 else (np.zeros(hi - lo, int), np.zeros(hi - lo))
                best, score = np.where(letters, best, len(names) - 1), np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return marked.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
