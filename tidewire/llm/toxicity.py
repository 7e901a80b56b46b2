"""Toxicity scores from a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two strings compares their subsequences of three (at the long
scale also of two) letters, each weighted by a decay to the power of its steps,
within a span, normalised to 1 for equal strings; values count from a floor on.
There are two scales: windows of five letters, compared strictly, find stems
inside words; windows of seven (a word of eight is one window), compared with
wide gaps, find words with letters put in, left out or doubled. A mark stands
before each word, so stems at its start are told from the same letters inside.
A word is the sum of its windows, and the kernels of both scales add up. The
Nyström map projects words on landmark strings; a linear SVM (squared hinge) is
trained there on labelled texts, where a toxic document lends its label to its
words that hold a landmark and a clean one to the word that the model finds most
toxic. Edited forms of the long landmarks are virtual examples: each is a toxic
word of its own. A sentence, and so a document, scores as its most toxic word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textkit as tk

@dataclass(frozen=True)
class Scale:
    """Letters of a window (words longer by ``slack`` at most are one), and how windows are compared."""

    window: int
    slack: int
    decay: float
    span: int
    floor: float
    power: int
    pairs: bool

    def value(self, kernel: np.ndarray) -> np.ndarray:
        """What a kernel value counts."""
        return np.maximum(0, (kernel - self.floor) / (1 - self.floor)) ** self.power if self.pairs else np.where(kernel >= self.floor, kernel**self.power, 0)


SCALES = (Scale(5, 0, 0.7, 5, 0.5, 4, False), Scale(7, 1, 0.8, 7, 0.55, 1, True))
SURE, CLOSE = 0, 0.9  # a window is a landmark candidate if luck would bring fewer than exp(-SURE) such windows; a word holds one at this value
#: What toxic words, edited landmarks and the clean documents' words weigh in training.
SHARES = (0.12, 0.08, 0.8)
#: Share of a landmark's rows that are toxic, at least.
PURE = 0.6
#: Kernel value up to which two landmarks are unlike.
ALIKE = 0.84
#: Windows whose scores a task remembers.
KNOWN = 1 << 18
#: Bounds of the training sample: documents of each label, bytes of one of them; landmarks of a scale.
SAMPLE_DOCS, SAMPLE_BYTES, LANDMARKS = 1500, 1 << 16, 128

_CLASS = np.full(256, 255, np.uint8)  # a-z and five classes of bytes over 127; all else is no letter
_START = 31  # stands before a word
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = np.arange(26)
_CLASS[128:] = 26 + np.arange(128) % 32 % 5
_CODES = 33 << 10  # three letters, then two


@dataclass
class Words:
    """Strings of a block: its letters one after the other, where each string begins, its size, row and word (itself, if it is one)."""

    letters: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray
    word: np.ndarray

    def hashes(self) -> np.ndarray:
        return tk.span_hashes(self.letters, self.start, self.start + self.size)

    def windows(self, scale: Scale) -> Words:
        """All windows of a scale; short strings stay whole."""
        short = self.size <= scale.window + scale.slack
        many = np.where(short, 1, self.size - scale.window + 1)
        start = np.repeat(self.start - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return Words(self.letters, start, np.repeat(np.where(short, self.size, scale.window), many), np.repeat(self.row, many), np.repeat(self.word, many))


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of whole texts, each after a mark of its start; marks inside words are dropped and three or more single letters in a row join to one word."""
    space = tk.SPACE[data]
    start, end, row = tk.spans(~space, offsets)
    cls = _CLASS[data]
    at = np.flatnonzero(cls < 32)
    word = np.searchsorted(start, at, "right") - 1
    size = np.bincount(word, minlength=len(start))
    same = np.zeros(len(start), bool)
    same[1:] = row[1:] == row[:-1]
    single = size == 1
    run = single & same & np.concatenate([[False], single[:-1]])
    if run.any():  # runs of one joint, that is two letters, stay apart
        run &= np.concatenate([[False], run[:-1]]) | np.concatenate([run[1:], [False]])
    new = ~run
    owner = np.cumsum(new) - 1
    size = np.bincount(owner, size, minlength=int(new.sum())).astype(np.int64)
    start = np.cumsum(size + 1) - size - 1
    letters = np.full(int((size + 1).sum()), _START, np.uint8)
    letters[np.arange(len(at)) + np.repeat(np.arange(len(size)), size) + 1] = cls[at]
    return Words(letters, start, size + 1, row[new], np.arange(len(size)))


def features(letters: np.ndarray, start: np.ndarray, size: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, code and weight of every subsequence of three letters of the words (and of two, where the scale has pairs)."""
    n = int(size.sum())
    word = np.repeat(np.arange(len(size), dtype=np.int32), size)
    place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    c = letters[np.repeat(start, size) + place].astype(np.int32)
    left = np.repeat(size, size) - place
    out = [(word[:0], c[:0], np.zeros(0, np.float32))]
    for reach in range(1, scale.span):
        i = np.flatnonzero(left > reach)
        if not len(i):
            break
        first, last, own, weight = c[i], c[i + reach], word[i], np.full(len(i), scale.decay**reach, np.float32)
        if scale.pairs:
            out.append((own, 32 << 10 | first << 5 | last, weight))
        for a in range(1, reach):
            out.append((own, first << 10 | c[i + a] << 5 | last, weight))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def squared_norms(word: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    key = word.astype(np.int64) * _CODES + code
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    return np.bincount(key[first] // _CODES, np.add.reduceat(weight[order].astype(float), first) ** 2 if len(key) else None, minlength=n)


@dataclass
class Kernel:
    """Kernel values of words to the landmarks."""

    slot: np.ndarray  # code -> row of table, or -1
    table: np.ndarray  # landmark features by code, each landmark of norm 1
    scale: Scale

    @staticmethod
    def of(strings: list[np.ndarray], scale: Scale) -> Kernel:
        letters, start, size = _packed(strings)
        word, code, weight = features(letters, start, size, scale)
        norm = np.sqrt(squared_norms(word, code, weight, len(size)))
        codes = np.unique(code)
        slot = np.full(_CODES, -1, np.int32)
        slot[codes] = np.arange(len(codes))
        table = np.zeros((len(codes), len(size)), np.float32)
        np.add.at(table, (slot[code], word), weight / norm[word])
        return Kernel(slot, table, scale)

    def values(self, letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that may be near a landmark, and a row of kernel values for each; all other words have none."""
        scale = self.scale
        word, code, weight = features(letters, start, size, scale)
        keep = self.slot[code] >= 0
        word, slot, weight = word[keep], self.slot[code[keep]], weight[keep]
        # The greatest landmark value of each code bounds what a word can share; the norm from the word's length is never too large.
        low = np.sqrt(sum(np.maximum(0, size - r) * (r - 1 + scale.pairs) * scale.decay ** (2 * r) for r in range(1, scale.span)))
        share = np.bincount(word, self._most[slot] * weight, minlength=len(size))
        near = np.flatnonzero((share >= scale.floor * low * 0.999) & (low > 0))
        out = np.zeros((len(near), self.table.shape[1]), np.float32)
        if not len(near):
            return near, out
        number = np.full(len(size), -1)
        number[near] = np.arange(len(near))
        keep = number[word] >= 0
        word, slot, weight = number[word[keep]], slot[keep], weight[keep]
        norm = np.sqrt(squared_norms(*features(letters, start[near], size[near], scale), len(near)))
        order = np.argsort(word, kind="stable")
        word, slot, weight = word[order], slot[order], weight[order]
        m = self.table.shape[1]
        for lo in range(0, len(near), 4096):
            i = slice(*np.searchsorted(word, [lo, lo + 4096]))
            many = self._many[slot[i]]  # landmarks that hold the code
            entry = np.repeat(self._first[slot[i]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            key = np.repeat((word[i] - lo) * m, many) + self._landmark[entry]
            hi = min(lo + 4096, len(near))
            sums = np.bincount(key, np.repeat(weight[i], many) * self._value[entry], minlength=(hi - lo) * m).reshape(hi - lo, m) / norm[lo:hi, None]
            out[lo:hi] = scale.value(sums)
        return near, out

    def __post_init__(self) -> None:
        self._most = self.table.max(1) if self.table.size else np.zeros(len(self.table), np.float32)
        code, self._landmark = np.nonzero(self.table)
        self._value = self.table[code, self._landmark]
        self._many = np.bincount(code, minlength=len(self.table))
        self._first = np.cumsum(self._many) - self._many


    def units(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words with a window near a landmark, and the sums of their windows' values."""
        w = words.windows(self.scale)
        _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        near, values = self.values(w.letters, w.start[first], w.size[first])
        number = np.full(len(first), -1)
        number[near[values.any(1)]] = np.flatnonzero(values.any(1))
        hit = np.flatnonzero(number[back] >= 0)
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros((0, self.table.shape[1]))
        begin = np.flatnonzero(np.r_[True, w.word[hit][1:] != w.word[hit][:-1]])
        return w.word[hit][begin], np.add.reduceat(values[number[back[hit]]], begin, axis=0)


class Scorer:
    """Scores of windows at one scale; a task remembers those of KNOWN windows."""

    def __init__(self, kernel: Kernel, direction: np.ndarray) -> None:
        self.kernel, self.direction = kernel, direction
        self.known, self.scores = np.zeros(0, tk.U), np.zeros(0)

    def of(self, w: Words) -> np.ndarray:
        kinds, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, kinds), max(0, len(self.known) - 1))
        old = self.known[at] == kinds if len(self.known) else np.zeros(len(kinds), bool)
        new = np.flatnonzero(~old)
        near, values = self.kernel.values(w.letters, w.start[first[new]], w.size[first[new]])
        score = np.zeros(len(kinds))
        score[old] = self.scores[at[old]]
        score[new[near]] = values @ self.direction
        if len(self.known) < KNOWN:
            kept = np.concatenate([self.known, kinds[new]])
            order = np.argsort(kept)
            self.known, self.scores = kept[order], np.concatenate([self.scores, score[new]])[order]
        return score[back]


@dataclass
class Model:
    scorers: list[Scorer]
    bias: float
    sharpness: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.scorers:
            return np.full(n, self.bias)
        words, best = split(data, offsets), np.full(n, self.bias)
        if len(words.row):
            total = np.full(len(words.row), self.bias)
            for scorer in self.scorers:  # every word has a window at each scale
                w = words.windows(scorer.kernel.scale)
                total += np.add.reduceat(scorer.of(w), np.flatnonzero(np.r_[True, w.word[1:] != w.word[:-1]]))
            top = np.flatnonzero(np.r_[True, words.row[1:] != words.row[:-1]])
            best[words.row[top]] = np.maximum.reduceat(total, top)
        return 1 / (1 + np.exp(-np.clip(self.sharpness * best, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, each example weighing its ``share``; Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = keep * w - 2 * x[on].T @ (share[on] * y[on] * slack[on])
        step = np.linalg.solve(np.diag(keep) + 2 * (x[on] * share[on, None]).T @ x[on], grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _frequencies(blocks: Callable[[], Iterator[tuple[Words, int]]], scale: Scale, of: np.ndarray | None = None, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows (of those in ``of``, sorted) by hash, with the number of rows (for which ``rows`` is true) that hold them."""
    seen = [np.zeros(0, tk.U)]
    for w, base in blocks():
        w = w.windows(scale)
        h, row = w.hashes(), w.row + base
        keep = w.size >= 3
        if rows is not None:
            keep &= rows[row]
        if of is not None:
            keep &= of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h
        h, row = h[keep], row[keep]
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        seen.append(h[np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]] if len(h) else h)
    kinds, many = np.unique(np.concatenate(seen), return_counts=True)
    if of is None:
        return kinds, many
    full = np.zeros(len(of), np.int64)
    full[np.searchsorted(of, kinds)] = many
    return of, full


def _rank(blocks: Callable[[], Iterator[tuple[Words, int]]], scale: Scale, of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How surely the windows ``of`` mark toxic rows: minus the logarithm of the chance of so many by luck (Chernoff's bound); 0 if fewer than PURE of their rows are toxic."""
    bad, good = (_frequencies(blocks, scale, of, rows)[1] for rows in (toxic, ~toxic))
    share, many = toxic.mean(), np.maximum(1, bad + good)
    a = np.clip(bad / many, 1e-9, 1 - 1e-9)
    return np.where(a > max(share, PURE), many * (a * np.log(a / share) + (1 - a) * np.log((1 - a) / (1 - share))), 0)


def _letters_of(blocks: Callable[[], Iterator[tuple[Words, int]]], scale: Scale, wanted: np.ndarray) -> dict[int, np.ndarray]:
    found: dict[int, np.ndarray] = {}
    for w, _ in blocks():
        w = w.windows(scale)
        h = w.hashes()
        for i in np.flatnonzero(np.isin(h, wanted)):
            if int(h[i]) not in found:
                found[int(h[i])] = w.letters[w.start[i] : w.start[i] + w.size[i]]
    return found


def _landmarks(blocks: Callable[[], Iterator[tuple[Words, int]]], toxic: np.ndarray, scale: Scale) -> list[np.ndarray]:
    """Windows that mark toxic rows, unlike one another."""
    kinds, many = _frequencies(blocks, scale, rows=toxic)
    kinds = kinds[many >= min(3, many.max(initial=0))]
    if not len(kinds):
        return []
    rank = _rank(blocks, scale, kinds, toxic)
    top = kinds[np.argsort(-rank, kind="stable")[: 12 * LANDMARKS]]
    tops = _letters_of(blocks, scale, top)
    ranked: list[tuple[float, bytes]] = [(float(rank[np.searchsorted(kinds, h)]), x.tobytes()) for h, x in tops.items()]
    ranked = sorted({x for x in ranked if x[0] > np.log(len(kinds)) + SURE}, key=lambda x: (-x[0], x[1]))[: 12 * LANDMARKS]
    strings = [np.frombuffer(x, np.uint8) for _, x in ranked]
    if not strings:
        return []
    near = _gram(Kernel.of(strings, scale), strings)
    most, picked = float(scale.value(np.array(ALIKE))), []
    for i in range(len(strings)):
        if len(picked) < LANDMARKS and (not picked or near[i, picked].max() < most):
            picked.append(i)
    return [strings[i] for i in picked]


def _packed(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in strings])
    return np.concatenate(strings), np.cumsum(size) - size, size


def _gram(kernel: Kernel, strings: list[np.ndarray]) -> np.ndarray:
    """Kernel values of ``strings`` to the landmarks."""
    out = np.zeros((len(strings), kernel.table.shape[1]))
    near, values = kernel.values(*_packed(strings))
    out[near] = values
    return out


def edited(x: np.ndarray) -> list[np.ndarray]:
    """A string with a letter put in (another one, or the one before again) or left out in the middle."""
    k = len(x) // 2
    other = np.setdiff1d(np.arange(26, dtype=np.uint8), x)[-1:]
    return [np.concatenate([x[:k], other, x[k:]]), np.concatenate([x[:k], x[k - 1 : k], x[k:]]), np.concatenate([x[:k], x[k + 1 :]])]


def _joined(kernels: list[Kernel], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values (of the landmarks of all scales, side by side) of the words near any landmark."""
    found = [k.units(words) for k in kernels]
    those = np.unique(np.concatenate([w for w, _ in found]))
    out, at = np.zeros((len(those), sum(x.shape[1] for _, x in found)), np.float32), 0
    for w, x in found:
        out[np.searchsorted(those, w), at : at + x.shape[1]] = x
        at += x.shape[1]
    return words.row[those], out


def train(texts: list[str] | pa.Array, toxic: np.ndarray) -> Model:
    """A model of labelled texts; without both labels the score is the only label seen, or 0."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model([], float(toxic.any()), 1.0)
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())

    def blocks() -> Iterator[tuple[Words, int]]:
        return ((split(data, offsets), lo) for lo, _, data, offsets in tk.texts(column, 1 << 19))

    strings = [x for x in ((scale, _landmarks(blocks, toxic, scale)) for scale in SCALES) if x[1]]
    if not strings:
        return Model([], 0.0, 1.0)
    kernels = [Kernel.of(own, scale) for scale, own in strings]
    width = [len(own) for _, own in strings]
    root, at = np.zeros((sum(width), sum(width))), 0
    for kernel, (_, own) in zip(kernels, strings, strict=True):
        value, vector = np.linalg.eigh(_gram(kernel, own))
        root[at : at + len(own), at : at + len(own)] = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
        at += len(own)

    found, rows = [np.zeros((0, at), np.float32)], [np.zeros(0, np.int64)]
    for words, base in blocks():  # words near no landmark are alike: all 0
        row, x = _joined(kernels, words)
        if not len(row):
            continue
        row = row + base
        order = np.lexsort((-x.sum(1), row))
        nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        use = order[(nth < 5) | toxic[row[order]] & (x[order].max(1) >= CLOSE)]
        found.append(x[use])
        rows.append(row[use])
    found.append(np.zeros(((~toxic).sum(), at), np.float32))
    x, row = np.concatenate(found), np.concatenate([*rows, np.flatnonzero(~toxic)])
    z, score, close = x @ root, x.sum(1), x.max(1, initial=0) >= CLOSE
    made = [e for scale, own in strings if scale.pairs for t in own if len(t) > 4 for e in edited(t)]
    virtual = z[:0]
    if made:
        letters, start, size = _packed(made)
        virtual = _joined(kernels, Words(letters, start, size, np.arange(len(made)), np.arange(len(made))))[1] @ root
    weights = None
    for _ in range(6):
        order = np.lexsort((-score, row))
        top = order[np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])]
        used = np.concatenate([np.flatnonzero(toxic[row] & close), top[~toxic[row[top]]]])
        bad = np.concatenate([toxic[row[used]], np.ones(len(virtual), bool)])
        ours = np.arange(len(bad)) >= len(used)
        share = sum(w * k / max(1, k.sum()) for w, k in zip(SHARES, (bad & ~ours, ours, ~bad), strict=True))
        weights = _svm(np.concatenate([z[used], virtual]), np.where(bad, 1.0, -1.0), share)
        score = z @ weights[:-1] + weights[-1]
    direction = np.split(root @ weights[:-1], np.cumsum(width)[:-1])
    return Model([Scorer(k, d) for k, d in zip(kernels, direction, strict=True)], float(weights[-1]), 3.0)


def training_rows(docs: DataFrame, labels: DataFrame, held_out: str) -> tuple[pa.Array, np.ndarray]:
    """A bounded sample of labelled texts: at most SAMPLE_DOCS toxic and twice as many clean ones in the order of a hash, of SAMPLE_BYTES at most.

    Documents whose labels contradict one another teach nothing, and neither do rows for which ``held_out`` is true.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("t")).where("toxic = t").drop("t")
    known = known.where(f"not ({held_out})")
    ids = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(SAMPLE_DOCS * (2 - t)) for t in (1, 0)]
    ids = F.broadcast(ids[0].unionByName(ids[1]))  # at most 3 * SAMPLE_DOCS pairs of numbers
    found = docs.select("doc_id", "text").where(f"text is not null and octet_length(text) <= {SAMPLE_BYTES}").join(ids, "doc_id").select("text", "toxic").toArrow()
    found = found.group_by(["toxic", "text"]).aggregate([]).sort_by([("toxic", "ascending"), ("text", "ascending")])
    return found["text"].combine_chunks(), found["toxic"].to_numpy() == 1


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def toxicity(docs: DataFrame, labels: DataFrame, held_out: str = HELD_OUT) -> DataFrame:
    """All columns of ``docs`` with toxicity (0 to 1) of each whole text.

    Null and empty texts, and texts without words, score as a word near no landmark,
    which is clean. Without labels of both kinds every row gets the one label
    seen, or 0. ``docs`` may have any further columns; one named toxicity is
    replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(*training_rows(docs, labels, held_out)))
    docs = docs.drop("toxicity")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.texts(batch.column(at), 1 << 17):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.value.scores(data, offsets))], names=[*part.schema.names, "toxicity"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("toxicity", DoubleType())]))
