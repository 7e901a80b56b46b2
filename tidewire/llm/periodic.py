"""Periodic runs of words: every maximal repetition of a text, found by probing a harmonic grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has this many words at least, and twice its period.
SHORTEST = 12
#: Grid points probed at once; a single period of a very long text may have more.
PROBES = 1 << 17
#: A probe that survives is extended by so many words on both sides together with all others, before it is worth a loop of its own.
NEAR = SHORTEST // 2
#: Words compared at once when a survivor is extended; each further chunk is four times as long.
CHUNK, LONGEST_CHUNK = 32, 1 << 15

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbers(words: list[bytes]) -> np.ndarray:
    """Words as integers, equal ones as equal integers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def grids(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid points jp with (j + 1)p < n, by rising period and place, in blocks of about PROBES: n log n points in all."""
    p = 1
    while 2 * p <= n:
        periods = np.arange(p, min(n // 2, p + PROBES) + 1)
        points = (n - 1) // periods
        upto = np.cumsum(points)
        k = max(1, int(np.searchsorted(upto, PROBES, "right")))
        periods, points, first = periods[:k], points[:k], upto[:k] - points[:k]
        period = np.repeat(periods, points)
        yield (np.arange(len(period)) - np.repeat(first, points)) * period, period
        p += k


def near(ids: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of the matching grid points may lie in a run, by their nearest NEAR words on each side."""
    n, reach, open_ended = len(ids), np.ones(len(at), np.int64), np.zeros(len(at), bool)
    for way in (-1, 1):
        live = np.arange(len(at))
        for k in range(1, NEAR + 1):
            i = at[live] + way * k
            inside = (i >= 0) & (i + period[live] < n)
            live, i = live[inside], i[inside]
            live = live[ids[i] == ids[i + period[live]]]
            reach[live] += 1
        open_ended[live] = True
    return open_ended | (reach >= np.maximum(SHORTEST - period, period))


def matching(ids: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The longest stretch lo <= i < hi of places whose word equals that p words on; i is one."""
    hi, size, end = i + 1, CHUNK, len(ids) - p
    while hi < end:
        differ = np.flatnonzero(ids[hi : min(hi + size, end)] != ids[hi + p : min(hi + size, end) + p])
        if len(differ):
            hi += int(differ[0])
            break
        hi, size = min(hi + size, end), min(4 * size, LONGEST_CHUNK)
    lo, size = i, CHUNK
    while lo > 0:
        start = max(0, lo - size)
        differ = np.flatnonzero(ids[start:lo] != ids[start + p : lo + p])
        if len(differ):
            lo = start + int(differ[-1]) + 1
            break
        lo, size = start, min(4 * size, LONGEST_CHUNK)
    return lo, hi


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``ids``, by start, then period.

    A run is a stretch with smallest period q, at least max(SHORTEST, 2q) long,
    that no neighbour extends with period q. Each run of period q holds a grid
    point jq whose word equals the one at (j + 1)q, so probing the grids of all
    periods misses none. A point inside a found run whose period divides p, with
    (j + 1)p inside too, can only give that run again and is skipped; so can
    points inside the stretch extended last.
    """
    n = len(ids)
    if n < SHORTEST:
        return []
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    # Of the runs over each place, the one found first (its period is the smallest) and the longest: its end (0 where there is none) and period.
    over = [(np.zeros(n, np.int64), np.ones(n, np.int64)) for _ in range(2)]
    for at, period in grids(n):
        hit = np.flatnonzero(ids[at] == ids[at + period])
        at, period = at[hit], period[hit]
        if found:
            new = np.ones(len(at), bool)
            for end, q in over:
                new &= (at + period >= end[at]) | (period % q[at] != 0)
            at, period = at[new], period[new]
        worth = near(ids, at, period)
        last, upto = 0, 0
        for i, p in zip(at[worth].tolist(), period[worth].tolist(), strict=True):
            if (p == last and i < upto) or any(i + p < end[i] and p % q[i] == 0 for end, q in over):
                continue
            lo, hi = matching(ids, i, p)
            last, upto, end = p, hi, hi + p
            # An equal stretch was found with a smaller period, which divides this one.
            if end - lo < max(SHORTEST, 2 * p) or (lo, end) in known:
                continue
            known.add((lo, end))
            found.append((lo, end - lo, p))
            (first_end, first_q), (long_end, long_q) = over
            free = np.flatnonzero(first_end[lo:end] == 0) + lo
            first_end[free], first_q[free] = end, p
            less = np.flatnonzero(long_end[lo:end] < end) + lo
            long_end[less], long_q[less] = end, p
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: of each run its first period stays, unless another run drops it."""
    if not found:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then period) and collapsed, the text without the repetitions of its runs.

    Words are maximal stretches without ASCII white space, numbered from 0; whole
    texts are read, each by itself, so equal texts get equal results. A null or
    empty text, or one of fewer than 12 words, has no runs; collapsed is then its
    words joined by one space ('' without words). Other columns pass through,
    null or not; own columns named n_words, runs or collapsed are replaced. An
    empty table gives an empty one.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")])
    own = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, all_runs, rest = [], [], []
            for body in batch.column(own.index(text)).cast(pa.binary()):
                words = (body.as_py() or b"").split()
                here = runs(numbers(words))
                counts.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in here])
                rest.append(collapsed(words, here))
            added = [pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(RUN)), pa.array(rest, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*own, "n_words", "runs", "collapsed"])

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], "n_words long", "runs array<struct<start: long, length: long, period: long>>", "collapsed string"])
    return docs.mapInArrow(scan, fields)
