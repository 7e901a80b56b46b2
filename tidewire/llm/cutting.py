"""Cutting stock by column generation: which lengths fill a sequence, and how often, from a histogram of lengths."""

from __future__ import annotations

import numpy as np

#: Lengths in one linear program; a histogram of more is dealt to several, whose simplex stays this small.
ROWS = 512
#: Lengths up to this part of the capacity are in every program.
SHORT = 16
#: Columns taken from one run of the knapsack.
COLUMNS = 48
#: Gain of a column below which it is not worth entering.
LEAST_GAIN = 1e-7
#: A program ends this near (as a part) to the bound that prices give, or all tokens; what it leaves over is filled or cut later.
GAP = 0.002
#: Runs of the knapsack for one program at most.
ROUNDS = 8


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The least price of filling each room from 0 to ``capacity`` exactly, any length as often as wanted, and the index of a length to begin with (inf, -1 where none does)."""
    least, choice = np.full(capacity + 1, np.inf), np.full(capacity + 1, -1)
    least[0] = 0.0
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        k = upto[room]
        if k:
            cost = price[:k] + least[room - lengths[:k]]
            i = int(cost.argmin())
            if cost[i] < np.inf:
                least[room], choice[room] = cost[i], i
    return least, choice


def patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(copies of each length, times) of a linear program's solution: the most full sequences within ``demand``.

    Revised simplex from the basis of slacks (every document left over). The
    first columns are those of a greedy filling; then prices of lengths go to the
    knapsack, whose cheapest exact fillings join while they cost less than the
    sequence they fill. Every basis is a packing, so ending within GAP of the
    bound, or after ROUNDS runs of the knapsack, only leaves more over.
    """
    m, all_tokens = len(lengths), float(lengths @ demand)
    place = {int(x): i for i, x in enumerate(lengths)}
    inverse, basis, amount = np.eye(m), [None] * m, demand.astype(float)
    value, price = np.zeros(m), np.zeros(m)

    def enter(column: np.ndarray, gain: float, what) -> np.ndarray | None:
        """One pivot; the places where prices changed, or None if no basic variable limits the column."""
        some = np.flatnonzero(column)
        way = inverse[:, some] @ column[some]
        up = np.flatnonzero(way > 1e-9)
        if not len(up):
            return None
        ratio = amount[up] / way[up]
        best = ratio.min()
        tied = up[ratio <= best + 1e-12]
        r = int(tied[np.argmax(way[tied])])
        amount[:] = np.maximum(amount - best * way, 0.0)
        amount[r] = best
        inverse[r] /= way[r]
        # Few entries differ from 0 while columns come from the greedy filling.
        rows, wide = np.flatnonzero(np.abs(way) > 1e-12), np.flatnonzero(np.abs(inverse[r]) > 1e-13)
        rows = rows[rows != r]
        inverse[np.ix_(rows, wide)] -= np.outer(way[rows], inverse[r, wide])
        basis[r], value[r] = what, 0.0 if what is None else 1.0
        price[wide] += gain * inverse[r, wide]
        return wide

    def solved(columns: np.ndarray) -> bool:
        """Enter ``columns`` (one a row), and slacks again, while any gains; whether one did."""
        some, gain = False, 1.0 - columns @ price
        for _ in range(4 * len(columns) + m):
            i, j = int(gain.argmax()), int(price.argmin())
            before = price.copy()
            if -price[j] > max(gain[i], LEAST_GAIN):
                wide = enter(np.eye(1, m, j)[0], -price[j], None)
            elif gain[i] > LEAST_GAIN:
                wide = enter(columns[i], gain[i], columns[i])
            else:
                break
            if wide is None:
                break
            gain -= columns[:, wide] @ (price[wide] - before[wide])
            some = True
        price[:] = value @ inverse  # no drift
        return some

    first = [copies for copies, _ in filled({int(x): int(n) for x, n in zip(lengths, demand, strict=True)}, capacity)]
    columns = np.zeros((len(first), m))
    for row, copies in enumerate(first):
        for x, n in copies.items():
            columns[row, place[x]] = n
    if len(first):
        solved(columns)
    for _ in range(ROUNDS):
        held = np.maximum(price, 0.0)
        least, choice = knapsack(lengths, held, capacity)
        total = held + least[capacity - lengths]
        cheapest, bound = float(total.min()), all_tokens / capacity
        if cheapest > 0:  # prices over the cheapest column are a solution of the dual
            bound = min(bound, float(held @ demand) / cheapest)
        if float(value @ amount) >= (1 - GAP) * bound:
            break
        made = {}
        for i in np.argsort(total, kind="stable")[: 4 * COLUMNS]:
            if not total[i] < 1.0 - LEAST_GAIN or len(made) >= COLUMNS:
                break
            column, room = np.zeros(m), capacity - int(lengths[i])
            column[i] += 1
            while room:
                column[choice[room]] += 1
                room -= int(lengths[choice[room]])
            made[column.tobytes()] = column
        if not made or not solved(np.array(list(made.values()))):
            break
    return [(column, float(x)) for column, x in zip(basis, amount, strict=True) if column is not None and x > 0]


def filled(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(copies of each length, times) that fill sequences exactly from what is ``left`` of each length; what is used is taken from it.

    The longest length begins; which sums the others reach is a set of bits. A
    length that no others complete never is later, so it stays over for good.
    """
    out, hopeless = [], set()
    while True:
        open_ = sorted((x for x, n in left.items() if n > 0 and x not in hopeless), reverse=True)
        if not open_:
            return out
        begin, target = open_[0], capacity - open_[0]
        reach, steps = 1, []
        for x in open_:
            spare, k = min(left[x] - (x == begin), target // x), 1
            while spare > 0 and not reach >> target & 1:
                take = min(k, spare)
                steps.append((x, take, reach))
                reach |= (reach << take * x) & ((1 << target + 1) - 1)
                spare, k = spare - take, 2 * k
            if reach >> target & 1:
                break
        if not reach >> target & 1:
            hopeless.add(begin)
            continue
        copies, room = {begin: 1}, target
        for x, take, before in reversed(steps):
            if not before >> room & 1:
                copies[x] = copies.get(x, 0) + take
                room -= take * x
        times = min(left[x] // n for x, n in copies.items())
        for x, n in copies.items():
            left[x] -= n * times
        out.append((copies, times))


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """((copies of each length, times) of full sequences, what is left of each length) for a ``histogram`` of lengths below ``capacity``.

    The optimum of each program is rounded down; what that leaves is filled up
    exactly where it can be. Work depends on the number of lengths, not of documents.
    """
    out, left = [], {x: n for x, n in histogram.items() if n > 0}
    # Each program gets one of every few neighbouring lengths, in no regular steps: lengths that share a factor with the capacity
    # fill fewer sequences. The shortest lengths, which complete the others, are in each program with their share of the pieces.
    parts = max(1, -(-len(left) // ROWS))
    draw, order = np.random.default_rng(31), sorted(left)
    short = [x for x in order if x <= capacity // SHORT] if parts > 1 else []
    dealt: list[list[int]] = [[] for _ in range(parts)]
    for lo in range(len(short), len(order), parts):
        for x, part in zip(order[lo : lo + parts], draw.permutation(parts), strict=False):
            dealt[part].append(x)
    for part, own in enumerate(dealt):
        share = {x: (left[x] - 1) // (parts - part) + 1 for x in short if left[x]}
        lengths = np.array([*share, *own], np.int64)
        demand = np.array([*share.values(), *[left[x] for x in own]])
        if not len(lengths):
            continue
        for column, x in sorted(patterns(lengths, demand, capacity), key=lambda c: -c[1]):
            copies = {int(lengths[i]): int(column[i]) for i in np.flatnonzero(column)}
            times = min(int(x + 1e-6), *[left[y] // n for y, n in copies.items()], 1 << 62)
            if times > 0:
                out.append((copies, times))
                for y, n in copies.items():
                    left[y] -= n * times
    out += filled(left, capacity)
    return out, {x: n for x, n in left.items() if n > 0}
