"""Pair scores in thousandths: terminal similarity, anchor assignment and its bound, constrained alignment.

A node's terminal codes are an array of six, its hypotheses an array of front * 20 + back codes
(see operators.nodes). The first two scores are column expressions; the assignment and the
alignment are dynamic programs over arrays of pairs in Arrow-batched functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from motifloom.functions.alphabet import ALPHABET, SIZE, dimer_similarity, residue_similarities, similarity, substitution

#: Sequences weigh 4 times within this many residues of either end.
END, END_WEIGHT = 3, 4
SCALE = 1000
#: Terminal codes that hypotheses join: of sequences of eight residues, and of longer ones.
SHORT, LONG = ((0, 4), (0, 5), (1, 5)), ((0, 3), (0, 4), (0, 5), (1, 4), (1, 5), (2, 5))


def terminal_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of terminal codes: the mean of both ends' similarities, each floored at zero and capped at 1000."""

    def end(at: int) -> Column:
        total = sum((similarity(F.get(a, i), F.get(b, i)) for i in range(at + 1, at + 3)), similarity(F.get(a, at), F.get(b, at)))
        return F.least(F.lit(1000), F.floor(F.greatest(F.lit(0), total) / 3).cast("int"))

    return F.floor((end(0) + end(3) + 1) / 2).cast("int")


def anchor_bound(a: Column, b: Column) -> Column:
    """An upper bound of the anchor similarity of hypothesis arrays: the best partner of each of the fewer (a's, if as many)."""
    best = lambda few, many: F.aggregate(few, F.lit(0), lambda s, x: s + F.array_max(F.transform(many, lambda y: dimer_similarity(x, y))))
    swap = F.size(a) > F.size(b)
    total = F.when(swap, best(b, a)).otherwise(best(a, b))
    n = F.least(F.size(a), F.size(b))
    return F.when(n == 0, 0).otherwise(F.least(F.lit(1000), F.floor(F.greatest(F.lit(0), total) / (2 * n)).cast("int")))


def packed(terminal: Column, short: Column) -> Column:
    """Six terminal codes, and whether the sequence has eight residues, as one long."""
    number = F.lit(0).cast("long")
    for k in range(6):
        number = number * SIZE + F.get(terminal, k)
    return number * 2 + short.cast("long")


def packed_bounds(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """anchor_bound() of pairs of packed() numbers: hypotheses join a front and a back residue, so nine similarities of fronts and nine of backs make them all."""
    table = np.array(residue_similarities(), np.int64).reshape(SIZE, SIZE)
    a, b = ([x // 2 // SIZE ** (5 - k) % SIZE for k in range(6)] for x in (left, right))
    out = np.zeros(len(left), np.int64)
    for shapes in ((x, y) for x in (0, 1) for y in (0, 1)):
        at = np.flatnonzero((left % 2 == shapes[0]) & (right % 2 == shapes[1]))
        near = {(x, y): table[a[x][at], b[y][at]] for s in (0, 3) for x in range(s, s + 3) for y in range(s, s + 3)}
        mine, other = (SHORT if x else LONG for x in shapes)
        swap = len(mine) > len(other)
        of = lambda x, y: near[(y, x) if swap else (x, y)]  # noqa: B023, E731
        few, many = (other, mine) if swap else (mine, other)
        total = sum(np.max([of(f, g) + of(e, h) for g, h in many], axis=0) for f, e in few)
        out[at] = np.minimum(1000, np.maximum(0, total) // (2 * len(few)))
    return out


def assignment(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The anchor similarity of pairs of hypotheses, (pairs, few) and (pairs, many): the best one-to-one assignment of the fewer.

    All pairs advance together through the subsets of partners used so far.
    """
    if left.shape[1] > right.shape[1]:
        left, right = right, left
    few, many = left.shape[1], right.shape[1]
    if not few:
        return np.zeros(len(left), np.int64)
    table = np.array(residue_similarities(), np.int64).reshape(SIZE, SIZE)
    sums = table[left[:, :, None] // SIZE, right[:, None, :] // SIZE] + table[left[:, :, None] % SIZE, right[:, None, :] % SIZE]
    sums = np.ascontiguousarray(sums.transpose(1, 2, 0), np.int32)
    best = np.full((1 << many, len(left)), -(10**9), np.int32)  # a row a subset, so that pairs lie side by side
    best[0] = 0
    for used in sorted(range(1 << many), key=int.bit_count):
        row = used.bit_count()
        for k in range(many):
            if row < few and not used >> k & 1:
                np.maximum(best[used | 1 << k], best[used] + sums[row, k], out=best[used | 1 << k])
    whole = best[[used for used in range(1 << many) if used.bit_count() == few]].max(0).astype(np.int64)
    return np.minimum(1000, np.maximum(0, whole) // (2 * few))


def align(left: np.ndarray, right: np.ndarray, gaps: tuple[float, float, float, float] = (-4.0, -1.0, -2.0, -1.0), matches: int = 2) -> np.ndarray:
    """The constrained alignment similarity of pairs of sequences of one length each, (pairs, m) and (pairs, n) codes.

    A global alignment with affine gaps (open, extend, terminal open, terminal extend), in which at
    least `matches` residues of the first three meet, and of the last three. Residues weigh 4 near
    the ends. The raw score is divided by the root of the product of both self scores.
    """
    pairs, m = left.shape
    n = right.shape[1]
    scores = np.array(substitution(), np.int64)
    weight = lambda i, size: END_WEIGHT if i < END or i >= size - END else 1
    open_, extend, end_open, end_extend = (int(np.floor(abs(g) * 2 * SCALE + 0.5) * np.sign(g)) for g in gaps)
    none = np.int64(-(10**12))
    empty = lambda: np.full((pairs, matches + 1, matches + 1, 3), none)

    def bumped(cell: np.ndarray, front: bool, back: bool) -> np.ndarray:
        """Best over states, counts of matches at the ends raised by one, up to `matches`."""
        out = cell.max(3)
        for on, axis in ((front, 1), (back, 2)):
            if on:
                moved = np.moveaxis(np.full_like(out, none), axis, 1)
                source = np.moveaxis(out, axis, 1)
                moved[:, 1:] = source[:, :-1]
                np.maximum(moved[:, -1], source[:, -1], out=moved[:, -1])
                out = np.moveaxis(moved, 1, axis)
        return out

    above: list[np.ndarray] = []
    for i in range(m + 1):
        row: list[np.ndarray] = []
        for j in range(n + 1):
            cell = empty()
            if not i and not j:
                cell[:, 0, 0, 0] = 0
            if i and j:
                gain = (weight(i - 1, m) + weight(j - 1, n)) * scores[left[:, i - 1], right[:, j - 1]] * SCALE
                cell[..., 0] = bumped(above[j - 1], i <= END and j <= END, i > m - END and j > n - END) + gain[:, None, None]
            if i:  # left's residue against a gap, not right after a gap on the other side
                edge = j in (0, n)
                before = above[j]
                cell[..., 1] = np.maximum(before[..., 0] + (end_open if edge else open_), before[..., 1] + (end_extend if edge else extend))
            if j:
                edge = i in (0, m)
                before = row[j - 1]
                cell[..., 2] = np.maximum(before[..., 0] + (end_open if edge else open_), before[..., 2] + (end_extend if edge else extend))
            row.append(cell)
        above = row
    raw = above[n][:, matches, matches].max(1)

    def self_score(codes: np.ndarray) -> np.ndarray:
        weights = np.array([2 * weight(k, codes.shape[1]) for k in range(codes.shape[1])], np.int64)
        return (scores[codes, codes] * weights).sum(1) * SCALE

    root = np.sqrt(self_score(left).astype(float) * self_score(right).astype(float))
    return np.where(raw <= 0, 0, np.minimum(1000, np.floor(raw / root * 1000 + 0.5))).astype(np.int64)


def quick_align(left: np.ndarray, right: np.ndarray, gaps: tuple[float, float, float, float] = (-4.0, -1.0, -2.0, -1.0), matches: int = 2) -> np.ndarray:
    """align(), by fewer states: how many residues of the first three have met matters where both are among them only, as all must have by then; so at the back.

    A cell holds its states by these counts, each a row of all pairs or None where no alignment ends so. Sequences
    under six residues, whose ends overlap, go through align().
    """
    (pairs, m), n = left.shape, right.shape[1]
    if min(m, n) < 2 * END:
        return align(left, right, gaps, matches)
    scores = np.array(substitution(), np.int64)
    weight = lambda i, size: END_WEIGHT if i < END or i >= size - END else 1
    open_, extend, end_open, end_extend = (int(np.floor(abs(g) * 2 * SCALE + 0.5) * np.sign(g)) for g in gaps)
    most = (m + n) * (max(map(abs, (open_, extend, end_open, end_extend))) + int(np.abs(scores).max()) * 2 * END_WEIGHT * SCALE)
    kind = np.int32 if most < 1 << 30 else np.int64
    gains = {w: (scores * w * SCALE).astype(kind).ravel() for w in (2, 1 + END_WEIGHT, 2 * END_WEIGHT)}
    rows, cols = np.ascontiguousarray(left.T, np.int64) * SIZE, np.ascontiguousarray(right.T, np.int64)
    plus = lambda a, x: None if a is None else a + x
    larger = lambda a, b: b if a is None else a if b is None else np.maximum(a, b)
    nothing = (None, None, None)

    def gap(cell: dict, key: tuple[int, int], state: int, edge: bool) -> np.ndarray | None:
        before = cell.get(key, nothing)
        return larger(plus(before[0], end_open if edge else open_), plus(before[state], end_extend if edge else extend))

    def raised(k: int, on: bool) -> list[int]:
        """The counts from which a match leads to k."""
        return [k] if not on else sorted({k - 1, k} if k == matches else {k - 1})

    above: list[dict] = []
    for i in range(m + 1):
        row: list[dict] = []
        for j in range(n + 1):
            cell = {}
            front, back = i <= END and j <= END, i > m - END and j > n - END
            for key in [(f, 0) for f in range(matches + 1)] if front else [(matches, b) for b in range(matches + 1 if back else 1)]:
                met = np.zeros(pairs, kind) if not i and not j and key == (0, 0) else None
                if i and j:
                    for source in ((f, b) for f in raised(key[0], front) for b in raised(key[1], back)):
                        for state in above[j - 1].get(source, nothing):
                            met = larger(met, state)
                    if met is not None:
                        met = met + gains[weight(i - 1, m) + weight(j - 1, n)].take(rows[i - 1] + cols[j - 1])
                # a gap is not right after one on the other side
                cell[key] = met, gap(above[j], key, 1, j in (0, n)) if i else None, gap(row[j - 1], key, 2, i in (0, m)) if j else None
            row.append(cell)
        above = row
    raw = None
    for state in above[n].get((matches, matches), nothing):
        raw = larger(raw, state)
    raw = np.zeros(pairs, np.int64) if raw is None else raw.astype(np.int64)
    self_score = lambda codes: (scores[codes, codes] * np.array([2 * weight(k, codes.shape[1]) for k in range(codes.shape[1])], np.int64)).sum(1) * SCALE
    root = np.sqrt(self_score(left).astype(float) * self_score(right).astype(float))
    return np.where(raw <= 0, 0, np.minimum(1000, np.floor(raw / root * 1000 + 0.5))).astype(np.int64)


_CODES = np.full(128, -1, np.int64)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(SIZE)


def _by_shape(left: list[np.ndarray], right: list[np.ndarray], kernel: Callable, most: int) -> pd.Series:
    """kernel over pairs, those of equal lengths at once, `most` at a time."""
    out = np.zeros(len(left), np.int32)
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        shapes.setdefault((len(x), len(y)), []).append(k)
    for at in shapes.values():
        for k in range(0, len(at), most):
            own = at[k : k + most]
            out[own] = kernel(np.array([left[i] for i in own], np.int64), np.array([right[i] for i in own], np.int64))
    return pd.Series(out)


def anchor_similarity(a: Column, b: Column) -> Column:
    """The anchor similarity of two hypothesis arrays."""

    @F.pandas_udf(IntegerType())
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return _by_shape(list(x), list(y), assignment, 4096)

    return scored(a, b)


def alignments(left: pa.Array, right: pa.Array, gaps: tuple[float, float, float, float], matches: int, most: int = 4096) -> np.ndarray:
    """The alignment similarities of two arrays of sequences, those of equal lengths at once, `most` at a time."""

    def flat(of: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = of.to_pylist()
        size = np.fromiter(map(len, text), np.int64, len(text))
        return _CODES[np.frombuffer("".join(text).encode(), np.uint8)], np.cumsum(size) - size, size

    (x, x_at, m), (y, y_at, n) = flat(left), flat(right)
    out = np.zeros(len(left), np.int32)
    order = np.lexsort((n, m))
    ends = np.flatnonzero((np.diff(m[order], append=-1) != 0) | (np.diff(n[order], append=-1) != 0)) + 1
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(out) else ():
        for k in range(lo, hi, most):
            own = order[k : min(hi, k + most)]
            at = lambda of, starts, size: of[starts[own][:, None] + np.arange(size[own[0]])]  # noqa: B023, E731
            out[own] = quick_align(at(x, x_at, m), at(y, y_at, n), gaps, matches)
    return out


def alignment_similarity(a: Column, b: Column, gaps: tuple[float, float, float, float] = (-4.0, -1.0, -2.0, -1.0), matches: int = 2) -> Column:
    """The constrained alignment similarity of two sequence columns of valid residues, each of at least three."""

    @F.pandas_udf(IntegerType())
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(alignments(pa.array(x, pa.string()), pa.array(y, pa.string()), gaps, matches))

    return scored(a, b)
