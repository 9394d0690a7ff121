"""The residue alphabet, residue similarities in thousandths, and their use in column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 20 residues, and the BLOSUM62 substitution scores of each with those up to itself.
ALPHABET = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
SIZE = len(ALPHABET)


def substitution() -> list[list[int]]:
    """The whole 20 x 20 matrix of substitution scores."""
    rows = [[int(v) for v in line.split()] for line in BLOSUM62.split("\n") if line]
    return [[rows[max(i, j)][min(i, j)] for j in range(SIZE)] for i in range(SIZE)]


def half_away(x: float) -> int:
    """Rounds to the nearest integer, halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def residue_similarities() -> list[int]:
    """By code * 20 + code: the score over the root of the product of both self scores, in thousandths."""
    m = substitution()
    return [half_away(m[a][b] / math.sqrt(m[a][a] * m[b][b]) * 1000) for a in range(SIZE) for b in range(SIZE)]


def integers(values: list[int]) -> Column:
    """A constant array of integers."""
    return F.expr(f"array({','.join(map(str, values))})")


def code(residue: Column) -> Column:
    """0 to 19 for a residue letter, -1 for others."""
    return F.instr(F.lit(ALPHABET), residue) - 1


def similarity(a: Column, b: Column) -> Column:
    """The residue similarity of two codes, in thousandths."""
    return F.get(integers(residue_similarities()), a * SIZE + b)


def half_score(pair_sum: Column) -> Column:
    """Half of a sum of two residue similarities, halves away from zero: the seed score of two dimers."""
    up = F.floor((F.abs(pair_sum) + 1) / 2).cast("int")
    return F.when(pair_sum >= 0, up).otherwise(-up)


def dimer_similarity(x: Column, y: Column) -> Column:
    """The sum of both residue similarities of two dimers, each given as first * 20 + second."""
    first = similarity(F.floor(x / SIZE).cast("int"), F.floor(y / SIZE).cast("int"))
    return first + similarity(x % SIZE, y % SIZE)
