"""Nodes: distinct sequences with their frequencies and the features that pair scores read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions.alphabet import SIZE, code
from motifloom.operators.tables import ranked
from motifloom.sources.records import accepted

# The terminal columns (0 to 2 from the front, 3 to 5 at the back) of the six hypotheses, and the column pairs of seeds.
HYPOTHESES = ((0, 3), (0, 4), (0, 5), (1, 4), (1, 5), (2, 5))
COLUMN_PAIRS = {"contiguous": ((0, 1), (1, 2)), "all_column_pairs": ((0, 1), (0, 2), (1, 2))}
#: Residues that the two columns of a hypothesis are apart at least.
APART = 6
FRAME = 9


def terminal_codes(sequence: Column) -> Column:
    """The codes of the first three and last three residues."""
    at = [F.substring(sequence, k, 1) for k in (1, 2, 3, -3, -2, -1)]
    return F.array(*[code(x).cast("int") for x in at])


def hypothesis_mask(length: Column) -> Column:
    """Bit i is set if the columns of hypothesis i are at least 6 residues apart in a sequence of this length."""
    bits = [F.when(length - 3 + (back - 3) - front >= APART, 1 << i).otherwise(0) for i, (front, back) in enumerate(HYPOTHESES)]
    return sum(bits[1:], bits[0]).cast("int")


def hypotheses(terminal: Column, length: Column) -> Column:
    """The active hypotheses, as front code * 20 + back code, in the order of their bits."""
    each = [F.struct((length - 3 + (b - 3) - f >= APART).alias("on"), (F.get(terminal, f) * SIZE + F.get(terminal, b)).alias("pair")) for f, b in HYPOTHESES]
    return F.transform(F.filter(F.array(*each), lambda h: h["on"]), lambda h: h["pair"].cast("int"))


def dimers(terminal: Column, back: bool, seed: str) -> Column:
    """The distinct dimers of one end's column pairs, as first code * 20 + second code."""
    return F.array_distinct(F.array(*[(F.get(terminal, i + 3 * back) * SIZE + F.get(terminal, j + 3 * back)).cast("int") for i, j in COLUMN_PAIRS[seed]]))


def composite_keys(terminal: Column, seed: str) -> Column:
    """The distinct front * 400 + back of all front and back dimers, ascending; 9 at most."""
    front, back = dimers(terminal, False, seed), dimers(terminal, True, seed)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(front, lambda f: F.transform(back, lambda b: f * SIZE * SIZE + b)))))


def frame(sequence: Column) -> Column:
    """Nine motif columns as a string: the first four and last five residues; of eight residues, four, a gap '-', four; '-' only for others."""
    n = F.length(sequence)
    eight = F.concat(F.substring(sequence, 1, 4), F.lit("-"), F.substring(sequence, 5, 4))
    return F.when(n >= FRAME, F.concat(F.substring(sequence, 1, 4), F.right(sequence, F.lit(5)))).when(n == FRAME - 1, eight).otherwise("-" * FRAME)


def features(nodes: DataFrame) -> DataFrame:
    """nodes with length, mask, terminal codes `t` and hypotheses `h`."""
    n = F.length("sequence")
    return nodes.withColumn("length", n).withColumn("mask", hypothesis_mask(n)).withColumn("t", terminal_codes(F.col("sequence"))).withColumn("h", hypotheses(F.col("t"), F.col("length")))


def load(records: DataFrame, strict: bool = False) -> DataFrame:
    """(node_id, sequence, frequency): the distinct accepted sequences, numbered from 0 in byte order."""
    counted = accepted(records, strict).groupBy("sequence").agg(F.count("*").alias("frequency"))
    return ranked(counted, F.col("sequence"), to="node_id").select("node_id", "sequence", "frequency")
