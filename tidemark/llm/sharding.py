"""Uniform shuffle into shards of exact sizes by a hypergeometric matrix.

The rows are dealt into C cells by a hash of their key. For each cell the
numbers of rows that go to each shard are drawn from the multivariate
hypergeometric law, so that every row sum is the cell's row count and every
column sum is the shard's exact size. Each cell is permuted locally and cut at
the cumulative counts (first permutation), the rows are exchanged to their
shards, and each shard is permuted again (second permutation) to give slots.

Everything on the rows' path is DataFrame work. The driver only draws the
matrix, whose size (at most ``MAX_CELLS`` x shards) does not depend on the data.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Upper bound of the number of cells, hence of the matrix's rows.
MAX_CELLS = 4096
#: Rows that a cell holds on average while there are fewer than MAX_CELLS cells.
CELL_ROWS = 2048


def _stirling_rest(n: int) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without loss where both are close."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, power, k = (x - mean) * v, 2 * x * v, 1
    while True:
        power *= v * v
        new = total + power / (2 * k + 1)
        if new == total:
            return new
        total, k = new, k + 1


def _binomial(x: int, n: int, p: float, q: float) -> float:
    """The binomial probability by saddle-point expansion (Loader 2000): full precision for any n."""
    if x == 0:
        return math.exp(n * math.log1p(-p)) if p < 0.5 else math.exp(n * math.log(q)) if q else float(n == 0)
    if x == n:
        return math.exp(n * math.log1p(-q)) if q < 0.5 else math.exp(n * math.log(p))
    e = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return math.exp(e) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def draw_hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items out of ``good + bad`` are good, by inversion from the mode.

    Probabilities are right to the precision of doubles at any size, which
    differences of log-gamma values would not be.
    """
    lo, hi = max(0, drawn - bad), min(drawn, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (drawn + 1) * (good + 1) // (total + 2)))
    p, q = drawn / total, (total - drawn) / total
    at_mode = _binomial(mode, good, p, q) * _binomial(drawn - mode, bad, p, q) / _binomial(drawn, total, p, q)
    left = rng.random() - at_mode
    down = up = mode
    p_down = p_up = at_mode
    while left > 0 and (down > lo or up < hi):
        if up < hi:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(cells: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with the given row sums (cells) and column sums (shards), drawn uniformly."""
    rng, left, out = random.Random(seed), list(shards), []
    for n in cells:
        row, need, rest = [], n, sum(left)
        for k, room in enumerate(left):
            rest -= room
            got = draw_hypergeometric(rng, room, rest, need)
            row.append(got)
            left[k] -= got
            need -= got
        out.append(row)
    return out


def shuffle_into_shards(df: DataFrame, key: list[str], n_shards: int, seed: int = 7, max_cells: int = MAX_CELLS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1; counts at most one apart) and ``slot`` (gapless from 0 in each shard).

    ``key``: columns that tell rows apart; rows equal in all of them are
    interchangeable. Nulls are keys like any other. An empty table gives an
    empty result. Columns of df named shard or slot are replaced. The result
    depends on the rows and the seed only, not on how Spark splits the input.
    Equal texts need not meet in a shard: the counts' law leaves no room for it.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    cell, rank, first, second, ends, block, size, before = fresh(df.columns, "_cell", "_rank", "_first", "_second", "_ends", "_block", "_n", "_before")
    total = df.count()
    n_cells = max(1, min(max_cells, math.ceil(total / cell_rows)))
    hashed = lambda k: F.xxhash64(F.lit(seed + k), *key)
    rows = df.withColumns({cell: F.pmod(hashed(0), F.lit(n_cells)).cast("int"), first: hashed(2), second: hashed(1)})
    counts = {r[0]: r[1] for r in rows.groupBy(cell).agg(F.count(F.lit(1))).collect()}  # at most MAX_CELLS rows
    sizes = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    matrix = communication_matrix([counts.get(c, 0) for c in range(n_cells)], sizes, seed)
    cuts = spark.createDataFrame([(c, list(accumulate(row))) for c, row in enumerate(matrix)], f"`{cell}` int, `{ends}` array<bigint>")
    in_cell = Window.partitionBy(cell).orderBy(first, *key)
    sent = (
        rows.withColumn(rank, F.row_number().over(in_cell))
        .join(F.broadcast(cuts), cell)  # MAX_CELLS rows at most
        .withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(rank))))
        .withColumn(block, F.floor(F.shiftrightunsigned(second, 64 - 12) * F.lit(n_cells) / F.lit(4096)).cast("int"))
        .drop(cell, first, rank, ends)
    )
    sent = materialize(sent, "sharding")
    # A shard's slots follow the second hash: whole blocks in order of the hash's leading bits, then rows in a block.
    blocks = sent.groupBy("shard", block).agg(F.count(F.lit(1)).alias(size))
    earlier = F.sum(size).over(Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("shard", block, F.coalesce(earlier, F.lit(0)).alias(before))
    in_block = Window.partitionBy("shard", block).orderBy(second, *key)
    return (
        sent.withColumn(rank, F.row_number().over(in_block))
        .join(blocks, ["shard", block])
        .withColumn("slot", F.col(before) + F.col(rank) - 1)
        .drop(block, second, rank, before)
    )
