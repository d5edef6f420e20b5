"""Spots of crowded cells replaced by a fixed number of weighted points with the same kernel sums.

Within a cell the kernel, as a function of the spot's position, is interpolated at ORDER x ORDER Chebyshev
nodes. The sum over a cell's spots is then a sum over its nodes, each weighted by what the spots' Lagrange
polynomials add up to there; the weights hold for every place that looks at the cell, so they are made once.
A cell of side h / 2 (h: bandwidth) keeps a Gaussian's values up to 10 h away right to 2e-11 of its largest
value in the cell and 2e-9 of its smallest; half the side does so for twice the distance. Cells of few spots
keep their spots. What a place reads thus depends on its reach, not on the number of incidents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import stored
from .distance_join import CELL, with_cell
from .skew import is_small, salted_join

ORDER = 14
#: Bandwidths up to which the cells of level 0 hold, and the last level: each level halves the cells.
REACH, LEVELS = 10.0, 3
ANGLES = [(2 * a + 1) * math.pi / (2 * ORDER) for a in range(ORDER)]


def level_of(km: Column, bandwidth: float) -> Column:
    """The level whose cells hold for places that reach `km` far."""
    halvings = F.ceil(F.log2(F.greatest(km / F.lit(REACH * bandwidth), F.lit(1.0))))
    return F.least(halvings, F.lit(LEVELS - 1)).cast("int")


def _side(bandwidth: float, level: int) -> float:
    return bandwidth / 2 ** (level + 1)


def _kernel_of_angles(angle: Column) -> Column:
    """1 + 2 (cos t + ... + cos (ORDER - 1) t)."""
    half = F.sin(angle / 2)
    return F.when(half == 0, F.lit(2.0 * ORDER - 1)).otherwise(F.sin(angle * (ORDER - 0.5)) / half)


def _polynomial(angle: Column, node: float) -> Column:
    """Lagrange polynomial of a node at cos(angle)."""
    return (_kernel_of_angles(angle - node) + _kernel_of_angles(angle + node)) / (2 * ORDER)


def _angle(at: Column, low: Column, high: Column) -> Column:
    place = (at * 2 - low - high) / (high - low)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), place)))


def _node(angle: Column, low: Column, high: Column) -> Column:
    return (low + high + (high - low) * F.cos(angle)) / 2


def condensed(spots: DataFrame, bandwidth: float, level: int = 0, few: int = ORDER * ORDER) -> DataFrame:
    """(plat, plon, n): spots, with those of cells that hold more than `few` replaced; n may be negative.

    Spots are distinct coordinates with their counts n.
    """
    grid = geo.CellGrid(_side(bandwidth, level))
    placed = with_cell(spots, grid, "plat", "plon")
    crowded = stored(placed.groupBy(*CELL).agg(F.count("*").alias("_n")).filter(F.col("_n") > few).select(*CELL))
    plain = spots.select("plat", "plon", F.col("n").cast("double").alias("n"))
    if crowded.isEmpty():
        return plain
    if is_small(crowded, 200_000):
        inside = placed.join(F.broadcast(crowded), CELL)
        outside = placed.join(F.broadcast(crowded), CELL, "left_anti")
    else:
        inside = salted_join(placed, crowded, CELL, ["plat", "plon"])
        outside = placed.join(crowded.hint("merge"), CELL, "left_anti")
    a, b, c, d = grid.box(F.col("_row"), F.col("_col"))
    angles = inside.select(*CELL, "n", _angle(F.col("plat"), a, b).alias("_u"), _angle(F.col("plon"), c, d).alias("_v"))
    north = F.array(*[F.struct(F.lit(t).alias("_t"), (F.col("n") * _polynomial(F.col("_u"), t)).alias("_w"))
                      for t in ANGLES])
    east = {f"_e{i}": _polynomial(F.col("_v"), t) for i, t in enumerate(ANGLES)}
    # At most ORDER rows of ORDER sums for each cell and task are shuffled.
    sums = angles.withColumns(east).select(*CELL, *east, F.inline(north)).groupBy(*CELL, "_t").agg(
        *[F.sum(F.col("_w") * F.col(e)).alias(e) for e in east])
    nodes = F.array(*[F.struct(F.lit(t).alias("_s"), F.col(e).alias("n")) for e, t in zip(east, ANGLES, strict=True)])
    made = sums.select(*CELL, "_t", F.inline(nodes)).select(
        _node(F.col("_t"), a, b).alias("plat"), _node(F.col("_s"), c, d).alias("plon"), "n")
    return outside.select("plat", "plon", F.col("n").cast("double").alias("n")).unionByName(made)
