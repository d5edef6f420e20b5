"""Kernel density on a grid and at locations, and its classes.

No kernel term that counts is left out. Beyond `UNDERFLOW` bandwidths a term is exactly zero in double
precision. Within that, a node whose nearest spot is at distance d needs the spots up to
sqrt(d^2 + 2 h^2 (40 + ln n)) only: all others together are below double precision of the nearest one's
term, however far out the node is. That nearest distance is bounded through cells of spots. The nodes
that a cell reaches follow from its coordinates by arithmetic, so nodes are never joined with spots:
each task explodes its spots to their cell's nodes, adds up at most one row per node, and only those
sums are shuffled. Locations read crowded cells as a fixed number of points (`proxies`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, rules
from ..session import stored
from . import stats
from .distance_join import CELL, with_cell, with_search_cells
from .proxies import condensed, level_of
from .skew import is_small, salted_join

#: exp(-x^2 / 2) is zero in double precision beyond this.
UNDERFLOW = 39.0
#: exp(-DIGITS) is below the last digit of a double.
DIGITS = 40.0
#: Nodes in all cells' lists up to which the lists are broadcast.
MAX_LISTED = 200_000


@dataclass(frozen=True)
class Kernel:
    """`geodesic`: bandwidth 0.01 degrees of latitude, in km. `plain`: degrees taken for radians,
    bandwidth 0.01 on the unit sphere, as the original figures were made."""

    mode: str = "geodesic"
    degrees: float = 0.01

    @property
    def bandwidth(self) -> float:
        return self.degrees * geo.KM_PER_DEGREE if self.mode == "geodesic" else self.degrees

    def distance(self, lat1, lon1, lat2, lon2) -> Column:
        if self.mode == "geodesic":
            return geo.haversine_km(lat1, lon1, lat2, lon2)
        half_lat, half_lon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
        a = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
        a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
        return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))

    def value(self, distance: Column) -> Column:
        return F.exp(distance * distance / F.lit(-2 * self.bandwidth ** 2))

    def reach(self, box):
        """Degrees of latitude and longitude beyond which the kernel counts as zero."""
        cut = UNDERFLOW * self.degrees
        lat_min, lat_max = box[0] - cut, box[1] + cut
        if self.mode == "geodesic":
            smallest = math.cos(math.radians(min(max(abs(lat_min), abs(lat_max)), 89.9)))
        else:
            steps = 1000
            smallest = min(abs(math.cos(lat_min + (lat_max - lat_min) * i / steps))
                           for i in range(steps + 1))
        return cut * 1.01, cut * 1.01 / max(smallest, 1e-3)


def spot_weights(points: DataFrame, by=(), lat="latitude", lon="longitude") -> DataFrame:
    known = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return known.groupBy(F.col(lat).alias("plat"), F.col(lon).alias("plon"), *by).agg(
        F.count("*").alias("n"))


class _Axis:
    """Evenly spaced values of one axis of the grid."""

    def __init__(self, low: float, high: float, size: int, reach: float):
        self.low, self.high, self.size, self.reach = low, high, size, reach
        self.step = (high - low) / (size - 1)

    def cell(self, c: Column) -> Column:
        """Number of the nearest value, also beyond the ends."""
        return F.round((c - self.low) / self.step).cast("long")

    def within(self, first: Column, last: Column) -> Column:
        """Numbers of the values that lie within reach of the range, null if there is none."""
        a = F.greatest(F.ceil((first - self.reach - self.low) / self.step), F.lit(0))
        b = F.least(F.floor((last + self.reach - self.low) / self.step), F.lit(self.size - 1))
        return F.when(a <= b, F.sequence(a, b))

    def value(self, index: Column) -> Column:
        return geo.linspace(self.low, self.high, self.size, index)


def _axes(box, size, kernel):
    lat_min, lat_max, lon_min, lon_max = box
    reach_lat, reach_lon = kernel.reach(box)
    return _Axis(lat_min, lat_max, size, reach_lat), _Axis(lon_min, lon_max, size, reach_lon)


def _in_cells(spots: DataFrame, axes) -> DataFrame:
    return spots.withColumns({"ci": axes[0].cell(F.col("plat")), "cj": axes[1].cell(F.col("plon"))})


def _node_cells(spots: DataFrame, by, axes) -> DataFrame:
    """(by, ci, cj, i, j, near, far, total): the cells that may reach a node, with bounds of the
    distance to their spots and the group's number of incidents."""
    cells = _in_cells(spots, axes).groupBy(*by, "ci", "cj").agg(
        F.min("plat").alias("a"), F.max("plat").alias("b"), F.min("plon").alias("c"),
        F.max("plon").alias("d"), F.sum("n").alias("n"))
    pairs = (cells.withColumn("i", F.explode(axes[0].within(F.col("a"), F.col("b"))))
             .withColumn("j", F.explode(axes[1].within(F.col("c"), F.col("d")))))
    near, far = geo.box_distance_bounds(
        axes[0].value(F.col("i")), axes[1].value(F.col("j")), [F.col(x) for x in "abcd"])
    return pairs.withColumns({"near": near, "far": far}).drop("a", "b", "c", "d")


def _limits(pairs: DataFrame, by) -> DataFrame:
    """(by, i, j, nearest, total): an upper bound of each node's nearest distance."""
    return pairs.groupBy(*by, "i", "j").agg(F.min("far").alias("nearest"), F.sum("n").alias("total"))


def _reach(nearest: Column, total: Column, bandwidth: float) -> Column:
    """How far spots can count, given the nearest one's distance and how many there are."""
    return F.sqrt(nearest * nearest + 2 * bandwidth ** 2 * (DIGITS + F.log(F.greatest(total, F.lit(1.0)))))


def _hits(spots: DataFrame, by, axes, kernel: Kernel) -> DataFrame:
    """A row per spot and node that it counts at."""
    if kernel.mode != "geodesic":
        # The bounds of boxes hold on the sphere only; here every node in reach is taken.
        return (spots.withColumn("i", F.explode(axes[0].within(F.col("plat"), F.col("plat"))))
                .withColumn("j", F.explode(axes[1].within(F.col("plon"), F.col("plon")))))
    pairs = _node_cells(spots, by, axes)
    limits = _limits(pairs, by)
    # At most one row per node and group, so the join's other side is what is long.
    reached = pairs.drop("n").join(limits, [*by, "i", "j"]).filter(
        F.col("near") <= _reach(F.col("nearest"), F.col("total"), kernel.bandwidth) * (1 + 1e-9))
    # A cell's nodes are at most the grid's.
    nodes = stored(reached.groupBy(*by, "ci", "cj").agg(F.collect_list(F.struct("i", "j")).alias("nodes")))
    # A list is as long as the grid at most, so what a broadcast holds follows from the lists' total length.
    listed = nodes.agg(F.sum(F.size("nodes"))).first()[0] or 0
    keys = [*by, "ci", "cj"]
    placed = _in_cells(spots, axes)
    joined = (placed.join(F.broadcast(nodes), keys) if listed <= MAX_LISTED
              else salted_join(placed, nodes, keys, ["plat", "plon"]))
    return joined.withColumn("node", F.explode("nodes")).select(
        *by, "plat", "plon", "n", "node.i", "node.j")


def kernel_grid(points: DataFrame, box=None, size: int = 50, kernel: Kernel = Kernel(),
                by=()) -> DataFrame:
    """(i, j, lat, lon, kernel sum) for every grid node, per `by` group."""
    box, by = box or geo.city_box(rules.DEFAULT_CITY), list(by)
    axes = _axes(box, size, kernel)
    spots = spot_weights(points, by)
    hits = _hits(spots, by, axes, kernel).withColumns(
        {"lat": axes[0].value(F.col("i")), "lon": axes[1].value(F.col("j"))})
    value = kernel.value(kernel.distance(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")))
    sums = hits.groupBy("i", "j", *by).agg(F.sum(F.col("n") * value).alias("kernel"))
    full = grid_nodes(points.sparkSession, box, size)
    if by:
        # Every group gets every node: the node list is unrolled onto the group's row.
        groups = spots.select(*by).distinct()
        i, j = F.col("i"), F.col("j")
        full = (groups.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
                .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
                .withColumns({"i": i.cast("long"), "j": j.cast("long")})
                .withColumns({"lat": axes[0].value(i), "lon": axes[1].value(j)}))
    return full.join(sums, ["i", "j", *by], "left").withColumn(
        "kernel", F.coalesce("kernel", F.lit(0.0)))


def grid_nodes(spark, box=None, size: int = 50) -> DataFrame:
    """All nodes (i, j, lat, lon), ends of the box included."""
    lat_min, lat_max, lon_min, lon_max = box or geo.city_box(rules.DEFAULT_CITY)
    i, j = F.floor(F.col("id") / size), F.col("id") % size
    return spark.range(size * size).select(
        i.alias("i"), j.alias("j"), geo.linspace(lat_min, lat_max, size, i).alias("lat"),
        geo.linspace(lon_min, lon_max, size, j).alias("lon"))


def density_grid(points: DataFrame, box=None, size: int = 50, kernel: Kernel = Kernel(),
                 area_km2: float = rules.CITY_AREA_KM2, by=()) -> DataFrame:
    """Incidents per km² at every node, with its class; `by` gives one grid per group.

    The kernel sums are scaled so that the grid adds up to the number of incidents.
    """
    by = list(by)
    # Read by totals, classes and result: the kernel is summed once.
    sums = stored(kernel_grid(points, box, size, kernel, by))
    known = points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    cells = size * size
    # One row per group on this side.
    totals = sums.groupBy(*by).agg(F.sum("kernel").alias("_sum"))
    counts = known.groupBy(*by).agg(F.count("*").alias("_n"))
    if by:
        sums = sums.join(totals.join(counts, by), by)
        norm, count = F.col("_sum"), F.col("_n")
    else:
        norm, count = totals.scalar(), counts.scalar()
    density = sums.withColumn(
        "density", F.when(norm > 0, F.col("kernel") * (count / norm) * F.lit(cells / area_km2))
        .otherwise(0.0)).drop("_sum", "_n")
    return classify(density, by)


def thresholds(grid: DataFrame, by=()) -> DataFrame:
    """33rd and 67th percentile of the grid; a grid has a fixed number of nodes."""
    return grid.groupBy(*by).agg(
        F.percentile("density", F.lit(0.33)).alias("low_max"),
        F.percentile("density", F.lit(0.67)).alias("medium_max"))


def class_of(density: Column, low: Column, medium: Column) -> Column:
    return F.when(density <= low, "Low").when(density <= medium, "Medium").otherwise("High")


def classify(grid: DataFrame, by=()) -> DataFrame:
    limits = thresholds(grid, by)
    if by:
        joined = grid.join(limits, list(by))
        return joined.withColumn(
            "classification", class_of(F.col("density"), F.col("low_max"), F.col("medium_max"))
        ).drop("low_max", "medium_max")
    return grid.withColumn("classification", class_of(
        F.col("density"), limits.select("low_max").scalar(),
        limits.select("medium_max").scalar()))


def density_at(locations: DataFrame, points: DataFrame, grid: DataFrame,
               kernel: Kernel = Kernel(), key: str = "loc_id",
               area_km2: float = rules.CITY_AREA_KM2) -> DataFrame:
    """Density, class and percentile in the grid of each location, on the grid's own scale."""
    if kernel.mode != "geodesic":
        raise ValueError("locations are only evaluated with the geodesic kernel")
    box = geo.city_box(rules.DEFAULT_CITY)
    axes = _axes(box, 50, kernel)
    spots = stored(spot_weights(points))
    places = locations.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct().filter(
        F.col("_lat").isNotNull() & F.col("_lon").isNotNull())
    # Through its nearest node a location is not farther from a spot than this.
    node = [F.greatest(F.lit(0), F.least(a.cell(F.col(c)), F.lit(a.size - 1))).cast("long")
            for a, c in zip(axes, ("_lat", "_lon"), strict=True)]
    limits = _limits(_node_cells(spots, [], axes), [])
    there = places.withColumns({"i": node[0], "j": node[1]}).join(F.broadcast(limits), ["i", "j"])
    detour = geo.haversine_km(F.col("_lat"), F.col("_lon"), axes[0].value(F.col("i")), axes[1].value(F.col("j")))
    total = spots.agg(F.sum("n")).scalar()
    there = there.withColumn("_km", F.least(F.lit(UNDERFLOW * kernel.bandwidth), _reach(
        F.col("nearest") + detour, total, kernel.bandwidth))).select(
        "_lat", "_lon", "_km", level_of(F.col("_km"), kernel.bandwidth).alias("_level"))
    cells = geo.CellGrid(4 * kernel.bandwidth)
    search = stored(with_search_cells(there, cells, F.col("_km"), "_lat", "_lon"))
    # Crowded cells are read as a fixed number of points, cut the finer the farther a location reaches.
    levels = sorted(r[0] for r in search.select("_level").distinct().collect())
    sources = [condensed(spots, kernel.bandwidth, level).withColumn("_level", F.lit(level)) for level in levels]
    if not sources:
        sources = [spots.withColumn("_level", F.lit(0))]
    near = with_cell(reduce(DataFrame.unionByName, sources), cells, "plat", "plon")
    keys = [*CELL, "_level"]
    pairs = near.join(F.broadcast(search), keys) if is_small(search, 200_000) else salted_join(
        near, search, keys, ["plat", "plon"])
    distance = geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("plat"), F.col("plon"))
    sums = pairs.withColumn("distance", distance).filter(F.col("distance") <= F.col("_km")).groupBy(
        "_lat", "_lon").agg(F.sum(F.col("n") * kernel.value(F.col("distance"))).alias("_kernel"))
    scale = grid.agg((F.sum("density") / F.sum("kernel")).alias("s")).scalar()
    values = grid.agg(F.sort_array(F.collect_list("density"))).scalar()
    limits = thresholds(grid)
    found = (locations.withColumns({"_lat": F.col("lat"), "_lon": F.col("lon")})
             .join(sums, ["_lat", "_lon"], "left").drop("_lat", "_lon")
             .withColumn("density", F.coalesce(F.greatest(F.col("_kernel"), F.lit(0.0)) * scale, F.lit(0.0)))
             .withColumn("_values", values))
    return found.withColumns({
        "classification": class_of(F.col("density"), limits.select("low_max").scalar(),
                                   limits.select("medium_max").scalar()),
        "density_percentile": stats.percentile_rank(F.col("density"), F.col("_values")),
    }).drop("_kernel", "_values")


def class_balance(grid: DataFrame) -> DataFrame:
    """Node count and share of each class, and whether the classes are balanced."""
    counts = grid.groupBy("classification").agg(F.count("*").alias("count"))
    spread = counts.agg(F.max("count") / F.min("count")).scalar()
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumns({
        "percent": F.col("count") * 100.0 / total, "balanced": spread < 3})
