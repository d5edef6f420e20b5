"""Density clustering (DBSCAN semantics) of weighted points, and profiles of the clusters.

Equal coordinates are one weighted spot. Spots are put into cells small enough that any two spots of
a cell are neighbours, so a cell of enough weight has core spots only and needs no distances. Only
spots of light cells (fewer than `min_points` each) look around, and cells that lie wholly inside
their circle are added as one number. Clusters are the components of the graph of core cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, rules
from ..session import stored
from . import stats
from .components import connected_components
from .ranking import global_rank
from .skew import salted_join

MAX_DIRECT_PAIRS = 200_000_000
TIGHT = 1 - 1e-6
BOX = ["x0", "x1", "y0", "y1"]


@dataclass(frozen=True)
class Plane:
    """Cells and distances of one kind of coordinates. `x` is longitude, `y` latitude on a sphere."""

    eps: float
    side_x: float
    side_y: float
    reach_x: int
    reach_y: int
    earth_km: float | None = None

    @staticmethod
    def flat(eps: float) -> Plane:
        side = eps / math.sqrt(2) * TIGHT
        return Plane(eps, side, side, 2, 2)

    @staticmethod
    def sphere(eps_km: float, lat_low: float, lat_high: float,
               earth_km: float = rules.HOTSPOT_EARTH_KM) -> Plane:
        """Column width by the latitude nearest the equator, reach by the one farthest from it."""
        angle = math.degrees(eps_km / earth_km)
        calm = 0.0 if lat_low <= 0 <= lat_high else min(abs(lat_low), abs(lat_high))
        far = min(max(abs(lat_low), abs(lat_high)) + angle, 89.9)
        side_y = angle / math.sqrt(2) * TIGHT
        side_x = side_y / math.cos(math.radians(calm))
        reach = angle * 1.001 / math.cos(math.radians(far)) / side_x
        return Plane(eps_km, side_x, side_y, math.ceil(reach), 2, earth_km)

    def cell(self, group: Column, x: Column, y: Column) -> Column:
        return F.struct(group.alias("g"), geo.floor_long(x / F.lit(self.side_x)).alias("i"),
                        geo.floor_long(y / F.lit(self.side_y)).alias("j"))

    def offsets(self, forward_only: bool = False) -> Column:
        steps = [(i, j) for i in range(-self.reach_x, self.reach_x + 1)
                 for j in range(-self.reach_y, self.reach_y + 1)
                 if not forward_only or (i, j) > (0, 0)]
        return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])

    def distance(self, x1, y1, x2, y2) -> Column:
        if self.earth_km is None:
            return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
        return geo.haversine_km(y1, x1, y2, x2, self.earth_km)

    def bounds(self, box1, box2):
        """Least and greatest possible distance between points of two boxes (x0, x1, y0, y1)."""
        a0, a1, c0, c1 = box1
        b0, b1, d0, d1 = box2
        zero = F.lit(0.0)
        gap_x, gap_y = F.greatest(b0 - a1, a0 - b1, zero), F.greatest(d0 - c1, c0 - d1, zero)
        span_x = F.greatest(F.abs(b1 - a0), F.abs(a1 - b0))
        span_y = F.greatest(F.abs(d1 - c0), F.abs(c1 - d0))
        if self.earth_km is None:
            return F.sqrt(gap_x * gap_x + gap_y * gap_y), F.sqrt(span_x * span_x + span_y * span_y)
        high = F.greatest(*[F.abs(c) for c in (c0, c1, d0, d1)])
        low = F.when((F.least(c0, d0) <= 0) & (F.greatest(c1, d1) >= 0), zero).otherwise(
            F.least(*[F.abs(c) for c in (c0, c1, d0, d1)]))
        far_cos, near_cos = F.cos(F.radians(high)), F.cos(F.radians(low))
        return (geo._arc_km(gap_y, gap_x, far_cos * far_cos, self.earth_km),
                geo._arc_km(span_y, span_x, near_cos * near_cos, self.earth_km))


def sphere_for(points: DataFrame, eps_km: float, y: str = "latitude") -> Plane:
    low, high = points.agg(F.min(y), F.max(y)).first()
    return Plane.sphere(eps_km, low or 0.0, high or 0.0)


def density_clusters(points: DataFrame, plane: Plane, min_points: float, x: str = "longitude",
                     y: str = "latitude", order: str = "incident_id", group=None, weight=None,
                     max_direct_pairs: int = MAX_DIRECT_PAIRS) -> DataFrame:
    """One row per (group, x, y): weight, `core` flag and `cluster` (-1 is noise).

    Clusters are numbered by group and then by their smallest core id (`order`; ids of digits count
    as numbers). A border spot belongs to the lowest-numbered cluster it touches.
    """
    group_col = F.col(group) if group else F.lit(0)
    first = F.struct(F.length(order).alias("len"), F.col(order).alias("id"))
    spots = stored(
        points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(group_col.alias("g"), F.col(x).alias("x"), F.col(y).alias("y"))
        .agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("w"),
             F.min(first).alias("first"))
        .withColumn("cell", plane.cell(F.col("g"), F.col("x"), F.col("y"))))
    n_spots = spots.count()
    cells = stored(_cells(spots))
    heavy = cells.select("cell", (F.col("w") >= min_points).alias("heavy"))
    light = spots.join(heavy.filter("NOT heavy").select("cell"), "cell", "left_semi")
    around = _weight_around(light, spots, cells, plane, n_spots)
    core_light = around.filter(F.col("total") >= min_points).select("g", "x", "y")
    core = stored(
        spots.join(heavy.filter("heavy").select("cell"), "cell", "left_semi")
        .unionByName(light.join(core_light, ["g", "x", "y"], "left_semi")))

    core_cells = stored(_cells(core))
    edges = _core_edges(core, core_cells, plane, max_direct_pairs)
    roots = connected_components(core_cells.select(F.col("cell").alias("node")), edges)
    roots = roots.select(F.col("node").alias("cell"), "root")
    starts = (core_cells.join(roots, "cell").groupBy("root")
              .agg(F.min("first").alias("first")).withColumn("g", F.col("root.g")))
    ranked = global_rank(starts, ["g", "first"], "cluster").select("root", "cluster")
    labels = stored(roots.join(ranked, "root").select("cell", "cluster"))

    inner = core.join(labels, "cell").select("g", "x", "y", "w", "first", "cluster")
    rest = light.join(core_light, ["g", "x", "y"], "left_anti")
    touched = _touching(rest, core, core_cells.join(labels, "cell"), plane, n_spots)
    outer = (rest.join(touched, ["g", "x", "y"], "left")
             .select("g", "x", "y", "w", "first",
                     F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster")))
    return (inner.withColumn("core", F.lit(True))
            .unionByName(outer.withColumn("core", F.lit(False))))


def core_spots(points: DataFrame, plane: Plane, min_points: float, x: str = "longitude",
               y: str = "latitude") -> DataFrame:
    """Neighbour weight (itself included) of every spot, and whether that makes it a core spot."""
    spots = stored(points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
                   .groupBy(F.lit(0).alias("g"), F.col(x).alias("x"), F.col(y).alias("y"))
                   .agg(F.count("*").alias("w"))
                   .withColumn("cell", plane.cell(F.col("g"), F.col("x"), F.col("y"))))
    around = _weight_around(spots, spots, _cells(spots, first=False), plane, spots.count())
    return around.select(F.col("x").alias(x), F.col("y").alias(y), F.col("total"),
                         (F.col("total") >= min_points).alias("core"))


def _cells(spots: DataFrame, first: bool = True) -> DataFrame:
    extra = [F.min("first").alias("first")] if first else []
    return spots.groupBy("cell").agg(
        F.sum("w").alias("w"), F.count("*").alias("n"), F.min("x").alias("x0"),
        F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), *extra)


def _near_cells(spots: DataFrame, cells: DataFrame, plane: Plane) -> DataFrame:
    """(spot, cell) pairs within reach, with whether the whole cell is within `eps`."""
    shift = F.struct(F.col("cell.g").alias("g"), (F.col("cell.i") + F.col("o.i")).alias("i"),
                     (F.col("cell.j") + F.col("o.j")).alias("j"))
    around = (spots.select("g", "x", "y", "cell", F.explode(plane.offsets()).alias("o"))
              .select("g", "x", "y", shift.alias("cell")))
    here = [F.col("x"), F.col("x"), F.col("y"), F.col("y")]
    near, far = plane.bounds(here, [F.col(c) for c in BOX])
    return (around.join(cells, "cell")
            .withColumn("near", near).withColumn("far", far)
            .filter(F.col("near") <= plane.eps * (1 + 1e-9))
            .withColumn("whole", F.col("far") <= plane.eps * (1 - 1e-9)))


def _weight_around(some: DataFrame, spots: DataFrame, cells: DataFrame, plane: Plane,
                   n_spots: int) -> DataFrame:
    pairs = _near_cells(some, cells.select("cell", "w", *BOX), plane)
    whole = pairs.filter("whole").select("g", "x", "y", "w")
    there = spots.select("cell", F.col("x").alias("px"), F.col("y").alias("py"), "w")
    rim = pairs.filter("NOT whole").select("g", "x", "y", "cell")
    close = plane.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")) <= plane.eps
    rim = salted_join(there, rim, ["cell"], ["px", "py"], n_spots).filter(close).select("g", "x", "y", "w")
    return whole.unionByName(rim).groupBy("g", "x", "y").agg(F.sum("w").alias("total"))


def _touching(some: DataFrame, core: DataFrame, labelled_cells: DataFrame,
              plane: Plane, n_spots: int) -> DataFrame:
    """Lowest cluster with a core spot within `eps`."""
    pairs = _near_cells(some, labelled_cells.select("cell", "cluster", *BOX), plane)
    whole = pairs.filter("whole").select("g", "x", "y", "cluster")
    there = core.select("cell", F.col("x").alias("px"), F.col("y").alias("py"))
    rim = pairs.filter("NOT whole").select("g", "x", "y", "cell", "cluster")
    close = plane.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")) <= plane.eps
    rim = salted_join(there, rim, ["cell"], ["px", "py"], n_spots).filter(close).select(
        "g", "x", "y", "cluster")
    return whole.unionByName(rim).groupBy("g", "x", "y").agg(F.min("cluster").alias("cluster"))


def _core_edges(core: DataFrame, core_cells: DataFrame, plane: Plane,
                max_direct_pairs: int) -> DataFrame:
    """Pairs of core cells that hold two core spots within `eps` of each other.

    Most pairs are settled by their boxes alone. The others are compared spot by spot when that is
    little work (checked); otherwise both cells are quartered and the quarters compared the same
    way, so crowded cells never meet in full.
    """
    boxes = core_cells.select("cell", "n", *BOX)
    shift = F.struct(F.col("a.g").alias("g"), (F.col("a.i") + F.col("o.i")).alias("i"),
                     (F.col("a.j") + F.col("o.j")).alias("j"))
    left = boxes.select(*[F.col(c).alias(f"a_{c}") for c in ["n", *BOX]], F.col("cell").alias("a"))
    right = boxes.select(*[F.col(c).alias(f"b_{c}") for c in ["n", *BOX]], F.col("cell").alias("b"))
    pairs = (left.withColumn("o", F.explode(plane.offsets(True))).withColumn("b", shift)
             .drop("o").join(right, "b"))
    pairs = pairs.withColumns({c: F.lit(0).cast("long") for c in ("a_u", "a_v", "b_u", "b_v")})
    edges, level = None, 0
    while True:
        near, far = plane.bounds([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX])
        judged = stored(
            pairs.withColumn("near", near).withColumn("far", far)
            .filter(F.col("near") <= plane.eps * (1 + 1e-9))
            .withColumn("sure", F.col("far") <= plane.eps * (1 - 1e-9))
            .select("a", "b", "a_u", "a_v", "b_u", "b_v", "a_n", "b_n", "sure"))
        sure = judged.filter("sure").select("a", "b").distinct()
        edges = sure if edges is None else edges.unionByName(sure)
        unsure = judged.filter("NOT sure").join(sure, ["a", "b"], "left_anti")
        work = unsure.agg(F.sum(F.col("a_n") * F.col("b_n"))).first()[0]
        if not work:
            return edges
        if work <= max_direct_pairs or level >= 24:
            return edges.unionByName(_direct_edges(unsure, core, plane, level))
        level += 1
        parts = (_parts(core, plane, level).groupBy("cell", "u", "v").agg(
            F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
            F.min("y").alias("y0"), F.max("y").alias("y1")))
        unsure = unsure.select("a", "b", "a_u", "a_v", "b_u", "b_v")
        for s in ("a", "b"):
            mine = parts.select(
                F.col("cell").alias(s), F.shiftright("u", 1).alias(f"{s}_u"),
                F.shiftright("v", 1).alias(f"{s}_v"), F.col("u").alias(f"{s}_uu"),
                F.col("v").alias(f"{s}_vv"), *[F.col(c).alias(f"{s}_{c}") for c in ["n", *BOX]])
            unsure = (unsure.join(mine, [s, f"{s}_u", f"{s}_v"]).drop(f"{s}_u", f"{s}_v")
                      .withColumnsRenamed({f"{s}_uu": f"{s}_u", f"{s}_vv": f"{s}_v"}))
        pairs = unsure


def _parts(core: DataFrame, plane: Plane, level: int) -> DataFrame:
    """Core spots with the index of their part of the cell: 2^level parts on each axis."""
    def index(c, side, corner):
        inside = c / F.lit(side) - corner
        return F.least(geo.floor_long(inside * 2 ** level), F.lit(2 ** level - 1).cast("long"))

    return core.select(
        "cell", "x", "y", index(F.col("x"), plane.side_x, F.col("cell.i")).alias("u"),
        index(F.col("y"), plane.side_y, F.col("cell.j")).alias("v"))


def _direct_edges(unsure: DataFrame, core: DataFrame, plane: Plane, level: int) -> DataFrame:
    spots = _parts(core, plane, level)
    pairs = unsure.select("a", "b", "a_u", "a_v", "b_u", "b_v")
    for s in ("a", "b"):
        mine = spots.select(
            F.col("cell").alias(s), F.col("u").alias(f"{s}_u"), F.col("v").alias(f"{s}_v"),
            F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"))
        pairs = pairs.join(mine, [s, f"{s}_u", f"{s}_v"])
    close = plane.distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")) <= plane.eps
    return pairs.filter(close).select("a", "b")


# --- hotspots of the incident table ---------------------------------------------------------

def label_incidents(incidents: DataFrame, eps_km: float = 0.5, min_points: int = 10) -> DataFrame:
    """Incidents with `cluster` and `core`, by great-circle distance over the whole table."""
    spots = density_clusters(incidents, sphere_for(incidents, eps_km), min_points)
    labels = spots.select(F.col("x").alias("longitude"), F.col("y").alias("latitude"), "cluster",
                          "core")
    return salted_join(incidents, labels, ["latitude", "longitude"])


def label_by_quadrant(incidents: DataFrame, box=None, eps: float = 0.01, min_points: int = 5,
                      min_rows: int = 50, weight=None) -> DataFrame:
    """Incidents with `quadrant`, `cluster` and `core`; coordinates standardised per quadrant.

    Quadrants with fewer than `min_rows` incidents are left out.
    """
    box = box or geo.city_box(rules.DEFAULT_CITY)
    quadrant = geo.quadrant(F.col("latitude"), F.col("longitude"), box)
    spots = (incidents.withColumn("quadrant", quadrant)
             .groupBy("quadrant", "latitude", "longitude")
             .agg(F.count("*").alias("n"),
                  F.sum(F.col(weight) if weight else F.lit(1)).alias("w"),
                  F.min(F.struct(F.length("incident_id"), F.col("incident_id"))).alias("first")))
    moments = (incidents.withColumn("quadrant", quadrant).groupBy("quadrant").agg(
        F.count("*").alias("rows"), F.avg("latitude").alias("mean_lat"),
        F.avg("longitude").alias("mean_lon"), F.stddev_pop("latitude").alias("std_lat"),
        F.stddev_pop("longitude").alias("std_lon")).filter(F.col("rows") >= min_rows))

    def scaled(c, mean, std):
        return (F.col(c) - F.col(mean)) / F.when(F.col(std) > 0, F.col(std)).otherwise(1.0)

    # Four rows at most.
    flat = stored(spots.join(F.broadcast(moments), "quadrant").select(
        "quadrant", "latitude", "longitude", "w", F.col("first.incident_id").alias("incident_id"),
        scaled("longitude", "mean_lon", "std_lon").alias("sx"),
        scaled("latitude", "mean_lat", "std_lat").alias("sy")))
    found = density_clusters(flat, Plane.flat(eps), min_points, "sx", "sy", group="quadrant",
                             weight="w")
    labels = flat.join(
        found.select(F.col("g").alias("quadrant"), F.col("x").alias("sx"),
                     F.col("y").alias("sy"), "cluster", "core"),
        ["quadrant", "sx", "sy"]).select("quadrant", "latitude", "longitude", "cluster", "core")
    return salted_join(incidents, labels, ["latitude", "longitude"])


def cluster_profiles(labelled: DataFrame, keys=("cluster",), k: int = 5) -> DataFrame:
    """Centre, count, commonest offense and the five commonest offenses of each cluster."""
    inside = labelled.filter(F.col("cluster") != -1)
    centres = inside.groupBy(*keys).agg(
        F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"),
        F.count("*").alias("crime_count"))
    common = stats.top_list(inside, keys, "crime_type", k, "common_crimes")
    return centres.join(common, list(keys), "left").withColumn(
        "dominant_crime", F.coalesce(F.get("common_crimes", 0)["value"], F.lit("Unknown")))


def hotspot_profiles(labelled: DataFrame) -> DataFrame:
    """Mean position, count, modal offense and modal law category of each hotspot."""
    inside = labelled.filter(F.col("cluster") != -1)
    centres = inside.groupBy("cluster").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
        F.count("*").alias("crime_count"))
    common = stats.modes(inside, ["cluster"], {
        "ofns_desc": "ofns_desc", "law_cat_cd": "law_cat_cd"}).drop("count")
    return centres.join(common, "cluster", "left")
