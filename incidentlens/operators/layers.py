"""Tables behind the map layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import sample_rows
from .zones import demographic_zone_table


def heat_points(incidents: DataFrame, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Position and severity of all incidents, or of a seeded sample of `limit`."""
    rows = incidents if limit is None else sample_rows(incidents, limit, "incident_id", seed)
    return rows.select("incident_id", "latitude", "longitude",
                       F.col("severity_weight").alias("weight"))


def heat_cells(incidents: DataFrame, digits: int = 3) -> DataFrame:
    """Heat map of every incident: summed severity per cell of rounded coordinates."""
    scale = F.lit(float(10 ** digits))
    cell = lambda c: (F.floor(F.col(c) * scale + 0.5) / scale).alias(c)
    return incidents.groupBy(cell("latitude"), cell("longitude")).agg(
        F.sum("severity_weight").alias("weight"), F.count("*").alias("count"))


def hotspot_layer(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        F.col("cluster").alias("id"), F.col("center_lat").alias("lat"),
        F.col("center_lon").alias("lon"), "crime_count")


def demographic_layer(zoned: DataFrame, zone: str = "zone") -> DataFrame:
    """Zones with the commonest value of their first attribute."""
    return demographic_zone_table(zoned, zone).select(
        F.col(zone).cast("long").alias("id"), F.col("center_lat").alias("lat"),
        F.col("center_lon").alias("lon"),
        F.get("profiles", 0)["dominant_value"].alias("dominant_demo"))


def density_layer(grid: DataFrame) -> DataFrame:
    return grid.select("lat", "lon", "density", "classification")


def map_layers(hotspots: DataFrame, zones: DataFrame, density: DataFrame) -> DataFrame:
    """All layers as one table; columns a layer lacks are null."""
    parts = [("dbscan_clusters", hotspots), ("demographic_zones", zones),
             ("density_zones", density)]
    out = None
    for name, part in parts:
        part = part.withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
