"""The build: cleaned incidents to zones, hotspots, demographic zones and density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import density, evaluate, hotspots, zones
from ..session import stored
from .safety_card import Models


def build_models(incidents: DataFrame, n_init: int = 10, seed: int = 42) -> Models:
    """Fit all models and write the tables that describe them."""
    zone_model = zones.fit_crime_zones(incidents, n_init=n_init, seed=seed)
    zoned = zones.fitted(zone_model, incidents)
    labelled = stored(hotspots.label_by_quadrant(incidents))
    demographic = zones.fit_demographic_zones(incidents, n_init=n_init, seed=seed)
    profiles = None
    if demographic is not None:
        known = zones.with_demographics(incidents)
        profiles = stored(zones.demographic_zone_table(zones.assign(demographic, known)))
    points = labelled.groupBy("latitude", "longitude").agg(F.min("cluster").alias("cluster"))
    return Models(
        zone_model=zone_model, zone_table=stored(zones.zone_table(zoned)),
        hotspot_points=stored(points),
        hotspot_profiles=stored(hotspots.cluster_profiles(labelled, ("cluster", "quadrant"))),
        demographic_model=demographic, demographic_zones=profiles,
        density=stored(density.density_grid(incidents)))


def evaluation(incidents: DataFrame) -> DataFrame:
    """Ratings of the hotspot and demographic models, with the overall verdict."""
    labelled = stored(hotspots.label_by_quadrant(incidents))
    quality = evaluate.cluster_quality(labelled)
    known = zones.with_demographics(incidents)
    model = zones.fit_demographic_zones(incidents)
    known = (known.limit(0).withColumn("zone", F.lit(None).cast("int")) if model is None
             else zones.assign(model, known))
    share = evaluate.concentration_summary(zones.demographic_profiles(known))
    return evaluate.graded(quality, share)
