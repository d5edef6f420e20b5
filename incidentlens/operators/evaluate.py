"""Quality of clusters, zones and scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .silhouette import silhouette
from .skew import is_small

MAX_LISTED = 2_000


def centroids(df: DataFrame, label: str, x: str = "longitude", y: str = "latitude") -> DataFrame:
    return df.groupBy(label).agg(
        F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
        (F.var_pop(x) + F.var_pop(y)).alias("spread"))


def calinski_harabasz(centres: DataFrame) -> DataFrame:
    """Between- over within-cluster dispersion, from the centroid table alone."""
    n = F.sum("n")
    means = centres.agg((F.sum(F.col("n") * F.col("cx")) / n).alias("x"),
                        (F.sum(F.col("n") * F.col("cy")) / n).alias("y"))
    dx = F.col("cx") - means.select("x").scalar()
    dy = F.col("cy") - means.select("y").scalar()
    parts = centres.agg(
        F.sum(F.col("n") * (dx * dx + dy * dy)).alias("between"),
        F.sum(F.col("n") * F.col("spread")).alias("within"),
        F.sum("n").alias("n"), F.count("*").alias("k"))
    value = (F.col("between") * (F.col("n") - F.col("k"))) / (
        F.col("within") * (F.col("k") - 1))
    return parts.select(F.when((F.col("k") > 1) & (F.col("within") > 0), value)
                        .alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, label: str, x: str = "longitude", y: str = "latitude",
                   max_listed: int = MAX_LISTED) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / distance.

    The centroids travel as one array while they are few (checked). Otherwise each cluster looks at
    centroids in widening circles, and is done when no cluster outside could be worse.
    """
    centres = centroids(df, label, x, y).select(label, "cx", "cy")
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    scatter = stored(df.select(label, x, y).join(centres, label).groupBy(label).agg(
        F.avg(F.sqrt(dx * dx + dy * dy)).alias("s"), F.first("cx").alias("cx"),
        F.first("cy").alias("cy")))
    if is_small(scatter, max_listed):
        listed = scatter.agg(F.collect_list(F.struct(label, "s", "cx", "cy"))).scalar()

        def ratio(c):
            ex, ey = c["cx"] - F.col("cx"), c["cy"] - F.col("cy")
            distance = F.sqrt(ex * ex + ey * ey)
            return F.when((c[label] != F.col(label)) & (distance > 0),
                          (c["s"] + F.col("s")) / distance)

        worst = scatter.withColumn("_all", listed).select(
            F.array_max(F.transform("_all", ratio)).alias("worst"))
    else:
        worst = _worst_by_rings(scatter, label)
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def _worst_by_rings(scatter: DataFrame, label: str) -> DataFrame:
    n, s_max, x0, x1, y0, y1 = scatter.agg(
        F.count("*"), F.max("s"), F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    extent = max(x1 - x0, y1 - y0)
    radius = max(extent / max(math.sqrt(n), 1.0), extent * 1e-6)
    todo, done = scatter, None
    while True:
        r = float(radius)
        key = lambda c: F.floor(c / F.lit(r)).cast("long")  # noqa: B023, E731
        there = scatter.select(
            F.col(label).alias("_l"), F.col("s").alias("_s"), F.col("cx").alias("_x"),
            F.col("cy").alias("_y"), key(F.col("cx")).alias("_i"), key(F.col("cy")).alias("_j"))
        around = F.sequence(F.lit(-1), F.lit(1))
        here = (todo.withColumn("_di", F.explode(around)).withColumn("_dj", F.explode(around))
                .withColumns({"_i": key(F.col("cx")) + F.col("_di"),
                              "_j": key(F.col("cy")) + F.col("_dj")}))
        ex, ey = F.col("_x") - F.col("cx"), F.col("_y") - F.col("cy")
        gap = F.sqrt(ex * ex + ey * ey)
        found = (here.join(there, ["_i", "_j"]).filter(F.col("_l") != F.col(label))
                 .filter((gap > 0) & (gap <= r))
                 .groupBy(label).agg(F.max((F.col("s") + F.col("_s")) / gap).alias("worst")))
        judged = stored(todo.join(found, label, "left"))
        final = r > 2 * extent
        settled = F.lit(True) if final else F.coalesce(
            F.col("worst") >= (F.col("s") + F.lit(s_max)) / F.lit(r), F.lit(False))
        part = judged.filter(settled).select("worst")
        done = part if done is None else done.unionByName(part)
        if final:
            return done
        todo = stored(judged.filter(~settled).drop("worst"))
        if todo.isEmpty():
            return done
        radius *= 4


def cluster_quality(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """One row: cluster and noise counts and the separation measures, noise left out; the silhouette with plain
    distances, which the grades go by, and with squared ones."""
    inside = labelled.filter(F.col(label) != -1)
    centres = centroids(inside, label)
    return labelled.agg(
        F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("n_clusters"),
        F.count_if(F.col(label) == -1).alias("n_noise_points")).withColumns({
            "silhouette_score": silhouette(inside, label).scalar(),
            "silhouette_squared": silhouette(inside, label, squared=True).scalar(),
            "davies_bouldin_score": davies_bouldin(inside, label).scalar(),
            "calinski_harabasz_score": calinski_harabasz(centres).scalar()})


def concentration_summary(profiles: DataFrame, zone: str = "zone") -> DataFrame:
    """Mean over zones of the mean concentration of their attributes, with a grade."""
    per = profiles.groupBy(zone).agg(F.avg("concentration").alias("c"))
    mean = F.coalesce(F.avg("c"), F.lit(0.0))
    return per.agg(F.count("*").alias("n_zones"), mean.alias("avg_concentration")).withColumn(
        "pattern", F.when(F.col("avg_concentration") > 60, "STRONG")
        .when(F.col("avg_concentration") > 40, "MODERATE").otherwise("WEAK"))


def zone_coverage(assigned: DataFrame, zone: str = "zone", needed: int = 8) -> DataFrame:
    """Rows per predicted zone, and whether enough zones are reached."""
    counts = assigned.groupBy(zone).agg(F.count("*").alias("count"))
    reached = counts.agg(F.count("*")).scalar()
    return counts.withColumns({"n_zones_predicted": reached, "good_coverage": reached >= needed})


def score_spread(scores: DataFrame) -> DataFrame:
    """Mean, deviation and range of the zone scores; a deviation above 10 tells zones apart."""
    return scores.agg(
        F.avg("safety_score").alias("mean"), F.stddev_pop("safety_score").alias("std"),
        F.min("safety_score").alias("min"), F.max("safety_score").alias("max")).withColumns({
            "range": F.col("max") - F.col("min"), "good_variance": F.col("std") > 10})


def graded(quality: DataFrame, concentration: DataFrame) -> DataFrame:
    """Rating per model there is, and the overall score with its verdict on every row."""
    def rating(c, high, low):
        return F.when(c > high, "EXCELLENT").when(c > low, "GOOD").otherwise("FAIR")

    separation = F.col("silhouette_score")
    clusters = quality.filter(separation.isNotNull()).select(
        F.lit("DBSCAN Clustering").alias("model"), rating(separation, 0.5, 0.25).alias("rating"),
        separation.alias("score"))
    share = F.col("avg_concentration")
    zones = concentration.filter("n_zones > 0").select(
        F.lit("Demographic Zones").alias("model"), rating(share, 60, 40).alias("rating"),
        (share / 100).alias("score"))
    rows = stored(clusters.unionByName(zones))
    overall = rows.agg(F.avg("score")).scalar()
    return rows.withColumn("overall_score", overall).withColumn(
        "verdict", F.when(F.col("overall_score") > 0.6, "STRONG")
        .when(F.col("overall_score") > 0.4, "ACCEPTABLE").otherwise("NEEDS IMPROVEMENT"))
