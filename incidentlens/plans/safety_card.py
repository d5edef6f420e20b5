"""Safety cards: everything known about each location of a table, one row each."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..functions import text as T
from ..operators import density as D
from ..operators import distance_join as J
from ..operators import scoring, stats, zones
from ..operators.risk import category_sums
from ..operators.skew import is_small
from ..session import stored

BUCKETS = [name for name, _, _ in rules.TIME_BUCKETS]
#: Values up to which each has a figure of its own on a wide row.
MOST_VALUES = 200
LISTED = ["crime_type", *rules.DEMOGRAPHIC_COLUMNS]
NO_ZONE = ("struct<zone_id:int,profiles:array<struct<attribute:string,dominant_value:string,"
           "concentration:double,value_counts:map<string,bigint>>>,crime_count:bigint>")


@dataclass
class Models:
    """Outputs of the build: fitted models and the tables that describe them."""

    zone_model: PipelineModel
    zone_table: DataFrame
    hotspot_points: DataFrame
    hotspot_profiles: DataFrame
    demographic_model: PipelineModel | None
    demographic_zones: DataFrame | None
    density: DataFrame


def _time_sums(now: str | None) -> dict:
    """Figures by time bucket, of the last 30 days, and by category."""
    dated = F.col("occurred_at").isNotNull()
    sums = {name: (dated & F.col("hour_of_day").between(a, b)).cast("long")
            for name, a, b in rules.TIME_BUCKETS}
    recent = F.lit(0)
    if now:
        since = F.lit(now).cast("timestamp") - F.expr("INTERVAL 30 DAYS")
        recent = F.coalesce(F.col("occurred_at") >= since, F.lit(False)).cast("long")
    return {**sums, "total_recent": recent, **category_sums()}


def nearby_times(locations: DataFrame, incidents: DataFrame,
                 km: float = rules.INCIDENT_RADIUS_KM, now: str | None = None,
                 key: str = "loc_id") -> DataFrame:
    """Incidents around each location: all, by time bucket, of the last 30 days, and by category.

    These are fixed lists, so they are figures of one wide row. Undated incidents have no bucket.
    """
    return J.counts_within(locations, incidents, km, sums=_time_sums(now), key=key
                           ).withColumnRenamed("n", "nearby_crime_count")


def _listed_values(incidents: DataFrame, most: int) -> list | None:
    """The (attribute, value) pairs that occur, or None if they are more than `most`."""
    values = stored(stats.facets(incidents, LISTED, []).select("attribute", "value").distinct())
    if not is_small(values, most):
        return None
    return sorted((r["attribute"], r["value"]) for r in values.collect())


def _value_sums(values) -> dict:
    return {f"_v{i}": F.col(a).cast("string").eqNullSafe(F.lit(v)).cast("long") for i, (a, v) in enumerate(values)}


def _listed_figures(found: DataFrame, values, key: str) -> DataFrame:
    """Offenses with counts and commonest attributes, from a figure per value on one wide row."""
    def items(attribute):
        all_ = [F.struct((-F.col(f"_v{i}")).alias("o"), F.lit(v).alias("value"))
                for i, (a, v) in enumerate(values) if a == attribute]
        none = F.array().cast("array<struct<o:bigint,value:string>>")
        return F.filter(F.array(*all_), lambda x: x["o"] < 0) if all_ else none

    some = [F.col(f"_v{i}") > 0 for i in range(len(values))]
    rows = found.filter(reduce(Column.__or__, some, F.lit(False))).select(
        key, items("crime_type").alias("_types"),
        *[F.array_min(items(c)).alias(c) for c in rules.DEMOGRAPHIC_COLUMNS])
    # Offense names are a code list, so the array is short.
    offenses = F.transform(F.sort_array(F.flatten(F.collect_list("_types"))),
                           lambda x: F.struct(x["value"].alias("value"), (-x["o"]).alias("count")))
    return rows.groupBy(key).agg(offenses.alias("crime_types"), *[
        F.min(c)["value"].alias(c) for c in rules.DEMOGRAPHIC_COLUMNS])


def nearby_values(locations: DataFrame, incidents: DataFrame,
                  km: float = rules.INCIDENT_RADIUS_KM, key: str = "loc_id", most: int = MOST_VALUES) -> DataFrame:
    """Offenses around each location with counts, and the commonest victim attributes.

    The values that occur are counted first. Up to `most` of them are figures of one wide row, so what is
    joined does not grow with the number of values; else incidents become (attribute, value) rows that are
    counted per coordinate before they meet a location. One radius join serves all attributes.
    """
    values = _listed_values(incidents, most)
    if values is not None:
        return _listed_figures(J.counts_within(locations, incidents, km, sums=_value_sums(values), key=key), values, key)
    long = stats.facets(incidents, LISTED, ["latitude", "longitude"])
    found = J.counts_within(locations, long, km, ["attribute", "value"], key=key)
    is_ = lambda a: F.col("attribute") == a
    item = F.struct((-F.col("n")).alias("o"), F.col("value").alias("value"))
    # Offense names are a code list, so the array is short.
    offenses = F.transform(
        F.sort_array(F.collect_list(F.when(is_("crime_type"), item))),
        lambda x: F.struct(x["value"].alias("value"), (-x["o"]).alias("count")))
    modal = [F.min_by(F.when(is_(c), F.col("value")), F.when(is_(c), item)).alias(c)
             for c in rules.DEMOGRAPHIC_COLUMNS]
    return found.groupBy(key).agg(offenses.alias("crime_types"), *modal)


def listed_categories() -> Column:
    """Category figures of a row as an array of (value, count), largest first, zeros left out."""
    items = F.array_sort(F.array(*[
        F.struct((-F.col(c)).alias("o"), F.lit(c).alias("value")) for c in rules.CATEGORIES]))
    return F.transform(F.filter(items, lambda x: x["o"] < 0),
                       lambda x: F.struct(x["value"].alias("value"), (-x["o"]).alias("count")))


def nearby_summary(locations: DataFrame, incidents: DataFrame,
                   km: float = rules.INCIDENT_RADIUS_KM, now: str | None = None,
                   key: str = "loc_id") -> DataFrame:
    """Every location with the summary of the incidents around it; zeros where there are none.

    While the values are few (checked), one pass counts times, categories and values.
    """
    listed = _listed_values(incidents, MOST_VALUES)
    if listed is None:
        times = nearby_times(locations, incidents, km, now, key)
        values = nearby_values(locations, incidents, km, key, 0)
    else:
        sums = _time_sums(now)
        found = stored(J.counts_within(locations, incidents, km, sums={**sums, **_value_sums(listed)}, key=key))
        times = found.select(key, F.col("n").alias("nearby_crime_count"), *sums)
        values = _listed_figures(found, listed, key)
    counts = ["nearby_crime_count", "total_recent", *BUCKETS, *rules.CATEGORIES]
    empty = F.array().cast("array<struct<value:string,count:bigint>>")
    return (locations.join(times, key, "left").join(values, key, "left").na.fill(0, counts)
            .withColumns({"crime_types": F.coalesce("crime_types", empty),
                          "crime_categories": listed_categories()}).drop(*rules.CATEGORIES))


def scored(summary: DataFrame, base: str = "base_score",
           group: str = "demographic_group") -> DataFrame:
    """Add the group-adjusted score from the category counts already on the row."""
    who = scoring.known_group(F.col(group))
    extra = F.aggregate(
        "crime_categories", F.lit(0).cast("long"),
        lambda a, c: a + c["count"] * (scoring.weight_tenths(who, c["value"]) - 10))
    total = F.aggregate("crime_categories", F.lit(0).cast("long"), lambda a, c: a + c["count"])
    shift = F.when((F.col(group) != rules.DEFAULT_GROUP) & (total > 0), extra / total)
    adjusted = C.round_half_up(C.clamp(F.col(base) - shift), 1)
    return summary.withColumn("safety_score", F.when(shift.isNotNull(), adjusted).otherwise(
        C.round_half_up(F.col(base), 1))).withColumn(
        "base_safety_score", C.round_half_up(F.col(base), 1))


def time_analysis(summary: DataFrame) -> DataFrame:
    return summary.withColumn("peak", stats.peak_bucket(*[F.col(n) for n in BUCKETS]))


def safety_cards(locations: DataFrame, incidents: DataFrame, amenities: DataFrame, models: Models,
                 now: str | None = None, key: str = "loc_id") -> DataFrame:
    """Zone, scores, nearby incidents, time analysis, hotspot, demographic zone, density, amenities.

    Sections a location has no data for are null.
    """
    df = zones.locate(models.zone_model, locations, models.zone_table)
    df = df.withColumn("base_score", F.coalesce("safety_score", F.lit(50.0))).drop(
        "safety_score", "crime_count")
    df = time_analysis(scored(nearby_summary(df, incidents, now=now, key=key)))

    spots = J.nearest(locations, models.hotspot_points, "cluster").select(
        "lat", "lon", F.col("nearest.cluster").alias("cluster"))
    info = models.hotspot_profiles.select(
        "cluster", F.struct(F.col("cluster").alias("cluster_id"), "dominant_crime",
                            "common_crimes", "crime_count").alias("dbscan_cluster"))
    df = df.join(spots, ["lat", "lon"], "left").join(info, "cluster", "left").drop("cluster")

    if models.demographic_model is not None:
        placed = zones.predict_demographic_zone(
            models.demographic_model, models.demographic_zones,
            df.select(key, "lat", "lon", *rules.DEMOGRAPHIC_COLUMNS))
        profile = models.demographic_zones.select(
            F.col("zone").alias("demographic_zone"),
            F.struct(F.col("zone").alias("zone_id"), "profiles", "crime_count").alias("zone_info"))
        df = df.join(placed.select(key, "demographic_zone"), key, "left").join(
            profile, "demographic_zone", "left").drop("demographic_zone").withColumnRenamed(
            "zone_info", "demographic_zone")
    else:
        df = df.withColumn("demographic_zone", F.lit(None).cast(NO_ZONE))
    dense = D.density_at(locations.select(key, "lat", "lon"), incidents, models.density, key=key)
    df = df.join(dense.select(key, F.struct(
        "density", "classification", "density_percentile").alias("density")), key, "left")
    cards = scoring.amenity_cards(locations, amenities, key=key).select(
        key, F.struct("nearby_count", "type_counts", "closest").alias("amenities"))
    return df.join(cards, key, "left").drop("base_score").withColumns({
        "safety_level": C.safety_level(F.col("safety_score")),
        "score_colour": C.score_colour(F.col("safety_score"))})


def with_reports(cards: DataFrame, address: str = "message", amenity: str = "amenity_type",
                 group_text: str | None = "group_text") -> DataFrame:
    """Add the text report and, where the group is described, the advice for it."""
    kinds = F.coalesce("amenities.type_counts",
                       F.array().cast("array<struct<value:string,count:bigint>>"))
    out = cards.withColumn("report", T.safety_report(
        F.col("safety_score"), F.col(address), F.col(amenity), F.col("common_crimes"),
        F.col("nearby_crime_count"), F.col("crime_types"), F.col("peak"),
        F.col("amenities.nearby_count"), kinds))
    if group_text is None:
        return out
    out = out.withColumn("demographic_profile", T.parse_group(F.col(group_text)))
    advice = T.group_advice(F.col("demographic_profile"), F.col("safety_score"),
                            F.col("crime_types"))
    return out.withColumn("report", F.concat_ws("\n", "report", advice))


