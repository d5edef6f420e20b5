"""Group weights, adjusted scores, and amenity cards for a table of locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from .distance_join import counts_within, nearest_k
from .skew import salted_join


def group_weights(spark: SparkSession) -> DataFrame:
    """(demographic_group, crime_category, impact_weight): twenty rows."""
    rows = F.array(*[
        F.struct(F.lit(g).alias("demographic_group"), F.lit(c).alias("crime_category"),
                 F.lit(w).alias("impact_weight"))
        for g, weights in rules.GROUP_WEIGHTS.items() for c, w in weights.items()])
    return spark.range(1).select(F.inline(rows))


def known_group(c: Column) -> Column:
    return F.when(c.isin(list(rules.GROUP_WEIGHTS)), c).otherwise(rules.DEFAULT_GROUP)


def weight_tenths(group: Column, category: Column) -> Column:
    """Weight in whole tenths (10 where a category has none), so sums are exact."""
    chain = F
    for g, weights in rules.GROUP_WEIGHTS.items():
        for c, w in weights.items():
            if w != 1.0:
                chain = chain.when((group == g) & (category == c), F.lit(round(w * 10)))
    return chain.otherwise(F.lit(10)).cast("long")


def adjust_scores(locations: DataFrame, category_counts: DataFrame, base: str = "base_score",
                  key: str = "loc_id", group: str = "demographic_group") -> DataFrame:
    """Base score less ten points per unit of extra mean weight, within 0 and 100.

    `category_counts` has one column per category. Scores are unchanged for the general group and
    where there are no incidents.
    """
    who = known_group(F.col(group))
    count = {c: F.coalesce(c, F.lit(0)) for c in rules.CATEGORIES}
    extra = sum((n * (weight_tenths(who, F.lit(c)) - 10) for c, n in count.items()), F.lit(0))
    total = sum(count.values(), F.lit(0))
    shift = F.when((F.col(group) != rules.DEFAULT_GROUP) & (total > 0), extra / total)
    adjusted = C.round_half_up(C.clamp(F.col(base) - shift), 1)
    return (locations.join(category_counts, key, "left")
            .withColumn("adjusted_score", F.when(shift.isNotNull(), adjusted)
                        .otherwise(F.col(base))).drop(*rules.CATEGORIES))


def nearby_counts(locations: DataFrame, points: DataFrame, km: float,
                  key: str = "loc_id") -> DataFrame:
    """Number of points within `km`, zero where there are none."""
    found = counts_within(locations, points, km, key=key)
    return locations.join(found, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn(
        "n", F.col("n").cast("long")).withColumnRenamed("n", "nearby_count")


def nearest_of_each_type(locations: DataFrame, amenities: DataFrame,
                         km: float = rules.AMENITY_RADIUS_KM, key: str = "loc_id") -> DataFrame:
    """The nearest amenity of each type within `km` (by name, then position, on ties)."""
    found = nearest_k(locations, amenities, 1, km, "type")
    home = locations.select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    # A coordinate may have any number of locations, and one row per type here.
    return salted_join(home, found, ["_lat", "_lon"], [key]).select(
        key, "type", "name", C.round_half_up(F.col("distance"), 2).alias("distance_km"), "latitude", "longitude")


def amenity_cards(locations: DataFrame, amenities: DataFrame,
                  km: float = rules.AMENITY_RADIUS_KM, key: str = "loc_id") -> DataFrame:
    """Per location: amenity count, counts by type, and the nearest of each type."""
    by_type = counts_within(locations, amenities, km, ["type"], key=key)
    # Types are a short code list, so the arrays are short.
    counts = by_type.groupBy(key).agg(
        F.sum("n").alias("nearby_count"),
        by_count("type").alias("type_counts"))
    closest = nearest_of_each_type(locations, amenities, km, key).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(
            "type", "name", "distance_km", "latitude", "longitude"))).alias("closest"))
    return (locations.select(key).join(counts, key, "left").join(closest, key, "left")
            .withColumn("nearby_count", F.coalesce("nearby_count", F.lit(0).cast("long"))))


def by_count(value: str, count: str = "n") -> Column:
    """Aggregate: (value, count) structs, largest count first, then by value."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col(count)).alias("o"),
                                                   F.col(value).alias("value"))))
    return F.transform(ordered, lambda x: F.struct(
        x["value"].alias("value"), (-x["o"]).alias("count")))
