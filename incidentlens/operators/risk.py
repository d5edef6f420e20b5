"""Risk per cell, time, group and place: the planned risk model as batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..session import discard, stored
from .distance_join import counts_within
from .quantiles import percent_rank_by
from .ranking import rank_within
from .scoring import known_group, weight_tenths


#: Partitions of a written amenity table.
MERGE_BUCKETS = 64


def cell_id(lat: Column, lon: Column, digits: int = 3) -> Column:
    """Cells of about 100 m: both coordinates rounded, as text."""
    scale = 10 ** digits

    def part(c):
        return F.floor(c * F.lit(float(scale)) + 0.5).cast("string")

    return F.concat(part(lat), F.lit("_"), part(lon))


def day_type(day_of_week: Column) -> Column:
    return F.when(day_of_week >= 5, "weekend").otherwise("weekday")


def victim_groups(age: Column, sex: Column) -> Column:
    """Groups an incident counts for; every incident counts for the general group."""
    return F.array_compact(F.array(
        F.lit("general"), F.when(sex == "F", "women"), F.when(age == "<18", "children"),
        F.when(age == "65+", "elderly")))


def decay_tenths(occurred: Column, as_of) -> Column:
    """Time weight in whole tenths; rows without a date count as old."""
    days = F.date_diff(F.lit(as_of).cast("date"), occurred)
    return F.coalesce(F.round(C.time_decay(days) * 10), F.lit(rules.TIME_DECAY[-1][1] * 10)).cast(
        "long")


def confidence(n: Column, newest_days: Column) -> Column:
    """n / (n + 10), times 1 within 30 days, 0.7 within 90, else 0.4 (our own closed form)."""
    recency = F.coalesce(C.time_decay(newest_days), F.lit(rules.TIME_DECAY[-1][1]))
    return n / (n + F.lit(10.0)) * recency


KEYS = ["grid_cell_id", "hour_bucket", "day_type", "demographic_group"]


def day_rows(incidents: DataFrame, digits: int = 3) -> DataFrame:
    """A row per incident and group it counts for: cell, time bucket, day type, category and day."""
    return incidents.select(
        cell_id(F.col("latitude"), F.col("longitude"), digits).alias("grid_cell_id"),
        C.time_bucket(F.col("hour_of_day")).alias("hour_bucket"),
        day_type(F.col("day_of_week")).alias("day_type"),
        F.explode(victim_groups(F.col("vic_age_group"), F.col("vic_sex"))).alias("demographic_group"),
        "crime_category", F.to_date("occurred_at").alias("day"))


def day_counts(incidents: DataFrame, digits: int = 3) -> DataFrame:
    """Counts by what risk depends on. They add up over any parts of the incidents, and don't age."""
    return day_rows(incidents, digits).groupBy(*KEYS, "crime_category", "day").agg(F.count("*").alias("n"))


def risk_from_counts(counts: DataFrame, as_of: str) -> DataFrame:
    """The risk table of a day's date, with the decay applied to the day counts as they are read."""
    rows = counts.select(
        *KEYS, "crime_category", "n", (F.col("n") * decay_tenths(F.col("day"), as_of)).alias("decay"),
        F.date_diff(F.lit(as_of).cast("date"), "day").alias("age"))
    per = rows.groupBy(*KEYS, "crime_category").agg(
        F.sum("n").alias("n"), F.sum("decay").alias("decay"), F.min("age").alias("age"))
    tenths = weight_tenths(F.col("demographic_group"), F.col("crime_category"))
    total = per.groupBy(*KEYS).agg(
        F.sum("n").alias("raw_crime_count"), F.sum("decay").alias("d"),
        F.sum(F.col("decay") * tenths).alias("r"), F.min("age").alias("age"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("crime_category", "n"))))
        .alias("crime_breakdown"))
    return total.select(
        *KEYS, "raw_crime_count", (F.col("d") / F.lit(10.0)).alias("weighted_crime_count"),
        "crime_breakdown", (F.col("r") / F.lit(100.0)).alias("risk_score"),
        confidence(F.col("raw_crime_count"), F.col("age")).alias("confidence"))


def risk_table(incidents: DataFrame, as_of: str, digits: int = 3) -> DataFrame:
    """Counts and score per cell, time bucket, day type and group.

    The score is the decayed count weighted by group impact, in units of one fresh incident of
    weight 1.
    """
    return risk_from_counts(day_counts(incidents, digits), as_of)


def refresh_from_counts(table: DataFrame, counts: DataFrame, touched: DataFrame, as_of: str) -> DataFrame:
    """Risk table with the cells of `touched` (grid_cell_id) taken anew from their day counts; what is read of
    the counts is those cells' rows, and no incident."""
    touched = touched.select("grid_cell_id").distinct()
    fresh = risk_from_counts(counts.join(touched, "grid_cell_id", "left_semi"), as_of)
    return table.join(touched, "grid_cell_id", "left_anti").unionByName(fresh)


def write_risk_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").partitionBy("demographic_group").parquet(path)


def group_counts(incidents: DataFrame, keys) -> DataFrame:
    """Incidents by the group their victim belongs to."""
    return (incidents.withColumn("demographic_group", F.explode(
        victim_groups(F.col("vic_age_group"), F.col("vic_sex"))))
        .groupBy(*keys, "demographic_group").agg(F.count("*").alias("count")))


def category_sums() -> dict:
    """One figure per category, for a counting join."""
    return {c: (F.col("crime_category") == c).cast("long") for c in rules.CATEGORIES}


def risk_vectors(locations: DataFrame, incidents: DataFrame, km: float = 1.0,
                 key: str = "loc_id") -> DataFrame:
    """One count per category and location, zeros filled."""
    counts = counts_within(locations, incidents, km, sums=category_sums(), key=key).drop("n")
    return locations.join(counts, key, "left").na.fill(0, rules.CATEGORIES)


def exposure(group: Column, people: Column, venue: Column, hour: Column) -> Column:
    """Exposure multiplier of a visit, 1 where no rule applies."""
    night, late = (hour >= 22) | (hour < 6), hour >= 22
    alone = people <= 1
    bar, park = F.lower(venue).contains("bar"), F.lower(venue).contains("park")
    e = rules.EXPOSURE
    return (F.when((group == "children") & alone, e["child_alone"])
            .when((group == "children") & park & ~night, e["child_accompanied_park_day"])
            .when((group == "women") & bar & late & alone, e["woman_alone_bar_night"])
            .when((group == "women") & bar & late, e["woman_group_bar_night"])
            .when((group == "elderly") & alone & night, e["elderly_alone_night"])
            .otherwise(1.0))


def personal_risk(vectors: DataFrame, group: str = "demographic_group",
                  factor: str = "exposure") -> DataFrame:
    """Sum over categories of count × impact × exposure, and the category that adds most.

    On a tie the category listed first leads.
    """
    who = known_group(F.col(group))
    parts = {c: F.col(c) * weight_tenths(who, F.lit(c)) for c in rules.CATEGORIES}
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    leading = F.array_max(F.array(*[
        F.struct(p.alias("p"), F.lit(-i).alias("o"), F.lit(c).alias("c"))
        for i, (c, p) in enumerate(parts.items())]))
    count = sum([F.col(c) for c in rules.CATEGORIES[1:]], F.col(rules.CATEGORIES[0]))
    return vectors.withColumns({
        "incident_count": count,
        "personal_risk": total * F.col(factor) / F.lit(10.0),
        "dominant_risk": F.when(total > 0, leading["c"])})


def compare_places(risks: DataFrame, request: str, key: str = "loc_id") -> DataFrame:
    """Rank of each place within its request, and the safest one (lowest key on ties)."""
    risks = stored(risks)
    best = risks.groupBy(request).agg(
        F.min_by(key, F.struct("personal_risk", key)).alias("safer_choice"))
    ranked = rank_within(risks, [request], ["personal_risk", key], "rank")
    return ranked.join(best, request)


def safe_times(locations: DataFrame, incidents: DataFrame, km: float = 1.0,
               key: str = "loc_id") -> DataFrame:
    """Incidents per time bucket around each location, and the quietest bucket (first on ties)."""
    names = [n for n, _, _ in rules.TIME_BUCKETS]
    buckets = {n: F.col("hour_of_day").between(a, b).cast("long")
               for n, a, b in rules.TIME_BUCKETS}
    counts = counts_within(locations, incidents, km, sums=buckets, key=key).drop("n")
    wide = locations.select(key).join(counts, key, "left").na.fill(0, names)
    best = F.array_min(F.array(*[
        F.struct(F.col(n).alias("n"), F.lit(i).alias("i"), F.lit(n).alias("bucket"))
        for i, n in enumerate(names)]))
    return wide.withColumn("safest_window", best["bucket"])


def stale_cells(table: DataFrame, new_incidents: DataFrame, digits: int = 3) -> DataFrame:
    """Rows of the risk table whose cell has new incidents."""
    touched = new_incidents.select(
        cell_id(F.col("latitude"), F.col("longitude"), digits).alias("grid_cell_id")).distinct()
    return table.join(touched, "grid_cell_id", "left_semi")


def refresh_risk(table: DataFrame, incidents: DataFrame, new_incidents: DataFrame, as_of: str,
                 digits: int = 3) -> DataFrame:
    """Risk table with only the cells computed anew that the new incidents touch."""
    touched = new_incidents.select(
        cell_id(F.col("latitude"), F.col("longitude"), digits).alias("grid_cell_id"))
    return refresh_cells(table, incidents.unionByName(new_incidents), touched, as_of, digits)


def refresh_cells(table: DataFrame, incidents: DataFrame, touched: DataFrame, as_of: str,
                  digits: int = 3) -> DataFrame:
    """Risk table with the cells of `touched` (grid_cell_id, as the stream marks them) computed anew
    from all incidents.

    The touched cells' box is a filter of plain comparisons on the incidents: where these are stored
    by place (`write_incidents`), scans skip what lies outside.
    """
    touched = touched.select("grid_cell_id").distinct()
    part = F.split("grid_cell_id", "_")
    row, col = F.get(part, 0).cast("double"), F.get(part, 1).cast("double")
    box = touched.agg(F.min(row), F.max(row), F.min(col), F.max(col)).first()
    if box[0] is None:
        return table
    a, b, c, d = ((v + s) / 10 ** digits for v, s in zip(box, (-1, 1, -1, 1), strict=True))
    there = incidents.filter(F.col("latitude").between(a, b) & F.col("longitude").between(c, d)).withColumn(
        "grid_cell_id", cell_id(F.col("latitude"), F.col("longitude"), digits))
    fresh = risk_table(there.join(touched, "grid_cell_id", "left_semi"), as_of, digits)
    return table.join(touched, "grid_cell_id", "left_anti").unionByName(fresh)


def amenity_freshness(amenities: DataFrame, as_of: str,
                      days: int = rules.AMENITY_FRESH_DAYS) -> DataFrame:
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("last_verified_at"))
    return amenities.withColumn("age_days", age).withColumn(
        "freshness", F.when(age < days, "fresh").otherwise("stale"))


def merge_verified(amenities: DataFrame, seen: DataFrame, key: str = "name") -> DataFrame:
    """Amenity table after a verification run: dates move up, counts go up, new places come in."""
    news = seen.groupBy(key).agg(F.max("seen_at").alias("seen_at"),
                                 F.count("*").alias("times"))
    merged = amenities.join(news, key, "full")
    return merged.select(
        key, *[c for c in amenities.columns if c not in (
            key, "last_verified_at", "verification_count")],
        F.greatest("last_verified_at", "seen_at").alias("last_verified_at"),
        (F.coalesce("verification_count", F.lit(0)) + F.coalesce("times", F.lit(0)))
        .alias("verification_count"))


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_verified(table: DataFrame, path: str, key: str = "name", buckets: int = MERGE_BUCKETS) -> None:
    """Start an amenity table that `merge_written` keeps up to date: files by a hash of the key."""
    _bucketed(table.withColumn("last_batch", F.lit(-1).cast("long")), key, buckets).repartition("bucket").write.mode(
        "overwrite").partitionBy("bucket").parquet(path)


def read_verified(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_written(spark, path: str, seen: DataFrame, batch: int, key: str = "name",
                  buckets: int = MERGE_BUCKETS) -> list[int]:
    """Merge a verification run into the written table; returns the partitions that were overwritten.

    Only partitions that hold a seen key are read and written again. A row remembers the last batch it took,
    so a batch that is repeated, after a failure or by mistake, changes nothing; batches are numbered upwards.
    The merged rows are complete in the scratch folder before the first partition is replaced.
    """
    fresh = stored(_bucketed(seen, key, buckets))
    # At most one entry per partition.
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
    if not touched:
        return []
    old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    news = fresh.groupBy("bucket", key).agg(F.max("seen_at").alias("seen_at"), F.count("*").alias("times"))
    merged = old.join(news, ["bucket", key], "full")
    take = F.col("times").isNotNull() & (F.coalesce("last_batch", F.lit(-2)) < batch)
    changed = {
        "last_verified_at": F.when(take, F.greatest("last_verified_at", "seen_at")).otherwise(F.col("last_verified_at")),
        "verification_count": F.coalesce("verification_count", F.lit(0)) + F.when(take, F.col("times")).otherwise(0),
        "last_batch": F.when(take, F.lit(batch).cast("long")).otherwise(F.col("last_batch"))}
    kind = old.schema["verification_count"].dataType
    changed["verification_count"] = changed["verification_count"].cast(kind)
    complete = stored(merged.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in old.columns]))
    complete.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket").parquet(path)
    discard(fresh, complete)
    return touched


def normalise_between_cities(scores: DataFrame, city: str = "city",
                             score: str = "safety_score") -> DataFrame:
    """Percentile of each score within its city."""
    return percent_rank_by(scores, city, score, "percentile")


def layer_counts(layers: dict, digits: int = 2) -> DataFrame:
    """Points of several extra sources per cell, one column per source."""
    rows = None
    for name, points in layers.items():
        part = points.select(
            cell_id(F.col("latitude"), F.col("longitude"), digits).alias("grid_cell_id"),
            F.lit(name).alias("layer"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("grid_cell_id").pivot("layer", list(layers)).count().na.fill(0)


def score_rollup(incidents: DataFrame, levels) -> DataFrame:
    """Safety score at every level of a hierarchy, from one scan."""
    points = C.severity_points(F.col("crime_type"))
    total = incidents.rollup(*levels).agg(
        F.sum(points).alias("severity"), F.count("*").alias("crime_count"),
        F.grouping_id().alias("level"))
    share = F.col("severity") / (F.col("crime_count") * F.lit(10.0)) * 100
    return total.select(*levels, "level", "crime_count", C.clamp(100 - share)
                        .alias("safety_score"))


def trend(incidents: DataFrame, key, period: str = "month") -> DataFrame:
    """Counts per period and the change from the period before (periods with incidents only)."""
    counts = (incidents.filter(F.col("occurred_at").isNotNull())
              .groupBy(*key, F.date_trunc(period, "occurred_at").alias("period"))
              .agg(F.count("*").alias("count")))
    before = F.lag("count").over(Window.partitionBy(*key).orderBy("period"))
    return counts.withColumn("change", F.col("count") - before)
