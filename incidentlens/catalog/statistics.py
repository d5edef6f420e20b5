"""Aggregates, matrices and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators import distance_join as J
from ..operators import hotspots as H
from ..operators import layers, places, ranking, scoring, stats, zones
from ..operators.skew import is_small
from ..plans import safety_card as card
from ..session import stored
from ..sources import fixtures as fx
from .base import counts_json, half_up, haversine, list_text, modal, severity_points, sql
from .registry import query

NOW = "2024-01-31 00:00:00"
#: Points in the cells around a task's locations, and numbers of amenities.
REACH_PER_TASK, NUMBERS = 12_000_000, 1 << 40
DIST = haversine("loc.lat", "loc.lon", "inc.latitude", "inc.longitude")
AM_DIST = haversine("loc.lat", "loc.lon", "am.latitude", "am.longitude")
# Longitudes are compared first only to spare the check query most of the trigonometry.
NEAR = (f"abs(inc.latitude - loc.lat) <= 3 / 111.0::DOUBLE AND abs(inc.longitude - loc.lon) <= "
        f"0.04 AND {DIST} <= 3")


def hotspots(spark, d):
    """Incidents with their hotspot, found once per session."""
    return fx.kept(spark, d, "hotspots", lambda: H.label_incidents(fx.incidents(spark, d)))


def inside(spark, d):
    return hotspots(spark, d).filter("cluster <> -1")


def zoned(spark, d):
    """Incidents with a fixed square zone."""
    return fx.incidents(spark, d).withColumn(
        "zone", zones.grid_zone(F.col("latitude"), F.col("longitude")))


def as_text(pairs, value="value", count="count"):
    return F.array_join(F.transform(pairs, lambda x: F.concat(
        x[value], F.lit("="), x[count].cast("string"))), "; ")


@query("a1_value_counts", sql("inc loc", f"""@
n AS (SELECT loc_id, crime_type, count(*) AS c FROM loc JOIN inc ON {NEAR} GROUP BY 1, 2)
SELECT loc_id, {counts_json('crime_type', 'c')} AS crime_types FROM n GROUP BY loc_id"""))
def a1(spark, d):
    """Offense counts around each location as one map."""
    counts = J.counts_within(fx.locations(spark, d), fx.incidents(spark, d),
                             rules.INCIDENT_RADIUS_KM, ["crime_type"])
    return counts.groupBy("loc_id").agg(
        F.to_json(stats.sorted_counts("crime_type", "n")).alias("crime_types"))


@query("a1_counts_by_zone", sql("zon", f"""@
n AS (SELECT zone, crime_category, count(*) AS c FROM zon GROUP BY 1, 2)
SELECT zone, {counts_json('crime_category', 'c')} AS crime_categories FROM n GROUP BY zone"""))
def a1_zone(spark, d):
    return stats.counts_map(zoned(spark, d), ["zone"], "crime_category").select(
        "zone", F.to_json("counts").alias("crime_categories"))


def _matrix(value, values):
    return ", ".join(f"count(*) FILTER ({value} = {v}) AS {value}_{v}" for v in values)


HOURS, DAYS, MONTHS = range(24), range(7), range(1, 13)
_WITH_MONTH = "(SELECT *, month(occurred_at) AS month FROM hot WHERE cluster <> -1)"


@query("a2_hotspot_by_hour", sql("hot", f"""
SELECT cluster, {_matrix('hour_of_day', HOURS)} FROM hot WHERE cluster <> -1 GROUP BY cluster"""),)
def a2_hour(spark, d):
    return stats.matrix(inside(spark, d), "cluster", "hour_of_day", HOURS)


@query("a2_hotspot_by_weekday", sql("hot", f"""
SELECT cluster, {_matrix('day_of_week', DAYS)} FROM hot WHERE cluster <> -1 GROUP BY cluster"""))
def a2_weekday(spark, d):
    return stats.matrix(inside(spark, d), "cluster", "day_of_week", DAYS)


@query("a2_hotspot_by_month", sql("hot", f"""
SELECT cluster, {_matrix('month', MONTHS)} FROM {_WITH_MONTH} GROUP BY cluster"""))
def a2_month(spark, d):
    rows = inside(spark, d).withColumn("month", F.month("occurred_at"))
    return stats.matrix(rows, "cluster", "month", MONTHS)


_VICTIM = "cluster, vic_age_group, vic_race, vic_sex"


@query("a3_victim_patterns", sql("hot", f"""@
v AS (SELECT * FROM hot WHERE cluster <> -1 AND vic_age_group IS NOT NULL
      AND vic_race IS NOT NULL AND vic_sex IS NOT NULL)
SELECT {_VICTIM}, n AS count, crime_type AS most_common_offense
FROM (SELECT {_VICTIM}, count(*) AS n FROM v GROUP BY ALL)
JOIN {modal('v', _VICTIM, 'crime_type')} USING ({_VICTIM})"""))
def a3(spark, d):
    keys = ["cluster", "vic_age_group", "vic_race", "vic_sex"]
    return stats.modes(inside(spark, d).na.drop(subset=keys), keys,
                       {"most_common_offense": "crime_type"})


@query("a4_elderly_victims", sql("hot", f"""@
v AS (SELECT * FROM hot WHERE cluster <> -1 AND vic_age_group = '65+')
SELECT cluster, n AS count, crime_type, prem_typ_desc
FROM (SELECT cluster, count(*) AS n FROM v GROUP BY 1)
JOIN {modal('v', 'cluster', 'crime_type')} USING (cluster)
JOIN {modal('v', 'cluster', 'prem_typ_desc')} USING (cluster)"""))
def a4(spark, d):
    return elderly(spark, d)


def elderly(spark, d):
    return stats.modes(inside(spark, d).filter(F.col("vic_age_group") == "65+"), ["cluster"],
                       {"crime_type": "crime_type", "prem_typ_desc": "prem_typ_desc"})


@query("a5_female_victims", sql("hot", f"""@
v AS (SELECT *, lpad(CAST(hour_of_day AS VARCHAR), 2, '0') AS hour FROM hot
      WHERE cluster <> -1 AND vic_sex = 'F')
SELECT cluster, n AS count, crime_type, CAST(hour AS INTEGER) AS hour
FROM (SELECT cluster, count(*) AS n FROM v GROUP BY 1)
JOIN {modal('v', 'cluster', 'crime_type')} USING (cluster)
JOIN {modal('v', 'cluster', 'hour')} USING (cluster)"""))
def a5(spark, d):
    # Two-digit hours keep number order among texts.
    rows = inside(spark, d).filter(F.col("vic_sex") == "F").withColumn(
        "hour", F.lpad(F.col("hour_of_day").cast("string"), 2, "0"))
    return stats.modes(rows, ["cluster"], {"crime_type": "crime_type", "hour": "hour"}
                       ).withColumn("hour", F.col("hour").cast("int"))


@query("a6_modal_demographics", sql("inc loc", f"""@
p AS (SELECT loc_id, vic_age_group, vic_race, vic_sex FROM loc JOIN inc ON {NEAR})
SELECT loc_id, vic_age_group, vic_race, vic_sex
FROM (SELECT DISTINCT loc_id FROM p)
LEFT JOIN {modal('p', 'loc_id', 'vic_age_group')} USING (loc_id)
LEFT JOIN {modal('p', 'loc_id', 'vic_race')} USING (loc_id)
LEFT JOIN {modal('p', 'loc_id', 'vic_sex')} USING (loc_id)"""))
def a6(spark, d):
    return card.nearby_values(fx.locations(spark, d), fx.incidents(spark, d)).select(
        "loc_id", *rules.DEMOGRAPHIC_COLUMNS)


_BUCKETS = ", ".join(
    f"count(*) FILTER (occurred_at IS NOT NULL AND hour_of_day BETWEEN {a} AND {b}) AS {n}"
    for n, a, b in rules.TIME_BUCKETS)
_TIMES = f"""@
t AS (SELECT loc_id, {_BUCKETS}, count(*) FILTER (occurred_at >= TIMESTAMP '{NOW}' -
        INTERVAL 30 DAY) AS total_recent FROM loc JOIN inc ON {NEAR} GROUP BY loc_id)"""


@query("a7_time_of_day", sql("inc loc", _TIMES + " SELECT * FROM t"))
def a7(spark, d):
    return card.nearby_times(fx.locations(spark, d), fx.incidents(spark, d), now=NOW).select(
        "loc_id", *card.BUCKETS, "total_recent")


@query("a8_peak_time", sql("inc loc", _TIMES + """
SELECT loc_id, CASE WHEN m = morning THEN 'morning' WHEN m = afternoon THEN 'afternoon'
  WHEN m = evening THEN 'evening' ELSE 'night' END AS bucket, round(m * 100::DOUBLE / total, 6)
  AS percent
FROM (SELECT *, greatest(morning, afternoon, evening, night) AS m,
        morning + afternoon + evening + night AS total FROM t) WHERE total > 0"""))
def a8(spark, d):
    times = card.nearby_times(fx.locations(spark, d), fx.incidents(spark, d))
    return (card.time_analysis(times).filter("peak IS NOT NULL")
            .select("loc_id", "peak.bucket", F.round("peak.percent", 6).alias("percent")))


_EACH = ["borough", "hour_of_day", "vic_age_group", "vic_race", "vic_sex"]


@query("a9_counts_by_each", sql("inc", " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM inc "
    f"GROUP BY {c}" for c in _EACH)))
def a9(spark, d):
    return stats.counts_by_each(fx.incidents(spark, d), _EACH)


@query("a10_top_offenses", sql("inc", """
SELECT crime_type, count(*) AS count FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def a10(spark, d):
    return stats.top_overall(fx.incidents(spark, d), "crime_type", 10)


@query("a10_first_52_raw_offenses", sql("raw", """
SELECT ofns_desc, count(*) AS count FROM raw WHERE ofns_desc IS NOT NULL GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 52"""))
def a10_raw(spark, d):
    return stats.top_overall(fx.complaints(spark, d), "ofns_desc", 52)


@query("a11_top_offenses_per_zone", sql("zon", f"""@
n AS (SELECT zone, crime_type, count(*) AS c, row_number() OVER (PARTITION BY zone
        ORDER BY count(*) DESC, crime_type) AS r FROM zon GROUP BY 1, 2)
SELECT zone, {list_text('crime_type', 'c')} AS top_three FROM n WHERE r <= 3 GROUP BY zone"""))
def a11(spark, d):
    return stats.top_list(zoned(spark, d), ["zone"], "crime_type", 3).select(
        "zone", as_text(F.col("common")).alias("top_three"))


@query("a12_largest_hotspots", sql("hot", """
SELECT cluster, count(*) AS crime_count FROM hot WHERE cluster <> -1 GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10"""))
def a12(spark, d):
    return (inside(spark, d).groupBy("cluster").agg(F.count("*").alias("crime_count"))
            .orderBy(F.desc("crime_count"), "cluster").limit(10))


@query("a12_most_elderly_victims", sql("hot", """
SELECT cluster, count(*) AS count FROM hot WHERE cluster <> -1 AND vic_age_group = '65+'
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def a12_elderly(spark, d):
    return (elderly(spark, d).select("cluster", "count")
            .orderBy(F.desc("count"), "cluster").limit(5))


_TOP_HOT = """@
top AS (SELECT cluster, avg(latitude) AS lat, avg(longitude) AS lon, count(*) AS crime_count
        FROM hot WHERE cluster <> -1 GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10)"""
_TOP_DIST = haversine("top.lat", "top.lon", "am.latitude", "am.longitude")


def _a13_sql(km):
    return sql("am hot", _TOP_HOT + f""",
n AS (SELECT cluster, type, count(*) AS c FROM top JOIN am ON {_TOP_DIST} <= {km} GROUP BY 1, 2)
SELECT top.cluster, crime_count, coalesce(j, '{{}}') AS top_amenities FROM top LEFT JOIN
  (SELECT cluster, {counts_json('type', 'c')} AS j FROM n GROUP BY 1) USING (cluster)""")


@query("a13_amenities_within_200m", _a13_sql("0.2::DOUBLE"))
def a13_near(spark, d):
    found = places.amenities_of_top_hotspots(
        H.hotspot_profiles(hotspots(spark, d)), fx.amenities(spark, d), km=0.2)
    return found.withColumn("top_amenities", F.to_json("top_amenities"))


@query("a13_amenities_of_hotspots", _a13_sql(2))
def a13(spark, d):
    """2 km instead of 200 m: the test amenities are sparse."""
    found = places.amenities_of_top_hotspots(
        H.hotspot_profiles(hotspots(spark, d)), fx.amenities(spark, d), km=2.0)
    return found.withColumn("top_amenities", F.to_json("top_amenities"))


@query("a14_map_to_rows", sql("am hot", _TOP_HOT + f"""
SELECT cluster, crime_count, type, count(*) AS count FROM top JOIN am ON {_TOP_DIST} <= 2
GROUP BY 1, 2, 3"""))
def a14(spark, d):
    found = places.amenities_of_top_hotspots(
        H.hotspot_profiles(hotspots(spark, d)), fx.amenities(spark, d), km=2.0)
    return found.select("cluster", "crime_count", F.explode("top_amenities").alias(
        "type", "count"))


_E_DIST = haversine("c.lat", "c.lon", "am.latitude", "am.longitude")


@query("a15_contingency_chi_square", sql("am hot", f"""@
e AS (SELECT cluster, count(*) AS n FROM hot WHERE cluster <> -1 AND vic_age_group = '65+'
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
c AS (SELECT cluster, avg(latitude) AS lat, avg(longitude) AS lon FROM hot GROUP BY 1),
f AS (SELECT n > (SELECT quantile_cont(n, 0.5) FROM e) AS high, EXISTS (SELECT 1 FROM am
        WHERE type IN ('nursing_home', 'retirement_home') AND {_E_DIST} <= 5) AS home
      FROM e JOIN c USING (cluster)),
t AS (SELECT count(*) FILTER (home AND high) AS a, count(*) FILTER (home AND NOT high) AS b,
        count(*) FILTER (NOT home AND high) AS c, count(*) FILTER (NOT home AND NOT high) AS d
      FROM f),
x AS (SELECT *, a + b + c + d AS n, (a + b) * (c + d) * (a + c) * (b + d) AS p FROM t),
y AS (SELECT *, n * power(greatest(abs(a * d - b * c) - n / 2::DOUBLE, 0), 2) / p AS chi,
  1 / (1 + 0.3275911::DOUBLE * sqrt(chi / 2)) AS s FROM x WHERE p > 0)
SELECT a AS home_high, b AS home_low, c AS none_high, d AS none_low,
  CASE WHEN p > 0 THEN round(n * power(greatest(abs(a * d - b * c) - n / 2::DOUBLE, 0), 2) / p, 6)
  END AS chi_square, (SELECT round(s * (0.254829592::DOUBLE + s * (-0.284496736::DOUBLE + s * (
  1.421413741::DOUBLE + s * (-1.453152027::DOUBLE + s * 1.061405429::DOUBLE)))) * exp(-chi / 2), 6)
  FROM y) AS p_value FROM x"""))
def a15(spark, d):
    table = places.retirement_contingency(
        H.hotspot_profiles(hotspots(spark, d)), elderly(spark, d), fx.amenities(spark, d), km=5.0)
    return table.withColumns({"chi_square": F.round("chi_square", 6),
                              "p_value": F.round("p_value", 6)})


@query("a16_nearby_count", sql("inc loc", f"""
SELECT loc.loc_id, count(inc.incident_id) AS nearby_count FROM loc LEFT JOIN inc ON {NEAR}
GROUP BY 1"""))
def a16(spark, d):
    return scoring.nearby_counts(fx.locations(spark, d), fx.incidents(spark, d),
                                 rules.INCIDENT_RADIUS_KM).select("loc_id", "nearby_count")


@query("a17_share_in_zone", sql("zon", """
SELECT zone, vic_race, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY zone),
  6) AS share FROM zon GROUP BY zone, vic_race
QUALIFY count(*) / sum(count(*)) OVER (PARTITION BY zone) > 0.2"""))
def a17(spark, d):
    return stats.shares(zoned(spark, d), "zone", "vic_race", 0.2).withColumn(
        "share", F.round("share", 6))


@query("a18_feature_moments", sql("inc", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std_population,
  round(stddev_samp({c}), 6) AS std_sample FROM inc""" for c in ("latitude", "longitude"))))
def a18(spark, d):
    df = fx.incidents(spark, d)
    both = df.agg(*[F.struct(
        F.lit(c).alias("feature"), F.round(F.avg(c), 6).alias("mean"),
        F.round(F.stddev_pop(c), 6).alias("std_population"),
        F.round(F.stddev_samp(c), 6).alias("std_sample")).alias(c)
        for c in ("latitude", "longitude")])
    return both.select(F.inline(F.array("latitude", "longitude")))


@query("a19_percentile_rank", sql("zon", f"""@
s AS (SELECT zone, CAST(sum({severity_points('crime_type')}) AS BIGINT) AS v FROM zon GROUP BY 1)
SELECT a.zone, a.v AS severity, round(count(*) FILTER (b.v < a.v) * 100::DOUBLE / count(*), 6)
  AS percentile FROM s a JOIN s b ON true GROUP BY 1, 2"""))
def a19(spark, d):
    """Each zone's total severity against all zones."""
    totals = zoned(spark, d).groupBy("zone").agg(
        F.sum(C.severity_points(F.col("crime_type"))).alias("severity"))
    return stats.share_below(totals, "severity", "percentile").withColumn(
        "percentile", F.round("percentile", 6))


@query("a20_crosstab", sql("inc", """
SELECT crime_category, count(*) FILTER (law_cat_cd = 'FELONY') AS felony,
  count(*) FILTER (law_cat_cd = 'MISDEMEANOR') AS misdemeanor,
  count(*) FILTER (law_cat_cd = 'VIOLATION') AS violation FROM inc GROUP BY 1"""))
def a20(spark, d):
    wide = fx.incidents(spark, d).groupBy("crime_category").pivot(
        "law_cat_cd", fx.LAW_CATEGORIES).count().na.fill(0)
    return wide.select("crime_category", *[F.col(c).alias(c.lower()) for c in fx.LAW_CATEGORIES])


# --- windows, sorts, limits, set operations -------------------------------------------------

@query("w1_nearest_of_each_type", sql("am loc", f"""
SELECT loc_id, type, name, {half_up('dist', 2)} AS distance_km FROM (
  SELECT loc_id, type, name, {AM_DIST} AS dist, row_number() OVER (PARTITION BY loc_id, type
    ORDER BY {AM_DIST}, name) AS r FROM loc JOIN am ON {AM_DIST} <= 5) WHERE r = 1"""))
def w1(spark, d):
    return scoring.nearest_of_each_type(
        fx.locations(spark, d), fx.amenities(spark, d), 5.0).select(
        "loc_id", "type", "name", "distance_km")


@query("w2_top_per_group", sql("inc", """
SELECT borough, crime_type, count, rank FROM (SELECT borough, crime_type, count(*) AS count,
  CAST(row_number() OVER (PARTITION BY borough ORDER BY count(*) DESC, crime_type) AS INTEGER)
  AS rank FROM inc GROUP BY 1, 2) WHERE rank <= 5"""))
def w2(spark, d):
    return stats.top_values(fx.incidents(spark, d), ["borough"], "crime_type", 5)


@query("w3_share_of_group", sql("inc", """
SELECT borough, crime_category, count(*) AS count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY borough), 6) AS share
FROM inc GROUP BY 1, 2"""))
def w3(spark, d):
    return stats.shares(fx.incidents(spark, d), "borough", "crime_category", -1).withColumn(
        "share", F.round("share", 6))


@query("w4_renumber_labels", sql("zon", """
SELECT zone, dense_rank() OVER (ORDER BY first) - 1 AS number FROM (
  SELECT zone, min(CAST(incident_id AS BIGINT)) AS first FROM zon GROUP BY 1)"""))
def w4(spark, d):
    """Zones numbered by their first incident."""
    first = zoned(spark, d).groupBy("zone").agg(
        F.min(F.col("incident_id").cast("long")).alias("first"))
    return ranking.global_rank(first, ["first"], "number").select("zone", "number")


@query("w5_sorted_by_distance", sql("am loc", f"""
SELECT loc_id, name, CAST(row_number() OVER (PARTITION BY loc_id ORDER BY dist, name) AS INTEGER)
  AS position FROM (SELECT loc_id, name, {half_up(AM_DIST + ' * 1000', 1)} AS dist
  FROM loc JOIN am ON {AM_DIST} <= 5)"""))
def w5(spark, d):
    """Amenities of each location in order of distance: locations are put in order first, and keep it.

    A pair is one number, its distance in decimetres and then its amenity's place by name.
    """
    home = fx.locations(spark, d).select("loc_id", "lat", "lon").filter("loc_id IS NOT NULL")
    amenities = stored(ranking.global_rank(
        fx.amenities(spark, d).select("name", "latitude", "longitude"), ["name"], "number"))
    reach = J.in_reach(home, amenities, 5.0).agg(F.sum("_n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), reach // REACH_PER_TASK)
    pairs = J.within_distance(home.repartitionByRange(parts, "loc_id"), amenities.drop("name"), 5.0, in_place=True)
    key = F.floor(F.col("distance") * 1000 * 10.0 + 0.5) * NUMBERS + F.col("number")
    # The amenities within 5 km of one location fit a task.
    ranked = ranking.rank_within(pairs.select("loc_id", F.coalesce(key, F.lit(-1)).alias("key")), ["loc_id"], ["key"],
                                 "position", short_groups=True, in_order=True)
    names = amenities.select("number", "name")
    held = is_small(names, J.HELD_POINTS)
    named = ranked.withColumn("number", F.pmod("key", F.lit(NUMBERS))).join(
        F.broadcast(names) if held else names, "number").select("loc_id", "name", "position")
    return named if held else named.orderBy("loc_id", "position")


@query("w6_first_rows", sql("inc", """
SELECT crime_type, count(*) AS count FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"""))
def w6(spark, d):
    return stats.top_overall(fx.incidents(spark, d), "crime_type", 3)


@query("w7_seeded_sample", sql("inc", """
SELECT incident_id, latitude, longitude FROM inc ORDER BY md5(incident_id || '/42'), incident_id LIMIT 5000"""))
def w7(spark, d):
    """Fixed-size sample by hash order, same rows for the same seed."""
    return ranking.sample_rows(fx.incidents(spark, d), 5_000, "incident_id").select(
        "incident_id", "latitude", "longitude")


@query("w8_union_of_quadrants", sql("quad", """
SELECT incident_id, quadrant FROM quad"""))
def w8(spark, d):
    """Quadrant is a column of one table instead of four tables put together."""
    return quadrants(spark, d).select("incident_id", "quadrant")


def quadrants(spark, d):
    return fx.kept(spark, d, "quadrants", lambda: H.label_by_quadrant(fx.incidents(spark, d)))


@query("w9_merged_records", sql("inc", """
SELECT 'borough' AS kind, '{"value":"' || borough || '","count":' || count(*) || '}' AS record
FROM inc GROUP BY borough
UNION ALL SELECT 'category', '{"value":"' || crime_category || '","count":' || count(*) || '}'
FROM inc GROUP BY crime_category"""))
def w9(spark, d):
    counts = stats.counts_by_each(fx.incidents(spark, d), ["borough", "crime_category"])
    kind = F.when(F.col("attribute") == "borough", "borough").otherwise("category")
    return counts.select(kind.alias("kind"), F.to_json(F.struct("value", "count")).alias("record"))


@query("r5_heat_points", sql("inc", """
SELECT incident_id, latitude, longitude, severity_weight AS weight FROM inc"""))
def r5(spark, d):
    return layers.heat_points(fx.incidents(spark, d))


@query("r5_heat_cells", sql("inc", """
SELECT floor(latitude * 1000::DOUBLE + 0.5) / 1000::DOUBLE AS latitude,
  floor(longitude * 1000::DOUBLE + 0.5) / 1000::DOUBLE AS longitude,
  round(sum(severity_weight), 6) AS weight, count(*) AS count FROM inc GROUP BY 1, 2"""))
def r5_cells(spark, d):
    return layers.heat_cells(fx.incidents(spark, d)).withColumn("weight", F.round("weight", 6))
