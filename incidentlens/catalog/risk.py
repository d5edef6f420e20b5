"""Planned risk features (D1-D18) as batch tables, and the incremental stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators import classify, forest
from ..operators import density as D
from ..operators import hotspots as H
from ..operators import risk, zones
from ..session import scratch_folder, stored
from ..sources import city_layers
from ..sources import fixtures as fx
from ..streaming import incremental
from .base import (
    NEEDS, VIEWS, cases, counts_json, haversine, hotspot_view, quoted, sql, time_bucket)
from .cards import _tenths
from .models import FOREST_LEAVES, FOREST_TOP, GIVEN_FEATURES, _NODES, _SCORE, given_forest, labelled
from .registry import query

AS_OF = "2024-02-20"
_LOC_KM = haversine("loc.lat", "loc.lon", "inc.latitude", "inc.longitude")
ONE_KM = ("abs(inc.latitude - loc.lat) <= 1 / 111.0::DOUBLE AND "
          f"abs(inc.longitude - loc.lon) <= 0.013 AND {_LOC_KM} <= 1")


def _cell(digits, lat="latitude", lon="longitude"):
    scale = f"{float(10 ** digits)!r}::DOUBLE"
    part = "CAST(floor({} * " + scale + " + 0.5) AS BIGINT)"
    return f"({part.format(lat)} || '_' || {part.format(lon)})"


_AGE = f"(DATE '{AS_OF}' - CAST(occurred_at AS DATE))"
_DECAY = f"(CASE WHEN {_AGE} < 30 THEN 10 WHEN {_AGE} < 90 THEN 7 ELSE 4 END)"
_GROUPS = ("list_filter(['general', CASE WHEN vic_sex = 'F' THEN 'women' END, CASE WHEN "
           "vic_age_group = '<18' THEN 'children' END, CASE WHEN vic_age_group = '65+' THEN "
           "'elderly' END], lambda v: v IS NOT NULL)")
_FACTOR = "(CASE WHEN {a} < 30 THEN 1.0::DOUBLE WHEN {a} < 90 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END)"


def _risk_sql(source, digits=3):
    return f"""
e AS (SELECT {_cell(digits)} AS grid_cell_id, {time_bucket('hour_of_day')} AS hour_bucket,
  CASE WHEN day_of_week >= 5 THEN 'weekend' ELSE 'weekday' END AS day_type, crime_category,
  {_DECAY} AS decay, {_AGE} AS age, unnest({_GROUPS}) AS demographic_group FROM {source}),
pc AS (SELECT grid_cell_id, hour_bucket, day_type, demographic_group, crime_category,
  count(*) AS n, sum(decay) AS dec, min(age) AS age FROM e GROUP BY ALL),
risk AS (SELECT grid_cell_id, hour_bucket, day_type, demographic_group,
  CAST(sum(n) AS BIGINT) AS raw_crime_count, sum(dec) / 10.0::DOUBLE AS weighted_crime_count,
  {counts_json('crime_category', 'n')} AS crime_breakdown,
  sum(dec * ({_tenths('demographic_group', 'crime_category')})) / 100.0::DOUBLE AS risk_score,
  round(sum(n) / (sum(n) + 10.0::DOUBLE) * {_FACTOR.format(a='min(age)')}, 6) AS confidence
  FROM pc GROUP BY 1, 2, 3, 4)"""


def _shown(table):
    return table.withColumns({"crime_breakdown": F.to_json("crime_breakdown"),
                              "confidence": F.round("confidence", 6)})


@query("d1_risk_table", sql("inc", f"@{_risk_sql('inc')} SELECT * FROM risk"))
def d1(spark, d):
    return _shown(risk.risk_table(fx.incidents(spark, d), AS_OF))


@query("d2_time_decay", sql("inc", f"""
SELECT incident_id, {_DECAY} / 10.0::DOUBLE AS weight FROM inc"""))
def d2(spark, d):
    return fx.incidents(spark, d).select("incident_id", (
        risk.decay_tenths(F.col("occurred_at"), AS_OF) / F.lit(10.0)).alias("weight"))


@query("d3_victim_matched_counts", sql("inc", f"""@
e AS (SELECT borough, unnest({_GROUPS}) AS demographic_group FROM inc)
SELECT borough, demographic_group, count(*) AS count FROM e GROUP BY 1, 2"""))
def d3(spark, d):
    return risk.group_counts(fx.incidents(spark, d), ["borough"])


_VECTOR = f"""
v AS (SELECT loc_id, any_value(demographic_group) AS demographic_group, any_value(amenity_type)
  AS amenity_type, {', '.join(f"count(*) FILTER (crime_category = '{c}') AS {c}"
                              for c in rules.CATEGORIES)}
  FROM loc LEFT JOIN inc ON {ONE_KM} GROUP BY 1)"""


@query("d4_risk_vectors", sql("inc loc", f"""@{_VECTOR}
SELECT loc_id, {', '.join(rules.CATEGORIES)} FROM v"""))
def d4(spark, d):
    return risk.risk_vectors(fx.locations(spark, d), fx.incidents(spark, d)).select(
        "loc_id", *rules.CATEGORIES)


_PEOPLE, _HOUR = "(loc_id % 4 + 1)", "(loc_id % 24)"
_VENUE = "(CASE WHEN loc_id % 2 = 0 THEN 'Bar' ELSE 'Park' END)"
_LATE, _NIGHT = f"{_HOUR} >= 22", f"({_HOUR} >= 22 OR {_HOUR} < 6)"
_EXPOSURE = f"""CASE
  WHEN demographic_group = 'children' AND {_PEOPLE} <= 1 THEN 2.0::DOUBLE
  WHEN demographic_group = 'children' AND {_VENUE} = 'Park' AND NOT {_NIGHT} THEN 0.5::DOUBLE
  WHEN demographic_group = 'women' AND {_VENUE} = 'Bar' AND {_LATE} AND {_PEOPLE} <= 1
    THEN 1.5::DOUBLE
  WHEN demographic_group = 'women' AND {_VENUE} = 'Bar' AND {_LATE} THEN 0.8::DOUBLE
  WHEN demographic_group = 'elderly' AND {_PEOPLE} <= 1 AND {_NIGHT} THEN 1.8::DOUBLE
  ELSE 1.0::DOUBLE END"""


def visits(spark, d):
    """Locations as planned visits: group, company, venue and hour."""
    k = F.col("loc_id")
    out = fx.locations(spark, d).withColumns({
        "people": k % 4 + 1, "venue": F.when(k % 2 == 0, "Bar").otherwise("Park"),
        "hour": k % 24})
    return out.withColumn("exposure", risk.exposure(
        F.col("demographic_group"), F.col("people"), F.col("venue"), F.col("hour")))


@query("d5_exposure", sql("loc", f"SELECT loc_id, {_EXPOSURE} AS exposure FROM loc"))
def d5(spark, d):
    return visits(spark, d).select("loc_id", "exposure")


def _weighted(c):
    return f"{c} * ({_tenths('demographic_group', quoted(c))})"


_TOTAL = " + ".join(_weighted(c) for c in rules.CATEGORIES)
_MOST = f"greatest({', '.join(_weighted(c) for c in rules.CATEGORIES)})"
_PERSONAL = f"""{_VECTOR},
pr AS (SELECT loc_id, {' + '.join(rules.CATEGORIES)} AS incident_count,
  ({_TOTAL}) * {_EXPOSURE} / 10.0::DOUBLE AS personal_risk,
  CASE WHEN {_TOTAL} > 0 THEN {cases([(c, quoted(c)) for c in rules.CATEGORIES],
                                     lambda c: f"{_weighted(c)} = {_MOST}", "NULL")} END
  AS dominant_risk FROM v)"""


def personal(spark, d):
    vectors = risk.risk_vectors(visits(spark, d), fx.incidents(spark, d))
    return risk.personal_risk(vectors)


@query("d6_personal_risk", sql("inc loc", f"""@{_PERSONAL}
SELECT loc_id, incident_count, round(personal_risk, 6) AS personal_risk, dominant_risk,
  round(incident_count / (incident_count + 10.0::DOUBLE), 6) AS confidence FROM pr"""))
def d6(spark, d):
    return personal(spark, d).select(
        "loc_id", "incident_count", F.round("personal_risk", 6).alias("personal_risk"),
        "dominant_risk", F.round(risk.confidence(F.col("incident_count"), F.lit(0)), 6)
        .alias("confidence"))


@query("d7_compare_places", sql("inc loc", f"""@{_PERSONAL}
SELECT loc_id, loc_id // 5 AS request_id, dominant_risk, CAST(row_number() OVER w AS INTEGER)
  AS rank, first_value(loc_id) OVER w AS safer_choice FROM pr
WINDOW w AS (PARTITION BY loc_id // 5 ORDER BY personal_risk, loc_id)"""))
def d7(spark, d):
    rows = personal(spark, d).withColumn("request_id", F.floor(F.col("loc_id") / 5))
    return risk.compare_places(rows, "request_id").select(
        "loc_id", "request_id", "dominant_risk", "rank", "safer_choice")


_BUCKET_COUNTS = ", ".join(f"count(*) FILTER (hour_of_day BETWEEN {a} AND {b}) AS {n}"
                           for n, a, b in rules.TIME_BUCKETS)


@query("d8_safe_times", sql("inc loc", f"""@
t AS (SELECT loc_id, {_BUCKET_COUNTS} FROM loc LEFT JOIN inc ON {ONE_KM} GROUP BY 1)
SELECT *, {cases([(n, quoted(n)) for n, _, _ in rules.TIME_BUCKETS],
                 lambda n: f"{n} = least(morning, afternoon, evening, night)", "NULL")}
  AS safest_window FROM t"""))
def d8(spark, d):
    return risk.safe_times(fx.locations(spark, d), fx.incidents(spark, d))


@query("d9_confidence", sql("inc", f"""@
n AS (SELECT {_cell(2)} AS grid_cell_id, count(*) AS n, min({_AGE}) AS age FROM inc GROUP BY 1)
SELECT grid_cell_id, round(n / (n + 10.0::DOUBLE) * {_FACTOR.format(a='age')}, 6) AS confidence
FROM n"""))
def d9(spark, d):
    age = F.date_diff(F.lit(AS_OF).cast("date"), "occurred_at")
    cell = risk.cell_id(F.col("latitude"), F.col("longitude"), 2)
    return fx.incidents(spark, d).groupBy(cell.alias("grid_cell_id")).agg(
        F.round(risk.confidence(F.count("*"), F.min(age)), 6).alias("confidence"))


#: Which incidents are those of the last ingest; by id, so that undated ones are in one half too.
_IS_NEW = "CAST(incident_id AS BIGINT) % 7 = 3"
_OLD = f"old AS (SELECT * FROM inc WHERE NOT ({_IS_NEW}))"
_NEW = f"new AS (SELECT * FROM inc WHERE {_IS_NEW})"


def halves(spark, d):
    df = fx.incidents(spark, d)
    return df.filter(f"NOT ({_IS_NEW})"), df.filter(_IS_NEW)


@query("d10_stale_cells", sql("inc", f"""@{_OLD}, {_NEW},{_risk_sql('old', 2)}
SELECT grid_cell_id, hour_bucket, day_type, demographic_group, raw_crime_count FROM risk
WHERE grid_cell_id IN (SELECT {_cell(2)} FROM new)"""))
def d10(spark, d):
    old, new = halves(spark, d)
    return risk.stale_cells(risk.risk_table(old, AS_OF, 2), new, 2).select(
        "grid_cell_id", "hour_bucket", "day_type", "demographic_group", "raw_crime_count")


@query("d10_refreshed_risk", sql("inc", f"""@{_risk_sql('inc')}
SELECT * FROM risk"""))
def d10_refresh(spark, d):
    """Table of the older incidents brought up to date: equal to a full rebuild."""
    old, new = halves(spark, d)
    table = risk.risk_table(old, AS_OF)
    return _shown(risk.refresh_risk(table, old, new, AS_OF))


@query("d10_refreshed_from_marks", sql("inc", f"""@{_risk_sql('inc')}
SELECT * FROM risk"""))
def d10_marks(spark, d):
    """The stream's marks say which cells to compute anew; the result equals a full rebuild."""
    old, new = halves(spark, d)
    feed, marks = scratch_folder(spark, "feed"), scratch_folder(spark, "marks")
    rows = new.select("incident_id", "occurred_at", "latitude", "longitude")
    rows.write.parquet(feed)
    stream = spark.readStream.schema(rows.schema).parquet(feed)
    incremental.run_marking(stream, marks, scratch_folder(spark, "state"))
    touched = spark.read.schema("grid_cell_id STRING").parquet(marks)
    return _shown(risk.refresh_cells(risk.risk_table(old, AS_OF), fx.incidents(spark, d), touched, AS_OF))


@query("d10_risk_from_streamed_counts", sql("inc", f"""@{_risk_sql('inc')}
SELECT * FROM risk"""))
def d10_streamed_risk(spark, d):
    """The stream takes the older incidents, then the new ones; the cells that changed are taken from its
    totals, and the table equals a full rebuild."""
    old, new = halves(spark, d)
    feed, totals, state = (scratch_folder(spark, n) for n in ("feed", "totals", "state"))
    old.write.parquet(feed)
    stream = spark.readStream.schema(old.schema).parquet(feed)
    incremental.run_day_counts(stream, totals, state)
    table = stored(risk.risk_from_counts(incremental.current_totals(spark, totals), AS_OF))
    before = incremental.last_batch(spark, totals)
    new.write.mode("append").parquet(feed)
    incremental.run_day_counts(stream, totals, state)
    touched = stored(incremental.changed_cells(spark, totals, before))
    return _shown(risk.refresh_from_counts(
        table, incremental.current_totals(spark, totals, touched), touched, AS_OF))


@query("d10_streamed_cell_counts", sql("inc", f"""@
n AS (SELECT {_cell(2)} AS grid_cell_id, date_trunc('day', occurred_at) AS w, count(*) AS count
  FROM inc WHERE occurred_at IS NOT NULL GROUP BY 1, 2)
SELECT grid_cell_id, strftime(w, '%Y-%m-%d') AS window_start, count,
  (SELECT count(DISTINCT {_cell(3)}) FROM inc) AS cells_marked
FROM n WHERE w + INTERVAL 1 DAY <= (SELECT max(occurred_at) FROM inc) - INTERVAL 2 DAY"""))
def d10_stream(spark, d):
    """Incident files read as a stream; copies dropped, windows counted, touched cells marked.

    Windows younger than the two-day delay are still open and not written yet.
    """
    feed, out, marks = (scratch_folder(spark, n) for n in ("feed", "windows", "marks"))
    rows = fx.incidents(spark, d).select("incident_id", "occurred_at", "latitude", "longitude")
    rows.write.parquet(feed)
    stream = spark.readStream.schema(rows.schema).parquet(feed)
    incremental.run_counts(stream, out, scratch_folder(spark, "state"))
    incremental.run_marking(stream, marks, scratch_folder(spark, "state"))
    touched = spark.read.parquet(marks).groupBy().agg(
        F.count_distinct("grid_cell_id").alias("cells_marked"))
    windows = spark.read.schema("grid_cell_id STRING, window_start TIMESTAMP, count BIGINT"
                                ).parquet(out)
    return windows.withColumns({
        "window_start": F.date_format("window_start", "yyyy-MM-dd"),
        "cells_marked": touched.scalar()})


@query("d11_amenity_freshness", f"""
SELECT s_name AS name, CAST(DATE '{AS_OF}' - (DATE '2024-01-01' + CAST(s_suppkey % 60 AS INTEGER))
  AS INTEGER) AS age_days, CASE WHEN DATE '{AS_OF}' - (DATE '2024-01-01' +
  CAST(s_suppkey % 60 AS INTEGER)) < 30 THEN 'fresh' ELSE 'stale' END AS freshness FROM supplier""")
def d11(spark, d):
    return risk.amenity_freshness(verified(spark, d), AS_OF).select(
        "name", "age_days", "freshness")


def verified(spark, d):
    """Amenities with the day they were last verified and how often."""
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(
        F.col("s_name").alias("name"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))
        .alias("last_verified_at"), (k % 5).alias("verification_count"))


_MERGED = f"""
WITH am AS (SELECT s_name AS name, DATE '2024-01-01' + CAST(s_suppkey % 60 AS INTEGER) AS t,
  s_suppkey % 5 AS n FROM supplier),
seen AS (SELECT 'Supplier#' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0') AS name,
  max(DATE '2024-02-01' + CAST(c_custkey % 20 AS INTEGER)) AS t, count(*) AS n
  FROM customer GROUP BY 1)
SELECT coalesce(am.name, seen.name) AS name,
  strftime(greatest(am.t, seen.t), '%Y-%m-%d') AS last_verified_at,
  coalesce(am.n, 0) + coalesce(seen.n, 0) AS verification_count
FROM am FULL JOIN seen ON am.name = seen.name"""


def sightings(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(
        F.concat(F.lit("Supplier#"), F.lpad((k % 120).cast("string"), 9, "0")).alias("name"),
        F.date_add(F.lit("2024-02-01").cast("date"), (k % 20).cast("int")).alias("seen_at"))


@query("d11_merge_verified", _MERGED)
def d11_merge(spark, d):
    return risk.merge_verified(verified(spark, d), sightings(spark, d)).withColumn(
        "last_verified_at", F.date_format("last_verified_at", "yyyy-MM-dd"))


@query("d11_merge_written", _MERGED)
def d11_written(spark, d):
    """The same merge into a written table, read back after two runs of the same batch."""
    path = scratch_folder(spark, "verified")
    risk.write_verified(verified(spark, d), path)
    for _ in range(2):
        risk.merge_written(spark, path, sightings(spark, d), batch=1)
    return risk.read_verified(spark, path).select(
        "name", F.date_format("last_verified_at", "yyyy-MM-dd").alias("last_verified_at"), "verification_count")


@query("d12_between_cities", sql("inc", f"""@
s AS (SELECT borough AS city, {_cell(2)} AS grid_cell_id, {_SCORE} AS v FROM inc GROUP BY 1, 2)
SELECT city, grid_cell_id, round(v, 6) AS safety_score, round(percent_rank() OVER (PARTITION BY city
  ORDER BY v), 6) AS percentile FROM s"""))
def d12(spark, d):
    """Boroughs stand for cities."""
    cell = risk.cell_id(F.col("latitude"), F.col("longitude"), 2)
    scores = zones.zone_scores(fx.incidents(spark, d).withColumn(
        "zone", F.struct(F.col("borough").alias("city"), cell.alias("grid_cell_id")))).select(
        "zone.city", "zone.grid_cell_id", "safety_score")
    return risk.normalise_between_cities(scores).select(
        "city", "grid_cell_id", F.round("safety_score", 6).alias("safety_score"),
        F.round("percentile", 6).alias("percentile"))


@query("d13_extra_layers", sql("inc am loc", f"""@
e AS (SELECT {_cell(2)} AS grid_cell_id, 'incidents' AS layer FROM inc
  UNION ALL SELECT {_cell(2)}, 'transit' FROM am WHERE type = 'subway'
  UNION ALL SELECT {_cell(2, 'lat', 'lon')}, 'requests' FROM loc)
SELECT grid_cell_id, count(*) FILTER (layer = 'incidents') AS incidents,
  count(*) FILTER (layer = 'transit') AS transit, count(*) FILTER (layer = 'requests') AS requests
FROM e GROUP BY 1"""))
def d13(spark, d):
    """Incidents, transit stops and requests per cell; 311 and lighting tables join the same way."""
    return risk.layer_counts({
        "incidents": fx.incidents(spark, d),
        "transit": fx.amenities(spark, d).filter(F.col("type") == "subway"),
        "requests": fx.locations(spark, d).withColumnsRenamed(
            {"lat": "latitude", "lon": "longitude"})})


_KINDS = f"[{', '.join(quoted(k) for k in rules.SERVICE_REQUEST_KINDS)}, 'Rodent', NULL]"
_N_KINDS = len(rules.SERVICE_REQUEST_KINDS) + 2


@query("d13_requests_and_lights", f"""
WITH r AS (SELECT (4050000 + (o_orderkey * 17) % 40000) / 1e5 AS latitude,
  (-7420000 + (o_orderkey * 31) % 45000) / 1e5 AS longitude FROM orders
  WHERE o_orderkey % 19 <> 0 AND ({_KINDS})[CAST(o_orderkey % {_N_KINDS} AS INTEGER) + 1] <> 'Rodent'),
l AS (SELECT (4050000 + (p_partkey * 19) % 40000) / 1e5 AS latitude,
  (-7420000 + (p_partkey * 37) % 45000) / 1e5 AS longitude FROM part WHERE p_partkey % 23 <> 0),
e AS (SELECT {_cell(2)} AS grid_cell_id, 'requests' AS layer FROM r UNION ALL SELECT {_cell(2)}, 'lights' FROM l)
SELECT grid_cell_id, count(*) FILTER (layer = 'requests') AS requests,
  count(*) FILTER (layer = 'lights') AS lights FROM e GROUP BY 1""")
def d13_files(spark, d):
    """Service requests and street lights, written as the city's files and read back, per cell."""
    requests, lights = scratch_folder(spark, "requests"), scratch_folder(spark, "lights")
    fx.service_requests(spark, d).write.option("header", True).csv(requests)
    fx.street_lights(spark, d).write.option("header", True).csv(lights)
    return risk.layer_counts({"requests": city_layers.read_service_requests(spark, requests),
                              "lights": city_layers.read_street_lights(spark, lights)})


@query("d14_tree_importance")
def d14(spark, d):
    return classify.tree_importance(
        fx.incidents(spark, d), rules.DEMOGRAPHIC_COLUMNS,
        ["latitude", "longitude", "hour_of_day", "day_of_week"])


@query("d14_importance_of_given_forest", sql("inc", f"""@{FOREST_TOP},{FOREST_LEAVES},
cnt AS (SELECT t, node, crime_category, count(*) AS n FROM (
  SELECT 0 AS t, unnest(p0) AS node, crime_category FROM walk UNION ALL
  SELECT 1, unnest(p1), crime_category FROM walk) GROUP BY 1, 2, 3),
g AS (SELECT t, node, sum(n) - sum(n * n) / sum(n) AS mass FROM cnt GROUP BY 1, 2),
sp(t, node, l, r, feature) AS (VALUES (0, 0, 1, 2, 'latitude'), (0, 1, 3, 4, 'longitude'),
  (0, 2, 5, 6, 'hour_of_day'), (1, 0, 1, 2, 'longitude'), (1, 2, 3, 4, 'latitude')),
dr AS (SELECT sp.t, feature, g.mass - coalesce(x.mass, 0) - coalesce(y.mass, 0) AS gain FROM sp JOIN g USING (t, node)
  LEFT JOIN g x ON x.t = sp.t AND x.node = l LEFT JOIN g y ON y.t = sp.t AND y.node = r),
sh AS (SELECT feature, gain / sum(gain) OVER (PARTITION BY t) AS s FROM dr)
SELECT feature, round(sum(s) / (SELECT sum(s) FROM sh), 6) AS importance FROM sh GROUP BY 1"""))
def d14_given(spark, d):
    """How far a given forest's splits part the categories of the five commonest offenses."""
    rows = labelled(spark, d)
    found = forest.importance_for(rows, stored(given_forest(rows)), GIVEN_FEATURES, 2, "crime_category")
    return found.select("feature", F.round("importance", 6).alias("importance"))


@query("d15_score_rollup", sql("inc", f"""
SELECT borough, {_cell(1)} AS grid_cell_id, CAST(grouping(borough) * 2 + grouping({_cell(1)})
  AS BIGINT) AS level, count(*) AS crime_count, round({_SCORE}, 6) AS safety_score
FROM inc GROUP BY ROLLUP (borough, {_cell(1)})"""))
def d15(spark, d):
    cells = fx.incidents(spark, d).withColumn(
        "grid_cell_id", risk.cell_id(F.col("latitude"), F.col("longitude"), 1))
    return risk.score_rollup(cells, ["borough", "grid_cell_id"]).withColumn(
        "safety_score", F.round("safety_score", 6))


@query("d16_trend", sql("inc", """@
n AS (SELECT borough, date_trunc('week', occurred_at) AS w, count(*) AS count FROM inc
  WHERE occurred_at IS NOT NULL GROUP BY 1, 2)
SELECT borough, strftime(w, '%Y-%m-%d') AS period, count,
  count - lag(count) OVER (PARTITION BY borough ORDER BY w) AS change FROM n"""))
def d16(spark, d):
    """By week: the test data covers one month."""
    return risk.trend(fx.incidents(spark, d), ["borough"], "week").withColumn(
        "period", F.date_format("period", "yyyy-MM-dd"))


_K = f"sum(n * exp(power({haversine('lat', 'lon', 'y', 'x')}, 2) / (-2 * power(1.11::DOUBLE, 2))))"


@query("d17_density_by_category", sql("inc", f"""@{_NODES.replace(
    "s AS (SELECT latitude AS y, longitude AS x, count(*) AS n FROM inc GROUP BY 1, 2)",
    "s AS (SELECT crime_category, latitude AS y, longitude AS x, count(*) AS n FROM inc "
    "GROUP BY 1, 2, 3)")},
k AS (SELECT crime_category, i, j, {_K} AS kernel FROM node JOIN s ON true GROUP BY 1, 2, 3),
c AS (SELECT crime_category, count(*) AS total FROM inc GROUP BY 1),
dens AS (SELECT crime_category, i, j, kernel * (total / sum(kernel) OVER (PARTITION BY
  crime_category)) * (2500 / 783.8::DOUBLE) AS density FROM k JOIN c USING (crime_category)),
lim AS (SELECT crime_category, quantile_cont(density, 0.33) AS low_max, quantile_cont(density, 0.67)
  AS medium_max FROM dens GROUP BY 1)
SELECT crime_category, i, j, round(density, 6) AS density, CASE WHEN density <= low_max THEN 'Low'
  WHEN density <= medium_max THEN 'Medium' ELSE 'High' END AS classification
FROM dens JOIN lim USING (crime_category)"""))
def d17(spark, d):
    grid = D.density_grid(fx.incidents(spark, d), by=["crime_category"])
    return grid.select("crime_category", "i", "j", F.round("density", 6).alias("density"), "classification")


VIEWS["decayed"] = hotspot_view(f"sum({_DECAY})", 100)
NEEDS["decayed"] = ["raw", "typed", "inc"]


@query("d18_decayed_hotspots", sql("decayed", """
SELECT cluster, count(*) AS spots, CAST(sum(w) AS BIGINT) AS tenths
FROM lab JOIN spots ON lab.id = spots.id GROUP BY 1"""))
def d18(spark, d):
    """Hotspots where an old incident counts for less; weights in whole tenths."""
    df = fx.incidents(spark, d).withColumn("decay", risk.decay_tenths(F.col("occurred_at"), AS_OF))
    spots = H.density_clusters(df, H.sphere_for(df, 0.5), 100, weight="decay")
    return spots.groupBy("cluster").agg(
        F.count("*").alias("spots"), F.sum("w").alias("tenths"))
