"""Clusters, zones, density and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import classify, forest
from ..operators import density as D
from ..operators import evaluate as E
from ..operators import hotspots as H
from ..operators import stats, zones
from ..session import stored
from ..sources import fixtures as fx
from .base import counts_json, haversine, list_text, modal, severity_points, sql
from .registry import query
from .statistics import as_text, hotspots, quadrants, zoned

_MODELS = {}


def model(spark, d, name, fit):
    """A fitted model, kept for the session like the stored tables."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MODELS:
        _MODELS[key] = fit()
    return _MODELS[key]


def crime_zones(spark, d):
    return model(spark, d, "zones", lambda: zones.fit_crime_zones(fx.incidents(spark, d)))


def zoned_by_model(spark, d):
    return fx.kept(spark, d, "zoned", lambda: zones.assign(
        crime_zones(spark, d), fx.incidents(spark, d)))


def demographic_zones(spark, d):
    return model(spark, d, "demographic",
                 lambda: zones.fit_demographic_zones(fx.incidents(spark, d)))


def demographic_rows(spark, d):
    """Incidents with their demographic zone; no rows where there is no model."""
    def build():
        known = zones.with_demographics(fx.incidents(spark, d))
        fitted = demographic_zones(spark, d)
        if fitted is None:
            return known.limit(0).withColumn("zone", F.lit(None).cast("int"))
        return zones.assign(fitted, known)

    return fx.kept(spark, d, "demographic", build)


def density(spark, d):
    return fx.kept(spark, d, "density", lambda: D.density_grid(fx.incidents(spark, d)))


# --- crime zones ----------------------------------------------------------------------------

@query("m1_crime_zones")
def m1(spark, d):
    """Centre and size of the thirty fitted zones."""
    return zones.zone_centres(zoned_by_model(spark, d))


@query("m1_rows_in_the_nearest_zone", sql("inc", """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_elsewhere FROM inc"""))
def m1_nearest(spark, d):
    """Every incident is in the zone of its nearest fitted centre."""
    return zones.misplaced(crime_zones(spark, d), fx.incidents(spark, d))


@query("m2_assign_zones")
def m2(spark, d):
    moved = fx.locations(spark, d).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    return zones.assign(crime_zones(spark, d), moved).select("loc_id", "zone")


_CENTRES = """
c AS (SELECT zone, avg(latitude) AS center_lat, avg(longitude) AS center_lon FROM zon GROUP BY 1),
s AS (SELECT stddev_pop(latitude) AS sy, stddev_pop(longitude) AS sx FROM inc)"""


@query("m2_assign_to_given_centres", sql("loc zon", f"""@{_CENTRES},
r AS (SELECT loc_id, zone, power((lat - center_lat) / sy, 2) + power((lon - center_lon) / sx, 2)
  AS dist FROM loc JOIN c ON true JOIN s ON true)
SELECT loc_id, arg_min(zone, (dist, zone)) AS zone FROM r GROUP BY loc_id"""))
def m2_given(spark, d):
    """The same assignment with given centres, in standardised space."""
    centres = zones.zone_centres(zoned(spark, d))
    scale = zones.moments(fx.incidents(spark, d), zones.COORDINATES)
    moved = fx.locations(spark, d).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    return zones.assign_to_centres(moved, centres, scale).select("loc_id", "zone")


_SCORE = (f"greatest(0, least(100, 100 - sum({severity_points('crime_type')}) / "
          "(count(*) * 10.0::DOUBLE) * 100))")


@query("m3_zone_scores", sql("zon", f"""
SELECT zone, count(*) AS crime_count, round({_SCORE}, 6) AS safety_score FROM zon GROUP BY 1"""))
def m3(spark, d):
    return zones.zone_scores(zoned(spark, d)).withColumn(
        "safety_score", F.round("safety_score", 6))


@query("m3_zone_scores_by_model")
def m3_model(spark, d):
    return zones.zone_scores(zoned_by_model(spark, d))


_TOP3 = f"""
n AS (SELECT zone, crime_type, count(*) AS c, row_number() OVER (PARTITION BY zone
        ORDER BY count(*) DESC, crime_type) AS r FROM zon GROUP BY 1, 2),
top AS (SELECT zone, {list_text('crime_type', 'c')} AS common_crimes,
          any_value(crime_type) FILTER (r = 1) AS dominant_crime FROM n WHERE r <= 3 GROUP BY 1)"""


@query("m4_zone_offenses", sql("zon", f"@{_TOP3} SELECT * FROM top"))
def m4(spark, d):
    return zones.zone_offenses(zoned(spark, d)).withColumn(
        "common_crimes", as_text(F.col("common_crimes")))


# --- hotspots -------------------------------------------------------------------------------

@query("m5_hotspots_by_quadrant", sql("quad", """
SELECT incident_id, quadrant, cluster, core FROM quad"""))
def m5(spark, d):
    return quadrants(spark, d).select("incident_id", "quadrant", "cluster", "core")


@query("m6_cluster_profiles", sql("quad", f"""@
n AS (SELECT cluster, crime_type, count(*) AS c, row_number() OVER (PARTITION BY cluster
        ORDER BY count(*) DESC, crime_type) AS r FROM quad WHERE cluster <> -1 GROUP BY 1, 2),
top AS (SELECT cluster, {list_text('crime_type', 'c')} AS common_crimes,
          any_value(crime_type) FILTER (r = 1) AS dominant_crime FROM n WHERE r <= 5 GROUP BY 1)
SELECT q.cluster AS cluster, quadrant, round(avg(latitude), 6) AS center_lat,
  round(avg(longitude), 6) AS center_lon, count(*) AS crime_count, common_crimes, dominant_crime
FROM quad q JOIN top USING (cluster) GROUP BY ALL"""))
def m6(spark, d):
    return H.cluster_profiles(quadrants(spark, d), ("cluster", "quadrant")).withColumns({
        "center_lat": F.round("center_lat", 6), "center_lon": F.round("center_lon", 6),
        "common_crimes": as_text(F.col("common_crimes"))})


@query("m7_hotspots", sql("hot", "SELECT incident_id, cluster, core FROM hot"))
def m7(spark, d):
    return hotspots(spark, d).select("incident_id", "cluster", "core")


_S_DIST = haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude",
                    rules.HOTSPOT_EARTH_KM)


@query("m7_neighbour_weights", sql("inc", f"""@
s AS (SELECT latitude, longitude, count(*) AS w FROM inc GROUP BY 1, 2)
SELECT a.latitude AS latitude, a.longitude AS longitude, CAST(sum(b.w) AS BIGINT) AS total,
  sum(b.w) >= 10 AS core
FROM s a JOIN s b ON abs(a.latitude - b.latitude) <= 0.0046
  AND abs(a.longitude - b.longitude) <= 0.0062 AND {_S_DIST} <= 0.5 GROUP BY 1, 2"""))
def m7_weights(spark, d):
    df = fx.incidents(spark, d)
    return H.core_spots(df, H.sphere_for(df, 0.5), 10)


@query("m8_hotspot_profiles", sql("hot", f"""@
h AS (SELECT * FROM hot WHERE cluster <> -1)
SELECT cluster, latitude, longitude, crime_count, ofns_desc, law_cat_cd
FROM (SELECT cluster, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude,
  count(*) AS crime_count FROM h GROUP BY 1)
JOIN {modal('h', 'cluster', 'ofns_desc')} USING (cluster)
JOIN {modal('h', 'cluster', 'law_cat_cd')} USING (cluster)"""))
def m8(spark, d):
    return H.hotspot_profiles(hotspots(spark, d)).withColumns({
        "latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})


# --- demographic zones ----------------------------------------------------------------------

@query("m9_demographic_zones")
def m9(spark, d):
    """One row per fitted zone; none below 1,000 usable incidents."""
    return zones.zone_centres(demographic_rows(spark, d))


@query("m9_centres_of_given_zones", sql("zon", """
SELECT zone, round(avg(latitude), 6) AS center_lat, round(avg(longitude), 6) AS center_lon, count(*) AS crime_count
FROM zon WHERE vic_age_group IS NOT NULL AND vic_race IS NOT NULL AND vic_sex IS NOT NULL GROUP BY zone"""))
def m9_given(spark, d):
    """The zone table's centres, of the rows that demographic zones are made of."""
    return zones.zone_centres(zones.with_demographics(zoned(spark, d))).withColumns({
        c: F.round(c, 6) for c in ("center_lat", "center_lon")})


_ATTRIBUTES = " UNION ALL ".join(
    f"SELECT zone, '{c}' AS attribute, {c} AS value, count(*) AS c FROM zon WHERE {c} IS NOT NULL "
    "GROUP BY 1, 3" for c in rules.DEMOGRAPHIC_COLUMNS)
_PROFILES = f"""
f AS ({_ATTRIBUTES}),
prof AS (SELECT zone, attribute, arg_min(value, (-c, value)) AS dominant_value,
  max(c) / sum(c) * 100 AS concentration, {counts_json('value', 'c')} AS value_counts
  FROM f GROUP BY 1, 2)"""


@query("m10_zone_profiles", sql("zon", f"""@{_PROFILES}
SELECT zone, attribute, dominant_value, round(concentration, 6) AS concentration, value_counts
FROM prof"""))
def m10(spark, d):
    return zones.demographic_profiles(zoned(spark, d)).withColumns({
        "concentration": F.round("concentration", 6), "value_counts": F.to_json("value_counts")})


@query("m10_zone_profiles_by_model")
def m10_model(spark, d):
    return zones.demographic_profiles(demographic_rows(spark, d)).withColumn(
        "value_counts", F.to_json("value_counts"))


def people(spark, d):
    """Locations with the attributes of a person; some lack one."""
    k = F.col("loc_id")
    return fx.locations(spark, d).select(
        "loc_id", "lat", "lon", fx.pick(["18-24", "25-44", "65+", None], k % 4)
        .alias("vic_age_group"), fx.pick(["BLACK", "WHITE", "UNKNOWN"], k % 3).alias("vic_race"),
        fx.pick(["F", "M"], k % 2).alias("vic_sex"))


def numbered_zones(spark, d):
    """Incidents with a fixed square zone that has a number."""
    part = lambda c: F.floor(F.col(c) / F.lit(0.1)).cast("long")
    return fx.incidents(spark, d).withColumn("zone", part("latitude") * 10_000 + part("longitude"))


NUMBERED = """
num AS (SELECT * REPLACE (CAST(floor(latitude / 0.1::DOUBLE) AS BIGINT) * 10000 +
  CAST(floor(longitude / 0.1::DOUBLE) AS BIGINT) AS zone) FROM zon)"""


@query("m11_nearest_of_given_zones", sql("zon loc", f"""@{NUMBERED},
c AS (SELECT zone, avg(latitude) AS y, avg(longitude) AS x FROM num GROUP BY zone)
SELECT loc_id, CAST(arg_min(zone, ({haversine('lat', 'lon', 'y', 'x')}, zone)) AS INTEGER) AS demographic_zone,
  'centre' AS source FROM loc JOIN c ON true GROUP BY loc_id"""))
def m11_given(spark, d):
    """Without a model a person's zone is that of the nearest centre."""
    centres = zones.zone_centres(numbered_zones(spark, d))
    return zones.predict_demographic_zone(None, centres, people(spark, d)).select(
        "loc_id", "demographic_zone", "source")


@query("m11_predict_demographic_zone")
def m11(spark, d):
    centres = zones.zone_centres(demographic_rows(spark, d))
    found = zones.predict_demographic_zone(demographic_zones(spark, d), centres, people(spark, d))
    return found.select("loc_id", "demographic_zone", "source")


@query("m12_attribute_importance", sql("zon", f"""@
f AS ({_ATTRIBUTES}),
g AS (SELECT attribute, c, sum(c) OVER (PARTITION BY attribute, zone) AS nz,
  sum(c) OVER (PARTITION BY attribute, value) AS nv, sum(c) OVER (PARTITION BY attribute) AS nt
  FROM f),
h AS (SELECT attribute, sum(c * c / (nz * nt)::DOUBLE) AS w, sum(c * nv / (nt * nt)::DOUBLE) AS o
  FROM g GROUP BY 1)
SELECT attribute, CASE attribute WHEN 'vic_age_group' THEN 0.35::DOUBLE
  WHEN 'vic_race' THEN 0.4::DOUBLE ELSE 0.25::DOUBLE END AS stated_importance,
  round((w - o) / (1 - o), 6) AS measured_importance FROM h"""))
def m12(spark, d):
    return zones.attribute_importance(zoned(spark, d)).withColumn(
        "measured_importance", F.round("measured_importance", 6))


# --- density --------------------------------------------------------------------------------

_NODES = """
node AS (SELECT i, j, 40.4::DOUBLE + i * ((41.0::DOUBLE - 40.4::DOUBLE) / 49) AS lat,
  -74.3::DOUBLE + j * ((-73.7::DOUBLE - -74.3::DOUBLE) / 49) AS lon
  FROM range(50) a(i), range(50) b(j)),
s AS (SELECT latitude AS y, longitude AS x, count(*) AS n FROM inc GROUP BY 1, 2)"""
_KM = haversine("lat", "lon", "y", "x")
_PLAIN_A = ("(power(sin((y - lat) / 2), 2) + cos(lat) * cos(y) * power(sin((x - lon) / 2), 2))")
_PLAIN = f"(2 * atan2(sqrt({_PLAIN_A}), sqrt(1 - {_PLAIN_A})))"


def _kernel(distance, bandwidth):
    return f"sum(n * exp(power({distance}, 2) / (-2 * power({bandwidth}::DOUBLE, 2))))"


_GRID = f"""{_NODES},
k AS (SELECT i, j, lat, lon, {_kernel(_KM, 1.11)} AS kernel FROM node JOIN s ON true
      GROUP BY ALL),
dens AS (SELECT i, j, lat, lon, kernel, kernel * ((SELECT count(*) FROM inc) /
  (SELECT sum(kernel) FROM k)) * (2500 / 783.8::DOUBLE) AS density FROM k),
lim AS (SELECT quantile_cont(density, 0.33) AS low_max, quantile_cont(density, 0.67)
  AS medium_max FROM dens),
grid AS (SELECT dens.*, CASE WHEN density <= low_max THEN 'Low' WHEN density <= medium_max
  THEN 'Medium' ELSE 'High' END AS classification FROM dens JOIN lim ON true)"""


@query("m13_kernel_grid", sql("inc", f"""@{_NODES}
SELECT i, j, round({_kernel(_KM, 1.11)}, 6) AS kernel FROM node JOIN s ON true GROUP BY 1, 2"""))
def m13(spark, d):
    return D.kernel_grid(fx.incidents(spark, d)).select(
        "i", "j", F.round("kernel", 6).alias("kernel"))


@query("m13_kernel_grid_plain_degrees", sql("inc", f"""@{_NODES}
SELECT i, j, round({_kernel(_PLAIN, 0.01)}, 6) AS kernel FROM node JOIN s ON true
GROUP BY 1, 2"""))
def m13_plain(spark, d):
    return D.kernel_grid(fx.incidents(spark, d), kernel=D.Kernel("plain")).select(
        "i", "j", F.round("kernel", 6).alias("kernel"))


@query("m14_density_grid", sql("inc", f"""@{_GRID}
SELECT i, j, round(lat, 6) AS lat, round(lon, 6) AS lon, round(density, 6) AS density,
  classification FROM grid"""))
def m14(spark, d):
    return density(spark, d).select(
        "i", "j", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
        F.round("density", 6).alias("density"), "classification")


_ONE = "latitude BETWEEN 40.547 AND 40.553 AND longitude BETWEEN -74.153 AND -74.147"


@query("m14_density_of_one_cluster", sql("inc", f"""@
one AS (SELECT * FROM inc WHERE {_ONE}),{_GRID.replace("FROM inc", "FROM one")}
SELECT i, j, round(density, 6) AS density, density > 0 AS reached, classification FROM grid"""))
def m14_far(spark, d):
    """One small cluster in the city's box: most nodes are far from every incident."""
    grid = D.density_grid(fx.incidents(spark, d).filter(_ONE))
    return grid.select("i", "j", F.round("density", 6).alias("density"),
                       (F.col("density") > 0).alias("reached"), "classification")


_L_KM = haversine("loc.lat", "loc.lon", "y", "x")


@query("m15_density_at_locations", sql("inc loc", f"""@{_GRID},
here AS (SELECT loc_id, {_kernel(_L_KM, 1.11)} * (SELECT sum(density) / sum(kernel) FROM dens)
  AS density FROM loc JOIN s ON true GROUP BY 1)
SELECT loc_id, round(here.density, 6) AS density, CASE WHEN here.density <= low_max THEN 'Low'
  WHEN here.density <= medium_max THEN 'Medium' ELSE 'High' END AS classification,
  round(count(*) FILTER (dens.density < here.density) * 100::DOUBLE / count(*), 6)
  AS density_percentile FROM here JOIN dens ON true JOIN lim ON true GROUP BY ALL"""))
def m15(spark, d):
    found = D.density_at(fx.locations(spark, d).select("loc_id", "lat", "lon"),
                         fx.incidents(spark, d), density(spark, d))
    return found.select("loc_id", F.round("density", 6).alias("density"), "classification",
                        F.round("density_percentile", 6).alias("density_percentile"))


# --- zones of the older analyses, classifier ------------------------------------------------

@query("m16_history_zones")
def m16(spark, d):
    df = fx.incidents(spark, d)
    fitted = zones.fit_crime_zones(df, k=20, n_init=1, standardise=False)
    table = zones.zone_offenses(zones.assign(fitted, df))
    return zones.locate(fitted, fx.locations(spark, d), table).select(
        "loc_id", "zone", "dominant_crime", as_text(F.col("common_crimes")).alias("common"))


@query("m16_zone_offense_matrix", sql("zon", """
SELECT zone, crime_type, count(*) AS count FROM zon GROUP BY 1, 2"""))
def m16_matrix(spark, d):
    return zones.zone_matrix(zoned(spark, d))


@query("m17_race_zones")
def m17(spark, d):
    labelled, fitted = zones.fit_race_zones(fx.incidents(spark, d))
    table = zones.race_zone_table(zones.assign(fitted, labelled))
    found = zones.nearest_centre(fx.locations(spark, d), table)
    return found.select("loc_id", "zone").join(table, "zone").select(
        "loc_id", "zone", "sample_size", F.to_json("racial_composition").alias("composition"))


_RACE = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(vic_race, {word!r})' for word in words)} THEN '{name}'"
    for words, name in rules.RACE_LABELS_4) + " ELSE 'OTHER' END"


@query("m17_races_of_given_zones", sql("zon loc", f"""@{NUMBERED},
lab AS (SELECT zone, latitude, longitude, {_RACE} AS race_std FROM num WHERE vic_race IS NOT NULL),
c AS (SELECT zone, avg(latitude) AS y, avg(longitude) AS x, count(*) AS sample_size FROM lab GROUP BY 1),
r AS (SELECT zone, race_std, count(*) AS n FROM lab GROUP BY 1, 2),
top AS (SELECT zone, string_agg(race_std || ' ' || CAST(round(n * 1000 / sample_size) AS INTEGER), ', '
  ORDER BY race_std) AS races FROM r JOIN c USING (zone) WHERE n > 0.2 * sample_size GROUP BY 1),
f AS (SELECT loc_id, arg_min(zone, ({haversine('lat', 'lon', 'y', 'x')}, zone)) AS zone
  FROM loc JOIN c ON true GROUP BY 1)
SELECT loc_id, CAST(zone AS INTEGER) AS zone, sample_size, races FROM f JOIN c USING (zone) LEFT JOIN top USING (zone)"""))
def m17_given(spark, d):
    """Race shares, in thousandths, of the given zone whose centre is nearest."""
    zoned_rows = numbered_zones(spark, d).filter(F.col("vic_race").isNotNull())
    table = zones.race_zone_table(zones.with_race(zoned_rows))
    found = zones.nearest_centre(fx.locations(spark, d), table).select("loc_id", "zone").join(table, "zone")
    races = F.transform(F.map_entries("racial_composition"), lambda e: F.concat_ws(
        " ", e["key"], F.round(e["value"] * 1000).cast("int").cast("string")))
    return found.select("loc_id", F.col("zone").cast("int").alias("zone"), "sample_size",
                        F.concat_ws(", ", F.array_sort(races)).alias("races"))


def offense_model(spark, d):
    return model(spark, d, "offenses", lambda: classify.fit_offense_model(fx.incidents(spark, d)))


@query("m18_offense_classifier")
def m18(spark, d):
    fitted, predictions = offense_model(spark, d)
    return classify.class_report(predictions, fitted.stages[0].labels)


FOREST_TOP = """
top AS (SELECT crime_type, row_number() OVER (ORDER BY count(*) DESC, crime_type) - 1 AS label
  FROM inc GROUP BY 1 ORDER BY 2 LIMIT 5),
few AS (SELECT inc.*, label FROM inc JOIN top USING (crime_type)),
q AS (SELECT quantile_cont(latitude, 0.5) AS a, quantile_cont(longitude, 0.5) AS b,
  quantile_cont(longitude, 0.25) AS c, quantile_cont(latitude, 0.75) AS e FROM few)"""


@query("m18_exported_forest_agrees", sql("inc", f"""@{FOREST_TOP}
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_other FROM few"""))
def m18_exported(spark, d):
    """The fitted forest as a table of nodes: no row gets another class than from the library."""
    fitted, _ = offense_model(spark, d)
    nodes = fx.kept(spark, d, "forest", lambda: forest.exported(fitted.stages[-1]))
    known = fitted.transform(fx.incidents(spark, d)).select(
        "latitude", "longitude", F.col("prediction").alias("by_library"))
    depth = fitted.stages[-1].getMaxDepth()
    made = forest.predictions(known, nodes, ["latitude", "longitude"], depth, len(fitted.stages[0].labels))
    return made.agg(F.count("*").alias("n_rows"), F.count_if(
        ~F.col("prediction").eqNullSafe(F.col("by_library"))).alias("n_other"))


GIVEN_FEATURES = ["latitude", "longitude", "hour_of_day"]


def labelled(spark, d):
    """Incidents of the five commonest offenses, with the offense's rank as label."""
    incidents = fx.incidents(spark, d)
    names = stats.top_overall(incidents, "crime_type", 5)
    place = F.row_number().over(Window.orderBy(F.desc("count"), "crime_type"))  # five rows
    return incidents.join(F.broadcast(names.select(
        "crime_type", (place - 1).cast("double").alias("label"))), "crime_type")


def given_forest(rows):
    """Two trees that split at quantiles of the rows."""
    at = lambda c, p: F.percentile(c, F.lit(p))
    q = rows.agg(at("latitude", 0.5).alias("a"), at("longitude", 0.5).alias("b"), at("longitude", 0.25).alias("c"),
                 at("latitude", 0.75).alias("e"))
    splits = [(0, 0, 0, F.col("a"), 1, 2), (0, 1, 1, F.col("b"), 3, 4), (0, 2, 2, F.lit(12.0), 5, 6),
              (1, 0, 1, F.col("c"), 1, 2), (1, 2, 0, F.col("e"), 3, 4)]
    leaves = [(0, n) for n in (3, 4, 5, 6)] + [(1, n) for n in (1, 3, 4)]
    none = F.lit(None)
    items = [(F.lit(t), F.lit(n), F.lit(f), cut, F.lit(x), F.lit(y)) for t, n, f, cut, x, y in splits]
    items += [(F.lit(t), F.lit(n), none, none, none, none) for t, n in leaves]
    names = ["tree int", "node int", "feature int", "cut double", "left int", "right int"]
    rows_ = F.array(*[F.struct(*[c.cast(n.split()[1]).alias(n.split()[0]) for c, n in zip(i, names, strict=True)])
                      for i in items])
    return q.select(F.inline(rows_)).withColumn("left_values", F.lit(None).cast("array<double>"))


FOREST_LEAVES = """
walk AS (SELECT few.*, CASE WHEN latitude <= a THEN CASE WHEN longitude <= b THEN [0, 1, 3] ELSE [0, 1, 4] END
    WHEN hour_of_day <= 12 THEN [0, 2, 5] ELSE [0, 2, 6] END AS p0,
  CASE WHEN longitude <= c THEN [0, 1] WHEN latitude <= e THEN [0, 2, 3] ELSE [0, 2, 4] END AS p1
  FROM few JOIN q ON true)"""


@query("m18_report_of_given_forest", sql("inc", f"""@{FOREST_TOP},{FOREST_LEAVES},
v AS (SELECT t, leaf, label, count(*) / sum(count(*)) OVER (PARTITION BY t, leaf) AS share FROM (
  SELECT 0 AS t, p0[-1] AS leaf, label FROM walk UNION ALL SELECT 1, p1[-1], label FROM walk) GROUP BY 1, 2, 3),
l AS (SELECT DISTINCT p0[-1] AS l0, p1[-1] AS l1 FROM walk),
s AS (SELECT l0, l1, label, sum(share) AS s FROM l JOIN v ON (t = 0 AND leaf = l0) OR (t = 1 AND leaf = l1)
  GROUP BY 1, 2, 3),
best AS (SELECT l0, l1, arg_min(label, (-s, label)) AS prediction FROM s GROUP BY 1, 2),
p AS (SELECT label, prediction, count(*) AS n FROM walk JOIN best ON p0[-1] = l0 AND p1[-1] = l1 GROUP BY 1, 2),
r AS (SELECT crime_type, (SELECT sum(n) FROM p WHERE p.label = top.label) AS support,
  (SELECT sum(n) FROM p WHERE p.prediction = top.label) AS called,
  coalesce((SELECT sum(n) FROM p WHERE p.label = top.label AND p.prediction = top.label), 0) AS hit FROM top),
m AS (SELECT crime_type, CAST(support AS BIGINT) AS support, coalesce(hit / called, 0) AS precision,
  hit / support AS recall FROM r)
SELECT crime_type, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM m"""))
def m18_given(spark, d):
    """A given forest whose leaves get their votes from the rows: report of the classes."""
    rows = labelled(spark, d)
    nodes = stored(given_forest(rows))
    counts = stored(forest.node_counts(rows, nodes, GIVEN_FEATURES, 2, "label"))
    made = forest.predictions(rows, stored(forest.with_votes(nodes, counts, 5)), GIVEN_FEATURES, 2, 5)
    names = [r[0] for r in rows.select("crime_type", "label").distinct().orderBy("label").collect()]  # five
    return classify.class_report(made, names).select("crime_type", "support", *[
        F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# --- evaluation -----------------------------------------------------------------------------

_CH = """
h AS (SELECT cluster, longitude AS x, latitude AS y FROM hot WHERE cluster <> -1),
c AS (SELECT cluster, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM h GROUP BY 1),
sc AS (SELECT cluster, n, cx, cy, avg(sqrt(power(x - cx, 2) + power(y - cy, 2))) AS s,
  sum(power(x - cx, 2) + power(y - cy, 2)) AS w FROM h JOIN c USING (cluster) GROUP BY ALL),
m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM h),
db AS (SELECT a.cluster, max((a.s + b.s) / sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)))
  AS worst FROM sc a JOIN sc b ON a.cluster <> b.cluster GROUP BY 1)"""


@query("m19_separation", sql("hot", f"""@{_CH}
SELECT (SELECT count(*) FROM c) AS n_clusters,
  (SELECT count(*) FROM hot WHERE cluster = -1) AS n_noise_points,
  round((SELECT avg(worst) FROM db), 6) AS davies_bouldin_score,
  round((SELECT sum(sc.n * (power(cx - mx, 2) + power(cy - my, 2))) / (count(*) - 1)
    / (sum(w) / (any_value(m.n) - count(*))) FROM sc JOIN m ON true), 3)
    AS calinski_harabasz_score"""))
def m19(spark, d):
    df = hotspots(spark, d)
    inner = df.filter("cluster <> -1")
    return df.agg(
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("n_noise_points")).withColumns({
            "davies_bouldin_score": F.round(E.davies_bouldin(inner, "cluster").scalar(), 6),
            "calinski_harabasz_score": F.round(E.calinski_harabasz(
                E.centroids(inner, "cluster")).scalar(), 3)})


_SIL = """
p AS (SELECT cluster, x, y, count(*) AS w FROM h GROUP BY ALL),
v AS (SELECT c.cluster, any_value(c.n) AS n, any_value(cx) AS cx, any_value(cy) AS cy,
  avg(power(x - cx, 2) + power(y - cy, 2)) AS v FROM h JOIN c USING (cluster) GROUP BY 1),
far AS (SELECT p.cluster, x, y, w, v.cluster AS k, v.n, power(x - cx, 2) + power(y - cy, 2) + v AS d
  FROM p JOIN v ON true),
ab AS (SELECT any_value(w) AS w, max(n) FILTER (k = cluster) AS n,
  max(d * n / (n - 1.0::DOUBLE)) FILTER (k = cluster AND n > 1) AS a, min(d) FILTER (k <> cluster) AS b
  FROM far GROUP BY cluster, x, y),
sil AS (SELECT sum(w * CASE WHEN n > 1 THEN coalesce((b - a) / greatest(a, b), 0) ELSE 0 END) / sum(w) AS s
  FROM ab WHERE b IS NOT NULL)"""
_CH_QUAD = _CH.replace("FROM hot", "FROM quad")
_EUCLIDEAN = """
pt AS (SELECT p.*, c.n FROM p JOIN c USING (cluster)),
ds AS (SELECT a.cluster, a.x, a.y, a.w, a.n AS own, b.cluster AS k, any_value(b.n) AS n,
  sum(b.w * sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS t FROM pt a JOIN pt b ON true GROUP BY ALL),
eu AS (SELECT w, any_value(own) AS n, max(t) FILTER (k = cluster) / greatest(any_value(own) - 1, 1) AS a,
  min(t / n) FILTER (k <> cluster) AS b FROM ds GROUP BY cluster, x, y, w),
esil AS (SELECT sum(w * CASE WHEN n > 1 THEN coalesce((b - a) / greatest(a, b), 0) ELSE 0 END) / sum(w) AS s
  FROM eu WHERE b IS NOT NULL)"""


@query("m19_cluster_quality", sql("quad", f"""@{_CH_QUAD},{_SIL},{_EUCLIDEAN}
SELECT (SELECT count(*) FROM c) AS n_clusters,
  (SELECT count(*) FROM quad WHERE cluster = -1) AS n_noise_points,
  round((SELECT s FROM esil), 6) AS silhouette_score,
  round((SELECT s FROM sil), 6) AS silhouette_squared,
  round((SELECT avg(worst) FROM db), 6) AS davies_bouldin_score,
  round((SELECT sum(sc.n * (power(cx - mx, 2) + power(cy - my, 2))) / (count(*) - 1)
    / (sum(w) / (any_value(m.n) - count(*))) FROM sc JOIN m ON true), 3)
    AS calinski_harabasz_score"""))
def m19_quality(spark, d):
    return E.cluster_quality(quadrants(spark, d)).withColumns({
        "silhouette_score": F.round("silhouette_score", 6),
        "silhouette_squared": F.round("silhouette_squared", 6),
        "davies_bouldin_score": F.round("davies_bouldin_score", 6),
        "calinski_harabasz_score": F.round("calinski_harabasz_score", 3)})


@query("m20_mean_concentration", sql("zon", f"""@{_PROFILES},
z AS (SELECT zone, avg(concentration) AS c FROM prof GROUP BY 1)
SELECT count(*) AS n_zones, round(avg(c), 6) AS avg_concentration, CASE WHEN avg(c) > 60
  THEN 'STRONG' WHEN avg(c) > 40 THEN 'MODERATE' ELSE 'WEAK' END AS pattern FROM z"""))
def m20(spark, d):
    return E.concentration_summary(zones.demographic_profiles(zoned(spark, d))).withColumn(
        "avg_concentration", F.round("avg_concentration", 6))


@query("m21_density_balance", sql("inc", f"""@{_GRID},
n AS (SELECT classification, count(*) AS count FROM grid GROUP BY 1)
SELECT classification, count, round(count * 100::DOUBLE / sum(count) OVER (), 6) AS percent,
  max(count) OVER () / min(count) OVER () < 3 AS balanced FROM n"""))
def m21(spark, d):
    return D.class_balance(density(spark, d)).withColumn("percent", F.round("percent", 6))


@query("m22_zone_coverage")
def m22(spark, d):
    return E.zone_coverage(zoned_by_model(spark, d))


@query("m22_coverage_of_given_zones", sql("zon", """
SELECT zone, count(*) AS count, count(*) OVER () AS n_zones_predicted, count(*) OVER () >= 8 AS good_coverage
FROM zon GROUP BY zone"""))
def m22_given(spark, d):
    return E.zone_coverage(zoned(spark, d))


@query("m23_score_spread", sql("zon", f"""@
s AS (SELECT zone, {_SCORE} AS v FROM zon GROUP BY 1)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min,
  round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range, stddev_pop(v) > 10
  AS good_variance FROM s"""))
def m23(spark, d):
    return E.score_spread(zones.zone_scores(zoned(spark, d))).select(*[
        F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "range")], "good_variance")


def _rating(c, high, low):
    return f"CASE WHEN {c} > {high} THEN 'EXCELLENT' WHEN {c} > {low} THEN 'GOOD' ELSE 'FAIR' END"


@query("m24_overall_grade", sql("quad zon", f"""@{_CH_QUAD},{_SIL},{_EUCLIDEAN},{_PROFILES},
z AS (SELECT zone, avg(concentration) AS c FROM prof GROUP BY 1),
conc AS (SELECT count(*) AS n, avg(c) AS c FROM z),
g AS (SELECT 'DBSCAN Clustering' AS model, {_rating("s", 0.5, 0.25)} AS rating, s AS score FROM esil
  WHERE s IS NOT NULL UNION ALL
  SELECT 'Demographic Zones', {_rating("c", 60, 40)}, c / 100::DOUBLE FROM conc WHERE n > 0),
o AS (SELECT avg(score) AS o FROM g)
SELECT model, rating, round(score, 6) AS score, round(o, 6) AS overall_score, CASE WHEN o > 0.6
  THEN 'STRONG' WHEN o > 0.4 THEN 'ACCEPTABLE' ELSE 'NEEDS IMPROVEMENT' END AS verdict
FROM g JOIN o ON true"""))
def m24(spark, d):
    """Grade of the hotspots by quadrant and of the given zones."""
    quality = E.cluster_quality(quadrants(spark, d))
    share = E.concentration_summary(zones.demographic_profiles(zoned(spark, d)))
    return E.graded(quality, share).withColumns({
        "score": F.round("score", 6), "overall_score": F.round("overall_score", 6)})
