"""Geospatial operators and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, rules
from ..functions import text as T
from ..operators import density as D
from ..operators import distance_join as J
from ..operators import places, scoring, stats, zones
from ..plans import cleaning as plan
from ..sources import fixtures as fx
from .base import cases, half_up, haversine, quoted, sql
from .registry import query
from .statistics import AM_DIST, hotspots, zoned

MIDTOWN = (40.7580, -73.9855)


@query("g1_haversine", sql("inc", f"""
SELECT incident_id, round({haversine('latitude', 'longitude', '40.758::DOUBLE',
                                     '-73.9855::DOUBLE')}, 6) AS km FROM inc"""))
def g1(spark, d):
    """Distance of every incident from one point."""
    return fx.incidents(spark, d).select("incident_id", F.round(geo.haversine_km(
        F.col("latitude"), F.col("longitude"), F.lit(MIDTOWN[0]), F.lit(MIDTOWN[1])), 6)
        .alias("km"))


@query("g2_radius_search", sql("inc loc", f"""
SELECT loc_id, count(*) AS nearby, round(sum(d), 4) AS total_km, round(min(d), 6) AS nearest_km
FROM (SELECT loc_id, {haversine('loc.lat', 'loc.lon', 'inc.latitude', 'inc.longitude')} AS d
  FROM loc JOIN inc ON abs(inc.latitude - loc.lat) <= 1 / 111.0::DOUBLE
    AND abs(inc.longitude - loc.lon) <= 0.013) WHERE d <= 1 GROUP BY 1"""))
def g2(spark, d):
    """Every (location, incident) pair within 1 km, summed up per location.

    Pairs are made of coordinates, with the number of incidents there; locations get their coordinate's sums.
    """
    home = fx.locations(spark, d).select("loc_id", "lat", "lon")
    spots = fx.incidents(spark, d).groupBy("latitude", "longitude").agg(F.count("*").alias("n"))
    pairs = J.within_distance(home.select("lat", "lon").distinct(), spots, 1.0)
    found = pairs.groupBy("lat", "lon").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("distance")).alias("km"), F.min("distance").alias("nearest"))
    return home.join(found, ["lat", "lon"]).groupBy("loc_id").agg(
        F.sum("n").alias("nearby"), F.round(F.sum("km"), 4).alias("total_km"),
        F.round(F.min("nearest"), 6).alias("nearest_km"))


_PATTERN = quoted(rules.COORDINATE_PATTERN)
_DIRECT = f"""
direct AS (SELECT loc_id, message,
  TRY_CAST(nullif(regexp_extract(message, {_PATTERN}, 1), '') AS DOUBLE) AS a,
  TRY_CAST(nullif(regexp_extract(message, {_PATTERN}, 2), '') AS DOUBLE) AS o FROM req)"""


@query("g3_direct_coordinates", sql("req", f"""@{_DIRECT}
SELECT loc_id, CASE WHEN a BETWEEN -90 AND 90 AND o BETWEEN -180 AND 180 THEN a END AS lat,
  CASE WHEN a BETWEEN -90 AND 90 AND o BETWEEN -180 AND 180 THEN o END AS lon FROM direct"""))
def g3(spark, d):
    found = T.direct_coordinates(F.col("message"))
    return fx.requests(spark, d).select("loc_id", found["lat"].alias("lat"),
                                        found["lon"].alias("lon"))


_WORD = quoted(r"^(" + "|".join(rules.BUSINESS_WORDS) + r"),\s*")


@query("g4_strip_business_word", sql("req", f"""
SELECT loc_id, regexp_replace(message, {_WORD}, '', 'i') AS address FROM req"""))
def g4(spark, d):
    return fx.requests(spark, d).select(
        "loc_id", T.without_business_word(F.col("message")).alias("address"))


def _city(column):
    return cases([(names, quoted(code)) for code, names in rules.CITY_ALIASES.items()],
                 lambda names: f"lower(trim({column})) IN ({', '.join(map(quoted, names))})",
                 "NULL")


_GAZ_FIELDS = ["city", "county", "state", "borough", "suburb"]
_GAZ_CITY = f"coalesce({', '.join(_city(c) for c in _GAZ_FIELDS)})"


@query("g5_city_of_address", sql("gaz", f"""
SELECT place, {_GAZ_CITY} AS city_code FROM gaz"""))
def g5(spark, d):
    places_ = fx.gazetteer(spark, d)
    return places_.select("place", T.city_of_address(places_.columns).alias("city_code"))


@query("g6_city_of_coordinates", sql("typed", "SELECT cmplnt_num, " + cases(
    [(b, quoted(c)) for c, b in rules.CITY_BOXES.items()],
    lambda b: f"latitude BETWEEN {b[1]} AND {b[2]} AND longitude BETWEEN {b[3]} AND {b[4]}",
    "NULL") + " AS city_code FROM typed"))
def g6(spark, d):
    df = plan.typed_coordinates(fx.complaints(spark, d))
    return df.select("cmplnt_num", T.city_of_coordinates(
        F.col("latitude"), F.col("longitude")).alias("city_code"))


@query("g7_quadrant", sql("inc", """
SELECT incident_id, (CASE WHEN latitude >= (40.4::DOUBLE + 41.0::DOUBLE) / 2 THEN 'N' ELSE 'S'
  END) || (CASE WHEN longitude >= (-74.3::DOUBLE + -73.7::DOUBLE) / 2 THEN 'E' ELSE 'W' END)
  AS quadrant FROM inc"""))
def g7(spark, d):
    return fx.incidents(spark, d).select("incident_id", geo.quadrant(
        F.col("latitude"), F.col("longitude"), geo.city_box("nyc")).alias("quadrant"))


_HOT_D = haversine("loc.lat", "loc.lon", "p.latitude", "p.longitude")


@query("g8_nearest_labelled_point", sql("loc hot", f"""@
p AS (SELECT latitude, longitude, min(cluster) AS cluster FROM hot GROUP BY 1, 2),
r AS (SELECT loc_id, cluster, {_HOT_D} AS km FROM loc JOIN p ON true)
SELECT loc_id, arg_min(cluster, (km, cluster)) AS cluster, round(min(km), 6) AS km
FROM r GROUP BY loc_id"""))
def g8(spark, d):
    points = hotspots(spark, d).select("latitude", "longitude", "cluster")
    locations = fx.locations(spark, d)
    found = J.nearest(locations, points, "cluster")
    return locations.join(found, ["lat", "lon"]).select(
        "loc_id", "nearest.cluster", F.round("distance", 6).alias("km"))


_CENTRES = """@
c AS (SELECT zone, avg(latitude) AS center_lat, avg(longitude) AS center_lon FROM zon GROUP BY 1)"""
_C_DIST = haversine("loc.lat", "loc.lon", "center_lat", "center_lon")


@query("g9_nearest_zone_centre", sql("loc zon", f"""{_CENTRES},
r AS (SELECT loc_id, zone, {_C_DIST} AS km FROM loc JOIN c ON true)
SELECT loc_id, arg_min(zone, (km, zone)) AS zone FROM r GROUP BY loc_id"""))
def g9(spark, d):
    centres = zones.zone_centres(zoned(spark, d))
    return J.nearest_centre(fx.locations(spark, d), centres).select("loc_id", "zone")


_I_DIST = haversine("inc.latitude", "inc.longitude", "am.latitude", "am.longitude")


def _near_places(km):
    """Degree limits are only there to spare the check query most of the trigonometry."""
    return (f"abs(am.latitude - inc.latitude) <= {km} / 111.0::DOUBLE AND "
            f"abs(am.longitude - inc.longitude) <= {km} / 80.0::DOUBLE AND {_I_DIST} <= {km}")


@query("g10_places_near_incidents", sql("inc am", f"""
SELECT incident_id, name, type, am.latitude AS latitude, am.longitude AS longitude,
  inc.latitude AS crime_lat, inc.longitude AS crime_lon,
  {half_up(_I_DIST + ' * 1000', 1)} AS distance_meters
FROM inc JOIN am ON {_near_places(3)}"""))
def g10(spark, d):
    amenities = fx.amenities(spark, d).drop("borough")
    return places.places_near(fx.incidents(spark, d), amenities, 3.0, ordered=True).select(
        "incident_id", "name", "type", "latitude", "longitude", "crime_lat", "crime_lon",
        "distance_meters")


def _g11_sql(km):
    return sql("inc am", f"""
SELECT * FROM (SELECT incident_id, type, name, CAST(row_number() OVER (PARTITION BY incident_id,
  type ORDER BY {half_up(_I_DIST + ' * 1000', 1)}, name) AS INTEGER) AS rank
  FROM inc JOIN am ON {_near_places(km)}) WHERE rank <= 3""")


@query("g11_three_places_within_100m", _g11_sql("0.1::DOUBLE"))
def g11_near(spark, d):
    return places.nearest_places_per_type(
        fx.incidents(spark, d), fx.amenities(spark, d), 0.1).select("incident_id", "type", "name", "rank")


@query("g11_three_places_per_type", _g11_sql(5))
def g11(spark, d):
    """5 km instead of 100 m: the test amenities are sparse."""
    return places.nearest_places_per_type(
        fx.incidents(spark, d), fx.amenities(spark, d), 5.0).select(
        "incident_id", "type", "name", "rank")


@query("g12_density_grid_nodes", sql("inc", """@
node AS (SELECT i, j, 40.4::DOUBLE + i * ((41.0::DOUBLE - 40.4::DOUBLE) / 49) AS lat,
  -74.3::DOUBLE + j * ((-73.7::DOUBLE - -74.3::DOUBLE) / 49) AS lon
  FROM range(50) a(i), range(50) b(j)),
snap AS (SELECT CAST(floor((latitude - 40.4::DOUBLE) / ((41.0::DOUBLE - 40.4::DOUBLE) / 49) + 0.5)
  AS BIGINT) AS i, CAST(floor((longitude - -74.3::DOUBLE) /
  ((-73.7::DOUBLE - -74.3::DOUBLE) / 49) + 0.5) AS BIGINT) AS j, count(*) AS n FROM inc GROUP BY 1, 2)
SELECT node.i AS i, node.j AS j, round(lat, 6) AS lat, round(lon, 6) AS lon,
  coalesce(n, 0) AS incidents FROM node LEFT JOIN snap ON snap.i = node.i AND snap.j = node.j"""))
def g12(spark, d):
    """The 50×50 grid, with the incidents nearest to each node."""
    def snapped(c, low, high):
        return F.floor((F.col(c) - low) / ((high - low) / 49) + 0.5)

    counts = fx.incidents(spark, d).groupBy(
        snapped("latitude", 40.4, 41.0).alias("i"),
        snapped("longitude", -74.3, -73.7).alias("j")).agg(F.count("*").alias("incidents"))
    return D.grid_nodes(spark).join(counts, ["i", "j"], "left").na.fill(0, ["incidents"]).select(
        "i", "j", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "incidents")


@query("g13_fallback_box", sql("inc am", f"""@
near AS (SELECT incident_id, name, type, {half_up(_I_DIST + ' * 1000', 1)} AS distance_meters,
  'radius' AS method FROM inc JOIN am ON {_near_places(0.5)})
SELECT * FROM near UNION ALL
SELECT incident_id, name, type, {half_up(_I_DIST + ' * 1000', 1)}, 'box'
FROM inc JOIN am ON am.latitude BETWEEN inc.latitude - 0.01 AND inc.latitude + 0.01
  AND am.longitude BETWEEN inc.longitude - 0.01 AND inc.longitude + 0.01
WHERE incident_id NOT IN (SELECT incident_id FROM near)"""))
def g13(spark, d):
    return places.places_with_fallback(fx.incidents(spark, d), fx.amenities(spark, d), 0.5)


_STRIPPED = "lower(trim(regexp_replace({}, " + _WORD + ", '', 'i')))"
_BOX_CITY = cases([(b, quoted(c)) for c, b in rules.CITY_BOXES.items()],
                  lambda b: f"a BETWEEN {b[1]} AND {b[2]} AND o BETWEEN {b[3]} AND {b[4]}", "NULL")


@query("g14_text_to_coordinates", sql("req gaz", f"""@{_DIRECT},
idx AS (SELECT lower(trim(place)) AS k, lat, lon, {_GAZ_CITY} AS city FROM gaz),
t AS (SELECT *, a BETWEEN -90 AND 90 AND o BETWEEN -180 AND 180 AS ok,
  {_STRIPPED.format('message')} AS k1, CASE WHEN contains(message, ',') THEN
  {_STRIPPED.format("trim(substr(message, instr(message, ',') + 1))")} END AS k2 FROM direct),
u AS (SELECT t.*, i1.k IS NOT NULL AS h1, i2.k IS NOT NULL AS h2,
  CASE WHEN i1.k IS NOT NULL THEN i1.lat ELSE i2.lat END AS glat,
  CASE WHEN i1.k IS NOT NULL THEN i1.lon ELSE i2.lon END AS glon,
  CASE WHEN i1.k IS NOT NULL THEN i1.city ELSE i2.city END AS gcity
  FROM t LEFT JOIN idx i1 ON i1.k = k1 LEFT JOIN idx i2 ON i2.k = k2)
SELECT loc_id, CASE WHEN ok THEN a ELSE glat END AS lat, CASE WHEN ok THEN o ELSE glon END AS lon,
  CASE WHEN ok THEN coalesce({_BOX_CITY}, 'unknown')
       WHEN h1 OR h2 THEN coalesce(gcity, 'unknown') END AS city,
  CASE WHEN ok THEN 'direct' WHEN h1 THEN 'text' WHEN h2 THEN 'address' END AS source FROM u"""))
def g14(spark, d):
    return places.coordinates_of(fx.requests(spark, d), fx.gazetteer(spark, d))


@query("g15_places_of_a_type", sql("inc am", f"""
SELECT incident_id, name, type, inc.latitude AS crime_lat, inc.longitude AS crime_lon
FROM inc JOIN am ON {_near_places(0.5)} WHERE type IN ('hospital', 'police', 'school')"""))
def g15(spark, d):
    wanted = fx.amenities(spark, d).filter(F.col("type").isin("hospital", "police", "school"))
    return places.places_near(fx.incidents(spark, d), wanted, rules.INCIDENT_PLACE_KM).select(
        "incident_id", "name", "type", "crime_lat", "crime_lon")


# --- joins ----------------------------------------------------------------------------------

@query("j1_distance_join", sql("loc am", f"""
SELECT loc_id, name, round({AM_DIST}, 6) AS distance FROM loc JOIN am ON {AM_DIST} <= 2"""))
def j1(spark, d):
    home = fx.locations(spark, d).select("loc_id", "lat", "lon")
    return J.within_distance(home, fx.amenities(spark, d), 2.0).select(
        "loc_id", "name", F.round("distance", 6).alias("distance"))


@query("j2_nearest_neighbour", sql("loc am", f"""
SELECT loc_id, arg_min(name, ({AM_DIST}, name)) AS name, round(min({AM_DIST}), 6) AS km
FROM loc JOIN am ON true GROUP BY loc_id"""))
def j2(spark, d):
    locations = fx.locations(spark, d)
    found = J.nearest(locations, fx.amenities(spark, d), "name")
    return locations.join(found, ["lat", "lon"]).select(
        "loc_id", F.col("nearest.name").alias("name"), F.round("distance", 6).alias("km"))


_NODE_DIST = haversine("lat", "lon", "y", "x")


@query("j3_points_by_grid", sql("inc", f"""@
node AS (SELECT i, j, 40.4::DOUBLE + i * ((41.0::DOUBLE - 40.4::DOUBLE) / 49) AS lat,
  -74.3::DOUBLE + j * ((-73.7::DOUBLE - -74.3::DOUBLE) / 49) AS lon
  FROM range(50) a(i), range(50) b(j)),
s AS (SELECT latitude AS y, longitude AS x, count(*) AS n FROM inc GROUP BY 1, 2)
SELECT i * 50 + j AS node, CAST(sum(n) AS BIGINT) AS n FROM node JOIN s
  ON abs(y - lat) <= 2 / 111.0::DOUBLE AND {_NODE_DIST} <= 2 GROUP BY 1"""))
def j3(spark, d):
    """Incidents within 2 km of each grid node: a cell join, not a product."""
    nodes = D.grid_nodes(spark).withColumn("node", F.col("i") * 50 + F.col("j"))
    return J.counts_within(nodes, fx.incidents(spark, d), 2.0, key="node")


@query("j4_lookup_with_default", sql("inc loc", f"""@
w(demographic_group, crime_category, impact_weight) AS (VALUES {', '.join(
    f"({quoted(g)}, {quoted(c)}, {w!r}::DOUBLE)"
    for g, ws in rules.GROUP_WEIGHTS.items() for c, w in ws.items())}),
g AS (SELECT demographic_group AS g, count(*) AS n FROM loc GROUP BY 1),
c AS (SELECT crime_category AS c, count(*) AS n FROM inc GROUP BY 1)
SELECT g AS demographic_group, c AS crime_category, g.n AS locations, c.n AS incidents,
  coalesce(impact_weight, 1.0::DOUBLE) AS impact_weight
FROM g JOIN c ON true LEFT JOIN w ON w.demographic_group = g AND w.crime_category = c"""))
def j4(spark, d):
    """Weight of every group and category in the data, 1.0 where there is none."""
    groups = fx.locations(spark, d).groupBy("demographic_group").agg(
        F.count("*").alias("locations"))
    names = rules.CATEGORIES
    # Categories are a fixed list: unroll it onto the group rows, then look both up.
    rows = groups.withColumn("crime_category", F.explode(F.array(*[F.lit(c) for c in names])))
    counts = fx.incidents(spark, d).groupBy("crime_category").agg(F.count("*").alias("incidents"))
    return (rows.join(counts, "crime_category")
            .join(scoring.group_weights(spark), ["demographic_group", "crime_category"], "left")
            .withColumn("impact_weight", F.coalesce("impact_weight", F.lit(1.0))))


@query("j5_joined_by_id", sql("inc", """
SELECT a.incident_id AS incident_id, a.latitude AS latitude, a.longitude AS longitude,
  b.severity_weight AS weight FROM inc a JOIN inc b ON a.incident_id = b.incident_id"""))
def j5(spark, d):
    """Positions and weights from two projections, matched by id instead of by row order."""
    df = fx.incidents(spark, d)
    weights = df.select("incident_id", F.col("severity_weight").alias("weight"))
    return df.select("incident_id", "latitude", "longitude").join(weights, "incident_id")


@query("j6_semi_and_anti", sql("hot", """
SELECT incident_id, cluster FROM hot WHERE cluster <> -1 AND crime_type IN (
  SELECT crime_type FROM hot GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"""))
def j6(spark, d):
    df = hotspots(spark, d).select("incident_id", "crime_type", "cluster")
    top = stats.top_overall(df, "crime_type", 5)
    noise = df.filter("cluster = -1").select("incident_id")
    return (df.join(top, "crime_type", "left_semi").join(noise, "incident_id", "left_anti")
            .select("incident_id", "cluster"))


_CONCERNS = sorted({c for _, _, cs, _ in rules.AMENITY_CONTEXTS for c in cs})


@query("j7_fuzzy_concerns", sql("inc", f"""@
o AS (SELECT crime_type, count(*) AS count FROM inc GROUP BY 1),
k(concern) AS (VALUES {', '.join(f'({quoted(c)})' for c in _CONCERNS)})
SELECT concern, crime_type, count FROM o JOIN k ON contains(lower(crime_type), lower(concern))
  OR contains(lower(concern), lower(crime_type))"""))
def j7(spark, d):
    """Concerns and offenses where either contains the other."""
    kind = F.lower("crime_type")
    concerns = F.array(*[F.lit(c) for c in _CONCERNS])
    hits = F.filter(concerns, lambda c: kind.contains(F.lower(c)) | F.lower(c).contains(kind))
    return stats.value_counts(fx.incidents(spark, d), [], "crime_type").select(
        F.explode(hits).alias("concern"), "crime_type", "count")


@query("j8_features_side_by_side", sql("inc", """
SELECT incident_id, latitude, longitude, CASE WHEN vic_sex = 'F' THEN 1.0::DOUBLE ELSE 0 END AS f,
  CASE WHEN vic_sex = 'M' THEN 1.0::DOUBLE ELSE 0 END AS m FROM inc"""))
def j8(spark, d):
    """Coordinates and one-hot columns of the same row."""
    def one(v):
        return F.when(F.col("vic_sex") == v, 1.0).otherwise(0.0)

    return fx.incidents(spark, d).select("incident_id", "latitude", "longitude",
                                         one("F").alias("f"), one("M").alias("m"))


