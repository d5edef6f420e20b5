"""SQL text of the fixture views, shared by every check query (see FIXTURES.md)."""

from __future__ import annotations

from ..functions import rules
from ..sources import fixtures as fx


def quoted(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def pick(values, index: str) -> str:
    return f"([{', '.join(quoted(v) for v in values)}])[CAST({index} AS INTEGER) + 1]"


def cases(pairs, condition, default: str) -> str:
    whens = " ".join(f"WHEN {condition(k)} THEN {v}" for k, v in pairs)
    return f"CASE {whens} ELSE {default} END"


def contains(column: str):
    return lambda word: f"contains({column}, {quoted(word)})"


def half_up(x: str, digits: int) -> str:
    scale = f"{float(10 ** digits)!r}::DOUBLE"
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def haversine(lat1, lon1, lat2, lon2, radius=rules.EARTH_KM) -> str:
    a = (f"(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
         f"cos(radians({lat2})) * power(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    return f"(2 * {radius}::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


RAW = f"""
raw AS (
  SELECT CAST(event_id AS VARCHAR) AS cmplnt_num,
    CASE WHEN event_id % 71 = 0 THEN 'not a date' ELSE strftime(ts, '%m/%d/%Y') END AS cmplnt_fr_dt,
    strftime(ts, '%H:%M:%S') AS cmplnt_fr_tm,
    {pick(fx.OFFENSES, '(event_id * 7 + user_id) % 16')} AS ofns_desc,
    {pick(fx.LAW_CATEGORIES, 'event_id % 3')} AS law_cat_cd,
    {pick(fx.BOROUGHS, 'user_id % 5')} AS boro_nm,
    {pick(fx.PREMISES, 'user_id % 4')} AS prem_typ_desc,
    {pick(fx.AGES, 'event_id % 8')} AS vic_age_group,
    {pick(fx.RACES, '(event_id + user_id) % 9')} AS vic_race,
    {pick(fx.SEXES, 'user_id % 5')} AS vic_sex,
    CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN 'bad'
         WHEN event_id % 197 = 0 THEN '0'
         WHEN event_id % 5 = 0 THEN CAST((4040000 + (event_id * 7919) % 60000) / 1e5 AS VARCHAR)
         ELSE CAST((4055000 + (user_id % 4) * 8000 + ((event_id * 37) % 11 - 5) * 40) / 1e5
              AS VARCHAR) END AS latitude,
    CASE WHEN event_id % 197 = 0 THEN '0'
         WHEN event_id % 5 = 0 THEN CAST((-7430000 + (event_id * 104729) % 60000) / 1e5 AS VARCHAR)
         ELSE CAST((-7415000 + (user_id % 3) * 12000 + ((event_id * 53) % 13 - 6) * 40) / 1e5
              AS VARCHAR) END AS longitude
  FROM events)"""

def offense_type(c: str = "ofns_desc") -> str:
    return cases([(p, quoted(v)) for p, v in rules.OFFENSE_PATTERNS],
                 lambda p: f"regexp_matches(upper({c}), {quoted(p)})", f"trim(upper({c}))")


def category(c: str) -> str:
    return cases([(k, quoted(v)) for k, v in rules.OFFENSE_CATEGORIES], contains(c),
                 quoted(rules.DEFAULT_CATEGORY))


def severity(c: str) -> str:
    return cases([(k, f"{v!r}::DOUBLE") for k, v in rules.SEVERITY_WEIGHTS], contains(c),
                 "0.5::DOUBLE")


def severity_points(c: str) -> str:
    return cases([(k, str(v)) for k, v in rules.SEVERITY_POINTS.items()],
                 lambda k: f"{c} = {quoted(k)}", str(rules.DEFAULT_SEVERITY_POINTS))


def time_bucket(c: str) -> str:
    return cases([((a, b), quoted(n)) for n, a, b in rules.TIME_BUCKETS],
                 lambda ab: f"{c} BETWEEN {ab[0]} AND {ab[1]}", "NULL")


TYPED = f"""
typed AS (
  SELECT * REPLACE (TRY_CAST(latitude AS DOUBLE) AS latitude,
                    TRY_CAST(longitude AS DOUBLE) AS longitude)
  FROM raw)"""

INCIDENTS = f"""
cleaned AS (
  SELECT *, {offense_type()} AS crime_type,
    try_strptime(cmplnt_fr_dt || ' ' || cmplnt_fr_tm, '%m/%d/%Y %H:%M:%S') AS occurred_at
  FROM typed
  WHERE latitude BETWEEN 40.4 AND 41.0 AND longitude BETWEEN -74.3 AND -73.7
    AND ofns_desc IS NOT NULL),
inc AS (
  SELECT cmplnt_num AS incident_id, latitude, longitude, crime_type,
    {category('crime_type')} AS crime_category, {severity('crime_type')} AS severity_weight,
    occurred_at, CAST(coalesce(hour(occurred_at), 12) AS INTEGER) AS hour_of_day,
    CAST(coalesce(isodow(occurred_at) - 1, 0) AS INTEGER) AS day_of_week, boro_nm AS borough,
    CASE WHEN trim(upper(vic_age_group)) IN ('NAN', 'UNKNOWN', '') THEN NULL
         ELSE trim(upper(vic_age_group)) END AS vic_age_group,
    CASE WHEN contains(upper(vic_race), 'UNKNOWN') THEN 'UNKNOWN'
         ELSE coalesce(trim(upper(vic_race)), 'NAN') END AS vic_race,
    CASE WHEN upper(left(trim(vic_sex), 1)) IN ('N', 'U', '') THEN NULL
         ELSE upper(left(trim(vic_sex), 1)) END AS vic_sex,
    law_cat_cd, prem_typ_desc, ofns_desc
  FROM cleaned)"""

AMENITIES = f"""
am AS (
  SELECT s_name AS name,
    CASE WHEN s_suppkey % 10 = 0 THEN 'nursing_home'
         ELSE {pick(fx.AMENITY_KINDS, 's_suppkey % 6')} END AS type,
    {pick(fx.BOROUGHS, 's_suppkey % 5')} AS borough,
    (4050000 + (s_suppkey * 3571) % 40000) / 1e5 AS latitude,
    (-7420000 + (s_suppkey * 2903) % 45000) / 1e5 AS longitude
  FROM supplier)"""

LOCATIONS = f"""
loc AS (
  SELECT c_custkey AS loc_id, (4050000 + (c_custkey * 13) % 40000) / 1e5 AS lat,
    (-7420000 + (c_custkey * 29) % 45000) / 1e5 AS lon,
    {pick(fx.GROUPS, 'c_custkey % 5')} AS demographic_group,
    {pick(fx.CONTEXT_WORDS, 'c_custkey % 7')} AS amenity_type
  FROM customer)"""

GAZETTEER = f"""
gaz AS (
  SELECT s_name AS place, (4050000 + (s_suppkey * 3571) % 40000) / 1e5 AS lat,
    (-7420000 + (s_suppkey * 2903) % 45000) / 1e5 AS lon,
    CASE WHEN s_suppkey % 4 = 0 THEN ' New York ' WHEN s_suppkey % 4 = 1 THEN 'Springfield' END
      AS city,
    CASE WHEN s_suppkey % 5 = 0 THEN 'Kings County' END AS county,
    {pick(['New York', 'Illinois', None], 's_suppkey % 3')} AS state,
    {pick([b.title() for b in fx.BOROUGHS], 's_suppkey % 5')} AS borough,
    CASE WHEN s_suppkey % 7 = 0 THEN 'Camden' END AS suburb
  FROM supplier)"""

_COORDS = ("CAST((4050000 + (c_custkey * 13) % 40000) / 1e5 AS VARCHAR) || ', ' || "
           "CAST((-7420000 + (c_custkey * 29) % 45000) / 1e5 AS VARCHAR)")
_PLACE = "'Supplier#' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0')"

REQUESTS = f"""
req AS (
  SELECT c_custkey AS loc_id,
    CASE c_custkey % 9 WHEN 0 THEN 'Restaurant, ' || {_PLACE}
      WHEN 1 THEN 'PARK,  ' || upper({_PLACE}) WHEN 2 THEN {_COORDS}
      WHEN 3 THEN 'School, ' || {_COORDS} WHEN 4 THEN 'Apt 5, 350 5th Ave'
      WHEN 5 THEN 'Nightclub, ' || {_PLACE} WHEN 6 THEN '' WHEN 7 THEN 'Shop, ' || c_name
      ELSE {_PLACE} END AS message,
    {pick(fx.GROUP_TEXTS, 'c_custkey % 10')} || CASE WHEN c_custkey % 3 = 0
      THEN ' and ' || CAST(c_custkey % 6 AS VARCHAR) || ' Latina women' ELSE '' END AS group_text
  FROM customer)"""

VIEWS = {
    "raw": RAW, "typed": TYPED, "inc": INCIDENTS, "am": AMENITIES, "loc": LOCATIONS,
    "gaz": GAZETTEER, "req": REQUESTS,
}
NEEDS = {"typed": ["raw"], "inc": ["raw", "typed"]}


def sql(views: str, body: str) -> str:
    """Check query: the named fixture views as CTEs in front of the body.

    A body that brings its own CTEs starts with "@". The hotspot views close over core spots, so they
    are recursive.
    """
    names = []
    for v in views.split():
        names += [n for n in NEEDS.get(v, []) + [v] if n not in names]
    parts = ",".join(VIEWS[n] for n in names)
    joiner = ",\n" if body.lstrip().startswith("@") else "\n"
    body = body.lstrip().removeprefix("@")
    head = "WITH RECURSIVE" if {"hot", "quad", "decayed"} & set(names) else "WITH"
    return f"{head} {parts}{joiner}{body}"


# --- hotspots in SQL: spots, neighbours, core flags, closure over core spots, numbering -------

def _closure(near: str) -> str:
    """CTEs from spots(id, w, x, y, ...) and a neighbour condition to numbered clusters."""
    return f"""
near AS (SELECT a.id AS a, b.id AS b, b.w AS w FROM spots a JOIN spots b ON {near}),
core AS (SELECT a AS id, sum(w) AS total FROM near GROUP BY a),
edge AS (SELECT a, b FROM near JOIN core c1 ON c1.id = a JOIN core c2 ON c2.id = b
         WHERE c1.total >= min_points() AND c2.total >= min_points()),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
"""


def _labels(order: str) -> str:
    return f"""
numbered AS (SELECT root, dense_rank() OVER (ORDER BY {order}) - 1 AS cluster
             FROM (SELECT DISTINCT root FROM root) JOIN spots ON id = root),
lab AS (SELECT s.id, coalesce(n.cluster,
          (SELECT min(m.cluster) FROM near JOIN root r ON r.id = near.b JOIN numbered m
             ON m.root = r.root WHERE near.a = s.id), -1) AS cluster,
          n.cluster IS NOT NULL AS core
        FROM spots s LEFT JOIN root r ON r.id = s.id LEFT JOIN numbered n ON n.root = r.root)"""


_HOT_DISTANCE = haversine("a.y", "a.x", "b.y", "b.x", rules.HOTSPOT_EARTH_KM)



def hotspot_view(weight: str = "count(*)", least: int = 10) -> str:
    """spots, neighbours and numbered clusters (`lab`) by great-circle distance, 0.5 km."""
    near = f"abs(a.y - b.y) <= 0.0046 AND abs(a.x - b.x) <= 0.0062 AND {_HOT_DISTANCE} <= 0.5"
    return f"""
spots AS (SELECT min(CAST(incident_id AS BIGINT)) AS id, latitude AS y, longitude AS x,
            {weight} AS w FROM inc GROUP BY latitude, longitude),
{_closure(near).replace("min_points()", str(least))}{_labels("root").lstrip()}"""


VIEWS["hot"] = f"""{hotspot_view()},
hot AS (SELECT inc.*, lab.cluster, lab.core FROM inc
        JOIN spots ON latitude = y AND longitude = x JOIN lab ON lab.id = spots.id)"""

VIEWS["quad"] = f"""
q AS (SELECT *, (CASE WHEN latitude >= (40.4::DOUBLE + 41.0::DOUBLE) / 2 THEN 'N' ELSE 'S' END) ||
        (CASE WHEN longitude >= (-74.3::DOUBLE + -73.7::DOUBLE) / 2 THEN 'E' ELSE 'W' END)
        AS quadrant FROM inc),
mom AS (SELECT quadrant, avg(latitude) AS ma, avg(longitude) AS mo, stddev_pop(latitude) AS sa,
          stddev_pop(longitude) AS so FROM q GROUP BY quadrant HAVING count(*) >= 50),
spots AS (SELECT quadrant, min(CAST(incident_id AS BIGINT)) AS id, latitude, longitude,
            any_value((latitude - ma) / sa) AS y, any_value((longitude - mo) / so) AS x,
            count(*) AS w FROM q JOIN mom USING (quadrant) GROUP BY quadrant, latitude, longitude),
{_closure("a.quadrant = b.quadrant AND abs(a.y - b.y) <= 0.01 AND "
          "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.01")
 .replace("min_points()", "5")}{_labels("quadrant, root").lstrip()},
quad AS (SELECT inc.*, spots.quadrant, lab.cluster, lab.core FROM inc
         JOIN spots ON inc.latitude = spots.latitude AND inc.longitude = spots.longitude
         JOIN lab ON lab.id = spots.id)"""

VIEWS["zon"] = """
zon AS (SELECT *, CAST(floor(latitude / 0.1::DOUBLE) AS BIGINT) || '_' ||
          CAST(floor(longitude / 0.1::DOUBLE) AS BIGINT) AS zone FROM inc)"""

NEEDS.update({"hot": ["raw", "typed", "inc"], "quad": ["raw", "typed", "inc"],
              "zon": ["raw", "typed", "inc"]})


def counts_json(value: str, count: str) -> str:
    """Aggregate: counts as one JSON object in value order."""
    return f"""'{{' || string_agg('"' || {value} || '":' || {count}, ',' ORDER BY {value}) || '}}'"""


def list_text(value: str, count: str) -> str:
    """Aggregate: "value=count" items, largest first, then by value."""
    return f"string_agg({value} || '=' || {count}, '; ' ORDER BY {count} DESC, {value})"


def modal(table: str, keys: str, column: str) -> str:
    """Commonest value per key, smallest on ties."""
    return (f"(SELECT {keys}, {column} FROM (SELECT {keys}, {column}, row_number() OVER "
            f"(PARTITION BY {keys} ORDER BY count(*) DESC, {column}) AS r FROM {table} "
            f"WHERE {column} IS NOT NULL GROUP BY {keys}, {column}) WHERE r = 1)")
