"""Sources, cleaning rules and scalar projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..operators import stats
from ..plans import cleaning as plan
from ..session import scratch_folder
from ..sources import amenities as poi
from ..sources import complaints as src
from ..sources import fixtures as fx
from ..sources import sinks
from .base import cases, category, contains, half_up, offense_type, quoted, severity, sql
from .registry import query

R6 = "round({}, 6)"


# --- sources and sinks ---------------------------------------------------------------------

@query("s1_read_complaints_csv", sql("raw", """
SELECT cmplnt_num, cmplnt_fr_dt, cmplnt_fr_tm, ofns_desc, boro_nm, vic_age_group, vic_race, vic_sex,
  TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(longitude AS DOUBLE) AS longitude FROM raw"""))
def s1(spark, d):
    """The raw records go out as CSV and come back through the complaint reader."""
    raw = fx.complaints(spark, d)
    path = scratch_folder(spark, "complaints-csv")
    # Blanks around offense names are data, so neither side may trim them.
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    read = src.read_complaints(spark, path, raw.columns)
    return read.select(
        "cmplnt_num", "cmplnt_fr_dt", "cmplnt_fr_tm", "ofns_desc", "boro_nm", "vic_age_group",
        "vic_race", "vic_sex", C.number(F.col("latitude")).alias("latitude"),
        C.number(F.col("longitude")).alias("longitude"))


_CENTRES = ", ".join(f"({i}, {quoted(n)}, {a}::DOUBLE, {o}::DOUBLE)"
                     for i, (n, a, o) in enumerate(rules.BOROUGH_CENTRES))


def _offset(salt):
    return (f"(((id + 42) * 7919 + {salt * 104729}) % 100001 / 100000::DOUBLE * 2 - 1) * "
            "0.05::DOUBLE")


@query("s3_amenities_generated", sql("inc", f"""@
centre(i, borough, lat, lon) AS (VALUES {_CENTRES}),
made AS (
  SELECT borough, ([{', '.join(quoted(t) for t in rules.AMENITY_TYPES)}])[
      CAST(id % 20 % 6 AS INTEGER) + 1] AS type, id % 20 + 1 AS no,
    lat + {_offset(1)} AS latitude, lon + {_offset(2)} AS longitude
  FROM range(100) r(id) JOIN centre ON i = id // 20)
SELECT borough || ' ' || upper(left(type, 1)) || substr(type, 2) || ' ' || CAST(no AS VARCHAR)
    AS name, type, made.borough AS borough, round(latitude, 6) AS latitude,
  round(longitude, 6) AS longitude, n AS borough_incidents
FROM made LEFT JOIN (SELECT borough AS b, count(*) AS n FROM inc GROUP BY 1) ON b = upper(borough)
"""))
def s3(spark, d):
    """Generated places, each with the number of incidents of its borough."""
    per = fx.incidents(spark, d).groupBy(F.col("borough").alias("b")).agg(
        F.count("*").alias("borough_incidents"))
    made = poi.generated_amenities(spark)
    return made.join(per, F.col("b") == F.upper("borough"), "left").select(
        "name", "type", "borough", F.round("latitude", 6).alias("latitude"),
        F.round("longitude", 6).alias("longitude"), "borough_incidents")


@query("s4_normalise_columns", sql("raw", """
SELECT cmplnt_num, ofns_desc AS "OFNS_DESC", ofns_desc AS crime_type, boro_nm AS borough,
  vic_race, cmplnt_fr_dt, TRY_CAST(latitude AS DOUBLE) AS latitude,
  TRY_CAST(longitude AS DOUBLE) AS longitude FROM raw"""))
def s4(spark, d):
    """Upper-case and dotted headers; the old columns stay."""
    raw = fx.complaints(spark, d).select(
        "cmplnt_num", F.col("ofns_desc").alias("OFNS_DESC"), F.col("boro_nm").alias("BORO_NM"),
        F.col("vic_race").alias("VIC_RACE"), F.col("cmplnt_fr_dt").alias("CMPLNT_FR_DT"),
        F.col("latitude").alias("lat_lon.latitude"),
        F.col("longitude").alias("lat_lon.longitude"))
    out = src.normalise_columns(raw)
    keep = ["cmplnt_num", "OFNS_DESC", "crime_type", "borough", "latitude", "longitude"]
    # `VIC_RACE` and `vic_race` differ by case only, so they are taken by position.
    last = {c: i for i, c in enumerate(out.columns)}
    return out.toDF(*[f"c{i}" for i in range(len(out.columns))]).select(
        *[(C.number(F.col(f"c{last[c]}")) if c in ("latitude", "longitude")
           else F.col(f"c{last[c]}")).alias(c) for c in keep],
        F.col(f"c{last['vic_race']}").alias("vic_race"),
        F.col(f"c{last['cmplnt_fr_dt']}").alias("cmplnt_fr_dt"))


@query("s5_storage_schema", sql("inc", """
SELECT latitude, longitude, crime_type, crime_category, severity_weight,
  strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, hour_of_day, day_of_week, borough,
  vic_age_group, vic_race, vic_sex FROM inc"""))
def s5(spark, d):
    """Stored by borough, read back."""
    path = scratch_folder(spark, "incidents")
    src.write_incidents(src.storage_columns(fx.incidents(spark, d)), path)
    kept = src.storage_columns(src.read_incidents(spark, path))
    return kept.withColumn("occurred_at", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"))


@query("s6_csv_and_json_files", sql("am", """
SELECT name, type, borough, latitude, longitude, n AS type_places
FROM am JOIN (SELECT type AS t, count(*) AS n FROM am GROUP BY 1) ON t = type"""))
def s6(spark, d):
    """Places through a CSV file, counts by type through a JSON file."""
    places = fx.amenities(spark, d)
    csv, json = scratch_folder(spark, "places-csv"), scratch_folder(spark, "counts-json")
    sinks.write_csv(places, csv)
    sinks.write_json(stats.value_counts(places, [], "type", "type_places"), json)
    counts = spark.read.schema("type STRING, type_places BIGINT").json(json)
    return poi.read_amenities(spark, csv).join(counts, "type")


@query("s7_json_records", sql("inc", """
SELECT '{"borough":"' || borough || '","crime_category":"' || crime_category || '","count":' ||
  count(*) || '}' AS record FROM inc GROUP BY borough, crime_category"""))
def s7(spark, d):
    counts = fx.incidents(spark, d).groupBy("borough", "crime_category").agg(
        F.count("*").alias("count"))
    return counts.select(sinks.json_record("borough", "crime_category", "count").alias("record"))


# --- cleaning ------------------------------------------------------------------------------

@query("p1_numeric_coordinates", sql("typed", """
SELECT cmplnt_num, latitude, longitude FROM typed"""))
def p1(spark, d):
    return plan.typed_coordinates(fx.complaints(spark, d)).select(
        "cmplnt_num", "latitude", "longitude")


_BOX_ROWS = ", ".join(f"({quoted(c)}, {b[1]}::DOUBLE, {b[2]}::DOUBLE, {b[3]}::DOUBLE, "
                      f"{b[4]}::DOUBLE)" for c, b in rules.CITY_BOXES.items())


@query("p2_choose_bounds", sql("typed", f"""@
box(city, lat_min, lat_max, lon_min, lon_max) AS (VALUES {_BOX_ROWS}
  UNION ALL SELECT 'detected', quantile_cont(latitude, 0.01), quantile_cont(latitude, 0.99),
    quantile_cont(longitude, 0.01), quantile_cont(longitude, 0.99) FROM typed)
SELECT city, round(lat_min, 6) AS lat_min, round(lat_max, 6) AS lat_max,
  round(lon_min, 6) AS lon_min, round(lon_max, 6) AS lon_max,
  count(*) FILTER (latitude BETWEEN lat_min AND lat_max AND longitude BETWEEN lon_min AND lon_max)
    AS inside
FROM typed JOIN box ON true GROUP BY ALL"""))
def p2(spark, d):
    """Every way of choosing a box, and the rows each would keep, counted in one pass."""
    typed = plan.typed_coordinates(fx.complaints(spark, d))
    boxes = {c: plan.choose_box(typed, c) for c in rules.CITY_BOXES}
    boxes["detected"] = plan.detect_box(typed)
    rows = F.array(*[
        F.struct(F.lit(c).alias("city"),
                 *[F.round(F.lit(v), 6).alias(n) for v, n in zip(
                     b, ("lat_min", "lat_max", "lon_min", "lon_max"))],
                 F.col(c).alias("inside")) for c, b in boxes.items()])
    counted = typed.agg(*[
        F.count_if(F.col("latitude").between(b[0], b[1]) & F.col("longitude").between(b[2], b[3]))
        .alias(c) for c, b in boxes.items()])
    return counted.select(F.inline(rows))


@query("p3_detect_bounds", sql("typed", """
SELECT round(quantile_cont(latitude, 0.01), 6) AS lat_min,
  round(quantile_cont(latitude, 0.99), 6) AS lat_max,
  round(quantile_cont(longitude, 0.01), 6) AS lon_min,
  round(quantile_cont(longitude, 0.99), 6) AS lon_max, count(latitude) AS known FROM typed"""))
def p3(spark, d):
    raw = fx.complaints(spark, d)
    box = plan.detect_box(raw)
    return raw.agg(
        *[F.round(F.lit(v), 6).alias(n) for v, n in zip(
            box, ("lat_min", "lat_max", "lon_min", "lon_max"))],
        F.count(C.number(F.col("latitude"))).alias("known"))


@query("p4_box_filter", sql("typed", """
SELECT cmplnt_num, latitude, longitude FROM typed
WHERE latitude BETWEEN 40.4 AND 41.0 AND longitude BETWEEN -74.3 AND -73.7"""))
def p4(spark, d):
    df = plan.typed_coordinates(fx.complaints(spark, d))
    return plan.keep_in_box(df, plan.choose_box(city="nyc")).select(
        "cmplnt_num", "latitude", "longitude")


@query("p5_offense_standardise", sql("raw", f"""
SELECT cmplnt_num, {offense_type()} AS crime_type FROM raw"""))
def p5(spark, d):
    return fx.complaints(spark, d).select(
        "cmplnt_num", C.offense_type(F.col("ofns_desc")).alias("crime_type"))


_MAPPED = " OR ".join(f"regexp_matches(upper(ofns_desc), {quoted(p)})"
                      for p, _ in rules.OFFENSE_PATTERNS)


@query("p5_offense_statistics", sql("raw", f"""
SELECT count(*) FILTER ({_MAPPED}) AS mapped, count(DISTINCT trim(upper(ofns_desc))) AS before,
  count(DISTINCT {offense_type()}) AS after FROM raw"""))
def p5_statistics(spark, d):
    texts = fx.complaints(spark, d).groupBy(
        C.offense_text(F.col("ofns_desc")).alias("text")).agg(F.count("*").alias("n"))
    return plan.offense_totals(texts)


@query("p6_offense_category", sql("raw", f"""
SELECT cmplnt_num, {category(offense_type())} AS crime_category,
  {category('upper(ofns_desc)')} AS raw_category FROM raw"""))
def p6(spark, d):
    return fx.complaints(spark, d).select(
        "cmplnt_num",
        C.offense_category(C.offense_type(F.col("ofns_desc"))).alias("crime_category"),
        C.offense_category(F.upper("ofns_desc")).alias("raw_category"))


@query("p7_severity_weight", sql("raw", f"""
SELECT cmplnt_num, {severity(offense_type())} AS severity_weight FROM raw"""))
def p7(spark, d):
    return fx.complaints(spark, d).select(
        "cmplnt_num",
        C.severity_weight(C.offense_type(F.col("ofns_desc"))).alias("severity_weight"))


@query("p8_age_group", sql("raw", """
SELECT cmplnt_num, CASE WHEN trim(upper(vic_age_group)) NOT IN ('NAN', 'UNKNOWN', '')
  THEN trim(upper(vic_age_group)) END AS vic_age_group FROM raw"""))
def p8(spark, d):
    return fx.complaints(spark, d).select(
        "cmplnt_num", C.age_group(F.col("vic_age_group")).alias("vic_age_group"))


@query("p9_race", sql("raw", """
SELECT cmplnt_num, CASE WHEN contains(upper(vic_race), 'UNKNOWN') THEN 'UNKNOWN'
  ELSE coalesce(trim(upper(vic_race)), 'NAN') END AS vic_race FROM raw"""))
def p9(spark, d):
    return fx.complaints(spark, d).select(
        "cmplnt_num", C.race(F.col("vic_race")).alias("vic_race"))


@query("p10_sex", sql("raw", """
SELECT cmplnt_num, CASE WHEN upper(left(trim(vic_sex), 1)) NOT IN ('N', 'U', '')
  THEN upper(left(trim(vic_sex), 1)) END AS vic_sex FROM raw"""))
def p10(spark, d):
    return fx.complaints(spark, d).select("cmplnt_num", C.sex(F.col("vic_sex")).alias("vic_sex"))


@query("p11_timestamps", sql("raw", """@
parsed AS (
  SELECT cmplnt_num, try_strptime(cmplnt_fr_dt || ' ' || cmplnt_fr_tm, '%m/%d/%Y %H:%M:%S') AS t,
    try_strptime(cmplnt_fr_dt, '%m/%d/%Y') AS day FROM raw)
SELECT cmplnt_num, strftime(t, '%Y-%m-%d %H:%M:%S') AS occurred_at,
  CAST(coalesce(hour(t), 12) AS INTEGER) AS hour_of_day,
  CAST(coalesce(isodow(t) - 1, 0) AS INTEGER) AS day_of_week,
  CAST(coalesce(hour(day), 12) AS INTEGER) AS hour_from_date_only FROM parsed"""))
def p11(spark, d):
    raw = fx.complaints(spark, d)
    both = C.timestamp(F.col("cmplnt_fr_dt"), F.col("cmplnt_fr_tm"))
    return raw.select(
        "cmplnt_num", F.date_format(both, "yyyy-MM-dd HH:mm:ss").alias("occurred_at"),
        C.hour_or_noon(both).alias("hour_of_day"), C.weekday_or_monday(both).alias("day_of_week"),
        C.hour_or_noon(C.timestamp(F.col("cmplnt_fr_dt"))).alias("hour_from_date_only"))


@query("p12_drop_incomplete", sql("typed", """
SELECT cmplnt_num, latitude, longitude, ofns_desc AS crime_type FROM typed
WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND ofns_desc IS NOT NULL"""))
def p12(spark, d):
    df = plan.typed_coordinates(src.normalise_columns(fx.complaints(spark, d)))
    return plan.drop_incomplete(df).select("cmplnt_num", "latitude", "longitude", "crime_type")


@query("p13_cleaning_report", sql("typed", f"""@
flags AS (
  SELECT *, coalesce(latitude BETWEEN 40.4 AND 41.0 AND longitude BETWEEN -74.3 AND -73.7, false)
    AS inside FROM typed),
t AS (
  SELECT count(*) AS initial, count(*) FILTER (inside) AS in_box,
    count(DISTINCT trim(upper(ofns_desc))) FILTER (inside) AS before,
    count(DISTINCT {offense_type()}) FILTER (inside) AS after,
    count(*) FILTER (inside AND ({_MAPPED})) AS mapped,
    count(*) FILTER (inside AND try_strptime(cmplnt_fr_dt, '%m/%d/%Y') IS NULL) AS unparsed,
    count(*) FILTER (inside AND ofns_desc IS NULL) AS incomplete FROM flags)
SELECT 1::INTEGER AS step_no, 'Coordinate validation' AS name, initial - in_box AS removed,
  'Filtered to bounds (40.4, 41.0, -74.3, -73.7)' AS details FROM t
UNION ALL SELECT 2, 'Crime type standardization', 0,
  before || ' -> ' || after || ' unique types, ' || mapped || ' mapped' FROM t
UNION ALL SELECT 3, 'Demographic cleaning', 0,
  'Cleaned columns: vic_age_group, vic_race, vic_sex' FROM t
UNION ALL SELECT 4, 'Timestamp parsing', 0, unparsed || ' parse failures' FROM t
UNION ALL SELECT 5, 'Remove incomplete rows', incomplete,
  'Missing latitude, longitude, crime_type' FROM t
UNION ALL SELECT 6, 'Total', initial - in_box + incomplete,
  'Initial ' || initial || ', final ' || (in_box - incomplete) || ', removed ' ||
  CAST({half_up('(initial - in_box + incomplete) * 100::DOUBLE / initial', 1)} AS VARCHAR) || '%'
  FROM t"""))
def p13(spark, d):
    return plan.cleaning_report(fx.complaints(spark, d), city="nyc")


_INC = """SELECT incident_id, latitude, longitude, crime_type, crime_category, severity_weight,
  strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, hour_of_day, day_of_week, borough,
  vic_age_group, vic_race, vic_sex, law_cat_cd, prem_typ_desc FROM inc"""


@query("p14_clean_incidents", sql("inc", _INC))
def p14(spark, d):
    return plan.clean(fx.complaints(spark, d), city="nyc").select(
        "incident_id", *rules.STORAGE_COLUMNS, "law_cat_cd", "prem_typ_desc").withColumn(
        "occurred_at", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"))


def _race8(c):
    words = lambda ws: "(" + " OR ".join(contains(c)(w) for w in ws) + ")"
    rows = [(" AND ".join(words(w) for w in need), quoted(v)) for need, v in rules.RACE_LABELS_8]
    unknown = f"trim({c}) IN ({', '.join(quoted(w) for w in rules.RACE_UNKNOWN_WORDS)})"
    return cases([(unknown, "'UNKNOWN'"), *rows], str, "'OTHER'")


@query("p15_race_eight_labels", sql("raw", f"""
SELECT cmplnt_num, {_race8("upper(vic_race)")} AS race_label FROM raw"""))
def p15(spark, d):
    return fx.complaints(spark, d).select(
        "cmplnt_num", C.race_label_8(F.col("vic_race")).alias("race_label"))


_RACE4 = cases([(ws, quoted(v)) for ws, v in rules.RACE_LABELS_4],
               lambda ws: "(" + " OR ".join(contains("upper(vic_race)")(w) for w in ws) + ")",
               "'OTHER'")


@query("p16_race_four_labels", sql("raw", f"""
SELECT cmplnt_num, {_RACE4} AS race_label FROM raw"""))
def p16(spark, d):
    return fx.complaints(spark, d).select(
        "cmplnt_num", C.race_label_4(F.col("vic_race")).alias("race_label"))


@query("p17_fill_coordinates", sql("typed", """
SELECT cmplnt_num, coalesce(CASE WHEN CAST(cmplnt_num AS BIGINT) % 7 <> 0 THEN latitude END,
    latitude) AS latitude,
  coalesce(CASE WHEN CAST(cmplnt_num AS BIGINT) % 7 <> 0 THEN longitude END, longitude)
    AS longitude FROM typed WHERE latitude IS NOT NULL AND longitude IS NOT NULL"""))
def p17(spark, d):
    """A second coordinate pair with gaps, filled from the first."""
    df = plan.typed_coordinates(fx.complaints(spark, d))
    has = F.col("cmplnt_num").cast("long") % 7 != 0
    df = df.withColumns({
        "other_latitude": F.when(has, F.col("latitude")),
        "other_longitude": F.when(has, F.col("longitude"))})
    return df.select(
        "cmplnt_num", F.coalesce("other_latitude", "latitude").alias("latitude"),
        F.coalesce("other_longitude", "longitude").alias("longitude")).na.drop(
        subset=["latitude", "longitude"])


_RAW_COLUMNS = ["cmplnt_num", "cmplnt_fr_dt", "cmplnt_fr_tm", "ofns_desc", "law_cat_cd",
                "boro_nm", "prem_typ_desc", "vic_age_group", "vic_race", "vic_sex", "latitude",
                "longitude"]


@query("p18_null_counts", sql("raw", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM raw"
    for c in _RAW_COLUMNS)))
def p18(spark, d):
    return stats.null_counts(fx.complaints(spark, d))


_NUMERIC = ["latitude", "longitude", "severity_weight", "hour_of_day"]


@query("p19_describe", sql("inc", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
  round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 6) AS q25,
  round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS q50,
  round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 6) AS q75,
  round(CAST(max({c}) AS DOUBLE), 6) AS max FROM inc""" for c in _NUMERIC)))
def p19(spark, d):
    out = stats.describe(fx.incidents(spark, d), _NUMERIC)
    return out.select("column", "count", *[
        F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("p20_date_parts", sql("inc", """
SELECT incident_id, CAST(hour(occurred_at) AS INTEGER) AS hour,
  CAST(isodow(occurred_at) - 1 AS INTEGER) AS day_of_week,
  CAST(month(occurred_at) AS INTEGER) AS month FROM inc"""))
def p20(spark, d):
    t = F.col("occurred_at")
    return fx.incidents(spark, d).select(
        "incident_id", F.hour(t).alias("hour"), F.weekday(t).alias("day_of_week"),
        F.month(t).alias("month"))


_INNER = (40.4774, 40.9176, -74.2591, -73.7004)


@query("p22_box_and_first_ten", sql("inc", """
SELECT incident_id, latitude, longitude FROM inc WHERE latitude BETWEEN 40.4774 AND 40.9176
  AND longitude BETWEEN -74.2591 AND -73.7004
ORDER BY length(incident_id), incident_id LIMIT 10"""))
def p22(spark, d):
    return (plan.keep_in_box(fx.incidents(spark, d), _INNER)
            .select("incident_id", "latitude", "longitude")
            .orderBy(F.length("incident_id"), "incident_id").limit(10))


@query("p23_distinct_values", sql("inc", """
SELECT DISTINCT crime_type, vic_race FROM inc"""))
def p23(spark, d):
    return fx.incidents(spark, d).select("crime_type", "vic_race").distinct()


@query("p24_first_rows", sql("inc", """
SELECT incident_id, crime_type, borough FROM inc
ORDER BY occurred_at NULLS FIRST, length(incident_id), incident_id LIMIT 5"""))
def p24(spark, d):
    return (fx.incidents(spark, d)
            .orderBy(F.asc_nulls_first("occurred_at"), F.length("incident_id"), "incident_id")
            .limit(5).select("incident_id", "crime_type", "borough"))


@query("p25_label_filters", sql("inc", """
SELECT incident_id, crime_type FROM inc WHERE vic_age_group = '65+' AND vic_sex = 'F'
  AND crime_type IN (SELECT crime_type FROM inc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"""))
def p25(spark, d):
    df = fx.incidents(spark, d)
    top = stats.top_overall(df, "crime_type", 5)
    return (df.filter((F.col("vic_age_group") == "65+") & (F.col("vic_sex") == "F"))
            .join(top, "crime_type", "left_semi").select("incident_id", "crime_type"))


@query("p26_severity_lookup", sql("inc", f"""
SELECT incident_id, {cases([(k, str(v)) for k, v in rules.SEVERITY_POINTS.items()],
                           lambda k: f"crime_type = {quoted(k)}", "3")} / 10::DOUBLE AS weight
FROM inc"""))
def p26(spark, d):
    return fx.incidents(spark, d).select(
        "incident_id", (C.severity_points(F.col("crime_type")) / 10).alias("weight"))
