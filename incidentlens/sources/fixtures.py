"""Incident, amenity, location and request views over the test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..plans.cleaning import clean
from ..session import prepare, stored

# fixed values of the fixture
OFFENSES = [
    "PETIT LARCENY", "HARRASSMENT 2", "ASSAULT 3 & RELATED OFFENSES", "FELONY ASSAULT",
    "GRAND LARCENY OF MOTOR VEHICLE", "CRIMINAL MISCHIEF & RELATED OF", "ROBBERY", "BURGLARY",
    "RAPE", "SEX CRIMES", "DRIVING WHILE INTOXICATED", "MURDER & NON-NEGL. MANSLAUGHTER",
    "DANGEROUS DRUGS", " grand larceny ", "OFF. AGNST PUB ORD SENSBLTY &", None,
]
LAW_CATEGORIES = ["FELONY", "MISDEMEANOR", "VIOLATION"]
PREMISES = ["STREET", "RESIDENCE", "TRANSIT", "STORE"]
BOROUGHS = ["MANHATTAN", "BROOKLYN", "QUEENS", "BRONX", "STATEN ISLAND"]
AGES = ["<18", "18-24", "25-44", "45-64", "65+", "UNKNOWN", "1018", None]
RACES = [
    "WHITE", "BLACK", "WHITE HISPANIC", "BLACK HISPANIC", "ASIAN / PACIFIC ISLANDER",
    "AMERICAN INDIAN/ALASKAN NATIVE", "UNKNOWN/OTHER", "hispanic", None,
]
SEXES = ["F", "M", "U", "D", None]
AMENITY_KINDS = ["park", "school", "restaurant", "hospital", "police", "subway"]
GROUPS = ["general", "women", "children", "elderly", "unknown"]
CONTEXT_WORDS = ["Restaurant", "Park", "School", "Senior Center", "Clinic", "Nightclub", "Store"]
GROUP_TEXTS = [
    "3 white women + 2 black men", "1 queer couple men", "2 asian women, 1 hispanic man",
    "family with 2 children", "", "two friends", "10 people", "1 elderly woman and 1 native man",
    "6 kids, 2 pregnant women, 1 wheelchair user", "gold transit riders",
]


def pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw complaint records, one per event, all text."""
    e, u = F.col("event_id"), F.col("user_id")
    spread_lat = F.lit(4040000) + (e * 7919) % 60000
    centre_lat = F.lit(4055000) + (u % 4) * 8000 + ((e * 37) % 11 - 5) * 40
    spread_lon = F.lit(-7430000) + (e * 104729) % 60000
    centre_lon = F.lit(-7415000) + (u % 3) * 12000 + ((e * 53) % 13 - 6) * 40
    degrees = lambda c: (c / F.lit(1e5)).cast("string")
    lat = (F.when(e % 89 == 0, None).when(e % 83 == 0, "bad").when(e % 197 == 0, "0")
           .when(e % 5 == 0, degrees(spread_lat)).otherwise(degrees(centre_lat)))
    lon = (F.when(e % 197 == 0, "0").when(e % 5 == 0, degrees(spread_lon))
           .otherwise(degrees(centre_lon)))
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("cmplnt_num"),
        F.when(e % 71 == 0, "not a date").otherwise(F.date_format("ts", "MM/dd/yyyy"))
         .alias("cmplnt_fr_dt"),
        F.date_format("ts", "HH:mm:ss").alias("cmplnt_fr_tm"),
        pick(OFFENSES, (e * 7 + u) % 16).alias("ofns_desc"),
        pick(LAW_CATEGORIES, e % 3).alias("law_cat_cd"),
        pick(BOROUGHS, u % 5).alias("boro_nm"),
        pick(PREMISES, u % 4).alias("prem_typ_desc"),
        pick(AGES, e % 8).alias("vic_age_group"),
        pick(RACES, (e + u) % 9).alias("vic_race"),
        pick(SEXES, u % 5).alias("vic_sex"),
        lat.alias("latitude"),
        lon.alias("longitude"))


_STORED = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table, built once per session and read back from the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        prepare(spark)
        _STORED[key] = stored(build())
    return _STORED[key]


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned incident table, as the cleaning job would have stored it."""
    return kept(spark, sf_dir, "incidents",
                lambda: clean(complaints(spark, sf_dir), city="nyc"))


def amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.when(k % 10 == 0, "nursing_home").otherwise(pick(AMENITY_KINDS, k % 6)).alias("type"),
        pick(BOROUGHS, k % 5).alias("borough"),
        ((F.lit(4050000) + (k * 3571) % 40000) / F.lit(1e5)).alias("latitude"),
        ((F.lit(-7420000) + (k * 2903) % 45000) / F.lit(1e5)).alias("longitude"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("loc_id"),
        ((F.lit(4050000) + (k * 13) % 40000) / F.lit(1e5)).alias("lat"),
        ((F.lit(-7420000) + (k * 29) % 45000) / F.lit(1e5)).alias("lon"),
        pick(GROUPS, k % 5).alias("demographic_group"),
        pick(CONTEXT_WORDS, k % 7).alias("amenity_type"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known places with the address fields a geocoder would give."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("place"),
        ((F.lit(4050000) + (k * 3571) % 40000) / F.lit(1e5)).alias("lat"),
        ((F.lit(-7420000) + (k * 2903) % 45000) / F.lit(1e5)).alias("lon"),
        F.when(k % 4 == 0, " New York ").when(k % 4 == 1, "Springfield").alias("city"),
        F.when(k % 5 == 0, "Kings County").alias("county"),
        pick(["New York", "Illinois", None], k % 3).alias("state"),
        F.initcap(pick(BOROUGHS, k % 5)).alias("borough"),
        F.when(k % 7 == 0, "Camden").alias("suburb"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person would type: a place or coordinates, and a description of the group."""
    k = F.col("c_custkey")
    place = F.concat(F.lit("Supplier#"), F.lpad((k % 120).cast("string"), 9, "0"))
    coords = F.concat(
        ((F.lit(4050000) + (k * 13) % 40000) / F.lit(1e5)).cast("string"), F.lit(", "),
        ((F.lit(-7420000) + (k * 29) % 45000) / F.lit(1e5)).cast("string"))
    message = (
        F.when(k % 9 == 0, F.concat(F.lit("Restaurant, "), place))
        .when(k % 9 == 1, F.concat(F.lit("PARK,  "), F.upper(place)))
        .when(k % 9 == 2, coords)
        .when(k % 9 == 3, F.concat(F.lit("School, "), coords))
        .when(k % 9 == 4, F.lit("Apt 5, 350 5th Ave"))
        .when(k % 9 == 5, F.concat(F.lit("Nightclub, "), place))
        .when(k % 9 == 6, F.lit(""))
        .when(k % 9 == 7, F.concat(F.lit("Shop, "), F.col("c_name")))
        .otherwise(place))
    group = F.concat(
        pick(GROUP_TEXTS, k % 10), F.when(k % 3 == 0, F.concat(
            F.lit(" and "), (k % 6).cast("string"), F.lit(" Latina women"))).otherwise(""))
    return table(spark, sf_dir, "customer").select(
        k.alias("loc_id"), message.alias("message"), group.alias("group_text"))


def service_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service-request file's columns, one row per order, all text."""
    k = F.col("o_orderkey")
    kinds = [*rules.SERVICE_REQUEST_KINDS, "Rodent", None]
    kind = pick(kinds, k % len(kinds))
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("Unique Key"),
        F.date_format("o_orderdate", "MM/dd/yyyy hh:mm:ss a").alias("Created Date"),
        F.when(k % 3 == 0, F.upper(kind)).otherwise(kind).alias("Complaint Type"),
        F.when(k % 19 == 0, None).otherwise(((F.lit(4050000) + (k * 17) % 40000) / F.lit(1e5)).cast("string"))
        .alias("Latitude"),
        ((F.lit(-7420000) + (k * 31) % 45000) / F.lit(1e5)).cast("string").alias("Longitude"))


def street_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A street-light file's columns, one row per part, all text."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("OBJECTID"),
        ((F.lit(4050000) + (k * 19) % 40000) / F.lit(1e5)).cast("string").alias("Latitude"),
        F.when(k % 23 == 0, "none").otherwise(((F.lit(-7420000) + (k * 37) % 45000) / F.lit(1e5)).cast("string"))
        .alias("Longitude"))
