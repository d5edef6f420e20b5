"""The cleaning chain: raw complaint text to typed incidents, with a report of every step."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import geo, rules
from ..operators.quantiles import exact_quantiles
from ..session import stored
from ..sources.complaints import normalise_columns


def detect_box(df: DataFrame, lat: str = "latitude", lon: str = "longitude",
               percentile: float = 1.0, ignore_zero: bool = False):
    """Box between the low and high percentile of each axis (linear interpolation, exact)."""
    probs = [percentile / 100, 1 - percentile / 100]
    pair = df.select(C.number(F.col(lat)).alias("lat"), C.number(F.col(lon)).alias("lon"))
    if ignore_zero:
        pair = pair.filter((F.col("lat") != 0) | (F.col("lon") != 0))
    found = exact_quantiles(pair, ["lat", "lon"], probs)
    return (*found["lat"], *found["lon"])


def choose_box(df: DataFrame | None = None, city: str | None = None, box=None):
    """Explicit box > city > ACTIVE_CITY > detected from data > default city."""
    if box is not None:
        return tuple(box)
    for name in (city, os.getenv("ACTIVE_CITY", "").lower()):
        if name and name in rules.CITY_BOXES:
            return geo.city_box(name)
    if df is not None and not df.isEmpty():
        found = detect_box(df)
        if None not in found:
            return found
    return geo.city_box(rules.DEFAULT_CITY)


def typed_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.withColumns({lat: C.number(F.col(lat)), lon: C.number(F.col(lon))})


def keep_in_box(df: DataFrame, box, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.filter(geo.in_box(F.col(lat), F.col(lon), box))


def standardise(df: DataFrame, time_col: str | None = "cmplnt_fr_tm") -> DataFrame:
    """All column rules; columns that are missing are left out.

    Each step reads the columns of the step before, so no rule is evaluated twice per row.
    """
    have = set(df.columns)
    kind, when = F.col("crime_type"), F.col("occurred_at")
    texts = {}
    if "crime_type" in have:
        texts["crime_type"] = C.offense_text(kind)
    for name, rule in (("vic_age_group", C.age_group), ("vic_race", C.race), ("vic_sex", C.sex)):
        if name in have:
            texts[name] = rule(F.col(name))
    if "cmplnt_fr_dt" in have:
        time = F.col(time_col) if time_col and time_col in have else None
        texts["occurred_at"] = C.timestamp(F.col("cmplnt_fr_dt"), time)
    df = df.withColumns(texts) if texts else df
    derived = {}
    if "crime_type" in have:
        df = df.withColumn("crime_type", F.coalesce(C.offense_pattern(kind), kind))
        derived["crime_category"] = C.offense_category(kind)
        derived["severity_weight"] = C.severity_weight(kind)
    if "cmplnt_fr_dt" in have:
        derived["hour_of_day"] = C.hour_or_noon(when)
        derived["day_of_week"] = C.weekday_or_monday(when)
    return df.withColumns(derived) if derived else df


def drop_incomplete(df: DataFrame, required=tuple(rules.REQUIRED_COLUMNS)) -> DataFrame:
    for c in required:
        if c in df.columns:
            df = df.filter(F.col(c).isNotNull())
    return df


def clean(raw: DataFrame, city: str | None = None, box=None,
          time_col: str | None = "cmplnt_fr_tm") -> DataFrame:
    """Raw records to incidents. One narrow stage without a shuffle.

    No rule turns a value into null or null into a value for the required columns, so rows are
    dropped before the text rules run.
    """
    df = typed_coordinates(normalise_columns(raw))
    df = drop_incomplete(keep_in_box(df, choose_box(df, city, box)))
    df = standardise(df, time_col)
    if "cmplnt_num" in df.columns:
        df = df.withColumn("incident_id", F.col("cmplnt_num"))
    return df


def offense_totals(rows: DataFrame, text: str = "text", counted: str = "n") -> DataFrame:
    """Distinct offenses before and after standardisation, and rows mapped, from counts per text.

    The rules then run once per distinct text instead of once per row.
    """
    t, n = F.col(text), F.col(counted)
    seen = (n > 0) & t.isNotNull()
    name = F.coalesce(C.offense_pattern(t), t)
    return rows.agg(
        F.coalesce(F.sum(F.when(C.offense_pattern(t).isNotNull(), n)), F.lit(0)).alias("mapped"),
        F.count_if(seen).alias("before"), F.count_distinct(F.when(seen, name)).alias("after"))


def cleaning_report(raw: DataFrame, city: str | None = None, box=None,
                    time_col: str | None = "cmplnt_fr_tm") -> DataFrame:
    """Step table (step_no, name, removed, details) from one pass over the raw records."""
    df = typed_coordinates(normalise_columns(raw))
    box = choose_box(df, city, box)
    inside = F.coalesce(geo.in_box(F.col("latitude"), F.col("longitude"), box), F.lit(False))
    time = F.col(time_col) if time_col and time_col in df.columns else None
    flags = df.select(
        inside.alias("inside"), C.offense_text(F.col("crime_type")).alias("text"),
        C.timestamp(F.col("cmplnt_fr_dt"), time).isNull().alias("unparsed"))
    per_text = stored(flags.groupBy("text").agg(
        F.count("*").alias("initial"), F.count_if("inside").alias("n"),
        F.count_if(F.col("inside") & F.col("unparsed")).alias("unparsed"),
        F.count_if(F.col("inside") & F.col("text").isNull()).alias("incomplete")))
    sums = per_text.agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (
            ("initial", "initial"), ("n", "in_box"), ("unparsed", "unparsed"),
            ("incomplete", "incomplete"))])
    offenses = offense_totals(per_text)
    totals = sums.withColumns({c: offenses.select(c).scalar()
                               for c in ("mapped", "before", "after")})
    demographics = ", ".join(c for c in rules.DEMOGRAPHIC_COLUMNS if c in df.columns)
    zero = F.lit(0).cast("long")
    steps = [
        ("Coordinate validation", F.col("initial") - F.col("in_box"),
         F.lit("Filtered to bounds (" + ", ".join(str(v) for v in box) + ")")),
        ("Crime type standardization", zero,
         F.concat(F.col("before"), F.lit(" -> "), F.col("after"), F.lit(" unique types, "),
                  F.col("mapped"), F.lit(" mapped"))),
        ("Demographic cleaning", zero, F.lit(f"Cleaned columns: {demographics}")),
        ("Timestamp parsing", zero, F.concat(F.col("unparsed"), F.lit(" parse failures"))),
        ("Remove incomplete rows", F.col("incomplete"),
         F.lit("Missing " + ", ".join(rules.REQUIRED_COLUMNS))),
    ]
    removed = F.col("initial") - F.col("in_box") + F.col("incomplete")
    percent = F.when(F.col("initial") > 0, removed * 100.0 / F.col("initial")).otherwise(0.0)
    steps.append(("Total", removed, F.concat(
        F.lit("Initial "), F.col("initial"), F.lit(", final "), F.col("initial") - removed,
        F.lit(", removed "), C.round_half_up(percent, 1).cast("string"), F.lit("%"))))
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("name"),
                 gone.alias("removed"), details.alias("details"))
        for i, (name, gone, details) in enumerate(steps)])
    return totals.select(F.inline(rows))
