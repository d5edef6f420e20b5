import pytest
from pyspark.sql import functions as F

from incidentlens.functions import columns as C
from incidentlens.functions import geo, rules


def values(spark, rule, inputs, kind="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i INT, v {kind}")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


@pytest.mark.parametrize("rule, pairs", [
    (C.number, [("40.5", 40.5), (" 40.5 ", 40.5), ("bad", None), ("", None), (None, None),
                ("NaN", None), ("1d", None), ("1f", None), ("1e2", 100.0), ("-73", -73.0)]),
    (C.offense_type, [("Assault 3 & related", "ASSAULT_3"), ("HARRASSMENT 2", "HARASSMENT"),
                      (" petit larceny ", "PETIT_LARCENY"), ("grand larceny of motor vehicle",
                      "GRAND_LARCENY"), ("SEX CRIMES", "SEX_CRIMES"), ("arson", "ARSON"),
                      ("FELONY ASSAULT", "FELONY ASSAULT"), (None, None)]),
    (C.offense_category, [("RAPE", "sexual"), ("ASSAULT_3", "assault"), ("FELONY ASSAULT",
                          "assault"), ("DWI", "other"), ("BURGLARY", "property"),
                          (None, "other"), ("PETIT_LARCENY", "theft")]),
    (C.severity_weight, [("RAPE", 0.95), ("ASSAULT_3", 0.7), ("ARSON", 0.5), (None, 0.5)]),
    (C.severity_points, [("RAPE", 9), ("RAPE 1", 3), ("FELONY ASSAULT", 8), (None, 3)]),
    (C.age_group, [("65+", "65+"), ("unknown", None), ("", None), (None, None), ("1018", "1018"),
                   ("nan", None)]),
    (C.race, [("white", "WHITE"), ("Unknown/Other", "UNKNOWN"), (None, "NAN")]),
    (C.sex, [("female", "F"), (" m", "M"), ("U", None), ("n", None), ("", None), (None, None),
             ("D", "D")]),
    (C.race_label_8, [("WHITE HISPANIC", "WHITE HISPANIC"), ("White", "WHITE"),
                      ("BLACK HISPANIC", "BLACK HISPANIC"), ("african american", "BLACK"),
                      ("AMERICAN INDIAN", "ASIAN"), ("LATINO", "HISPANIC"), ("UNKNOWN",
                      "UNKNOWN"), ("", "UNKNOWN"), (None, "OTHER"), ("UNKNOWN/OTHER", "OTHER")]),
    (C.race_label_4, [("WHITE HISPANIC", "WHITE"), ("KOREAN", "ASIAN"), (None, "OTHER")]),
])
def test_text_rules(spark, rule, pairs):
    assert values(spark, rule, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_timestamps(spark):
    df = spark.createDataFrame(
        [(0, "01/31/2024", "23:05:00"), (1, "2024-01-31", "08:00:00"), (2, "junk", "08:00:00"),
         (3, None, None), (4, "02/30/2024", "08:00:00"), (5, "01/31/2024", None)],
        "i INT, d STRING, t STRING").orderBy("i")
    when = C.timestamp(F.col("d"), F.col("t"))
    rows = df.select(when.cast("string"), C.hour_or_noon(when), C.weekday_or_monday(when)).collect()
    assert [tuple(r) for r in rows] == [
        ("2024-01-31 23:05:00", 23, 2), ("2024-01-31 08:00:00", 8, 2), (None, 12, 0),
        (None, 12, 0), (None, 12, 0), ("2024-01-31 00:00:00", 0, 2)]
    dates = df.select(C.hour_or_noon(C.timestamp(F.col("d")))).collect()
    assert [r[0] for r in dates] == [0, 0, 12, 12, 12, 0]


def test_levels_and_colours(spark):
    scores = [100.0, 80.0, 79.9, 60.0, 40.0, 39.9, 20.0, 0.0]
    assert values(spark, C.safety_level, scores, "DOUBLE") == [
        "Very Safe", "Very Safe", "Safe", "Safe", "Moderate", "Concerning", "Concerning",
        "High Risk"]
    assert values(spark, C.score_colour, [70.1, 70.0, 40.0], "DOUBLE") == [
        "green", "orange", "red"]


def test_time_decay_and_buckets(spark):
    assert values(spark, C.time_decay, [0, 29, 30, 89, 90], "INT") == [1.0, 1.0, 0.7, 0.7, 0.4]
    assert values(spark, C.time_bucket, [5, 6, 11, 12, 18, 23, 0], "INT") == [
        "night", "morning", "morning", "afternoon", "evening", "evening", "night"]


def test_quadrant_middle_is_north_east(spark):
    box = geo.city_box("nyc")
    mid = ((box[0] + box[1]) / 2, (box[2] + box[3]) / 2)
    df = spark.createDataFrame([(mid[0], mid[1]), (mid[0] - 0.1, mid[1] - 0.1)],
                               "a DOUBLE, o DOUBLE")
    got = [r[0] for r in df.select(geo.quadrant(F.col("a"), F.col("o"), box)).collect()]
    assert got == ["NE", "SW"]


def test_severity_points_follow_weights():
    for name, weight in rules.SEVERITY_WEIGHTS:
        assert rules.SEVERITY_POINTS[name] == int(weight * 10)
