from pyspark.sql import functions as F

from incidentlens.functions import rules
from incidentlens.operators import distance_join as J
from incidentlens.plans import safety_card as card


def frames(spark):
    places = [(1, 40.70, -74.0), (2, 40.71, -74.0), (2, 40.71, -74.0), (3, 10.0, 10.0), (4, None, 1.0), (5, 40.75, -74.0),
              (None, 40.70, -74.0)]
    locations = spark.createDataFrame(places, "loc_id INT, lat DOUBLE, lon DOUBLE")
    rows = []
    for i in range(120):
        rows.append((40.70 + i % 7 * 0.004, -74.0 + i % 3 * 0.004, ["A", "B", None, "C"][i % 4], i % 24,
                     ["<18", "65+", None][i % 3], ["WHITE", "BLACK", None, None, "ASIAN"][i % 5], ["F", "M"][i % 2],
                     rules.CATEGORIES[i % len(rules.CATEGORIES)]))
    # Only nulls near location 5.
    rows = [r for r in rows if r[0] < 40.71] + [(40.775, -74.0, None, 3, None, None, None, "other")]
    incidents = spark.createDataFrame(
        rows, "latitude DOUBLE, longitude DOUBLE, crime_type STRING, hour_of_day INT, vic_age_group STRING, "
        "vic_race STRING, vic_sex STRING, crime_category STRING").withColumn(
        "occurred_at", F.lit("2024-01-15 10:00:00").cast("timestamp"))
    return locations, incidents


def test_values_on_one_wide_row_equal_values_in_rows(spark):
    locations, incidents = frames(spark)
    wide = card.nearby_values(locations, incidents).collect()
    long = card.nearby_values(locations, incidents, most=0).collect()
    assert len(long) > 2 and sorted(map(str, wide)) == sorted(map(str, long))


def test_summary_counts_in_one_pass(spark, monkeypatch):
    locations, incidents = frames(spark)
    calls = []
    monkeypatch.setattr(J, "counts_within", lambda *a, join=J.counts_within, **k: calls.append(a) or join(*a, **k))
    one = card.nearby_summary(locations, incidents, now="2024-01-20 00:00:00").collect()
    assert len(calls) == 1
    monkeypatch.setattr(card, "MOST_VALUES", 0)
    two = card.nearby_summary(locations, incidents, now="2024-01-20 00:00:00").collect()
    assert len(calls) == 3 and sorted(map(str, one)) == sorted(map(str, two))
