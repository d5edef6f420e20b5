import datetime as dt
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from incidentlens.functions import rules
from incidentlens.operators import risk
from incidentlens.operators.scoring import adjust_scores
from incidentlens.session import scratch_folder
from incidentlens.streaming import incremental


def incidents(spark, rows):
    return spark.createDataFrame(
        [(i, 40.7581, -73.9851, c, dt.datetime.fromisoformat(t), 22, 5, a, s)
         for i, c, t, a, s in rows],
        "incident_id STRING, latitude DOUBLE, longitude DOUBLE, crime_category STRING, "
        "occurred_at TIMESTAMP, hour_of_day INT, day_of_week INT, vic_age_group STRING, "
        "vic_sex STRING")


def test_risk_table(spark):
    df = incidents(spark, [("1", "sexual", "2024-02-10", "65+", "F"),
                           ("2", "theft", "2024-01-01", "<18", "M"),
                           ("3", "theft", "2023-01-01", None, None)])
    got = {r.demographic_group: r for r in risk.risk_table(df, "2024-02-20").collect()}
    assert set(got) == {"general", "women", "children", "elderly"}
    assert got["general"].raw_crime_count == 3
    assert got["general"].weighted_crime_count == pytest.approx(1.0 + 0.7 + 0.4)
    assert got["women"].risk_score == pytest.approx(1.8)
    assert got["children"].risk_score == pytest.approx(0.7 * 0.8)
    assert got["general"].grid_cell_id == "40758_-73985"
    assert got["general"].hour_bucket == "evening" and got["general"].day_type == "weekend"


def test_refresh_equals_rebuild(spark):
    old = incidents(spark, [("1", "theft", "2024-01-01", None, "F")])
    new = incidents(spark, [("2", "theft", "2024-02-01", None, "M")])
    table = risk.refresh_risk(risk.risk_table(old, "2024-02-20"), old, new, "2024-02-20")
    full = risk.risk_table(old.unionByName(new), "2024-02-20")
    show = lambda t: sorted(map(str, t.withColumn(
        "crime_breakdown", F.to_json("crime_breakdown")).collect()))
    assert show(table) == show(full)


def test_adjusted_scores(spark):
    places = spark.createDataFrame(
        [(1, 50.0, "women"), (2, 50.0, "general"), (3, 50.0, "nobody"), (4, 50.0, "women")],
        "loc_id INT, base_score DOUBLE, demographic_group STRING")
    counts = spark.createDataFrame(
        [(i, *[int(c in ("sexual", "other")) for c in rules.CATEGORIES]) for i in (1, 2, 3)],
        "loc_id INT, " + ", ".join(f"{c} BIGINT" for c in rules.CATEGORIES))
    got = {r.loc_id: r.adjusted_score for r in adjust_scores(places, counts).collect()}
    assert got == {1: 46.0, 2: 50.0, 3: 50.0, 4: 50.0}


def test_exposure(spark):
    rows = [("women", 1, "Bar", 22, 1.5), ("women", 3, "Bar", 23, 0.8), ("women", 1, "Bar", 20, 1.0),
            ("children", 1, "Park", 12, 2.0), ("children", 2, "Park", 12, 0.5),
            ("elderly", 1, "x", 3, 1.8), ("general", 1, "Bar", 23, 1.0)]
    df = spark.createDataFrame(rows, "g STRING, p INT, v STRING, h INT, want DOUBLE")
    for r in df.select("want", risk.exposure(*[F.col(c) for c in "gpvh"]).alias("got")).collect():
        assert r.got == r.want


def test_stream_drops_copies_and_marks_late_rows(spark):
    feed = scratch_folder(spark, "feed")
    first = incidents(spark, [("1", "x", "2024-01-01", None, None), ("1", "x", "2024-01-01", None,
                              None), ("2", "x", "2024-01-20", None, None)])
    late = incidents(spark, [("3", "x", "2023-06-01", None, None)]).withColumn(
        "latitude", F.lit(41.5))
    out, marks = scratch_folder(spark, "out"), scratch_folder(spark, "marks")
    state, state2 = scratch_folder(spark, "state"), scratch_folder(spark, "state")
    for batch in (first, late):
        batch.coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(first.schema).parquet(feed)
        incremental.run_counts(stream, out, state)
        incremental.run_marking(stream, marks, state2)
    windows = {(str(r.window_start)[:10], r["count"]) for r in spark.read.parquet(out).collect()}
    assert windows == {("2024-01-01", 1)}
    cells = {r.grid_cell_id for r in spark.read.parquet(marks).collect()}
    assert "41500_-73985" in cells and len(cells) == 2


def test_streamed_totals_survive_a_repeated_batch(spark, tmp_path):
    """Totals replace totals: writing a batch again changes nothing, and only changed cells are listed."""
    from incidentlens.streaming import incremental as inc

    schema = ("incident_id STRING, latitude DOUBLE, longitude DOUBLE, hour_of_day INT, day_of_week INT, "
              "crime_category STRING, occurred_at TIMESTAMP, vic_age_group STRING, vic_sex STRING")
    rows = [(str(i), 40.5 + (i % 3) / 100, -74.0, i % 24, i % 7, "THEFT", None if i % 5 == 0 else
             datetime(2024, 1, 1 + i % 20), "65+" if i % 2 else None, "F") for i in range(60)]
    first, second = spark.createDataFrame(rows[:50], schema), spark.createDataFrame(
        [r for r in rows[50:] if r[1] == 40.5], schema)
    feed, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    first.write.parquet(feed)
    stream = spark.readStream.schema(schema).parquet(feed)
    inc.run_day_counts(stream, out, state)
    table = risk.risk_from_counts(inc.current_totals(spark, out), "2024-02-20").cache()
    before = inc.last_batch(spark, out)
    second.write.mode("append").parquet(feed)
    inc.run_day_counts(stream, out, state)
    again = inc.written_totals(spark, out).filter(F.col("batch") == inc.last_batch(spark, out)).drop("batch", "bucket")
    inc.write_totals(spark.createDataFrame(again.collect(), again.schema), inc.last_batch(spark, out), out)
    touched = inc.changed_cells(spark, out, before)
    assert [r.grid_cell_id for r in touched.collect()] == ["40500_-74000"]
    got = risk.refresh_from_counts(table, inc.current_totals(spark, out, touched), touched, "2024-02-20")
    want = risk.risk_table(first.unionByName(second), "2024-02-20")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_merge_writes_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "table")
    day = lambda n: date(2024, 1, n)
    table = spark.createDataFrame([(f"p{i}", day(1), 1, "x") for i in range(200)],
                                  "name STRING, last_verified_at DATE, verification_count INT, type STRING")
    risk.write_verified(table, path)
    stamps = {f: f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}
    seen = spark.createDataFrame([("p3", day(5)), ("p3", day(4)), ("new", day(6))], "name STRING, seen_at DATE")
    assert len(risk.merge_written(spark, path, seen, 1)) == 2
    risk.merge_written(spark, path, seen, 1)
    left = [f for f, at in stamps.items() if f.exists() and f.stat().st_mtime_ns == at]
    assert len({f.parent for f in stamps}) - len({f.parent for f in left}) <= 2
    rows = {r.name: r for r in risk.read_verified(spark, path).collect()}
    assert len(rows) == 201 and rows["p3"].last_verified_at == day(5) and rows["p3"].verification_count == 3
    assert rows["new"].verification_count == 1 and rows["new"].type is None and rows["p4"].verification_count == 1
    risk.merge_written(spark, path, seen, 2)
    assert {r.name: r.verification_count for r in risk.read_verified(spark, path).collect()}["p3"] == 5
    assert risk.merge_written(spark, path, seen.limit(0), 3) == []
