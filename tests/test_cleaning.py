import numpy as np
import pytest

from incidentlens.operators.quantiles import exact_quantiles, percent_rank_by
from incidentlens.plans import cleaning as plan
from incidentlens.sources import complaints as src

RAW = [
    ("1", "01/02/2024", "10:00:00", "PETIT LARCENY", "40.7", "-74.0", "65+", "WHITE", "F"),
    ("2", "bad", "10:00:00", "ROBBERY", "40.4", "-74.3", "UNKNOWN", None, "U"),
    ("3", "01/02/2024", "10:00:00", None, "41.0", "-73.7", None, "BLACK", None),
    ("4", "01/02/2024", "10:00:00", "RAPE", "41.01", "-74.0", "<18", "x", "M"),
    ("5", "01/02/2024", "10:00:00", "RAPE", None, "-74.0", "<18", "x", "M"),
    ("6", "01/02/2024", "10:00:00", "RAPE", "NaN", "-74.0", "<18", "x", "M"),
]
COLUMNS = ("cmplnt_num STRING, cmplnt_fr_dt STRING, cmplnt_fr_tm STRING, ofns_desc STRING, "
           "latitude STRING, longitude STRING, vic_age_group STRING, vic_race STRING, "
           "vic_sex STRING")


def test_clean_keeps_box_edges_and_drops_nulls(spark):
    out = plan.clean(spark.createDataFrame(RAW, COLUMNS), city="nyc")
    rows = {r.incident_id: r for r in out.collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].crime_type == "PETIT_LARCENY" and rows["1"].hour_of_day == 10
    assert rows["2"].occurred_at is None and rows["2"].hour_of_day == 12
    assert rows["2"].vic_race == "NAN" and rows["2"].vic_age_group is None


def test_report_counts_every_step(spark):
    report = {r.name: r for r in plan.cleaning_report(
        spark.createDataFrame(RAW, COLUMNS), city="nyc").collect()}
    assert report["Coordinate validation"].removed == 3
    assert report["Remove incomplete rows"].removed == 1
    assert report["Timestamp parsing"].details == "1 parse failures"
    assert "final 2" in report["Total"].details


def test_empty_input(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert plan.clean(empty, city="nyc").count() == 0
    assert plan.choose_box(empty) == plan.choose_box(city="nyc")
    assert plan.cleaning_report(empty, city="nyc").count() == 6


def test_missing_optional_columns(spark):
    df = spark.createDataFrame([("40.7", "-74.0")], "latitude STRING, longitude STRING")
    out = plan.clean(df, city="nyc")
    assert out.columns == ["latitude", "longitude"] and out.count() == 1


def test_aliases(spark):
    df = spark.createDataFrame([("1", "2", "x", "y")], "`lat_lon.latitude` STRING, "
                               "Longitude STRING, ofns_desc STRING, offense_description STRING")
    row = src.normalise_columns(df).collect()[0].asDict()
    assert row["latitude"] == "1" and row["longitude"] == "2" and row["crime_type"] == "x"


def test_city_choice(spark, monkeypatch):
    monkeypatch.setenv("ACTIVE_CITY", "London")
    assert plan.choose_box()[0] == 51.28
    assert plan.choose_box(city="chicago")[0] == 41.64
    assert plan.choose_box(box=(1, 2, 3, 4)) == (1, 2, 3, 4)


@pytest.mark.parametrize("max_distinct", [200_000, 50, 3])
def test_quantiles_equal_numpy(spark, max_distinct):
    rng = np.random.default_rng(1)
    data = np.concatenate([np.round(rng.normal(40, 1, 1500), 3), np.full(700, 40.0), [1e6, -1e6]])
    df = spark.createDataFrame([(float(v),) for v in data] + [(None,)], "v DOUBLE")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["v"], probs, max_distinct)["v"]
    assert np.allclose(got, np.quantile(data, probs), rtol=0, atol=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v DOUBLE")
    assert exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}


def test_percent_rank_by(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)],
                               "g STRING, v DOUBLE")
    got = sorted((r.g, r.v, round(r.p, 4)) for r in percent_rank_by(df, "g", "v", "p").collect())
    assert got == [("a", 1.0, 0.0), ("a", 2.0, 0.3333), ("a", 2.0, 0.3333), ("a", 3.0, 1.0),
                   ("b", 5.0, 0.0)]


def test_city_layers(spark, tmp_path):
    from incidentlens.operators.risk import layer_counts
    from incidentlens.sources.city_layers import read_service_requests, read_street_lights

    (tmp_path / "r.csv").write_text(
        "Unique Key,Created Date,Complaint Type,Latitude,Longitude\n"
        '1,01/31/2024 01:02:03 PM,graffiti,40.751,-73.981\n'
        "2,2024-01-31T13:02:03.000,Illegal Parking,40.752,-73.982\n"
        "3,not a date,Graffiti,40.9,-73.7\n4,,Heating,40.7,-73.9\n5,,Graffiti,,\n")
    (tmp_path / "l.csv").write_text("OBJECTID,Latitude,Longitude\n7,40.7512,-73.9811\n8,x,-73.9\n")
    requests = read_service_requests(spark, str(tmp_path / "r.csv"))
    got = {r.request_id: str(r.created_at) for r in requests.collect()}
    assert got == {"1": "2024-01-31 13:02:03", "2": "2024-01-31 13:02:03", "3": "None"}
    assert read_service_requests(spark, str(tmp_path / "r.csv"), None).count() == 4
    lights = read_street_lights(spark, str(tmp_path / "l.csv"))
    cells = {r.grid_cell_id: (r.requests, r.lights) for r in layer_counts(
        {"requests": requests, "lights": lights}).collect()}
    assert sorted(cells.values()) == [(1, 0), (2, 1)]
