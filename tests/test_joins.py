import numpy as np
import pytest
from brute import haversine
from pyspark.sql import functions as F

from incidentlens.operators import distance_join as J
from incidentlens.operators import places
from incidentlens.operators.ranking import global_rank, rank_within, sample_rows
from incidentlens.operators.skew import salted_join
from incidentlens.session import prepare, stored


def frames(spark, seed=3, n=40, m=300, lat=40.7, lon=-74.0, spread=0.05):
    rng = np.random.default_rng(seed)
    loc = np.column_stack([rng.uniform(lat - spread, lat + spread, n),
                           rng.uniform(lon - spread, lon + spread, n)])
    pts = np.column_stack([rng.uniform(lat - spread, lat + spread, m),
                           rng.uniform(lon - spread, lon + spread, m)])
    pts[: m // 3] = pts[0]  # a third of the points share one place
    loc[: n // 3] = loc[0]
    locations = spark.createDataFrame(
        [(i, float(a), float(o)) for i, (a, o) in enumerate(loc)] + [(n, None, None)],
        "loc_id INT, lat DOUBLE, lon DOUBLE")
    points = spark.createDataFrame(
        [(i, float(a), float(o), "xy"[i % 2]) for i, (a, o) in enumerate(pts)]
        + [(m, None, 1.0, "x")], "pid INT, latitude DOUBLE, longitude DOUBLE, kind STRING")
    return loc, pts, locations, points


@pytest.mark.parametrize("lat, small_rows", [(40.7, 1000), (0.0, 0), (-60.0, 1000), (78.0, 0)])
def test_within_distance_equals_brute_force(spark, lat, small_rows):
    loc, pts, locations, points = frames(spark, lat=lat)
    got = {(r.loc_id, r.pid) for r in J.within_distance(
        locations, points, 2.0, small_rows=small_rows).collect()}
    d = haversine(loc[:, None, 0], loc[:, None, 1], pts[None, :, 0], pts[None, :, 1])
    assert got == set(zip(*np.nonzero(d <= 2.0)))


@pytest.mark.parametrize("lat", [40.7, 0.0, -60.0, 78.0])
@pytest.mark.parametrize("in_place, short_points", [(False, 1000), (True, 1000), (False, 0), (True, 0)])
def test_many_locations_with_short_or_long_points(spark, lat, in_place, short_points):
    loc, pts, locations, points = frames(spark, lat=lat)
    found = J.within_distance(locations, points, 2.0, small_rows=0, in_place=in_place, short_points=short_points)
    got = sorted((r.loc_id, r.pid) for r in found.collect())
    d = haversine(loc[:, None, 0], loc[:, None, 1], pts[None, :, 0], pts[None, :, 1])
    assert got == sorted(zip(*np.nonzero(d <= 2.0)))


def test_locations_of_one_coordinate_are_lists_of_bounded_length(spark):
    df = spark.createDataFrame([(i % 4, 1.0, 2.0) for i in range(25)] + [(9, 3.0, None)], "k INT, a DOUBLE, b DOUBLE")
    lists = [r["_rows"] for r in J.together(df, "a", "b", 10).collect()]
    assert max(map(len, lists)) <= 10 and sorted(x.k for rows in lists for x in rows) == sorted(i % 4 for i in range(25))


@pytest.mark.parametrize("per_list, per_block", [(50, 500), (3, 500), (50, 2), (2, 2)])
def test_places_near_come_in_order_for_every_incident(spark, monkeypatch, per_list, per_block):
    monkeypatch.setattr(places, "PER_LIST", per_list)
    monkeypatch.setattr(places, "PER_BLOCK", per_block)
    loc, pts, locations, points = frames(spark)
    incidents = locations.withColumnsRenamed({"loc_id": "incident_id", "lat": "latitude", "lon": "longitude"})
    d = haversine(loc[:, None, 0], loc[:, None, 1], pts[None, :, 0], pts[None, :, 1])
    for ordered in (True, False):
        got = places.places_near(incidents, points, 2.0, ordered=ordered).collect()
        assert sorted((r.incident_id, r.pid) for r in got) == sorted(zip(*np.nonzero(d <= 2.0)))
        if ordered:
            order = [(r.crime_lat, r.crime_lon, r.distance_meters) for r in got]
            assert order == sorted(order)


def test_places_near_a_crowded_coordinate_are_unrolled_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(places, "PER_UNROLLED", 5_000, raising=False)
    monkeypatch.setattr(places, "PER_TASK", 20_000, raising=False)
    crowd = [(i, 40.7, -74.0) for i in range(900)] + [(1_000 + i, 40.7 + i / 1000, -74.0) for i in range(1, 20)]
    incidents = spark.createDataFrame([*crowd, (None, 40.7, -74.0), (1, None, -74.0)],
                                      "incident_id INT, latitude DOUBLE, longitude DOUBLE")
    near = spark.createDataFrame([(i, 40.7 + i / 1e5, -74.0) for i in range(100)] + [(100, 40.7, None)],
                                 "pid INT, latitude DOUBLE, longitude DOUBLE")
    found = places.places_near(incidents, near, 0.5, ordered=True)
    rows = found.withColumn("part", F.spark_partition_id()).collect()
    at_crowd = [r for r in rows if r.crime_lat == 40.7]
    assert sorted((str(r.incident_id), r.pid) for r in at_crowd) == sorted(
        (str(i), p) for i in [*range(900), None] for p in range(100))
    order = [(r.part, r.crime_lat, r.crime_lon, r.distance_meters) for r in rows]
    assert order == sorted(order)
    per_part = [sum(r.part == p for r in rows) for p in {r.part for r in rows}]
    assert max(per_part) <= 40_000 < len(at_crowd)
    above = found._jdf.queryExecution().executedPlan().toString().split("rangepartitioning")[0]
    assert above.count("Exchange") == 1


def test_a_long_table_of_places_gives_the_same_rows_in_order(spark, monkeypatch):
    loc, pts, locations, points = frames(spark)
    incidents = locations.withColumnsRenamed({"loc_id": "incident_id", "lat": "latitude", "lon": "longitude"})
    monkeypatch.setattr(J, "HELD_POINTS", 0)
    got = places.places_near(incidents, points, 2.0, ordered=True).collect()
    d = haversine(loc[:, None, 0], loc[:, None, 1], pts[None, :, 0], pts[None, :, 1])
    assert sorted((r.incident_id, r.pid) for r in got) == sorted(zip(*np.nonzero(d <= 2.0)))
    order = [(r.crime_lat, r.crime_lon, r.distance_meters) for r in got]
    assert order == sorted(order)


def test_ranks_of_short_groups_need_no_further_exchange(spark):
    rows = [(i % 5, i * 7 % 50) for i in range(50)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g INT, v INT").repartitionByRange(3, "g")
    ranked = rank_within(df, ["g"], ["v"], "pos", short_groups=True).orderBy("g", "pos")
    got = [tuple(r) for r in ranked.select("g", "pos", "v").collect()]
    want = [(g, k + 1, v) for g in range(5) for k, v in enumerate(sorted(v for h, v in rows if h == g))]
    assert got == want
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1, plan


@pytest.mark.parametrize("kind", ["INT", "INT NOT NULL"])
def test_ranks_of_short_groups_as_lists_come_in_order_of_groups(spark, kind):
    from pyspark.sql.types import StructType

    rows = [(i % 5, i * 7 % 10) for i in range(50)] + [(None, 1)] + [(3, None)] * (kind == "INT")
    df = spark.createDataFrame(rows, StructType.fromDDL(f"g INT, v {kind}")).repartitionByRange(3, "g")
    ranked = rank_within(df, ["g"], ["v"], "pos", short_groups=True, in_order=True)
    values = {g: sorted((v for h, v in rows if h == g), key=lambda v: (v is not None, v)) for g in range(5)}
    assert [tuple(r) for r in ranked.collect()] == [(g, v, k + 1) for g in range(5) for k, v in enumerate(values[g])]
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_long_lists_of_points_come_to_locations_in_place(spark):
    points = spark.range(120_000).select(F.col("id").alias("pid"), (F.col("id") / 1e5).alias("latitude"),
                                         F.lit(1.0).alias("longitude"))
    locations = spark.createDataFrame([(1, 0.5, 1.0), (2, None, 1.0)], "loc_id INT, lat DOUBLE, lon DOUBLE")
    found = J.within_distance(locations.repartitionByRange(2, "loc_id"), points, 1.0, in_place=True)
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pid for r in found.collect()) == [i for i in range(120_000) if haversine(0.5, 1.0, i / 1e5, 1.0) <= 1.0]


@pytest.mark.parametrize("held", [0, 1000])
def test_columns_apart_come_once_for_each_location(spark, held):
    loc, pts, locations, points = frames(spark)
    longer = locations.withColumn("long", F.concat(F.lit("l"), "loc_id"))
    found = J.within_distance(longer, points, 2.0, in_place=True, short_points=held, apart=["long"]).collect()
    d = haversine(loc[:, None, 0], loc[:, None, 1], pts[None, :, 0], pts[None, :, 1])
    pairs = [r for r in found if r.distance is not None]
    assert sorted((r.loc_id, r.pid) for r in pairs) == sorted(zip(*np.nonzero(d <= 2.0)))
    assert all(r.long is None for r in pairs)
    assert sorted(r.long for r in found if r.distance is None) == sorted(f"l{i}" for i in range(len(loc)))


@pytest.mark.parametrize("held", [0, 1000])
def test_positions_by_distance_for_keys_that_repeat_and_names_that_are_missing(spark, tmp_path, monkeypatch, held):
    from incidentlens.catalog import queries

    keys = [*range(40), 7, 7, None]
    spark.createDataFrame([(k,) for k in keys], "c_custkey LONG").write.parquet(f"{tmp_path}/customer.parquet")
    names = [(k, None if k % 17 == 0 else f"n{k % 60}") for k in range(2_000)]
    spark.createDataFrame(names, "s_suppkey LONG, s_name STRING").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(J, "HELD_POINTS", held * 10)
    got = [tuple(r) for r in queries()["w5_sorted_by_distance"](spark, str(tmp_path)).collect()]
    place = lambda k, a, b: ((4050000 + k * a % 40000) / 1e5, (-7420000 + k * b % 45000) / 1e5)
    want = []
    for k in range(40):
        near = [(haversine(*place(k, 13, 29), *place(s, 3571, 2903)), n) for s, n in names]
        near = [(np.floor(km * 10_000 + 0.5), n or "") for km, n in near if km <= 5] * keys.count(k)
        want += [(k, n or None, i + 1) for i, (_, n) in enumerate(sorted(near))]
    assert got == want


def test_nearest_centre_per_coordinate_keeps_rows(spark):
    centres = spark.createDataFrame([(1, 40.0, -74.0), (2, 41.0, -74.0)], "zone INT, center_lat DOUBLE, center_lon DOUBLE")
    rows = [(1, 40.1, -74.0), (1, 40.1, -74.0), (2, 40.9, -74.0), (3, 40.5, -74.0), (4, None, -74.0), (None, 40.9, -74.0)]
    df = spark.createDataFrame(rows, "loc_id INT, lat DOUBLE, lon DOUBLE")
    found = J.nearest_centre(df, centres)
    got = sorted(((r.loc_id, r.zone) for r in found.collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 2), (3, found.filter("loc_id = 3").first().zone), (4, None), (None, 2)], key=str)
    assert "Exchange" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("lat, cells", [(40.7, 2), (0.0, 4), (-60.0, 7)])
def test_counts_within_equal_brute_force(spark, lat, cells):
    loc, pts, locations, points = frames(spark, lat=lat)
    got = {(r.loc_id, r.kind): r.n for r in J.counts_within(
        locations, points, 3.0, ["kind"], cells_per_radius=cells).collect()}
    d = haversine(loc[:, None, 0], loc[:, None, 1], pts[None, :, 0], pts[None, :, 1]) <= 3.0
    kinds = np.array(["xy"[i % 2] for i in range(len(pts))])
    want = {(i, k): int(d[i, kinds == k].sum()) for i in range(len(loc)) for k in "xy"}
    assert got == {k: v for k, v in want.items() if v}


def test_within_box(spark):
    loc, pts, locations, points = frames(spark)
    for small_rows in (1000, 0):
        got = {(r.loc_id, r.pid) for r in J.within_box(
            locations, points, 0.01, small_rows=small_rows).collect()}
        near = (np.abs(loc[:, None, 0] - pts[None, :, 0]) <= 0.01) & (
            np.abs(loc[:, None, 1] - pts[None, :, 1]) <= 0.01)
        assert got == set(zip(*np.nonzero(near)))


@pytest.mark.parametrize("max_pairs", [10**6, 50])
def test_nearest_reaches_far_locations(spark, max_pairs):
    loc, pts, _, points = frames(spark)
    far = [(100, 41.9, -73.2), (101, 10.0, 20.0), (102, None, 1.0)]
    rows = [(i, float(a), float(o)) for i, (a, o) in enumerate(loc)] + far
    locations = spark.createDataFrame(rows, "loc_id INT, lat DOUBLE, lon DOUBLE")
    found = J.nearest(locations, points, "pid", first_km=0.5, max_pairs=max_pairs)
    got = {r.loc_id: (r.nearest.pid, r.distance) for r in
           locations.join(found, ["lat", "lon"]).collect()}
    assert 102 not in got and len(got) == len(rows) - 1
    for i, a, o in rows[:-1]:
        d = haversine(a, o, pts[:, 0], pts[:, 1])
        assert got[i][0] == int(np.argmin(d))
        assert abs(got[i][1] - d.min()) < 1e-6


def brute_nearest_k(places, points, k, km):
    """{(place, type): [(distance, name)]} for places (lat, lon) and points (name, type, lat, lon)."""
    out = {}
    for i, (a, o) in enumerate(places):
        for name, kind, y, x in points:
            d = float(haversine(a, o, y, x))
            if d <= km:
                out.setdefault((i, kind), []).append((d, name))
    return {key: sorted(v)[:k] for key, v in out.items()}


@pytest.mark.parametrize(("k", "km", "per_answer", "short"), [(1, 3.0, 32, 10**6), (3, 8.0, 1, 0), (2, 0.4, 0.1, 0)])
def test_nearest_k_of_each_kind(spark, k, km, per_answer, short):
    rng = np.random.default_rng(k)
    places = [(40.7 + float(a) / 50, -74.0 + float(b) / 50) for a, b in rng.normal(size=(30, 2))] + [(41.9, -73.0)]
    spots = [(40.7 + float(a) / 30, -74.0 + float(b) / 30) for a, b in rng.normal(size=(400, 2))]
    points = [(f"p{i % 90:03d}", ["a", "b", "rare"][2 if i % 80 == 0 else i % 2], y, x) for i, (y, x) in enumerate(spots)]
    points += [(f"s{i}", "a", 40.7, -74.0) for i in range(20)] + points[:5]  # one coordinate, and repeated rows
    locations = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate([*places, places[0]])] + [(99, None, 1.0)],
                                      "loc_id INT, lat DOUBLE, lon DOUBLE")
    table = spark.createDataFrame(points, "name STRING, type STRING, latitude DOUBLE, longitude DOUBLE")
    got = {}
    for r in J.nearest_k(locations, table, k, km, "type", per_answer=per_answer, short=short).collect():
        got.setdefault((places.index((r._lat, r._lon)), r.type), []).append((r["rank"], r.distance, r.name))
    want = brute_nearest_k(places, points, k, km)
    assert set(got) == set(want)
    for key, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[key]) + 1))
        assert [r[2] for r in rows] == [w[1] for w in want[key]]
        assert np.allclose([r[1] for r in rows], [w[0] for w in want[key]])


def test_nearest_k_reads_few_of_many_neighbours(spark):
    """100,000 places around one location: the cells left hold a few points per answer."""
    points = spark.range(100_000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), (F.col("id") % 3).cast("string").alias("type"),
        (40.7 + (F.col("id") * 7919 % 100_003) / 3e6).alias("latitude"),
        (-74.0 + (F.col("id") * 104_729 % 100_019) / 3e6).alias("longitude"))
    location = spark.createDataFrame([(1, 40.715, -73.985)], "loc_id INT, lat DOUBLE, lon DOUBLE")
    spots = points.select(F.col("latitude").alias("_plat"), F.col("longitude").alias("_plon"),
                          F.col("type").alias("_by"), F.lit(1).alias("_n"))
    place = location.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    kept, n, grid, _ = J._ring(place, 1, spots, None, 3, 50.0, 0.0, J.PER_ANSWER, 0, False)
    assert n == kept.count()
    read = kept.join(J.with_cell(spots, grid, "_plat", "_plon"), [*J.CELL, "_by"]).count()
    assert 9 <= read <= 3 * 3 * J.PER_ANSWER
    got = J.nearest_k(location, points, 3, 50.0, "type", short=0).collect()
    rows = points.toPandas()
    rows["d"] = haversine(40.715, -73.985, rows.latitude, rows.longitude)
    want = rows.sort_values(["d", "name"]).groupby("type").head(3)
    assert sorted(r.name for r in got) == sorted(want.name)


def test_nearest_k_of_nothing(spark):
    _, _, locations, _ = frames(spark)
    empty = spark.createDataFrame([], "name STRING, type STRING, latitude DOUBLE, longitude DOUBLE")
    assert J.nearest_k(locations, empty, 3, 5.0, "type").count() == 0


def test_nearest_without_points(spark):
    _, _, locations, points = frames(spark)
    assert J.nearest(locations, points.limit(0), "pid").count() == 0


@pytest.mark.parametrize("limit", [1000, 1])
def test_nearest_centre_both_ways(spark, limit):
    loc, pts, locations, _ = frames(spark)
    centres = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in
                                     enumerate(pts[-5:])],
                                    "zone INT, center_lat DOUBLE, center_lon DOUBLE")
    got = {r.loc_id: r.zone for r in J.nearest_centre(
        locations, centres, max_centres=limit).collect()}
    for i, (a, o) in enumerate(loc):
        assert got[i] == int(np.argmin(haversine(a, o, pts[-5:, 0], pts[-5:, 1])))
    assert got[len(loc)] is None


@pytest.mark.parametrize("spread", [["v"], None])
def test_salted_join_keeps_every_pair(spark, spread):
    many = spark.range(3000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"),
                                    F.col("id").alias("v"))
    few = spark.range(20).select((F.col("id") % 5).alias("k"), F.col("id").alias("w"))
    plain = sorted(map(tuple, many.join(few, "k").select("k", "v", "w").collect()))
    salted = salted_join(many, few, ["k"], spread, rows_per_task=100)
    assert sorted(map(tuple, salted.select("k", "v", "w").collect())) == plain


def test_global_rank(spark):
    rng = np.random.default_rng(5)
    values = [int(v) for v in rng.permutation(500)]
    df = spark.createDataFrame([(v,) for v in values], "v INT").repartition(7)
    got = {r.v: r.pos for r in global_rank(df, ["v"], "pos").collect()}
    assert got == {v: v for v in values}


def test_rank_within(spark):
    df = spark.range(300).select((F.col("id") % 4 * (F.col("id") % 2)).alias("g"),
                                 (-F.col("id")).alias("v"))
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.g, r.v)):
        want[r.v] = 1 + sum(1 for v, g in [(k, w[1]) for k, w in want.items()] if g == r.g), r.g
    got = {r.v: (r.pos, r.g) for r in rank_within(df, ["g"], ["v"], "pos").collect()}
    assert got == want


def test_sample_of_a_long_table(spark):
    df = spark.range(5000).withColumn("key", F.col("id").cast("string"))
    got = [r.id for r in sample_rows(df, 20, "key").collect()]
    ordered = df.orderBy(F.md5(F.concat("key", F.lit("/42")))).limit(20)
    assert got == [r.id for r in ordered.collect()]


def test_sample_is_repeatable(spark):
    df = spark.range(1000).withColumn("key", F.col("id").cast("string"))
    one = [r.id for r in sample_rows(df, 50, "key").collect()]
    two = [r.id for r in sample_rows(df.repartition(5), 50, "key").collect()]
    other = [r.id for r in sample_rows(df, 50, "key", seed=7).collect()]
    assert one == two and len(set(one)) == 50 and one != other


def test_long_tables_in_short_files_are_not_broadcast(spark):
    """A list of cells of a few megabytes on disk, and many times that as a broadcast on the driver."""
    prepare(spark)
    cells = stored(spark.range(700_000).select(F.col("id").alias("_row"), F.lit(1).alias("_col"), *[
        F.lit(float(i)).alias(f"x{i}") for i in range(4)]))
    joined = salted_join(cells, cells.select("_row", "_col", F.col("x0").alias("y")), ["_row", "_col"])
    counted = joined.agg(F.count("*"), F.sum("x1"), F.sum("y"))
    assert counted.collect()[0][0] == 700_000
    assert "BroadcastHashJoin" not in counted._jdf.queryExecution().executedPlan().toString()
