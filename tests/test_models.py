import math

import numpy as np
import pytest
from brute import haversine
from pyspark.sql import functions as F

from incidentlens.operators import classify, density as D, evaluate as E, lloyd, places, quantiles, silhouette, stats, zones
from incidentlens.operators.proxies import condensed


def blobs(spark, n=240, k=4, seed=1):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, k, n)
    centre = rng.uniform([40.5, -74.2], [40.9, -73.8], (k, 2))
    at = np.round(centre[label] + rng.normal(0, 0.01, (n, 2)), 4)
    kinds = ["ROBBERY", "RAPE", "ARSON"]
    rows = [(str(i), float(a), float(o), int(c), kinds[int(c) % 3], "WHITE" if c % 2 else "BLACK",
             "F" if i % 2 else "M", "18-24")
            for i, ((a, o), c) in enumerate(zip(at, label))]
    df = spark.createDataFrame(
        rows, "incident_id STRING, latitude DOUBLE, longitude DOUBLE, cluster INT, "
        "crime_type STRING, vic_race STRING, vic_sex STRING, vic_age_group STRING")
    return at, label, df


def test_separation_measures(spark):
    at, label, df = blobs(spark)
    k, n = len(set(label)), len(at)
    centre = np.array([at[label == c].mean(axis=0) for c in range(k)])
    size = np.array([(label == c).sum() for c in range(k)])
    between = (size[:, None] * (centre - at.mean(axis=0)) ** 2).sum()
    within = sum(((at[label == c] - centre[c]) ** 2).sum() for c in range(k))
    ch = E.calinski_harabasz(E.centroids(df, "cluster")).first()[0]
    assert ch == pytest.approx(between / (k - 1) / (within / (n - k)), rel=1e-6)
    s = np.array([np.hypot(*(at[label == c] - centre[c]).T).mean() for c in range(k)])
    worst = [max((s[i] + s[j]) / np.hypot(*(centre[i] - centre[j])) for j in range(k) if j != i)
             for i in range(k)]
    for listed in (1000, 1):
        db = E.davies_bouldin(df, "cluster", max_listed=listed).first()[0]
        assert db == pytest.approx(np.mean(worst), rel=1e-9)
    d = (at[:, None, 0] - at[None, :, 0]) ** 2 + (at[:, None, 1] - at[None, :, 1]) ** 2
    values = []
    for i in range(n):
        # The mean over a cluster's own other rows, and over all rows of the others.
        means = {c: d[i, label == c].sum() / ((label == c).sum() - (c == label[i]))
                 for c in range(k)}
        a = means.pop(label[i])
        b = min(means.values())
        values.append((b - a) / max(a, b))
    got = E.silhouette(df, "cluster", squared=True).first()[0]
    assert got == pytest.approx(np.mean(values), rel=1e-9)


def plain_silhouette(at, label):
    """Mean silhouette by all pairs of plain distances."""
    d = np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1])
    values = []
    for i in range(len(at)):
        if (label == label[i]).sum() == 1:
            values.append(0.0)
            continue
        means = {c: d[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in set(label.tolist())}
        a = means.pop(label[i])
        b = min(means.values())
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(values))


def shapes(kind):
    rng = np.random.default_rng(11)
    if kind == "one tight, one wide":
        at = np.concatenate([rng.normal(0, 1e-4, (1500, 2)), rng.uniform(-1, 1, (900, 2)) + [0.3, 0]])
        return at, np.repeat([0, 1], [1500, 900])
    if kind == "many":
        centre = rng.uniform(0, 1, (40, 2)) ** 3
        label = np.r_[rng.integers(0, 40, 1200), 40, 41]
        at = np.concatenate([centre[label[:1200]] + rng.normal(0, 0.02, (1200, 2)), [[5.0, 5.0], [0.5, -3.0]]])
        return at, label
    at = np.round(rng.uniform(0, 1, (800, 2)), 1)  # much repeated coordinates, all over one another
    return at, rng.integers(0, 3, 800)


@pytest.mark.parametrize("kind", ["one tight, one wide", "many", "repeated"])
def test_silhouette_with_plain_distances(spark, kind):
    at, label = shapes(kind)
    df = spark.createDataFrame([(int(c), float(x), float(y)) for c, (x, y) in zip(label, at, strict=True)],
                               "cluster INT, longitude DOUBLE, latitude DOUBLE")
    got = silhouette.silhouette(df, "cluster").first()[0]
    assert got == pytest.approx(plain_silhouette(at, label), abs=1e-8)


def test_most_distances_come_from_series(spark):
    """Of a large cluster only the cells next to a point are read point by point."""
    rng = np.random.default_rng(12)
    at = np.concatenate([rng.uniform(0, 1, (3000, 2)), rng.uniform(3, 4, (3000, 2))])
    df = spark.createDataFrame([(i // 3000, float(x), float(y)) for i, (x, y) in enumerate(at)],
                               "cluster INT, longitude DOUBLE, latitude DOUBLE")
    spots = silhouette._spots(df, "cluster", "longitude", "latitude")
    clusters = silhouette._clusters(spots)
    placed = silhouette._placed(spots, clusters)
    tiles = silhouette._tiles(placed, clusters)
    rivals = silhouette._rivals(tiles, clusters, False)
    assert rivals.count() == tiles.count()
    members = silhouette._members(spots, clusters)
    far, near = silhouette._walk(rivals, tiles, clusters, silhouette._cells(members), 20)
    assert near.count() == 0 and far.count() <= 30 * tiles.count()


def test_worst_ratio_by_rings(spark):
    rng = np.random.default_rng(8)
    at = rng.uniform(0, 1, (60, 2)) ** 3
    s = rng.uniform(0.01, 0.2, 60)
    table = spark.createDataFrame([(i, float(v), float(x), float(y)) for i, (v, (x, y)) in
                                   enumerate(zip(s, at))], "c INT, s DOUBLE, cx DOUBLE, cy DOUBLE")
    d = np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1])
    np.fill_diagonal(d, np.inf)
    want = ((s[:, None] + s[None, :]) / d).max(axis=1)
    got = [r.worst for r in E._worst_by_rings(table, "c").collect()]
    assert sorted(got) == pytest.approx(sorted(want), rel=1e-9)


def test_one_cluster_has_no_separation(spark):
    _, _, df = blobs(spark, k=1)
    row = E.cluster_quality(df).first()
    assert row.n_clusters == 1 and row.silhouette_score is None
    assert row.calinski_harabasz_score is None


def test_zones_are_nearest_centres(spark):
    at, _, df = blobs(spark)
    model = zones.fit_crime_zones(df, k=4, n_init=3)
    got = {r.incident_id: r.zone for r in zones.assign(model, df).collect()}
    centre = np.array(model.stages[-1].clusterCenters())
    z = (at - at.mean(axis=0)) / at.std(axis=0)
    want = ((z[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [got[str(i)] for i in range(len(at))] == list(want)


def test_saved_zone_model(spark, tmp_path):
    from pyspark.ml import PipelineModel

    _, _, df = blobs(spark)
    model = zones.fit_crime_zones(df, k=3, n_init=1)
    model.write().overwrite().save(str(tmp_path / "zones"))
    again = PipelineModel.load(str(tmp_path / "zones"))
    one = zones.assign(model, df).select("incident_id", "zone").collect()
    assert sorted(one) == sorted(zones.assign(again, df).select("incident_id", "zone").collect())


def test_demographic_zones_need_a_thousand_rows(spark):
    _, _, df = blobs(spark)
    assert zones.fit_demographic_zones(df) is None
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5))))
    model = zones.fit_demographic_zones(many, k=4, n_init=1)
    assert zones.assign(model, many).select("zone").distinct().count() == 4


def test_zone_scores(spark):
    df = spark.createDataFrame([(1, "RAPE"), (1, "ARSON"), (2, "MURDER & NON-NEGL. MANSLAUGHTER")],
                               "zone INT, crime_type STRING")
    got = {r.zone: r.safety_score for r in zones.zone_scores(df).collect()}
    assert got == {1: pytest.approx(100 - 12 / 20 * 100), 2: 0.0}


@pytest.mark.parametrize("mode", ["geodesic", "plain"])
def test_density_equals_brute_force(spark, mode):
    at, _, df = blobs(spark)
    box, size = (40.4, 41.0, -74.3, -73.7), 20
    kernel = D.Kernel(mode)
    lat, lon = np.linspace(*box[:2], size), np.linspace(*box[2:], size)
    if mode == "geodesic":
        d = haversine(lat[:, None, None], lon[None, :, None], at[:, 0], at[:, 1])
    else:
        a = (np.sin((lat[:, None, None] - at[:, 0]) / 2) ** 2 + np.cos(lat[:, None, None])
             * np.cos(at[:, 0]) * np.sin((lon[None, :, None] - at[:, 1]) / 2) ** 2)
        d = 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))
    want = np.exp(-d ** 2 / (2 * kernel.bandwidth ** 2)).sum(axis=2)
    grid = D.density_grid(df, box, size, kernel)
    rows = grid.collect()
    got = np.zeros((size, size))
    for r in rows:
        got[r.i, r.j] = r.kernel
    assert np.allclose(got, want, atol=1e-9)
    assert sum(r.density for r in rows) * 783.8 / size ** 2 == pytest.approx(len(at))
    limits = np.percentile([r.density for r in rows], [33, 67])
    for r in rows:
        want_class = "Low" if r.density <= limits[0] else (
            "Medium" if r.density <= limits[1] else "High")
        assert r.classification == want_class


def test_density_by_group_has_every_node(spark):
    _, _, df = blobs(spark)
    grid = D.density_grid(df, size=10, by=["crime_type"])
    counts = {r["crime_type"]: r["count"] for r in grid.groupBy("crime_type").count().collect()}
    assert set(counts.values()) == {100}


def test_long_lists_of_nodes_are_not_broadcast(spark, monkeypatch):
    # Few cells, each with all nodes of the grid: their number says little about their size.
    _, _, df = blobs(spark)
    want = {tuple(r) for r in D.density_grid(df, size=10, by=["crime_type"]).select(
        "crime_type", "i", "j", F.round("density", 9)).collect()}
    calls = []
    monkeypatch.setattr(D, "MAX_LISTED", 50)
    monkeypatch.setattr(D, "salted_join", lambda *a, join=D.salted_join: calls.append(a) or join(*a))
    got = {tuple(r) for r in D.density_grid(df, size=10, by=["crime_type"]).select(
        "crime_type", "i", "j", F.round("density", 9)).collect()}
    assert got == want and len(calls) == 1


def plain_lloyd(x, w, centres, rounds=200):
    for _ in range(rounds):
        zone = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        weight = np.bincount(zone, w, len(centres))
        centres = np.where(weight[:, None] > 0, np.column_stack(
            [np.bincount(zone, w * c, len(centres)) for c in x.T]) / np.maximum(weight, 1e-9)[:, None], centres)
    return centres, (w * ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1)).sum()


def test_fits_from_many_starts(spark):
    rng = np.random.default_rng(3)
    middle = rng.uniform(-50, 50, (12, 2))
    x = np.round(middle[rng.integers(0, 12, 3000)] + rng.normal(0, 1.5, (3000, 2)), 3)
    w = rng.integers(1, 9, len(x))
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, w)], "a DOUBLE, b DOUBLE, w INT")
    fits = lloyd.fit_many(rows, ["a", "b"], 12, range(5), tol=1e-9)
    for centres, cost in fits:
        # Each is where plain steps end, and costs what it says.
        rest, want = plain_lloyd(x, w, centres, 1)
        assert np.allclose(rest, centres, atol=1e-6) and cost == pytest.approx(want, rel=1e-6)
    plain = min(plain_lloyd(x, w, x[rng.choice(len(x), 12, replace=False)])[1] for _ in range(5))
    best = min(fits, key=lambda f: f[1])
    assert best[1] <= plain * 1.0001
    assert all(((best[0] - m) ** 2).sum(axis=1).min() < 1 for m in middle)
    other = lloyd.fit_many(rows.repartition(7), ["a", "b"], 12, range(5), tol=1e-9)
    assert np.allclose([c for _, c in other], [c for _, c in fits], rtol=1e-9)


def test_fits_of_few_rows_and_saved_models(spark, tmp_path):
    rows = spark.createDataFrame([(0.0, 5.0, 2), (1.0, 5.0, 1), (9.0, 5.0, 4)], "a DOUBLE, b DOUBLE, w INT")
    centres, cost = lloyd.fit_many(rows, ["a", "b"], 10, [1, 2])[1]
    assert sorted(centres[:, 0].round(9).tolist()) == [0.0, 1.0, 9.0] and cost == pytest.approx(0, abs=1e-9)
    two = lloyd.fit_many(rows, ["a", "b"], 2, [1])[0]
    assert sorted(two[0][:, 0].round(9).tolist()) == [round(1 / 3, 9), 9.0] and two[1] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        lloyd.fit_many(rows.limit(0), ["a", "b"], 2, [1])
    df = spark.createDataFrame([("A", 40.7, -73.9), ("A", 40.71, -73.9), ("B", 40.6, -74.1), ("B", None, -74.1)],
                               "crime_type STRING, latitude DOUBLE, longitude DOUBLE")
    fitted = zones.fit_crime_zones(df, k=2, n_init=3)
    fitted.write().overwrite().save(str(tmp_path / "zones"))
    again = type(fitted).load(str(tmp_path / "zones"))
    got = [zones.assign(m, df).groupBy("crime_type").agg(F.collect_set("zone").alias("z")).collect() for m in (fitted, again)]
    assert all(len(r.z) == 1 for rows in got for r in rows) and sorted(map(str, got[0])) == sorted(map(str, got[1]))


def test_crowded_cells_keep_their_density(spark):
    rng = np.random.default_rng(5)
    at = np.vstack([rng.normal((40.70, -73.95), 0.002, (12_000, 2)), rng.uniform((40.55, -74.1), (40.9, -73.8), (600, 2))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in at], "latitude DOUBLE, longitude DOUBLE")
    spots = D.spot_weights(df)
    here = np.array([(40.70, -73.95), (40.712, -73.94), (40.73, -73.99), (40.62, -74.05), (40.3, -73.95), (41.0, -74.6)])
    d = haversine(here[:, None, 0], here[:, None, 1], at[:, 0], at[:, 1])
    for level, reach in enumerate((10, 20, 39)):
        rows = condensed(spots, 1.11, level).collect()
        assert len(rows) < len(at) * 0.8 and any(r.n < 0 for r in rows)
        assert sum(r.n for r in rows) == pytest.approx(len(at), rel=1e-12)
        got = np.array([(r.plat, r.plon, r.n) for r in rows])
        e = haversine(here[:, None, 0], here[:, None, 1], got[:, 0], got[:, 1])
        near = d.min(axis=1) < (reach - 3) * 1.11
        want = np.where(d < reach * 1.11, np.exp(-d ** 2 / (2 * 1.11 ** 2)), 0).sum(axis=1)
        sums = (got[:, 2] * np.where(e < reach * 1.11, np.exp(-e ** 2 / (2 * 1.11 ** 2)), 0)).sum(axis=1)
        assert np.allclose(sums[near], want[near], rtol=1e-7, atol=0)
    grid = D.density_grid(df)
    scale = grid.selectExpr("sum(density) / sum(kernel)").first()[0]
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(here)], "loc_id INT, lat DOUBLE, lon DOUBLE")
    found = {r.loc_id: r.density for r in D.density_at(places, df, grid).collect()}
    want = np.exp(-d ** 2 / (2 * 1.11 ** 2)).sum(axis=1) * scale
    assert np.allclose([found[i] for i in range(len(here))], want, rtol=1e-6, atol=1e-300)


def test_class_report(spark):
    rows = [(0.0, 0.0)] * 3 + [(0.0, 1.0)] + [(1.0, 1.0)] * 2 + [(2.0, 0.0)]
    df = spark.createDataFrame(rows, "label DOUBLE, prediction DOUBLE")
    got = {r.crime_type: r for r in classify.class_report(df, ["a", "b", "c"]).collect()}
    assert got["a"].precision == 0.75 and got["a"].recall == 0.75 and got["a"].support == 4
    assert got["b"].precision == pytest.approx(2 / 3) and got["b"].recall == 1.0
    assert got["c"].f1 == 0.0 and got["c"].support == 1


def test_split_is_by_key(spark):
    df = spark.range(4000).withColumn("key", F.col("id").cast("string"))
    train, test = classify.split_by_hash(df, "key")
    assert train.count() + test.count() == 4000 and 700 < test.count() < 900
    assert train.join(test, "key").count() == 0


def test_training_rows_of_one_part_are_dealt_evenly(spark):
    """A file of one row group is one part; a forest would train on it in one task."""
    df = spark.range(0, 1000, 1, 1).select((F.col("id") % 300).cast("string").alias("key"), F.col("id").alias("x"))
    out = classify.dealt(df, ["key", "x"], 100)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sizes == [100] * 10
    assert classify.dealt(df, ["key", "x"], 1000) is df


def test_chi_square(spark):
    df = spark.createDataFrame([(10, 20, 30, 5), (1, 0, 3, 0)], "a INT, b INT, c INT, d INT")
    chi = stats.yates_chi_square(*[F.col(c) for c in "abcd"])
    rows = df.select(chi.alias("x")).withColumn("p", stats.chi_square_tail(F.col("x"))).collect()
    n, gap = 65, abs(10 * 5 - 20 * 30) - 32.5
    x = n * gap ** 2 / (30 * 35 * 40 * 25)
    assert rows[0].x == pytest.approx(x)
    assert rows[0].p == pytest.approx(math.erfc(math.sqrt(x / 2)), abs=2e-7)
    assert rows[1].x is None


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (2, None)],
                               "k INT, v STRING")
    got = {r.k: (r["count"], r.m) for r in stats.modes(df, ["k"], {"m": "v"}).collect()}
    assert got == {1: (3, "a"), 2: (2, None)}


def test_fallback_box(spark):
    incidents = spark.createDataFrame(
        [("1", 40.7, -74.0), ("2", 40.7, -74.0), ("3", 40.8, -74.0), ("4", 10.0, 10.0)],
        "incident_id STRING, latitude DOUBLE, longitude DOUBLE")
    shops = spark.createDataFrame([("n", "bar", 40.7005, -74.0), ("b", "bar", 40.809, -74.009)],
                                  "name STRING, type STRING, latitude DOUBLE, longitude DOUBLE")
    got = sorted((r.incident_id, r.name, r.method) for r in places.places_with_fallback(
        incidents, shops, 0.1).collect())
    assert got == [("1", "n", "radius"), ("2", "n", "radius"), ("3", "b", "box")]


def test_many_centres_are_searched_not_listed(spark, monkeypatch):
    rng = np.random.default_rng(21)
    at, centre = rng.normal(0, 1, (300, 2)), np.concatenate([rng.normal(0, 1, (80, 2)), [[0.5, 0.5], [0.5, 0.5]]])
    df = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(at)] + [(999, None, 1.0)],
                               "id INT, latitude DOUBLE, longitude DOUBLE")
    centres = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(centre)],
                                    "zone INT, center_lat DOUBLE, center_lon DOUBLE")
    scale = {"latitude": (0.1, 2.0), "longitude": (0.0, 0.5)}
    listed = {r.id: r.zone for r in zones.assign_to_centres(df, centres, scale).collect()}
    searched = zones.assign_to_centres(df, centres, scale, max_listed=10)
    assert searched.columns == ["id", "latitude", "longitude", "zone"]
    assert {r.id: r.zone for r in searched.collect()} == listed
    d = ((at[:, None, 0] - centre[:, 0]) / 2) ** 2 + ((at[:, None, 1] - centre[:, 1]) / 0.5) ** 2
    assert all(listed[i] == int(np.argmin(d[i])) for i in range(300)) and listed[999] is None


def test_demographic_zones_of_long_value_lists(spark, monkeypatch):
    """Values beyond the short list are indexed and one-hot encoded; the zones are those of the short form."""
    rng = np.random.default_rng(5)
    rows = [(str(i), 40.5 + 0.1 * float(rng.integers(0, 2)), -74.0, ["A", "B"][i % 2], "W", "F") for i in range(1200)]
    df = spark.createDataFrame(rows, "incident_id STRING, latitude DOUBLE, longitude DOUBLE, vic_age_group STRING, "
                               "vic_race STRING, vic_sex STRING")
    short = zones.assign(zones.fit_demographic_zones(df, k=4, n_init=2), df)
    monkeypatch.setattr(zones, "MAX_LABELS", 1)
    long = zones.assign(zones.fit_demographic_zones(df, k=4, n_init=2), df)
    both = short.withColumnRenamed("zone", "a").join(long.select("incident_id", F.col("zone").alias("b")), "incident_id")
    assert both.select("a", "b").distinct().count() == 4
    assert short.select("zone").distinct().count() == long.select("zone").distinct().count() == 4


def test_ranks_without_one_window(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 3 if i % 4 else 0}", float(v)) for i, v in enumerate(rng.integers(0, 40, 400))] + [("solo", 1.0)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(5)
    for r in quantiles.percent_rank_by(df, "g", "v", "p").collect():
        mine = [v for g, v in rows if g == r.g]
        want = sum(v < r.v for v in mine) / (len(mine) - 1) if len(mine) > 1 else 0.0
        assert r.p == pytest.approx(want)
    for r in stats.share_below(df, "v", "p").collect():
        assert r.p == pytest.approx(100 * sum(v < r.v for _, v in rows) / len(rows))
