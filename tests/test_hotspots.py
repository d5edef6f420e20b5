import numpy as np
import pytest
from brute import dbscan, haversine
from pyspark.sql import functions as F

from incidentlens.functions import rules
from incidentlens.operators import components
from incidentlens.operators import hotspots as H
from incidentlens.operators.components import connected_components, settle


def cloud(seed, n=260):
    rng = np.random.default_rng(seed)
    centres = rng.uniform([40.60, -74.05], [40.80, -73.85], (6, 2))
    near = centres[rng.integers(0, 6, n * 2 // 3)] + rng.normal(0, 0.004, (n * 2 // 3, 2))
    far = rng.uniform([40.55, -74.1], [40.85, -73.8], (n // 3, 2))
    points = np.round(np.vstack([near, far]), 3)
    return points[rng.permutation(len(points))]


def frame(spark, points):
    return spark.createDataFrame(
        [(str(i), float(a), float(o)) for i, (a, o) in enumerate(points)],
        "incident_id STRING, latitude DOUBLE, longitude DOUBLE")


@pytest.mark.parametrize("seed, eps, least, max_pairs", [
    (1, 0.5, 5, 10**8), (2, 1.0, 8, 0), (4, 2.5, 12, 10**8)])
def test_sphere_equals_brute_force(spark, seed, eps, least, max_pairs):
    points = cloud(seed)
    d = haversine(points[:, None, 0], points[:, None, 1], points[None, :, 0], points[None, :, 1],
                  rules.HOTSPOT_EARTH_KM)
    labels, core = dbscan((d, eps), least)
    df = frame(spark, points)
    spots = H.density_clusters(df, H.sphere_for(df, eps), least, max_direct_pairs=max_pairs)
    found = {(r.y, r.x): (r.cluster, r.core) for r in spots.collect()}
    for i, (a, o) in enumerate(points):
        assert found[(a, o)] == (labels[i], core[i])


@pytest.mark.parametrize("max_pairs", [0])
def test_flat_plane_with_groups(spark, max_pairs):
    points = cloud(7, 300)
    half = points[:, 0] >= 40.7
    df = frame(spark, points).withColumn(
        "side", F.when(F.col("latitude") >= 40.7, "A").otherwise("B"))
    spots = H.density_clusters(df, H.Plane.flat(0.004), 4, group="side",
                               max_direct_pairs=max_pairs)
    found = {(r.y, r.x): r.cluster for r in spots.collect()}
    offset = 0
    for side in (half, ~half):
        mine = points[side]
        d = np.hypot(mine[:, None, 0] - mine[None, :, 0], mine[:, None, 1] - mine[None, :, 1])
        labels, _ = dbscan((d, 0.004), 4)
        for (a, o), label in zip(mine, labels):
            assert found[(a, o)] == (label + offset if label >= 0 else -1)
        offset += labels.max() + 1


def test_one_place_and_empty(spark):
    same = frame(spark, np.tile([[40.7, -74.0]], (12, 1)))
    out = H.label_incidents(same)
    assert {(r.cluster, r.core) for r in out.collect()} == {(0, True)} and out.count() == 12
    few = frame(spark, np.tile([[40.7, -74.0]], (3, 1)))
    assert {r.cluster for r in H.label_incidents(few).collect()} == {-1}
    assert H.label_incidents(same.limit(0)).count() == 0


def test_weights_count_like_copies(spark):
    points = cloud(9, 120)
    df = frame(spark, points).withColumn("w", F.lit(2.0))
    plane = H.sphere_for(df, 0.8)
    twice = df.unionByName(df.withColumn("incident_id", F.concat("incident_id", F.lit("0000"))))
    a = {(r.y, r.x): r.cluster for r in H.density_clusters(df, plane, 6, weight="w").collect()}
    b = {(r.y, r.x): r.cluster for r in H.density_clusters(twice, plane, 6).collect()}
    assert {k for k, v in a.items() if v == -1} == {k for k, v in b.items() if v == -1}


def test_small_quadrants_are_left_out(spark):
    rng = np.random.default_rng(2)
    north = np.round(rng.normal([40.85, -73.9], 0.01, (80, 2)), 4)
    south = np.round(rng.normal([40.55, -74.2], 0.01, (49, 2)), 4)
    out = H.label_by_quadrant(frame(spark, np.vstack([north, south])))
    assert {r.quadrant for r in out.select("quadrant").distinct().collect()} == {"NE"}


def roots(n, edges):
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


@pytest.mark.parametrize("kind", ["random", "path", "star", "zigzag", "none"])
def test_components(spark, kind):
    n = 200
    rng = np.random.default_rng(11)
    edges = {
        "random": [tuple(map(int, e)) for e in rng.integers(0, n, (150, 2))],
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(n - 1, i) for i in range(n - 1)],
        "zigzag": [(i, (i * 77 + 13) % n) for i in range(0, n, 2)],
        "none": []}[kind]
    nodes = spark.range(n).select(F.col("id").alias("node"))
    table = spark.createDataFrame(edges, "a BIGINT, b BIGINT")
    got = {r.node: r.root for r in connected_components(nodes, table).collect()}
    assert [got[i] for i in range(n)] == roots(n, edges)


def test_components_of_a_long_chain_settle_in_few_rounds(spark):
    n = 10_000
    nodes = spark.range(n + 1).select(F.col("id").alias("node"))
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out, rounds = settle(nodes, chain)
    assert rounds <= 20
    assert {r.root: r["count"] for r in out.groupBy("root").count().collect()} == {0: n, n: 1}


def test_short_tables_of_components_are_one_file_each(spark, monkeypatch):
    files, held = [], components.stored

    def spy(df, *rows):
        table = held(df, *rows)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(components, "stored", spy)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        out, _ = settle(spark.range(61).select(F.col("id").alias("node")), chain)
        assert {r.root for r in out.collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # How many edges there are is known once they are stored.
    assert files[0] > 1 and set(files[1:]) == {1}
