"""KMeans from many starts at once: every pass over the rows serves all of them.

Rows are distinct feature values with a weight. Seeding is by distance: in each of `ROUNDS` passes every start
draws 2k rows, a row with probability by its weight times its squared distance from what the start has drawn
so far. Each row runs an exponential race with that rate and the first 2k win, so a draw needs no total and no
second pass. Race times come from a hash of the row's content: a task that runs again draws the same rows. What
all starts have drawn, weighted by the rows nearest to it, stands for the table on the driver (a few thousand
rows, whatever the table), and each start cuts it to k centres in its own way. A Lloyd pass then adds up, in
each task, one row per start and zone, and only these sums are shuffled; starts whose centres have come to rest
take no more part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeansModel
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS, LOCAL_ROUNDS, TOLERANCE = 4, 100, 1e-4
#: Rows that one task passes over, so that a short table is a job of one stage.
ROWS_PER_TASK = 50_000
#: Steps that an extrapolation looks back on.
MEMORY = 6
#: Distances held at once in a task.
BLOCK = 4_000_000
WEIGHT, COST = -1, -2


def _blocks(batches, features, per_row: int):
    """(values, weights, hashes) of some rows at a time."""
    step = max(1, BLOCK // per_row)
    for batch in batches:
        x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features]).astype(float)
        w = batch.column("w").to_numpy(zero_copy_only=False).astype(float)
        h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(w), step):
            yield x[i:i + step], w[i:i + step], h[i:i + step]


def squared_distances(x, centres):
    """(rows, centres); the origin should lie among the rows, since figures are taken from its products."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(d, 0.0)


def _uniform(hashes, salt: int):
    """Numbers in (0, 1) by hash and salt."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2 ** 64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def _draw(rows: DataFrame, features, shift, drawn: list, take: int, salts: list):
    """For each start the `take` rows that win the race against what it has drawn; fewer where rows are fewer."""
    def race(batches):
        best = [(np.empty(0), np.empty((0, len(features)))) for _ in drawn]
        for x, w, h in _blocks(batches, features, max(1, max(len(c) for c in drawn))):
            x = x - shift
            for s, centres in enumerate(drawn):
                rate = w * squared_distances(x, centres).min(axis=1) if len(centres) else w
                # What is left of the product of a row with itself is no distance.
                open_ = rate > w * 1e-14 * (1 + (x * x).sum(axis=1)) if len(centres) else rate > 0
                times = -np.log(_uniform(h[open_], salts[s])) / rate[open_]
                t, v = np.concatenate([best[s][0], times]), np.vstack([best[s][1], x[open_]])
                first = np.argsort(t, kind="stable")[:take]
                best[s] = t[first], v[first]
        for s, (t, v) in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(t), s, np.int32)), pa.array(t), pa.array(list(v), pa.list_(pa.float64()))],
                ["start", "time", "at"])

    runs = rows.mapInArrow(race, "start int, time double, at array<double>")
    place = F.row_number().over(Window.partitionBy("start").orderBy("time", "at"))
    found = runs.withColumn("_p", place).filter(F.col("_p") <= take).orderBy("start", "_p").toPandas()
    own = [np.array(list(found["at"][found["start"] == s])).reshape(-1, len(features)) for s in range(len(drawn))]
    return [np.vstack([c, v]) for c, v in zip(drawn, own, strict=True)]


def _sums(rows: DataFrame, features, shift, sets: list):
    """For each set of centres: sums of the rows nearest to each centre, their weight, and the cost."""
    sizes, d = [len(c) for c in sets], len(features)

    def add(batches):
        sums = [np.zeros((n, d)) for n in sizes]
        weights, costs = [np.zeros(n) for n in sizes], np.zeros(len(sizes))
        for x, w, _ in _blocks(batches, features, max(sizes)):
            x = x - shift
            for s, centres in enumerate(sets):
                distance = squared_distances(x, centres)
                zone = distance.argmin(axis=1)
                costs[s] += (w * distance[np.arange(len(w)), zone]).sum()
                weights[s] += np.bincount(zone, w, sizes[s])
                for j in range(d):
                    sums[s][:, j] += np.bincount(zone, w * x[:, j], sizes[s])
        for s in range(len(sets)):
            values = np.concatenate([sums[s].ravel(), weights[s], costs[s:s + 1]])
            zones = np.concatenate([np.repeat(np.arange(sizes[s]), d), np.arange(sizes[s]), [0]])
            parts = np.concatenate([np.tile(np.arange(d), sizes[s]), np.full(sizes[s], WEIGHT), [COST]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), s, np.int32)), pa.array(zones.astype(np.int32)),
                 pa.array(parts.astype(np.int32)), pa.array(values)], ["start", "zone", "part", "value"])

    made = rows.mapInArrow(add, "start int, zone int, part int, value double")
    # Centres times features of each start, however many rows there are.
    made = made.groupBy("start", "zone", "part").agg(F.sum("value").alias("value")).toPandas()
    out = []
    for s, n in enumerate(sizes):
        own = made[made["start"] == s]
        total, weight = np.zeros((n, d)), np.zeros(n)
        inner = own[own["part"] >= 0]
        total[inner["zone"], inner["part"]] = inner["value"]
        of = own[own["part"] == WEIGHT]
        weight[of["zone"]] = of["value"]
        out.append((total, weight, float(own[own["part"] == COST]["value"].sum())))
    return out


def _cut(points, weights, k: int, rng):
    """k centres of weighted points: seeded by distance, then moved."""
    k = min(k, len(points))
    centres = points[rng.choice(len(points), 1, p=weights / weights.sum())]
    for _ in range(k - 1):
        rate = weights * squared_distances(points, centres).min(axis=1)
        if rate.sum() <= 0:
            break
        centres = np.vstack([centres, points[rng.choice(len(points), 1, p=rate / rate.sum())]])
    for _ in range(LOCAL_ROUNDS):
        zone = squared_distances(points, centres).argmin(axis=1)
        weight = np.bincount(zone, weights, len(centres))
        moved = np.column_stack([np.bincount(zone, weights * c, len(centres)) for c in points.T])
        moved = np.where(weight[:, None] > 0, moved / np.maximum(weight, 1e-300)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def seed_centres(rows: DataFrame, features, k: int, seeds, shift) -> list:
    """One set of k centres per seed."""
    drawn = _draw(rows, features, shift, [np.empty((0, len(features))) for _ in seeds], 1, [s * 64 for s in seeds])
    for i in range(1, ROUNDS + 1):
        drawn = _draw(rows, features, shift, drawn, 2 * k, [s * 64 + i for s in seeds])
    points = np.unique(np.vstack(drawn), axis=0)
    weights = np.maximum(_sums(rows, features, shift, [points])[0][1], 1e-12)
    return [_cut(points, weights, k, np.random.default_rng(s)) for s in seeds]


def fit_many(rows: DataFrame, features, k: int, seeds, max_iter: int = 100, tol: float = TOLERANCE):
    """[(centres, cost)] of each seed. `rows`: the features and their weight `w`, no nulls.

    A start ends when no centre moves by more than `tol`, or after `max_iter` passes. The cost is that of the
    centres before the last move, which have had a pass; the move can only lower it.
    """
    features, seeds = list(features), list(seeds)
    total = F.sum("w")
    *mean, n = rows.agg(*[F.sum(F.col("w") * F.col(c)) / total for c in features], F.count("*")).first()
    if not n:
        raise ValueError("no rows to fit zones on")
    shift = np.array([float(v) for v in mean])
    hashed = rows.select(*features, F.col("w").cast("double").alias("w"), F.xxhash64(*features).alias("h"))
    hashed = hashed.coalesce(math.ceil(n / ROWS_PER_TASK))
    centres = seed_centres(hashed, features, k, seeds, shift)
    starts = [_Start(c) for c in centres]
    for _ in range(max_iter):
        moving = [s for s in starts if not s.rests]
        if not moving:
            break
        for start, (sums, weight, cost) in zip(moving, _sums(hashed, features, shift, [s.at for s in moving]), strict=True):
            start.move(np.where(weight[:, None] > 0, sums / np.maximum(weight, 1e-300)[:, None], start.at), cost, tol)
    return [(s.best + shift, s.cost) for s in starts]


class _Start:
    """One set of centres on its way: Lloyd steps, taken farther by Anderson's extrapolation of the last few.

    An extrapolated set that costs more than the one before is given up for the plain step.
    """

    def __init__(self, centres):
        self.at = self.best = self.plain = centres
        self.cost, self.rests, self.steps = np.inf, False, []

    def move(self, moved, cost, tol):
        if cost > self.cost:
            self.at, self.steps = self.plain, []
            self.cost = np.inf
            return
        self.cost, self.best, self.plain = cost, moved, moved
        step = moved - self.at
        if np.sqrt((step ** 2).sum(axis=1)).max() <= tol:
            self.rests = True
            return
        self.steps = [*self.steps, (step.ravel(), moved.ravel())][-MEMORY:]
        self.at = moved
        if len(self.steps) > 1:
            f, g = (np.diff(np.array(v), axis=0).T for v in zip(*self.steps, strict=True))
            share = np.linalg.lstsq(f, step.ravel(), rcond=1e-8)[0]
            self.at = (moved.ravel() - g @ share).reshape(moved.shape)


def as_model(spark, centres, out: str = "zone") -> KMeansModel:
    """The library's model with these centres, so that it is saved, loaded and applied like a fitted one."""
    listed = _py2java(spark.sparkContext, [Vectors.dense(c) for c in centres])
    plain = spark._jvm.org.apache.spark.mllib.clustering.KMeansModel(listed)
    model = KMeansModel(spark._jvm.org.apache.spark.ml.clustering.KMeansModel("zones", plain))
    return model.setFeaturesCol("features").setPredictionCol(out)
