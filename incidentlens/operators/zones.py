"""Zones from KMeans: crime zones, demographic zones, race-weighted zones; scores and profiles.

Models are fitted on rows collapsed to distinct feature values with a weight column, which gives the
same objective as fitting on every row.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Interaction, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..session import stored
from . import lloyd, stats
from .distance_join import nearest_centre
from .silhouette import nearest_of_many
from .skew import is_small

COORDINATES = ("latitude", "longitude")
COORDINATE_FACTOR = 0.7
DEMOGRAPHIC_FACTOR = 3.0
MIN_DEMOGRAPHIC_ROWS = 1_000
MAX_LABELS = 1_000


def moments(df: DataFrame, names, sample: bool = False) -> dict:
    """{column: (mean, standard deviation)}, population or sample; a zero deviation counts as 1."""
    spread = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(*[F.struct(F.avg(c).alias("mean"), spread(c).alias("std")).alias(c)
                   for c in names]).first()
    return {c: (row[c]["mean"] or 0.0, row[c]["std"] or 1.0) for c in names}


def _fit(rows: DataFrame, k: int, seed: int, n_init: int, max_iter: int, parallel: int):
    """Best of `n_init` fits of sparse vectors by training cost; the fits run as concurrent jobs."""
    rows = rows.persist()
    try:
        distinct = rows.count()

        def one(s):
            return KMeans(k=min(k, distinct), seed=s, featuresCol="features", weightCol="w",
                          predictionCol="zone", maxIter=max_iter).fit(rows)

        with ThreadPoolExecutor(max(1, min(parallel, n_init))) as pool:
            models = list(pool.map(one, range(seed, seed + n_init)))
        return min(models, key=lambda m: m.summary.trainingCost)
    finally:
        rows.unpersist()


def _model(df: DataFrame, expressions: dict, k, seed, n_init, max_iter) -> PipelineModel:
    """Pipeline of feature expressions, assembler and KMeans; it can be saved and loaded.

    The best of `n_init` starts by cost; one pass serves all starts. Rows without a feature take no part.
    """
    select = ", ".join(f"{sql} AS {name}" for name, sql in expressions.items())
    features = SQLTransformer(statement=f"SELECT *, {select} FROM __THIS__")
    assembler = VectorAssembler(inputCols=list(expressions), outputCol="features")
    # Written once: the passes of the fit then read as many partitions as the bytes need.
    names = list(expressions)
    flat = stored(features.transform(df).groupBy(*names).agg(F.count("*").alias("w")).na.drop(subset=names))
    fits = lloyd.fit_many(flat, names, k, range(seed, seed + n_init), max_iter)
    best = lloyd.as_model(df.sparkSession, min(fits, key=lambda f: f[1])[0])
    return PipelineModel(stages=[features, assembler, best])


def assign(model: PipelineModel, df: DataFrame, out: str = "zone") -> DataFrame:
    """Rows with their zone; rows without coordinates are left out."""
    known = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    made = model.transform(known)
    return made.select(*df.columns, F.col("zone").alias(out))


def misplaced(model: PipelineModel, df: DataFrame) -> DataFrame:
    """One row: how many rows have a zone, and for how many another centre is nearer."""
    made = model.transform(df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()))
    at = vector_to_array("features")
    # One entry per fitted centre.
    distances = F.array(*[
        F.aggregate(F.zip_with(at, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)),
                    F.lit(0.0), lambda t, v: t + v) for c in model.stages[-1].clusterCenters()])
    own = F.get("_d", F.col("zone"))
    return made.withColumn("_d", distances).agg(
        F.count("*").alias("n_rows"), F.count_if(own > F.array_min("_d") + 1e-9).alias("n_elsewhere"))


def fit_crime_zones(incidents: DataFrame, k: int = 30, seed: int = 42, n_init: int = 10,
                    max_iter: int = 100, standardise: bool = True):
    """Zones by position; with `standardise=False` on raw degrees."""
    if standardise:
        scale = moments(incidents, COORDINATES)
        features = {f"f_{c}": f"({c} - ({m!r})) / {s!r}D" for c, (m, s) in scale.items()}
    else:
        features = {f"f_{c}": f"{c} + 0D" for c in COORDINATES}
    return _model(incidents, features, k, seed, n_init, max_iter)


def zone_scores(zoned: DataFrame, zone: str = "zone") -> DataFrame:
    """Safety score of each zone: 100 less the mean whole-number severity in tenths."""
    points = C.severity_points(F.col("crime_type"))
    total = zoned.groupBy(zone).agg(
        F.sum(points).alias("severity"), F.count("*").alias("crime_count"))
    share = F.col("severity") / (F.col("crime_count") * F.lit(10.0)) * 100
    return total.select(zone, "crime_count", C.clamp(100 - share).alias("safety_score"))


def zone_offenses(zoned: DataFrame, zone: str = "zone", k: int = 3) -> DataFrame:
    """Commonest offense and the three commonest with counts."""
    return stats.top_list(zoned, [zone], "crime_type", k, "common_crimes").withColumn(
        "dominant_crime", F.get("common_crimes", 0)["value"])


def zone_table(zoned: DataFrame, zone: str = "zone") -> DataFrame:
    return zone_scores(zoned, zone).join(zone_offenses(zoned, zone), zone, "left")


# --- demographic zones ----------------------------------------------------------------------

def with_demographics(incidents: DataFrame) -> DataFrame:
    names = [c for c in rules.DEMOGRAPHIC_COLUMNS if c in incidents.columns]
    return incidents.na.drop(subset=names)


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_demographic_zones(incidents: DataFrame, k: int = 25, seed: int = 42, n_init: int = 10,
                          max_iter: int = 100, parallel: int = 8):
    """Zones by position (×0.7) and one-hot victim attributes (×3); None below 1,000 rows."""
    known = with_demographics(incidents)
    if is_small(known, MIN_DEMOGRAPHIC_ROWS - 1):
        return None
    scale = moments(known, COORDINATES)
    features = {f"f_{c}": f"({c} - ({m!r})) / {s!r}D * {COORDINATE_FACTOR}D"
                for c, (m, s) in scale.items()}
    names = [c for c in rules.DEMOGRAPHIC_COLUMNS if c in incidents.columns]
    long = []
    for c in names:
        # Attribute values are a short code list as a rule; one that is longer is indexed instead.
        values = [r[0] for r in known.select(c).distinct().orderBy(c).limit(MAX_LABELS + 1).collect()]
        if len(values) > MAX_LABELS:
            long.append(c)
            continue
        for i, v in enumerate(values):
            features[f"f_{c}_{i}"] = (
                f"IF({c} = {_literal(v)}, {DEMOGRAPHIC_FACTOR}D, 0D)")
    if long:
        return _model_of_long_lists(known, features, long, k, seed, n_init, max_iter, parallel)
    return _model(known, features, k, seed, n_init, max_iter)


def _model_of_long_lists(df: DataFrame, expressions: dict, names, k, seed, n_init, max_iter, parallel) -> PipelineModel:
    """Like `_model`, with one-hot vectors of the attributes in `names`, weighted like the others."""
    select = ", ".join(f"{sql} AS {name}" for name, sql in expressions.items())
    features = SQLTransformer(statement=f"SELECT *, {select} FROM __THIS__")
    flat = stored(features.transform(df).groupBy(*expressions, *names).agg(F.count("*").alias("w")))
    indexed = StringIndexer(inputCols=names, outputCols=[f"i_{c}" for c in names], handleInvalid="keep").fit(flat)
    encoded = OneHotEncoder(inputCols=[f"i_{c}" for c in names], outputCols=[f"v_{c}" for c in names],
                            dropLast=False).fit(indexed.transform(flat))
    wide = [f"w_{c}" for c in names]
    # A vector times a number, as an interaction of the two.
    factor = SQLTransformer(statement=f"SELECT *, {DEMOGRAPHIC_FACTOR}D AS _factor FROM __THIS__")
    scaled = [Interaction(inputCols=["_factor", f"v_{c}"], outputCol=w) for c, w in zip(names, wide, strict=True)]
    assembler = VectorAssembler(inputCols=[*expressions, *wide], outputCol="features")
    prepared = PipelineModel(stages=[indexed, encoded, factor, *scaled, assembler])
    rows = prepared.transform(flat).select("features", F.col("w").cast("double").alias("w"))
    best = _fit(rows, k, seed, n_init, max_iter, parallel)
    return PipelineModel(stages=[features, *prepared.stages, best])


def demographic_profiles(zoned: DataFrame, zone: str = "zone",
                         names=tuple(rules.DEMOGRAPHIC_COLUMNS)) -> DataFrame:
    """Per zone and attribute: counts of every value, the commonest value and its share in %."""
    counts = (stats.facets(zoned, names, [zone]).groupBy(zone, "attribute", "value")
              .agg(F.count("*").alias("count")))
    per = counts.groupBy(zone, "attribute").agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("dominant_value"),
        F.max("count").alias("top"), F.sum("count").alias("total"),
        stats.sorted_counts("value").alias("value_counts"))
    return per.select(zone, "attribute", "dominant_value",
                      (F.col("top") / F.col("total") * 100).alias("concentration"),
                      "value_counts")


def zone_centres(zoned: DataFrame, zone: str = "zone") -> DataFrame:
    return zoned.groupBy(zone).agg(
        F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"),
        F.count("*").alias("crime_count"))


def demographic_zone_table(zoned: DataFrame, zone: str = "zone") -> DataFrame:
    """One row per zone: centre, count, and the profile of each attribute as an array."""
    item = F.struct("attribute", "dominant_value", "concentration", "value_counts")
    # Attributes are the fixed victim columns, so the array has three items at most. A map cannot be
    # ordered, so items are ordered by attribute name through a comparator.
    by_name = lambda a, b: (
        F.when(a["attribute"] < b["attribute"], -1).when(a["attribute"] > b["attribute"], 1)
        .otherwise(0))
    profiles = demographic_profiles(zoned, zone).groupBy(zone).agg(
        F.array_sort(F.collect_list(item), by_name).alias("profiles"))
    return zone_centres(zoned, zone).join(profiles, zone, "left")


def predict_demographic_zone(model, centres: DataFrame, locations: DataFrame) -> DataFrame:
    """Zone of each location: by the model where all attributes are known, else nearest centre."""
    known = F.lit(model is not None)
    for c in rules.DEMOGRAPHIC_COLUMNS:
        known = known & F.col(c).isNotNull()
    found = nearest_centre(locations.filter(~known), centres, out="demographic_zone").withColumns({
        "demographic_zone": F.col("demographic_zone").cast("int"), "source": F.lit("centre")})
    if model is None:
        return found
    moved = locations.filter(known).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    by_model = assign(model, moved, "demographic_zone").withColumnsRenamed(
        {"latitude": "lat", "longitude": "lon"})
    return by_model.withColumn("source", F.lit("attributes")).unionByName(found)


def attribute_importance(zoned: DataFrame, zone: str = "zone") -> DataFrame:
    """Stated weights next to a measured one: between-zone share of each attribute's variance.

    For an attribute with value shares p(v) overall and p(v|z) in zone z, the measure is
    sum of w(z)·(p(v|z) - p(v))² over sum of p(v)·(1 - p(v)).
    """
    counts = (stats.facets(zoned, rules.DEMOGRAPHIC_COLUMNS, [zone])
              .groupBy("attribute", zone, "value").agg(F.count("*").alias("n")))
    # Σ w(z)·p(v|z)² and Σ p(v)²: absent (zone, value) pairs add nothing.
    within = (counts.groupBy("attribute", zone).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("s"))
        .groupBy("attribute").agg((F.sum("s") / F.sum("n")).alias("within")))
    overall = (counts.groupBy("attribute", "value").agg(F.sum("n").alias("n"))
               .groupBy("attribute").agg(
        (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("overall")))
    measured = (F.col("within") - F.col("overall")) / (1 - F.col("overall"))
    return within.join(overall, "attribute").select(
        "attribute", C.first_match(rules.STATED_IMPORTANCE.items(), F.col("attribute").__eq__)
        .alias("stated_importance"),
        F.when(F.col("overall") < 1, measured).otherwise(0.0).alias("measured_importance"))


# --- zones of the older analyses ------------------------------------------------------------

def with_race(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("vic_race").isNotNull()).withColumn(
        "race_std", C.race_label_4(F.col("vic_race")))


def fit_race_zones(incidents: DataFrame, k: int = 20, seed: int = 42, n_init: int = 1,
                   max_iter: int = 100):
    """Zones by position and race label, all z-scored by sample deviation."""
    labelled = with_race(incidents)
    names = [label for _, label in rules.RACE_LABELS_4]
    dummies = {f"is_{n.lower()}": F.when(F.col("race_std") == n, 1.0).otherwise(0.0)
               for n in names}
    wide = labelled.withColumns(dummies)
    scale = moments(wide, [*COORDINATES, *dummies], sample=True)
    features = {}
    for c, (m, s) in scale.items():
        value = c if c in COORDINATES else (
            f"IF(race_std = '{c.removeprefix('is_').upper()}', 1D, 0D)")
        features[f"f_{c}"] = f"({value} - ({m!r})) / {s!r}D"
    return labelled, _model(labelled, features, k, seed, n_init, max_iter)


def race_zone_table(zoned: DataFrame, zone: str = "zone", above: float = 0.2) -> DataFrame:
    """Centre, size and the races that make up more than a fifth of each zone."""
    shares = stats.shares(zoned, zone, "race_std", above).groupBy(zone).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("race_std", "share"))))
        .alias("racial_composition"))
    return zone_centres(zoned, zone).withColumnRenamed("crime_count", "sample_size").join(
        shares, zone, "left")


def zone_matrix(zoned: DataFrame, zone: str = "zone") -> DataFrame:
    """Zone × offense counts in long form."""
    return stats.value_counts(zoned, [zone], "crime_type")


def grid_zone(lat: Column, lon: Column, side: float = 0.1) -> Column:
    """Fixed zones: squares of `side` degrees, named by their indices."""
    return F.concat_ws("_", F.floor(lat / F.lit(side)).cast("string"),
                       F.floor(lon / F.lit(side)).cast("string"))


def locate(model: PipelineModel, locations: DataFrame, table: DataFrame) -> DataFrame:
    """Zone of each location with what is known about the zone; null without coordinates."""
    moved = locations.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    placed = assign(model, moved)
    lost = moved.filter(F.col("latitude").isNull() | F.col("longitude").isNull()).withColumn(
        "zone", F.lit(None).cast(placed.schema["zone"].dataType))
    return placed.unionByName(lost).withColumnsRenamed(
        {"latitude": "lat", "longitude": "lon"}).join(table, "zone", "left")


def fitted(model: PipelineModel, incidents: DataFrame) -> DataFrame:
    """Incidents with their zone, written once for the profiles that follow."""
    return stored(assign(model, incidents))


def assign_to_centres(df: DataFrame, centres: DataFrame, scale: dict, zone: str = "zone",
                      out: str = "zone", max_listed: int = MAX_LABELS) -> DataFrame:
    """Zone by the nearest given centre in standardised space (lowest zone on ties).

    `scale` is {"latitude": (mean, deviation), ...}; centres are in degrees. Up to `max_listed` of them
    (checked) travel as one array; more are searched tile by tile. Rows without coordinates have no zone.
    """
    spread = {c: F.lit(s) for c, (_, s) in scale.items()}
    if not is_small(centres, max_listed):
        x, y = F.col("longitude") / spread["longitude"], F.col("latitude") / spread["latitude"]
        placed = df.withColumns({"_x": x, "_y": y})
        known = placed.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
        found = nearest_of_many(
            known.select(F.col("_x").alias("x"), F.col("_y").alias("y")),
            centres.select(F.col(zone).alias("k"), (F.col("center_lon") / spread["longitude"]).alias("cx"),
                           (F.col("center_lat") / spread["latitude"]).alias("cy")))
        found = found.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("k").alias("_k"))
        return placed.join(found, ["_x", "_y"], "left").withColumn(out, F.col("_k")).select(
            *[c for c in df.columns if c != out], out)
    listed = centres.select(F.sort_array(F.collect_list(
        F.struct(zone, "center_lat", "center_lon")))).scalar()

    def squared(c):
        dy = (F.col("latitude") - c["center_lat"]) / spread["latitude"]
        dx = (F.col("longitude") - c["center_lon"]) / spread["longitude"]
        return F.struct((dx * dx + dy * dy).alias("d"), c[zone].alias("zone"))

    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return (df.withColumn("_centres", listed)
            .withColumn(out, F.when(known, F.array_min(F.transform("_centres", squared))["zone"]))
            .drop("_centres"))
