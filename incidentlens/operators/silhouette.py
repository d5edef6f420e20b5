"""Mean silhouette of clusters in the plane, with plain and with squared distances, over all rows.

Both work on different coordinates with their counts. Each cluster has a tree of square cells; the cells of a
low level are tiles, groups of points that are handled alike. For a tile, only clusters that may be the
nearest other one are looked at: the mean distance from a point to a cluster is at least that to its centre
and at most that plus the cluster's deviation, so centres are searched in widening rings until none outside
can win.

The sum of distances from a point to a cluster walks down that cluster's tree: a cell whose radius is at most
`SEPARATION` of its distance from the tile is taken as a series, otherwise its children are, and cells of at
most `LEAF` points are added up point by point. For a cell with members w around its centre and a point z,

    |z - w| = |z| (1 - w/z)^(1/2) (1 - w*/z*)^(1/2),

a double power series whose coefficients, the cell's moments of order s and frequency m, do not depend on z.
Cut off after order `ORDER`, it is wrong by less than 0.05 * SEPARATION^(ORDER + 1) of |z| for each member,
1e-9. So the work per point grows with the logarithm of the cluster's size, and no list of clusters, cells or
points is held anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, stored

SEPARATION, ORDER, LEAF = 0.2, 10, 16
#: Levels of cells below the one that would hold `LEAF` points evenly, the deepest level, and how far tiles lie
#: above the lowest cells.
BELOW, DEEPEST, TILE_ABOVE = 2, 20, 3
TERMS = [(s, m) for s in range(ORDER + 1) for m in range(s % 2, s + 1, 2)]
CELL = ["k", "l", "i", "j"]
TILE = ["c", "ti", "tj"]


def _coefficients() -> list[float]:
    """Of (1 - t)^(1/2)."""
    a = [1.0]
    for j in range(1, ORDER + 1):
        a.append(a[-1] * (2 * j - 3) / (2 * j))
    return a


def _spots(df: DataFrame, label: str, x: str, y: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("c"), F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.count("*").alias("w"))


def _clusters(spots: DataFrame) -> DataFrame:
    """One row per cluster: size n, centre, variance v, the square of its tree (ox, oy, h) and its levels."""
    n = F.sum("w")
    cx, cy = F.sum(F.col("w") * F.col("x")) / n, F.sum(F.col("w") * F.col("y")) / n
    rows = spots.groupBy("c").agg(
        n.alias("n"), F.count("*").alias("m"), cx.alias("cx"), cy.alias("cy"), F.min("x").alias("x0"),
        F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    spread = spots.join(rows.select("c", "cx", "cy"), "c").groupBy("c").agg(
        (F.sum(F.col("w") * (dx * dx + dy * dy)) / F.sum("w")).alias("v"))
    even = F.ceil(F.log(F.col("m") / LEAF) / math.log(4)) + BELOW
    levels = F.when(F.col("m") > LEAF, F.least(even, F.lit(DEEPEST))).otherwise(0).cast("int")
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2 * (1 + 1e-9)
    return stored(rows.join(spread, "c").select(
        "c", "n", "cx", "cy", "v", ((F.col("x0") + F.col("x1")) / 2).alias("ox"),
        ((F.col("y0") + F.col("y1")) / 2).alias("oy"), F.greatest(half, F.lit(1e-12)).alias("h"),
        levels.alias("levels"), F.greatest(levels - TILE_ABOVE, F.lit(0)).alias("tile_level")))


def _index(at: str, origin: str, level):
    """Number of the cell of a level along one axis."""
    n = F.pow(F.lit(2.0), level)
    return F.least(F.floor((F.col(at) - F.col(origin) + F.col("h")) / (2 * F.col("h")) * n), n - 1).cast("long")


def _centre(origin: str, index: str, level):
    return F.col(origin) - F.col("h") + (F.col(index) + 0.5) * 2 * F.col("h") / F.pow(F.lit(2.0), level)


def _placed(spots: DataFrame, clusters: DataFrame) -> DataFrame:
    """Spots with their tile."""
    level = F.col("tile_level")
    return stored(spots.join(clusters, "c").select(
        "c", "x", "y", "w", _index("x", "ox", level).alias("ti"), _index("y", "oy", level).alias("tj")))


def _tiles(placed: DataFrame, clusters: DataFrame) -> DataFrame:
    """(c, ti, tj, tx, ty, tr): centre and radius of each tile."""
    level = F.col("tile_level")
    return stored(placed.select(*TILE).distinct().join(clusters, "c").select(
        *TILE, _centre("ox", "ti", level).alias("tx"), _centre("oy", "tj", level).alias("ty"),
        (F.col("h") / F.pow(F.lit(2.0), level) * math.sqrt(2) * (1 + 1e-9)).alias("tr")))


def _rivals(tiles: DataFrame, clusters: DataFrame, squared: bool) -> DataFrame:
    """(tile, k): the clusters that may be the nearest one for some point of the tile, its own (c) left out.

    Tiles are (c, ti, tj, tx, ty, tr), clusters (c, cx, cy, v)."""
    n, x0, x1, y0, y1 = clusters.agg(F.count("*"), F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    extent = max(x1 - x0, y1 - y0, 1e-9)
    radius, todo, out = extent / math.sqrt(n), tiles, None
    while True:
        r, final = float(radius), radius > 2 * extent
        key = lambda c: F.floor(c / F.lit(r)).cast("long")  # noqa: B023, E731
        there = clusters.select(F.col("c").alias("k"), "cx", "cy", "v", key(F.col("cx")).alias("gi"),
                                key(F.col("cy")).alias("gj"))
        around = F.sequence(F.lit(-1), F.lit(1))
        # Beyond the last ring a tile may still lie outside the centres' box: then every centre is looked at there.
        here = todo.withColumns({"gx": F.least(F.greatest(F.col("tx"), F.lit(x0)), F.lit(x1)),
                                 "gy": F.least(F.greatest(F.col("ty"), F.lit(y0)), F.lit(y1))})
        here = here.withColumn("di", F.explode(around)).withColumn("dj", F.explode(around)).withColumns(
            {"gi": key(F.col("gx")) + F.col("di"), "gj": key(F.col("gy")) + F.col("dj")})
        dx, dy = F.col("tx") - F.col("cx"), F.col("ty") - F.col("cy")
        d = F.sqrt(dx * dx + dy * dy)
        near, far = F.greatest(d - F.col("tr"), F.lit(0.0)), d + F.col("tr")
        low, high = (near * near + F.col("v"), far * far + F.col("v")) if squared else (near, far + F.sqrt("v"))
        beyond = F.greatest(F.lit(r) - F.col("tr"), F.lit(0.0))  # nearer centres are all among those found
        found = here.join(there, ["gi", "gj"]).filter(~F.col("k").eqNullSafe(F.col("c"))).select(
            *TILE, "k", low.alias("low"), F.min(high).over(Window.partitionBy(*TILE)).alias("best"),
            (beyond * beyond if squared else beyond).alias("beyond"))
        found = stored(found.filter(F.col("low") <= F.col("best") * (1 + 1e-9)))
        settled = found if final else found.filter(F.col("best") <= F.col("beyond"))
        part = settled.select(*TILE, "k")
        out = part if out is None else out.unionByName(part)
        if final:
            return out
        met = settled.select(*[F.col(t).alias(f"_{t}") for t in TILE]).distinct()
        same = [F.col(t).eqNullSafe(F.col(f"_{t}")) for t in TILE]
        todo = stored(todo.join(met, same, "left_anti"))
        if todo.isEmpty():
            return out
        radius *= 4


def _members(spots: DataFrame, clusters: DataFrame) -> DataFrame:
    """(k, l, i, j, x, y, w, px, py): every spot in its cell of every level, px and py from the cell's centre."""
    level = F.col("l")
    rows = spots.join(clusters, "c").withColumn("l", F.explode(F.sequence(F.lit(0), F.col("levels")))).withColumns(
        {"i": _index("x", "ox", level), "j": _index("y", "oy", level)})
    return rows.select(F.col("c").alias("k"), "l", "i", "j", "x", "y", "w",
                       (F.col("x") - _centre("ox", "i", level)).alias("px"),
                       (F.col("y") - _centre("oy", "j", level)).alias("py"))


def _cells(members: DataFrame) -> DataFrame:
    """(k, l, i, j, m, moments): distinct coordinates in each cell, and its moments term by term."""
    rho, psi = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")), F.atan2("py", "px")
    sums = []
    for s, m in TERMS:
        size = F.col("w") * F.pow("rho", F.lit(float(s)))
        sums += [F.sum(size * F.cos(m * F.col("psi")))] + ([F.sum(size * F.sin(m * F.col("psi")))] if m else [])
    return stored(members.withColumns({"rho": rho, "psi": psi}).groupBy(*CELL).agg(
        F.count("*").alias("m"), F.array(*sums).alias("moments")))


def _series():
    """Sum of the distances from (x, y) to the members of a cell with centre (zx, zy)."""
    a, at, total = _coefficients(), 0, F.lit(0.0)
    for s, m in TERMS:
        size = a[(s + m) // 2] * a[(s - m) // 2] * (2 if m else 1) * F.pow("r", F.lit(1.0 - s))
        wave = F.get("moments", F.lit(at)) * F.cos(m * F.col("phi"))
        if m:
            wave = wave + F.get("moments", F.lit(at + 1)) * F.sin(m * F.col("phi"))
        total, at = total + size * wave, at + (2 if m else 1)
    return total


def _walk(pairs: DataFrame, tiles: DataFrame, clusters: DataFrame, cells: DataFrame, deepest: int):
    """(far, near): for each (tile, k) the cells of cluster k taken as series and those taken by their points."""
    square = clusters.select(F.col("c").alias("k"), "ox", "oy", "h", "levels")
    known = cells.select(*CELL, "m")
    todo = pairs.join(tiles, TILE).withColumns({"l": F.lit(0), "i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    far = near = None
    for level in range(deepest + 1):
        placed = todo.join(known, CELL).join(square, "k")
        size = F.pow(F.lit(2.0), F.col("l"))
        zx, zy = _centre("ox", "i", F.col("l")), _centre("oy", "j", F.col("l"))
        dx, dy = F.col("tx") - zx, F.col("ty") - zy
        radius = F.col("h") / size * math.sqrt(2)
        apart = radius <= SEPARATION * (F.sqrt(dx * dx + dy * dy) - F.col("tr"))
        few = (F.col("m") <= LEAF) | (F.col("l") >= F.col("levels"))
        judged = stored(placed.select(*TILE, "tx", "ty", "tr", *CELL, zx.alias("zx"), zy.alias("zy"),
                                      F.when(few, "near").when(apart, "far").otherwise("cut").alias("way")))
        parts = [judged.filter(F.col("way") == way).select(*TILE, *CELL, "zx", "zy") for way in ("far", "near")]
        far, near = parts if far is None else (far.unionByName(parts[0]), near.unionByName(parts[1]))
        cut = judged.filter("way = 'cut'")
        if level == deepest or cut.isEmpty():
            return far, near
        both = F.sequence(F.lit(0), F.lit(1))
        todo = cut.select(*TILE, "tx", "ty", "tr", "k", (F.col("l") + 1).alias("l"), "i", F.col("j"),
                          F.explode(both).alias("di")).withColumn("dj", F.explode(both)).select(
            *TILE, "tx", "ty", "tr", "k", "l", (2 * F.col("i") + F.col("di")).alias("i"),
            (2 * F.col("j") + F.col("dj")).alias("j"))


def distance_sums(placed: DataFrame, pairs: DataFrame, tiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """(c, x, y, w, k, total): for every point of a tile and every cluster paired with it, the sum of distances."""
    members = stored(_members(placed.select("c", "x", "y", "w"), clusters))
    cells = _cells(members)
    deepest = clusters.agg(F.max("levels")).first()[0]
    far, near = _walk(pairs, tiles, clusters, cells, deepest)
    dx, dy = F.col("x") - F.col("zx"), F.col("y") - F.col("zy")
    series = (placed.join(far, TILE).withColumns({"r": F.sqrt(dx * dx + dy * dy), "phi": F.atan2(dy, dx)})
              .join(cells.drop("m"), CELL).select("c", "x", "y", "w", "k", _series().alias("total")))
    ex, ey = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    other = members.select(*CELL, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("w").alias("w2"))
    points = placed.join(near, TILE).join(other, CELL).select(
        "c", "x", "y", "w", "k", (F.col("w2") * F.sqrt(ex * ex + ey * ey)).alias("total"))
    return series.unionByName(points).groupBy("c", "x", "y", "w", "k").agg(F.sum("total").alias("total"))


def _mean(values: DataFrame) -> DataFrame:
    """One row from (w, n, a, b): a to the own cluster, b to the nearest other one."""
    score = F.when(F.col("n") > 1, F.coalesce(
        (F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))).otherwise(0.0)
    return values.agg((F.sum(F.col("w") * F.when(F.col("b").isNotNull(), score)) / F.sum("w")).alias("silhouette"))


def silhouette(df: DataFrame, label: str, x: str = "longitude", y: str = "latitude",
               squared: bool = False) -> DataFrame:
    """One row: the mean silhouette of all rows, null below two clusters.

    A row that is alone in its cluster counts as zero, and so does one at distance zero of all. With
    `squared`, distances are squared, and a cluster's mean is that to its centre plus its variance.
    """
    spots = stored(_spots(df, label, x, y))
    clusters = _clusters(spots)
    if clusters.count() < 2:
        return clusters.agg(F.max(F.lit(None).cast("double")).alias("silhouette"))
    placed = _placed(spots, clusters)
    tiles = _tiles(placed, clusters)
    rivals = _rivals(tiles, clusters, squared)
    own = tiles.select(*TILE, F.col("c").alias("k"))
    pairs = stored(rivals.unionByName(own))
    sizes = clusters.select(F.col("c").alias("k"), "n", "cx", "cy", "v")
    if squared:
        dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
        sums = placed.join(pairs, TILE).join(sizes, "k").select(
            "c", "x", "y", "w", "k", "n", ((dx * dx + dy * dy + F.col("v")) * F.col("n")).alias("total"))
    else:
        sums = distance_sums(placed, pairs, tiles, clusters).join(sizes.select("k", "n"), "k")
    mine = F.col("k") == F.col("c")
    values = sums.groupBy("c", "x", "y", "w").agg(
        F.max(F.when(mine, F.col("n"))).alias("n"),
        F.max(F.when(mine, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"))
    out = stored(_mean(values))
    discard(spots, placed, tiles, pairs)
    return out


def nearest_of_many(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(x, y, k): the nearest centre (lowest k on ties) of each point (x, y), for any number of centres (k, cx, cy).

    Points are grouped into square tiles about as wide as the centres lie apart; a centre is compared with the
    points of those tiles only for which bounds don't rule it out.
    """
    n, x0, x1, y0, y1 = centres.agg(F.count("*"), F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    side = max(x1 - x0, y1 - y0, 1e-9) / math.sqrt(n)
    placed = stored(points.select("x", "y").distinct().withColumns({
        "c": F.lit(None).cast("long"), "ti": F.floor(F.col("x") / side).cast("long"),
        "tj": F.floor(F.col("y") / side).cast("long")}))
    tiles = placed.select(*TILE).distinct().withColumns({
        "tx": (F.col("ti") + 0.5) * side, "ty": (F.col("tj") + 0.5) * side,
        "tr": F.lit(side / math.sqrt(2) * (1 + 1e-9))})
    flat = centres.select(F.col("k").alias("c"), "cx", "cy", F.lit(0.0).alias("v"))
    pairs = _rivals(stored(tiles), flat, True)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return (placed.drop("c").join(pairs.drop("c"), ["ti", "tj"]).join(centres, "k").groupBy("x", "y").agg(
        F.min(F.struct((dx * dx + dy * dy).alias("d"), "k")).alias("best")).select("x", "y", "best.k"))
