"""Joins on place.  Every range or distance condition becomes an equi-join on grid cells first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselon.functions.grid import Grid, within_open
from tesselon.operators.graph import checkpointed, components


def covering_cells(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """One row for every grid cell that covers a point (overlaps give several): adds c, r and cell."""
    out = points.withColumn("c", F.explode(grid.columns(F.col(x)))).withColumn("r", F.explode(grid.rows(F.col(y))))
    return out.withColumn("cell", grid.key(F.col("c"), F.col("r")))


def fanout(points: DataFrame, tiles: DataFrame, grid: Grid, inside) -> DataFrame:
    """Points with each tile that covers them: an equi-join on the arithmetic cell, refined by ``inside``."""
    near = covering_cells(points, grid).drop("c", "r")
    return near.join(tiles, "cell").filter(inside(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def covering(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Points with each box (x0, y0, x1, y1) that they lie strictly inside, wherever the boxes are; ``size``: about a box's side."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    indexed = boxes.withColumn("_bx", span("x0", "x1")).withColumn("_by", span("y0", "y1"))
    joined = _bucketed(points, size, 0, "x", "y").join(indexed, ["_bx", "_by"]).drop("_bx", "_by")
    return joined.filter(within_open(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")]))


def _bucketed(df: DataFrame, size: float, reach: int, x: str, y: str) -> DataFrame:
    bx, by = (F.floor(F.col(c) / size) for c in (x, y))
    if not reach:
        return df.withColumns({"_bx": bx, "_by": by})
    around = lambda b: F.explode(F.sequence(b - reach, b + reach))
    return df.withColumn("_bx", around(bx)).withColumn("_by", around(by))


def near_pairs(left: DataFrame, right: DataFrame, distance: float, closed: bool = False) -> DataFrame:
    """(left, right) rows less than (closed: at most) ``distance`` apart, with d; right columns are prefixed by r_.

    Sort-merge: by a file's size Spark would broadcast a side whose rows come nine times.
    """
    named = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    joined = _bucketed(left, distance, 0, "x", "y").join(_bucketed(named, distance, 1, "r_x", "r_y").hint("merge"), ["_bx", "_by"]).drop("_bx", "_by")
    d = F.hypot(F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y"))
    joined = joined.withColumn("d", d)
    return joined.filter(F.col("d") <= distance if closed else F.col("d") < distance)


def not_within(left: DataFrame, right: DataFrame, distance: float, key: str = "id") -> DataFrame:
    """Left rows with no right row nearer than ``distance``; an empty right side excludes nothing."""
    return left.join(near_pairs(left.select(key, "x", "y"), right.select("x", "y"), distance).select(key).distinct(), key, "left_anti")


def within(left: DataFrame, right: DataFrame, distance: float, key: str = "id") -> DataFrame:
    return left.join(near_pairs(left.select(key, "x", "y"), right.select("x", "y"), distance).select(key).distinct(), key, "left_semi")


def _extent(*sides: tuple[DataFrame, list[str], list[str]]) -> float:
    """A length that no distance between points of these frames exceeds (0 if any is empty)."""
    boxes = [df.agg(*[f(F.greatest(*c) if len(c) > 1 else c[0]) if f is F.max else f(F.least(*c) if len(c) > 1 else c[0]) for c in (xs, ys) for f in (F.min, F.max)]).first() for df, xs, ys in sides]
    if any(v is None for box in boxes for v in box):
        return 0.0
    return math.hypot(max(b[1] for b in boxes) - min(b[0] for b in boxes), max(b[3] for b in boxes) - min(b[2] for b in boxes))


def nearest(left: DataFrame, right: DataFrame, start: float, key: str = "id", other_than_self: bool = False) -> DataFrame:
    """Distance to the nearest right point, whatever it is; null only if there is none.

    By rings: what no ring of a radius settles goes on to twice that radius, until all is settled or the
    radius exceeds the extent of all points.  Each round's points are stored, so no round repeats another.
    """
    right = right.select(F.col(key).alias("rid"), "x", "y") if other_than_self else right.select(F.lit(None).cast("string").alias("rid"), "x", "y")
    waiting, done, radius = checkpointed(left.select(key, "x", "y")), None, start
    extent = _extent((waiting, ["x"], ["y"]), (right, ["x"], ["y"]))
    while True:
        pairs = near_pairs(waiting, right, radius, closed=True)
        if other_than_self:
            pairs = pairs.filter(F.col("r_rid") != F.col(key))
        found = checkpointed(pairs.groupBy(key).agg(F.min("d").alias("d")))
        done = found if done is None else done.unionByName(found)
        if radius >= extent:
            return left.join(done, key, "left")
        waiting = checkpointed(waiting.join(found, key, "left_anti"))
        if not waiting.limit(1).count():
            return left.join(done, key, "left")
        radius *= 2


def pairs_within(points: DataFrame, distance: float, key: str = "id") -> DataFrame:
    """Unordered pairs (a, b, d) at most ``distance`` apart: each bucket with itself and with four of its eight neighbours."""
    own = _bucketed(points.select(F.col(key).alias("a"), "x", "y"), distance, 0, "x", "y")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    far = own.select(F.col("a").alias("b"), F.col("x").alias("r_x"), F.col("y").alias("r_y"), "_bx", "_by", F.explode(steps).alias("_s"))
    far = far.withColumns({"_bx": F.col("_bx") + F.col("_s.i"), "_by": F.col("_by") + F.col("_s.j"), "_same": (F.col("_s.i") == 0) & (F.col("_s.j") == 0)}).drop("_s")
    pairs = own.join(far.hint("merge"), ["_bx", "_by"]).filter(F.when(F.col("_same"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    pairs = pairs.withColumn("d", F.hypot(F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y"))).filter(F.col("d") <= distance)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")


def single_linkage(points: DataFrame, distance: float, key: str = "id") -> DataFrame:
    """Points with their cluster: the least id that links of at most ``distance`` reach."""
    vertices = points.select(F.col(key).alias("id"))
    return points.join(components(vertices, pairs_within(points, distance, key)).withColumnRenamed("id", key), key)


def overlap_box(rows: DataFrame, by: str) -> DataFrame:
    """The box that the extents of all groups (dates) share: greatest of the least, least of the greatest coordinates."""
    boxes = rows.groupBy(by).agg(F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb"))
    return boxes.agg(F.max("xa").alias("x0"), F.max("ya").alias("y0"), F.min("xb").alias("x1"), F.min("yb").alias("y1"))


def near_clusters(summary: DataFrame, points: DataFrame, margin: float, size: float) -> DataFrame:
    """component and n_near: points inside each cluster's box widened by ``margin``; 0 if there is none."""
    boxes = summary.select("component", (F.col("xa") - margin).alias("x0"), (F.col("ya") - margin).alias("y0"), (F.col("xb") + margin).alias("x1"), (F.col("yb") + margin).alias("y1"))
    seen = covering(points.select("x", "y"), boxes, size).groupBy("component").agg(F.count(F.lit(1)).alias("n_near"))
    return summary.select("component").join(seen, "component", "left").fillna(0, ["n_near"])


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Size and extent of each cluster."""
    out = clustered.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb"))
    return out.withColumn("span", F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")))


def common_cells(clustered: DataFrame, grid: Grid, key: str = "id") -> DataFrame:
    """Grid cells that cover every member of a cluster."""
    n = clustered.groupBy("component").agg(F.count_distinct(key).alias("n"))
    seen = covering_cells(clustered, grid).groupBy("component", "cell").agg(F.count_distinct(key).alias("m"))
    return seen.join(n, "component").filter("m = n").select("component", "cell", "n")


def segments(lines: DataFrame, key: str, points: str = "points") -> DataFrame:
    """Straight pieces (ax, ay, bx, by) of polylines of at least two points."""
    steps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(F.col(points)[i - 1].alias("a"), F.col(points)[i].alias("b")))
    out = lines.filter(F.size(points) >= 2).select(key, F.explode(steps).alias("s"))
    return out.select(key, F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length == 0, 0.0).otherwise(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def _crossed(lines: DataFrame, reach: float) -> DataFrame:
    """Segments with each cell of side ``reach`` (_bx, _by) that may hold a point within ``reach`` of them.

    A column of cells gets those beside the part of the segment that is near the column, not all of its box.
    """
    pad = F.lit(reach) + (F.abs("ax") + F.abs("ay") + F.abs("bx") + F.abs("by")) * 1e-9  # more than rounding moves
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach)))
    out = lines.withColumn("_bx", cells(low - pad, high + pad))
    ends = [F.least(F.greatest(x, low), high) for x in (F.col("_bx") * reach - pad, (F.col("_bx") + 1) * reach + pad)]
    at = [F.col("ay") + (x - F.col("ax")) / (F.col("bx") - F.col("ax")) * (F.col("by") - F.col("ay")) for x in ends]
    steep = high - low <= reach  # no division by next to nothing
    bottom, top = (F.when(steep, f("ay", "by")).otherwise(f(*at)) for f in (F.least, F.greatest))
    return out.withColumn("_by", cells(bottom - pad, top + pad))


def _first_reach(places: DataFrame, lines: DataFrame, start: float) -> float:
    """A reach of at most ``start`` at which segments come about as often, by cell, as places meet them, and most places meet one."""
    row = lines.agg(F.min(F.least("ax", "bx")), F.max(F.greatest("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ay", "by")), F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).first()
    n = places.count()
    if row[0] is None or not n or not row[4]:
        return start
    area = (row[1] - row[0]) * (row[3] - row[2])
    return min(start, max(math.sqrt(5 * area / (3 * n)), 2 * area / row[4]) or start)


def segment_distance(points: DataFrame, lines: DataFrame, start: float, key: str = "id") -> DataFrame:
    """Distance to the nearest segment; null only if there is none.

    Each place and each segment is looked up once, however many rows have it.  Segments are indexed by
    the cells that they pass, widened by a reach that begins at ``start``, or less where there is much
    to compare, and doubles for the places that no segment within it settles.
    """
    waiting, done = checkpointed(points.select("x", "y").filter("x is not null and y is not null").distinct()), None
    lines = checkpointed(lines.select("ax", "ay", "bx", "by").distinct())
    reach = _first_reach(waiting, lines, start)
    extent = _extent((waiting, ["x"], ["y"]), (lines, ["ax", "bx"], ["ay", "by"]))
    while True:
        joined = _bucketed(waiting, reach, 0, "x", "y").join(_crossed(lines, reach).hint("merge"), ["_bx", "_by"])
        d = point_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
        found = checkpointed(joined.select("x", "y", d.alias("d")).filter(F.col("d") <= reach).groupBy("x", "y").agg(F.min("d").alias("d")))
        done = found if done is None else done.unionByName(found)
        if reach < extent:
            waiting = checkpointed(waiting.join(found, ["x", "y"], "left_anti"))
        if reach >= extent or not waiting.limit(1).count():
            return points.join(done, ["x", "y"], "left").select(*points.columns, "d")
        reach *= 2


def draws_away(points: DataFrame, n: int, distance: float, box: tuple[float, float, float, float], seed: str, patience: int = 12, most: int | None = None) -> DataFrame:
    """The first n hashed draws of a box that lie no nearer to any point than ``distance``: id, x, y.

    Draws are made until n have passed, each time as many more as before.  With ``most``, the draws there
    are, those of them that pass are the result, however few; without, after ``patience`` doublings with
    too few the points leave next to no room and ValueError is raised.
    """
    from tesselon.operators.sampling import hashed_points

    places = checkpointed(points.select("x", "y").distinct())
    kept, begin, draws = None, 0, 2 * n
    while True:
        draws = draws if most is None else min(draws, most)
        found = not_within(hashed_points(points.sparkSession, draws, *box, seed).filter(F.col("id") >= begin), places, distance)
        kept = checkpointed((found if kept is None else kept.unionByName(found)).orderBy("id").limit(n))
        patience -= 1
        if draws == most or kept.count() == n:
            return kept
        if most is None and not patience:
            raise ValueError(f"of {draws} draws fewer than {n} lie {distance} from all points")
        begin, draws = draws, 2 * draws


def grid_points(spark, x0: float, y0: float, x1: float, y1: float, spacing: float) -> DataFrame:
    """A systematic grid, half open at the far ends."""
    nx, ny = (max(0, math.ceil((b - a) / spacing - 1e-9)) for a, b in ((x0, x1), (y0, y1)))
    out = spark.range(nx * ny)
    return out.select("id", (F.lit(x0) + (F.col("id") % nx) * spacing).alias("x"), (F.lit(y0) + F.floor(F.col("id") / nx) * spacing).alias("y"))


def tiling(spark, x0: float, y0: float, x1: float, y1: float, tile: int, overlap: int, res: float) -> DataFrame:
    """Overlapping tiles of an area; the last ones end at its edge.  Row 0 is at the top."""
    size, stride = tile * res, (tile - overlap) * res
    nx, ny = (math.ceil((b - a) / stride - 1e-9) for a, b in ((x0, x1), (y0, y1)))
    out = spark.range(nx * ny).select((F.col("id") % nx).alias("c"), F.floor(F.col("id") / nx).alias("r"))
    left, top = F.lit(x0) + F.col("c") * stride, F.lit(y1) - F.col("r") * stride
    return out.select("c", "r", left.alias("left"), F.greatest(top - size, F.lit(y0)).alias("bottom"), F.least(left + size, F.lit(x1)).alias("right"), top.alias("top"))
