"""Joins on place, label stores, samples, matching and coordinates."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.functions import crs, grid
from tesselon.operators import evaluation, labels, masking, matching, sampling, spatial, temporal


def points(spark, rows):
    return spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in rows], "id long, x double, y double")


@pytest.fixture(scope="module")
def layers(spark):
    rng = np.random.default_rng(8)
    a = [(i, *p) for i, p in enumerate(rng.uniform(0, 300, (80, 2)))]
    b = [(i, *p) for i, p in enumerate(rng.uniform(0, 300, (30, 2)))]
    return a, b, points(spark, a), points(spark, b)


def test_distance_joins(layers):
    a, b, left, right = layers
    d = {i: min(math.hypot(x - u, y - v) for _, u, v in b) for i, x, y in a}
    assert {r.id for r in spatial.not_within(left, right, 25.0).collect()} == {i for i, v in d.items() if v >= 25}
    assert {r.id for r in spatial.within(left, right, 25.0).collect()} == {i for i, v in d.items() if v < 25}
    for r in spatial.nearest(left, right, 10.0).collect():
        assert r.d == pytest.approx(d[r.id])
    assert spatial.not_within(left, right.limit(0), 25.0).count() == len(a)  # nothing excludes nothing
    assert [r.d for r in spatial.nearest(left.limit(1), right.limit(0), 10.0).collect()] == [None]
    far = points(left.sparkSession, [(1, 0.0, 0.0), (2, 5000.0, 0.0)])
    assert {r.id: r.d for r in spatial.nearest(far, far, 1.0, other_than_self=True).collect()} == {1: 5000.0, 2: 5000.0}


def test_draws_go_on_until_enough_pass(spark):
    held = points(spark, [(i, 10.0 * (i % 10), 10.0 * (i // 10)) for i in range(100)])  # leaves little room
    drawn = spatial.draws_away(held, 15, 6.5, (0.0, 0.0, 100.0, 100.0), "1").collect()
    assert len(drawn) == 15 and all(math.hypot(r.x - 10.0 * (i % 10), r.y - 10.0 * (i // 10)) >= 6.5 for r in drawn for i in range(100))
    with pytest.raises(ValueError, match="draws"):
        spatial.draws_away(held, 15, 60.0, (0.0, 0.0, 90.0, 90.0), "1", patience=2)


def test_pairs_and_chains(spark, layers):
    a, _, left, _ = layers
    want = {(i, j) for (i, x, y), (j, u, v) in itertools.combinations(a, 2) if math.hypot(x - u, y - v) <= 20}
    assert {(r.a, r.b) for r in spatial.pairs_within(left, 20.0).collect()} == want
    chain = points(spark, [(i, 3.9 * i, 0.0) for i in range(20)] + [(50, 200.0, 0.0)])
    found = {r.id: r.component for r in spatial.single_linkage(chain, 4.0).collect()}
    assert found == {**{i: 0 for i in range(20)}, 50: 50}
    s = spatial.cluster_summary(spatial.single_linkage(chain, 4.0)).filter("component = 0").first()
    assert s.n == 20 and s.span == pytest.approx(3.9 * 19)


def test_segments(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]), (2, [(5.0, 5.0)])], "road int, points array<struct<x:double,y:double>>")
    segs = spatial.segments(lines, "road")
    assert segs.count() == 2
    p = points(spark, [(1, 5, 3), (2, 13, 14), (3, 10, 5), (4, 90, 90)])
    got = {r.id: r.d for r in spatial.segment_distance(p, segs, 6.0).collect()}
    assert got[1] == 3 and got[2] == 5 and got[3] == 0 and got[4] == pytest.approx(math.hypot(80, 80))


def test_membership_on_the_edge(spark):
    row = spark.range(1).select(*[f(F.lit(0.0), F.lit(5.0), 0.0, 0.0, 10.0, 10.0).alias(n) for n, f in (("open", grid.within_open), ("half", grid.within_half_open), ("closed", grid.within_closed))]).first()
    assert (row.open, row.half, row.closed) == (False, True, True)


def test_cells_cover_their_points(spark):
    g = grid.Grid()
    rng = np.random.default_rng(1)
    p = points(spark, [(i, g.x0 + x, g.y0 - y) for i, (x, y) in enumerate(rng.uniform(0, 900, (200, 2)))])
    for r in spatial.covering_cells(p, g).collect():
        assert g.x0 + r.c * g.stride <= r.x <= g.x0 + r.c * g.stride + g.size
        assert g.y0 - r.r * g.stride - g.size <= r.y <= g.y0 - r.r * g.stride
    overlap = points(spark, [(1, g.x0 + 95, g.y0 - 95)])
    assert {r.cell for r in spatial.covering_cells(overlap, g).collect()} == {"c000_r000", "c000_r001", "c001_r000", "c001_r001"}


def test_tiling_ends_at_the_area(spark):
    t = spatial.tiling(spark, 0.0, 0.0, 500.0, 500.0, 1024, 128, 0.1).collect()
    assert len(t) == 36 and max(r.right for r in t) == 500 and min(r.bottom for r in t) == 0
    assert min(r.right - r.left for r in t) == pytest.approx(52)


def test_swiss_coordinates(spark):
    # The projection's origin and its published ellipsoidal longitude and latitude on WGS84.
    p = points(spark, [(1, 2600000, 1200000), (2, 2720000, 1117000), (3, 2500000, 1100000)])
    out = crs.with_lonlat(p)
    first = out.filter("id = 1").first()
    assert first.lat == pytest.approx(46.951083, abs=2e-6) and first.lon == pytest.approx(7.438632, abs=2e-6)
    for r in crs.with_lv95(out).collect():
        assert (r.east, r.north) == pytest.approx((r.x, r.y), abs=0.02)


def test_label_stores(spark):
    rows = spark.createDataFrame([("b", 1, 0.04, 0.0), ("a", 2, 0.01, 0.0), ("a", 3, 9.0, 9.0)], "source string, id int, x double, y double")
    assert {r.id for r in labels.first_wins(rows, 1, [F.col("source"), F.col("id")]).collect()} == {2, 3}
    done = spark.createDataFrame([(9.0004, 9.0, "m1")], "x double, y double, model string")
    assert {r.id for r in labels.not_done(rows, done).collect()} == {1, 2}
    v = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 6.0, "palm"), (2, 1.0, 1.0, 5.0, 6.0, "not_palm"), (3, 1.0, 1.0, 5.0, 6.0, "unsure")], "index int, x double, y double, corrected_x double, corrected_y double, verdict string")
    assert sorted((r["index"], r.label, r.x) for r in labels.route_verdicts(v).collect()) == [(1, 1, 5.0), (2, 0, 1.0)]


def cheapest(edges):
    """(pairs, total distance) of the best matching, by trying all."""
    lefts, near = sorted({e[0] for e in edges}), {(a, b): d for a, b, d in edges}
    rights, found = sorted({e[1] for e in edges}), [(0, 0.0)]

    def go(i, used, n, total):
        if i == len(lefts):
            found[0] = max(found[0], (n, total), key=lambda f: (f[0], -f[1]))
            return
        go(i + 1, used, n, total)
        for r in rights:
            if r not in used and (lefts[i], r) in near:
                go(i + 1, used | {r}, n + 1, total + near[lefts[i], r])

    go(0, frozenset(), 0, 0.0)
    return found[0]


def test_matching_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for k in range(300):
        a, b = rng.random((int(rng.integers(1, 7)), 2)) * 4, rng.random((int(rng.integers(1, 7)), 2)) * 4
        if k % 3 == 0:
            a, b = a.round(), b.round()  # ties
        d = np.hypot(a[:, None, 0] - b[:, 0], a[:, None, 1] - b[:, 1])
        edges = [(i, j, float(d[i, j])) for i, j in zip(*np.nonzero(d <= rng.choice([0.8, 1.5, 2.5])), strict=True)]
        got = matching.match(edges)
        assert len({x for x, _, _ in got}) == len({y for _, y, _ in got}) == len(got)
        n, total = cheapest(edges)
        assert (len(got), sum(x[2] for x in got)) == (n, pytest.approx(total))


def test_chain_matches_every_point():
    edges = [e for i in range(1100) for e in ((i, i, 1.0), (i, i - 1, 0.9)) if e[1] >= 0]
    assert len(matching.match(edges)) == 1100


def test_matches_of_cells(spark):
    schema = "cell long, id long, x double, y double"
    found = spark.createDataFrame([(1, 0, 1.0, 0.0), (2, 0, 0.0, 0.0), (2, 1, 1.0, 0.0), (3, 0, 5.0, 5.0)], schema)
    true = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0), (2, 0, 1.0, 0.0), (2, 1, 2.0, 0.0), (4, 0, 5.0, 5.0)], schema)
    assert matching.match_by_cell(found, true, 1.5).groupBy("cell").count().collect() and matching.match([]) == []
    pairs = sorted((r.cell, r.found_id, r.true_id) for r in matching.match_by_cell(found, true, 1.1).collect() if r.cell == 2)
    assert pairs == [(2, 0, 0), (2, 1, 1)]  # most matches, though (1, 0) alone is nearer
    assert matching.match_by_cell(found, true, 1.5).filter("cell = 1").count() == 1


def test_temporal_statistics(spark):
    rows = spark.createDataFrame([(1, 0.6), (1, 0.8), (2, 0.5)], "point int, ndvi double")
    got = {r.point: (r.ndvi_std, r.ndvi_range, r.n_dates) for r in temporal.stability(rows, ["point"], ["ndvi"]).collect()}
    assert got[1] == pytest.approx((0.1, 0.2, 2)) and got[2] == (0.0, 0.0, 1)
    twice = temporal.stability(rows.union(rows), ["point"], ["ndvi"]).filter("point = 1").first()
    assert twice.ndvi_std == pytest.approx(0.1) and twice.n_dates == 4


def test_histogram_bins(spark):
    rows = spark.createDataFrame([(p,) for p in (0.0, 0.1, 0.999, 1.0)], "p double")
    assert {r.bin: r.n for r in evaluation.histogram(rows, "p").collect()} == {0: 1, 1: 1, 9: 2}


def test_auc_with_ties(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (0, 0.5)]
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in rows if y for z, b in rows if not z]
    got = evaluation.roc_auc(spark.createDataFrame(rows, "y int, p double").withColumn("g", F.lit(1)), ["g"], F.col("y"), "p").first()
    assert got.auc == pytest.approx(np.mean(pairs))


def test_masks_and_patches(spark):
    px = spark.range(64).select(F.lit(1).alias("cell"), F.floor(F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    back = masking.unpatchify(masking.patchify(px, 2, 8), 2, 8)
    assert back.select("row", "col", "v").exceptAll(px.select("row", "col", "v")).count() == 0
    patches = masking.patchify(px, 2, 8).select("cell", "patch").distinct()
    assert masking.random_mask(patches, 16, 0.75, "s").filter("masked = 0").count() == 4


def test_even_ranks_and_folds(spark):
    assert sampling.even_ranks(10, 4) == sorted({round(i * 3) for i in range(4)}) and sampling.even_ranks(2, 5) == [0, 1] and sampling.even_ranks(0, 3) == []
    rows = spark.range(23).withColumn("g", F.lit(0))
    sizes = sampling.round_robin(rows, ["g"], F.col("id").cast("string"), 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [4, 4, 5, 5, 5]


def test_coordinates_agree_with_the_published_approximation(spark):
    """The survey's polynomials for LV95 are good to about a tenth of a second; its worked example is E 2 700 000, N 1 100 000."""
    from tesselon.functions import crs

    rows = [(i, 2_500_000.0 + 37_000 * i, 1_080_000.0 + 21_000 * (i % 9)) for i in range(9)] + [(99, 2_700_000.0, 1_100_000.0)]
    for r in crs.with_lonlat(points(spark, rows)).collect():
        y, x = (r.x - 2_600_000) / 1e6, (r.y - 1_200_000) / 1e6
        lon = (2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y**3) * 100 / 36
        lat = (16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x**3) * 100 / 36
        assert abs(r.lon - lon) < 0.16 / 3600 and abs(r.lat - lat) < 0.12 / 3600
        if r.id == 99:
            assert abs(r.lon - (8 + 43 / 60 + 49.80 / 3600)) < 0.05 / 3600 and abs(r.lat - (46 + 2 / 60 + 38.86 / 3600)) < 0.05 / 3600


def test_near_pairs_are_never_broadcast(layers):
    """A side that is small as a file comes nine times: 8 million rows of a 9 MB file filled the driver."""
    _, _, left, right = layers
    plan = spatial.near_pairs(left, right, 20.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pairs_of_repeated_places(spark):
    """Each pair once, whichever neighbouring bucket holds its other end; no broadcast, as every row comes five times."""
    rng = np.random.default_rng(3)
    rows = [(int(i), *p) for i, p in zip(rng.permutation(150), [*rng.uniform(-60, 60, (120, 2)).round(), *[(20.0, -20.0)] * 30], strict=True)]
    want = sorted((min(i, j), max(i, j), math.hypot(x - u, y - v)) for (i, x, y), (j, u, v) in itertools.combinations(rows, 2) if math.hypot(x - u, y - v) <= 20)
    found = spatial.pairs_within(points(spark, rows), 20.0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in found.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_segments_are_indexed_by_the_cells_they_pass(spark):
    """Long slanted segments took every cell of their boxes, 169 of 100 m for one over a square kilometre."""
    rng = np.random.default_rng(5)
    ends = np.concatenate([rng.uniform(0, 1000, (40, 4)), np.array([[500.0, 0, 500, 1000], [0, 300, 1000, 300], [7, 7, 7, 7], [500, 0, 500.001, 900]])]) + 2.7e6
    held = [[float(v) for v in e] for e in [*ends, *ends[:5]]]
    segs = spark.createDataFrame(held, "ax double, ay double, bx double, by double")
    assert spatial._crossed(segs.limit(1).selectExpr("0D AS ax", "0D AS ay", "1000D AS bx", "1000D AS by"), 100.0).count() <= 90
    places = rng.uniform(-200, 1200, (150, 2)) + 2.7e6
    rows = [(i, *p) for i, p in enumerate([*places, *places[:20]])]

    def distance(x, y):
        out = []
        for ax, ay, bx, by in held:
            length = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length, 0), 1) if length else 0
            out.append(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return min(out)

    for start in (3.0, 150.0):
        got = {r.id: r.d for r in spatial.segment_distance(points(spark, rows), segs, start).collect()}
        assert len(got) == 170 and all(got[i] == pytest.approx(distance(x, y), abs=1e-6) for i, x, y in rows)


def test_draws_without_room_end(spark):
    """Of a given number of draws those that pass are the result: none where points fill the box, an error before."""
    held = points(spark, [(i, 10.0 * (i % 10), 10.0 * (i // 10)) for i in range(100)])
    assert spatial.draws_away(held, 15, 60.0, (0.0, 0.0, 90.0, 90.0), "1", most=500).count() == 0
    some = spatial.draws_away(held, 15, 6.5, (0.0, 0.0, 100.0, 100.0), "1", most=100).collect()
    every = spatial.draws_away(held, 15, 6.5, (0.0, 0.0, 100.0, 100.0), "1").collect()
    assert 0 < len(some) < 15 and sorted(some) == sorted(every)[: len(some)] and max(r.id for r in some) < 100
