"""Grid scoring, dense surfaces and the files they end in; vector files and configurations."""

import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import features, focal, labels, raster, scoring, spatial
from tesselon.sinks import documents
from tesselon.sources import config, tables, tiff, vector_files

TILES = "cell string, date int, x0 double, y0 double, x1 double, y1 double, res double, height int, width int"


@pytest.fixture(scope="module")
def tiles(spark):
    return spark.createDataFrame([("a", 1, 0.0, 0.0, 4.0, 4.0, 1.0, 4, 4), ("a", 2, 0.0, 0.0, 4.0, 4.0, 1.0, 4, 4), ("b", 1, 3.0, 0.0, 7.0, 4.0, 1.0, 4, 4)], TILES)


@pytest.fixture(scope="module")
def px(spark):
    rows = [(cell, date, r, c, float(10 * date + r * 4 + c) * (0.0 if (cell, date, r, c) == ("a", 2, 1, 1) else 1.0)) for cell, date in (("a", 1), ("a", 2), ("b", 1)) for r in range(4) for c in range(4)]
    return spark.createDataFrame(rows, "cell string, date int, row int, col int, v double")


def test_grid_leaves_out_edges_and_reviewed_places(spark, tiles):
    places = {(r.x, r.y) for r in scoring.grid_locations(tiles, 1.0).collect()}
    assert places == {(float(x), float(y)) for x in range(1, 7) for y in range(1, 4)}
    near = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    kept = {(r.x, r.y) for r in scoring.grid_locations(tiles, 1.0, near, 1.5).collect()}
    assert places - kept == {(1.0, 1.0), (2.0, 1.0), (1.0, 2.0), (2.0, 2.0)}
    assert scoring.grid_locations(tiles.limit(0), 1.0).count() == 0


def test_covering_finds_boxes_of_any_size(spark, tiles):
    p = spark.createDataFrame([(1, 3.5, 2.0), (2, 0.0, 2.0), (3, 6.9, 3.9)], "id int, x double, y double")
    for size in (0.7, 4.0, 50.0):
        got = sorted((r.id, r.cell, r.date) for r in spatial.covering(p, tiles, size).collect())
        assert got == [(1, "a", 1), (1, "a", 2), (1, "b", 1), (3, "b", 1)]


def test_location_features_take_the_newest_date_with_data(spark, tiles, px):
    p = spark.createDataFrame([(1, 1.5, 2.5), (2, 0.5, 3.5), (3, 9.0, 9.0)], "id int, x double, y double")
    windows = features.band_windows(px, ["v"], (1,), ("cell", "date"))
    got = {r.id: r for r in scoring.location_features(p, tiles, windows, F.col("v") != 0, ["v_point"], 4.0).collect()}
    assert set(got) == {1, 2}
    assert (got[1].date, got[1].v_point, got[1].n_dates, got[1].v_point_range) == (1, 15.0, 1, 0.0)
    assert (got[2].date, got[2].v_point, got[2].n_dates, got[2].v_point_std, got[2].v_point_range) == (2, 20.0, 2, 5.0, 10.0)


def test_band_windows_equal_the_single_ones(spark, px):
    got = features.band_windows(px.withColumn("w", F.col("v") * 2), ["v", "w"], (1, 2), ("cell", "date"))
    one = px.filter("cell = 'a' and date = 2")
    for r in (1, 2):
        want = {(x.row, x.col): (x.mean, x.std) for x in focal.mean_std(one, r).collect()}
        ends = {(x.row, x.col): (x.hi, x.lo) for x in focal.minmax(one, r).collect()}
        for x in got.filter("cell = 'a' and date = 2").collect():
            assert (x[f"v_mean_{r}"], x[f"v_std_{r}"]) == pytest.approx(want[x.row, x.col])
            assert (x[f"v_max_{r}"], x[f"v_min_{r}"]) == ends[x.row, x.col] and x[f"w_mean_{r}"] == pytest.approx(2 * x[f"v_mean_{r}"])


def test_prior_results_are_kept_and_not_scored_again(spark):
    places = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "id int, x double, y double")
    prior = spark.createDataFrame([(1.0001, 2.0, "t", 0.5)], "x double, y double, tile string, predicted_prob double")
    assert [r.id for r in labels.not_done(places, prior).collect()] == [2]


def test_scored_geojson_is_whole_and_ordered(spark, tmp_path):
    path = str(tmp_path / "out" / "scores.geojson")
    rows = spark.range(500).select((F.col("id") * 1.0).alias("x"), F.lit(2.0).alias("y"), F.concat(F.lit('t"'), "id").alias("tile"), ((F.col("id") * 37 % 500) / 500).alias("predicted_prob")).repartition(7)
    for _ in range(2):
        assert documents.write_scored_geojson(rows, path) == 500
    text = json.load(open(path))
    probs = [f["properties"]["predicted_prob"] for f in text["features"]]
    assert len(probs) == 500 and probs == sorted(probs, reverse=True) and [p.name for p in (tmp_path / "out").iterdir()] == ["scores.geojson"]
    assert tables.geojson_points(spark, path).count() == 500
    assert documents.write_scored_geojson(rows.limit(0), path) == 0 and json.load(open(path))["features"] == []


def test_surfaces_become_rasters(spark, tiles, tmp_path):
    tiff.register(spark)
    surface = spark.createDataFrame([("a", r, c, None if r == c else (r * 4 + c) / 16) for r in range(4) for c in range(4)], "cell string, row int, col int, prob double")
    scoring.rasters(surface, tiles).write.format("tesselon_tiff").option("nodata", "nan").mode("append").save(str(tmp_path / "dense"))
    a, place = tiff.decode((tmp_path / "dense" / "a_prob.tif").read_bytes())
    assert a.shape == (1, 4, 4) and np.isnan(np.diag(a[0])).all() and a[0, 1, 2] == 6 / 16 and a.dtype == np.float32
    assert (place["x0"], place["y0"], place["res"], place["nodata"]) == (0.0, 4.0, 1.0, "nan")


def test_geopackage_points(spark, tmp_path):
    path = tmp_path / "o.gpkg"
    with sqlite3.connect(path) as base:
        base.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        base.execute("INSERT INTO gpkg_geometry_columns VALUES ('palms', 'geom')")
        base.execute("CREATE TABLE palms (fid INTEGER PRIMARY KEY, geom BLOB, species TEXT)")
        plain = b"GP\0\1" + struct.pack("<i", 2056) + struct.pack("<BIdd", 1, 1, 9.0, 46.0)
        boxed = b"GP\0\3" + struct.pack("<i", 2056) + struct.pack("<4d", 1, 1, 2, 2) + struct.pack(">BIdd", 0, 1, 8.5, 46.5)
        line = b"GP\0\1" + struct.pack("<i", 2056) + struct.pack("<BII", 1, 2, 0)
        empty = b"GP\0\1" + struct.pack("<i", 2056) + struct.pack("<BIdd", 1, 1, float("nan"), float("nan"))
        base.executemany("INSERT INTO palms (geom, species) VALUES (?, ?)", [(plain, "a"), (boxed, None), (line, "c"), (None, "d"), (empty, "e")])
    rows = vector_files.vector_points(spark, str(path)).orderBy("x").collect()
    assert [(r.x, r.y, r.attributes["species"]) for r in rows] == [(8.5, 46.5, None), (9.0, 46.0, "a")]
    with pytest.raises(Exception, match="no layer"):
        vector_files.vector_points(spark, str(path), "others").collect()


def test_shapefile_points(spark, tmp_path):
    records = [struct.pack("<idd", 1, 9.0, 46.0), struct.pack("<i", 0), struct.pack("<idd", 1, 8.0, 45.0)]
    body = b"".join(struct.pack(">ii", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    (tmp_path / "o.shp").write_bytes(struct.pack(">i", 9994) + b"\0" * 96 + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14
    (tmp_path / "o.dbf").write_bytes(struct.pack("<BBBBIHH", 3, 0, 0, 0, 3, 65, 5) + b"\0" * 20 + field + b"\r" + b" one  two   \xc3\xa9 ")
    rows = vector_files.vector_points(spark, str(tmp_path / "o.shp")).orderBy("x").collect()
    assert [(r.x, r.y, r.attributes["NAME"]) for r in rows] == [(8.0, 45.0, "é"), (9.0, 46.0, "one")]
    assert {(r.lon, r.lat) for r in tables.occurrences(spark, str(tmp_path / "o.shp")).collect()} == {(8.0, 45.0), (9.0, 46.0)}
    with pytest.raises(ValueError):
        vector_files.vector_points(spark, "a.txt")


def test_configuration(tmp_path):
    text = """# run
aoi:
  name: "here # there"   # a comment
  bbox_lv95: [2718000, 1115000, 2718500.5, 1115500]
  crs: 'EPSG:2056'
imagery:
  years: [2018, 2021]
  res_m: 0.10
  tile_overlap_px: 64
  max_tiles: null
  dates:
    - "20210324"
    - 20230601
  flags: {deep: false, seeds: [1, 2]}
paths:
seed: 42
"""
    (tmp_path / "c.yaml").write_text(text)
    c = config.load_config(str(tmp_path / "c.yaml"))
    assert c["imagery"] == {"years": [2018, 2021], "res_m": 0.1, "tile_overlap_px": 64, "max_tiles": None, "dates": ["20210324", 20230601], "flags": {"deep": False, "seeds": [1, 2]}}
    assert c["seed"] == 42 and c["paths"] is None and config.parse("") == {}
    a = config.area(c)
    assert (a.name, a.bbox, a.overlap_px, a.tile_size_px, a.res_m) == ("here # there", (2718000.0, 1115000.0, 2718500.5, 1115500.0), 64, 1024, 0.1)
    for bad in ("a: 1\n   b: 2", "a:\n  - 1\n  b: 2", "just text"):
        with pytest.raises(ValueError):
            config.parse(bad)
    c["aoi"]["crs"] = "EPSG:4326"
    with pytest.raises(ValueError):
        config.area(c)


def test_cut_tiles_overlap_and_skip_empty_ones(spark):
    px = spark.createDataFrame([(r, c, 0.0 if c >= 6 else float(r * 10 + c + 1)) for r in range(7) for c in range(10)], "row int, col int, v double")
    got = raster.cut_tiles(px, 4, 1)
    tiles = {}
    for t in got.collect():
        tiles.setdefault((t.r, t.c), {})[t.row, t.col] = t.v
    assert set(tiles) == {(r, c) for r in (0, 1, 2) for c in (0, 1)}
    assert tiles[0, 1] == {(r, c - 3): (0.0 if c >= 6 else r * 10 + c + 1.0) for r in range(4) for c in range(3, 7)}
    assert set(tiles[2, 0]) == {(0, c) for c in range(4)}
    assert {(t.r, t.c) for t in raster.cut_tiles(px, 4, 1, most=3).select("r", "c").collect()} == {(0, 0), (0, 1), (1, 0)}


def test_backdrop_wants_equal_shapes(spark):
    rgb = spark.createDataFrame([("a", r, c, float(r + c), 1.0, 2.0) for r in range(3) for c in range(3)], "cell string, row int, col int, r double, g double, b double")
    surface = rgb.select("cell", "row", "col", (F.col("r") * 2).alias("prob"))
    rows = raster.backdrop(rgb, surface, ["r", "g", "b"]).collect()
    assert len(rows) == 9 and all(0 <= x.r <= 1 and x.prob == 2 * (x.row + x.col) for x in rows)
    with pytest.raises(Exception, match="shape"):
        raster.backdrop(rgb, surface.filter("col < 2"), ["r", "g", "b"]).collect()
