"""Codecs, readers, writers and streams."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.sinks import documents
from tesselon.sources import tables, tiff
from tesselon.streaming import flows


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "f4", "f8"])
@pytest.mark.parametrize("shape", [(1, 5, 7), (6, 130, 33)])
def test_tiff_round_trip(dtype, shape):
    a = np.random.default_rng(1).integers(0, 200, shape).astype(dtype)
    out, place = tiff.decode(tiff.encode(a, 2715098.0, 1120181.0, 0.1, nodata="nan"))
    assert (out == a).all() and out.dtype == np.dtype(dtype)
    assert (place["x0"], place["y0"], place["res"], place["epsg"], place["nodata"]) == (2715098.0, 1120181.0, 0.1, 2056, "nan")


def test_tiff_source_and_writer(spark, tmp_path):
    tiff.register(spark)
    folder = tmp_path / "feature_stack_rs_20230601"
    folder.mkdir()
    bands = np.random.default_rng(2).random((6, 8, 9)).astype(np.float32)
    for cell in ("c001_r002", "c000_r000"):
        (folder / f"aoi_2023_{cell}_nirchm.tif").write_bytes(tiff.encode(bands, 10.0, 20.0, 0.5))
    (folder / "aoi_2023_c000_r000_rgbchm.tif").write_bytes(tiff.encode(bands[:4], 10.0, 20.0, 0.5))
    read = spark.read.format("tesselon_tiff").option("suffix", "_nirchm.tif").option("bands", 6).option("epsg", 2056)
    rows = read.load(str(folder)).collect()
    assert [(r.cell, r.date, r.height, r.width) for r in sorted(rows)] == [("c000_r000", "20230601", 8, 9), ("c001_r002", "20230601", 8, 9)]
    assert np.allclose(np.array(rows[0].bands).reshape(6, 8, 9), bands)
    meta = spark.read.format("tesselon_tiff").option("metaonly", "true").load(str(folder))
    assert meta.filter("bands is null").count() == 3 and tables.delivery(meta).first().tiles == 3
    out = tmp_path / "out"
    read.load(str(folder)).write.format("tesselon_tiff").mode("append").save(str(out))
    assert (tiff.decode((out / "aoi_2023_c001_r002_nirchm.tif").read_bytes())[0] == bands).all()
    with pytest.raises(Exception, match="bands"):
        spark.read.format("tesselon_tiff").option("bands", 6).load(str(folder)).collect()


def test_unsupported_tiff():
    with pytest.raises(KeyError):
        tiff.decode(b"not a tiff")
    assert zlib  # the only codec it needs


def test_geojson_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(2, 2715100.126, 1120000.0, "x"), (1, 2715101.5, 1120001.0, "y")], "id int, x double, y double, note string")
    rows = p.select("id", documents.point_feature(F.col("x"), F.col("y"), F.struct("id", "note")).alias("feature"))
    path = str(tmp_path / "labels" / "a.geojson")
    documents.write_document(documents.feature_collection(rows, "a", order="id"), path)
    text = json.load(open(path))
    assert text["crs"]["properties"]["name"].endswith("2056") and [f["properties"]["id"] for f in text["features"]] == [1, 2]
    back = tables.geojson_points(spark, path).orderBy("id").collect()
    assert [(r.id, r.x, r.note) for r in back] == [(1, 2715101.5, "y"), (2, 2715100.13, "x")]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"extra": 5}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}]}))
    both = tables.ragged_points(spark, [path, str(tmp_path / "b.geojson")])
    assert both.count() == 3 and both.filter("extra = 5 and note is null and file_order = 1").count() == 1


def test_kml_round_trip(spark, tmp_path):
    marks = spark.createDataFrame([(1, 9.0, 46.0), (2, 9.5, 46.5)], "id int, lon double, lat double")
    marks = marks.select("id", documents.kml_point(F.concat(F.lit("a&<"), "id"), F.lit("ff00ff00"), F.col("lon"), F.col("lat"), F.lit("")).alias("placemark"))
    path = tmp_path / "a.kml"
    documents.write_document(documents.kml_document(marks, "doc", order="id"), str(path))
    rows = tables.kml_points(spark, [str(path)]).orderBy("lon").collect()
    assert [(r.folder, r.name, r.lon, r.lat) for r in rows] == [(None, "a&<1", 9.0, 46.0), (None, "a&<2", 9.5, 46.5)]
    nested = tmp_path / "b.kml"
    nested.write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>Out</name><Folder><name>In</name><Placemark><name>p</name><Point><coordinates>1,2,0</coordinates></Point></Placemark></Folder></Folder></Document></kml>')
    assert tables.kml_points(spark, [str(nested)]).first().folder == "In"


def test_tabular_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("rs_20230601, c000_r001\n\nno comma\nrs_20230701,c002_r002\n")
    assert [tuple(r) for r in tables.manifest(spark, str(tmp_path / "m.csv")).collect()] == [("rs_20230601", "c000_r001"), ("rs_20230701", "c002_r002")]
    (tmp_path / "v.csv").write_text("index,tile,x,y,corrected_x,corrected_y,predicted_prob,verdict\n1,t,1,2,3,4,0.5,palm\n")
    assert tables.verdicts(spark, str(tmp_path / "v.csv")).first().corrected_y == 4.0
    (tmp_path / "w.csv").write_text("index,verdict\n1,palm\n")
    with pytest.raises(ValueError, match="corrected_x"):
        tables.verdicts(spark, str(tmp_path / "w.csv"))
    (tmp_path / "o.csv").write_text("Species,decimalLongitude,DecimalLatitude\nx,9.0,46.0\ny,,46.1\n")
    assert tables.occurrences(spark, str(tmp_path / "o.csv")).count() == 1
    (tmp_path / "f.csv").write_text("point_id,label,fold_tile,x,y,chm_mean_r1.0,chm_skew_r3.0,n_dates_covered\np,1,t,0,0,0.5,0.1,3\n")
    table = tables.feature_table(spark, str(tmp_path / "f.csv"))
    assert tables.feature_columns(table) == ["chm_mean_r1.0", "chm_skew_r3.0"] and tables.ablated(table, True, True).columns == ["point_id", "label", "fold_tile", "x", "y", "n_dates_covered"]


def test_service_pages(spark, tmp_path):
    pages = [{"offset": 0, "endOfRecords": False, "results": [{"key": 1, "species": "a", "year": 2020, "coordinateUncertaintyInMeters": 5.0, "basisOfRecord": "H", "decimalLongitude": 9.0, "decimalLatitude": 46.0}]}, {"offset": 300, "endOfRecords": True, "results": [{"key": 2, "species": "a", "year": 2021, "coordinateUncertaintyInMeters": 5.0, "basisOfRecord": "H", "decimalLongitude": None, "decimalLatitude": 46.0}]}]
    for i, p in enumerate(pages):
        (tmp_path / f"p{i}.json").write_text(json.dumps(p))
    assert [r.gbifID for r in tables.occurrence_pages(spark, str(tmp_path / "p*.json")).collect()] == ["1"]
    (tmp_path / "c.json").write_text(json.dumps({"features": [{"id": "i", "properties": {"datetime": "2021-05-01"}, "assets": {"a_0.1_2056.tif": {"href": "u/a_0.1.tif"}, "b_2_2056.tif": {"href": "u/b.tif"}, "a_0.1.xyz": {"href": "u/x.xyz"}}}]}))
    got = tables.assets_by_year(tables.catalogue_items(spark, str(tmp_path / "c.json")), "_0.1_").collect()
    assert [(r.year, r.hrefs) for r in got] == [("2021", ["u/a_0.1.tif"])]
    (tmp_path / "r.json").write_text(json.dumps({"elements": [{"type": "way", "id": 1, "tags": {"highway": "path"}, "geometry": [{"lon": 9.0, "lat": 46.0}, {"lon": 9.1, "lat": 46.0}]}, {"type": "way", "id": 2, "tags": {"highway": "path"}, "geometry": [{"lon": 9.0, "lat": 46.0}]}, {"type": "node", "id": 3}]}))
    assert [r.id for r in tables.roads(spark, str(tmp_path / "r.json")).collect()] == [1]


def test_append_is_idempotent_with_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "store")
    for _ in range(2):
        documents.append_labels(rows, path, ["id"])
    assert spark.read.parquet(path).count() == 2
    documents.append_labels(rows, path)
    assert spark.read.parquet(path).count() == 4


def test_stream_resumes(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("events.parquet", "out", "log"))
    spark.createDataFrame([(1, 2.0)], "id int, v double").write.parquet(source)
    for _ in range(2):
        flows.run_available(flows.file_stream(spark, str(tmp_path), "events"), out, log)
    spark.createDataFrame([(2, 3.0)], "id int, v double").write.mode("append").parquet(source)
    flows.run_available(flows.file_stream(spark, str(tmp_path), "events"), out, log)
    assert sorted(r.id for r in spark.read.parquet(out).select("id").collect()) == [1, 2]


def test_area_config_checks_its_system():
    with pytest.raises(ValueError):
        tables.AreaConfig("x", crs="EPSG:4326")
