"""Coordinates, documents and nested inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions import crs
from tesselon.plans import roles
from tesselon.plans.roles import points_sql, rounded
from tesselon.sinks import documents as docs
from tesselon.sources import tables

query = roles.Registry()
QUERIES, SQL = query.queries, query.sql

_LATLON = "SELECT c_custkey AS id, 46.0::DOUBLE + (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS lat, 8.5::DOUBLE + (c_custkey * 91 % 1000) / 1000.0::DOUBLE AS lon FROM customer"


@query(crs.as_sql(points_sql("customer"), crs.to_wgs84_steps(), "id, round(lat, 8) AS lat, round(lon, 8) AS lon"))
def lv95_to_wgs84(spark, sf_dir):
    return rounded(crs.with_lonlat(roles.points(spark, sf_dir, "customer")).select("id", "lat", "lon"), 8)


@query(crs.as_sql(_LATLON, crs.to_lv95_steps(), "id, round(east, 4) AS east, round(north, 4) AS north"))
def wgs84_to_lv95(spark, sf_dir):
    k = F.col("c_custkey")
    p = roles.table(spark, sf_dir, "customer").select(k.alias("id"), (46.0 + (k * 37 % 1000) / 1000.0).alias("lat"), (8.5 + (k * 91 % 1000) / 1000.0).alias("lon"))
    return rounded(crs.with_lv95(p).select("id", "east", "north"), 4)


@query(f"""SELECT id, '{{"type":"Feature","properties":{{"id":' || id || ',"source":"supplier"}},"geometry":{{"type":"Point","coordinates":[' || round(x, 1) || ',' || round(y, 1) || ']}}}}' AS feature FROM ({points_sql('supplier')})""".replace("|| round(x, 1) ||", "|| CAST(x AS DECIMAL(12,1)) ||").replace("|| round(y, 1) ||", "|| CAST(y AS DECIMAL(12,1)) ||"))
def geojson_emit(spark, sf_dir):
    p = roles.points(spark, sf_dir, "supplier")
    place = F.format_string('{"type":"Feature","properties":%s,"geometry":{"type":"Point","coordinates":[%.1f,%.1f]}}', F.to_json(F.struct("id", F.lit("supplier").alias("source"))), F.col("x"), F.col("y"))
    return p.select("id", place.alias("feature"))


@query(f"""SELECT id, printf('<Placemark><name>%s</name><description>%s</description><Style><IconStyle><color>ff00ffff</color></IconStyle></Style><Point><coordinates>%.8f,%.8f,0</coordinates></Point></Placemark>', 'p&amp;' || id, 'row ' || id, x, y) AS placemark FROM ({points_sql('supplier')})""")
def kml_emit(spark, sf_dir):
    p = roles.points(spark, sf_dir, "supplier")
    return p.select("id", docs.kml_point(F.concat(F.lit("p&"), "id"), F.lit("ff00ffff"), F.col("x"), F.col("y"), F.concat(F.lit("row "), "id")).alias("placemark"))


@query("""SELECT r_regionkey AS id, '<Placemark><name>' || r_name || '</name><Style><LineStyle><color>ff0000ff</color></LineStyle><PolyStyle><color>330000ff</color></PolyStyle></Style><Polygon><outerBoundaryIs><LinearRing><coordinates>' ||
  printf('%.8f,46.00000000,0 %.8f,46.00000000,0 %.8f,46.50000000,0 %.8f,46.00000000,0', r_regionkey::DOUBLE, r_regionkey + 1.0::DOUBLE, r_regionkey + 1.0::DOUBLE, r_regionkey::DOUBLE) || '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' AS placemark FROM region""")
def kml_polygons(spark, sf_dir):
    k = F.col("r_regionkey").cast("double")
    ring = F.array(*[F.struct(a.alias("lon"), F.lit(b).alias("lat")) for a, b in ((k, 46.0), (k + 1, 46.0), (k + 1, 46.5))])
    return roles.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), docs.kml_polygon(F.col("r_name"), F.lit("ff0000ff"), ring).alias("placemark"))


@query("SELECT r_regionkey AS id, printf('POLYGON((%.8f 46.00000000,%.8f 46.00000000,%.8f 47.00000000,%.8f 47.00000000,%.8f 46.00000000))', r_regionkey::DOUBLE, r_regionkey + 1.0::DOUBLE, r_regionkey + 1.0::DOUBLE, r_regionkey::DOUBLE, r_regionkey::DOUBLE) AS wkt FROM region")
def wkt_boxes(spark, sf_dir):
    k = F.col("r_regionkey").cast("double")
    return roles.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), docs.wkt_box(k, F.lit(46.0), k + 1, F.lit(47.0)).alias("wkt"))


@query("WITH a AS (SELECT strftime(ts, '%d') AS year, event_type AS name, 'https://tiles/' || event_id || CASE WHEN event_id % 3 = 0 THEN '.xyz' ELSE '.tif' END AS href FROM events WHERE event_type LIKE '%c%') SELECT year, CAST(count(*) AS INT) AS n, min(href) AS first_href FROM a WHERE href LIKE '%.tif' GROUP BY year")
def stac_assets_by_year(spark, sf_dir):
    e = roles.table(spark, sf_dir, "events")
    href = F.concat(F.lit("https://tiles/"), "event_id", F.when(F.col("event_id") % 3 == 0, ".xyz").otherwise(".tif"))
    items = e.select(F.date_format("ts", "dd").alias("year"), F.create_map("event_type", F.struct(href.alias("href"))).alias("assets"))
    return tables.assets_by_year(items, "c").select("year", F.size("hrefs").alias("n"), F.col("hrefs")[0].alias("first_href"))


@query(f"SELECT id, printf('https://map.geo.admin.ch/?E=%.1f&N=%.1f&zoom=12&bgLayer=ch.swisstopo.swissimage', x, y) AS url FROM ({points_sql('supplier')})")
def review_links(spark, sf_dir):
    p = roles.points(spark, sf_dir, "supplier")
    return p.select("id", docs.page_links(F.col("x"), F.col("y"), F.lit(8.0), F.lit(46.0))[2]["url"].alias("url"))


@query("SELECT page_id, '<div class=\"card\"><h3>' || replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</h3><img src=\"data:image/png;base64,AA==\"/><a href=\"u\">n</a><button data-verdict=\"palm\">palm</button><button data-verdict=\"not_palm\">not_palm</button><button data-verdict=\"unsure\">unsure</button></div>' AS card FROM pages WHERE url IS NOT NULL")
def html_cards(spark, sf_dir):
    links = F.array(F.struct(F.lit("n").alias("name"), F.lit("u").alias("url")))
    return roles.table(spark, sf_dir, "pages").filter("url is not null").select("page_id", docs.html_card(F.col("url"), F.lit("AA=="), links).alias("card"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, CAST(len(json_keys(props)) AS INT) AS n_keys FROM events")
def json_properties(spark, sf_dir):
    m = F.from_json("props", "map<string,string>")
    keys = F.json_object_keys("props")
    return roles.table(spark, sf_dir, "events").select("event_id", F.element_at(m, keys[0]).alias("first_value"), F.size(keys).alias("n_keys"))


@query("SELECT page_id, regexp_extract(url, '([a-z]+)\\.example', 1) AS cell, regexp_extract(url, '/([0-9]+)', 1) AS number, replace(url, 'http://', 'https://') AS renamed, left(url, 8) AS head FROM pages")
def string_keys(spark, sf_dir):
    u = F.col("url")
    return roles.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, r"([a-z]+)\.example", 1).alias("cell"), F.regexp_extract(u, "/([0-9]+)", 1).alias("number"), F.replace(u, F.lit("http://"), F.lit("https://")).alias("renamed"), F.substring(u, 1, 8).alias("head"))
