"""Label stores, shortlists and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions.grid import Grid
from tesselon.operators import labels, sampling, spatial, temporal
from tesselon.plans import roles
from tesselon.plans.roles import CANDIDATES, OBSERVATIONS, X0, Y0, points_sql, rounded

query = roles.Registry()
QUERIES, SQL = query.queries, query.sql

_SHORT = "SELECT c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 END AS dist, c_nationkey % 2 = 0 AS nir_available, c_nationkey FROM customer"


def _shortlist(spark, sf_dir):
    c = roles.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100).alias("dist"), (F.col("c_nationkey") % 2 == 0).alias("nir_available"), "c_nationkey")


_PRIORITY = f"SELECT *, coalesce(dist <= 25, false) AS near_road, CAST(NOT coalesce(dist <= 25, false) AS INT) + CAST(NOT nir_available AS INT) AS priority FROM ({_SHORT})"


@query(f"SELECT id, near_road, nir_available, priority, round(dist, 6) AS dist FROM ({_PRIORITY}) ORDER BY priority, dist NULLS LAST, id LIMIT 60")
def priority_rank(spark, sf_dir):
    out = labels.prioritised(_shortlist(spark, sf_dir), 25.0).orderBy("priority", F.asc_nulls_last("dist"), "id").limit(60)
    return rounded(out.select("id", "near_road", "nir_available", "priority", "dist"))


@query(f"WITH s AS (SELECT id, priority FROM ({_PRIORITY}) WHERE priority = 0), o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT id, priority, n FROM o RIGHT JOIN s ON o_custkey = id")
def right_join_shortlist(spark, sf_dir):
    s = labels.prioritised(_shortlist(spark, sf_dir), 25.0).filter("priority = 0").select("id", "priority")
    o = roles.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return o.join(s, "id", "right").select("id", "priority", "n")


@query(f"SELECT number, id, round(prob, 6) AS prob FROM (SELECT row_number() OVER (ORDER BY prob DESC, id) AS number, id, prob FROM ({CANDIDATES}) WHERE prob >= 0.2) WHERE number BETWEEN 21 AND 40")
def offset_limit_page(spark, sf_dir):
    """Rows 21 to 40 by probability: the sort keeps 40 rows a task, only those are numbered."""
    from pyspark.sql import Window

    best = roles.candidates(spark, sf_dir).filter("prob >= 0.2").orderBy(F.desc("prob"), "id").limit(40)
    numbered = best.withColumn("number", F.row_number().over(Window.orderBy(F.desc("prob"), "id")).cast("long"))
    return rounded(numbered.filter("number > 20").select("number", "id", "prob"))


@query(f"SELECT tile, id FROM (SELECT tile, id, row_number() OVER (PARTITION BY tile ORDER BY md5('7_' || id), '7_' || id) AS n FROM ({CANDIDATES})) WHERE n <= 5")
def topk_per_tile(spark, sf_dir):
    return temporal.capped(roles.candidates(spark, sf_dir), ["tile"], F.concat_ws("_", F.lit("7"), "id"), 5).select("tile", "id")


@query("WITH r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT id, i FROM r WHERE i IN (SELECT CAST(round_even(k * (n - 1) / 6.0, 0) AS BIGINT) FROM (SELECT unnest(range(0, 7)) AS k), (SELECT any_value(n) AS n FROM r))")
def even_rank_sample(spark, sf_dir):
    from pyspark.sql import Window

    part = roles.table(spark, sf_dir, "part")
    ranked = part.select(F.col("p_partkey").alias("id"), (F.row_number().over(Window.orderBy("p_retailprice", "p_partkey")) - 1).cast("long").alias("i"))
    return ranked.filter(F.col("i").isin(sampling.even_ranks(part.count(), 7)))


@query(f"SELECT id FROM ({CANDIDATES}) ORDER BY md5('9_' || id) LIMIT 100")
def seeded_subsample(spark, sf_dir):
    return sampling.subsample(roles.candidates(spark, sf_dir).select("id"), F.concat_ws("_", F.lit("9"), "id"), 100)


@query(f"SELECT id, fold FROM (SELECT id, (row_number() OVER (PARTITION BY label ORDER BY md5('7_' || id), '7_' || id) - 1) % 5 AS fold FROM ({CANDIDATES}))")
def roundrobin_folds(spark, sf_dir):
    return sampling.round_robin(roles.candidates(spark, sf_dir), ["label"], F.concat_ws("_", F.lit("7"), "id"), 5).select("id", F.col("fold").cast("long"))


_LAYERS = f"SELECT 'customer' AS source, id, x, y, NULL AS note FROM ({points_sql('customer')}) UNION ALL SELECT 'supplier', id, x, y, NULL FROM ({points_sql('supplier')}) UNION ALL SELECT 'part', id, x, y, 'reviewed' FROM ({points_sql('part')})"


def _layers(spark, sf_dir):
    named = [roles.points(spark, sf_dir, n).withColumn("source", F.lit(n)) for n in ("customer", "supplier", "part")]
    return labels.union_layers(named[0], named[1], named[2].withColumn("note", F.lit("reviewed")))


@query(f"SELECT source, note, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM ({_LAYERS}) GROUP BY source, note")
def union_labels(spark, sf_dir):
    return rounded(_layers(spark, sf_dir).groupBy("source", "note").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")), 4)


@query(f"SELECT DISTINCT round(x, 6) AS x, round(y, 6) AS y FROM ({_LAYERS})")
def dedup_exact(spark, sf_dir):
    return rounded(_layers(spark, sf_dir).select("x", "y").dropDuplicates(["x", "y"]))


@query(f"SELECT source, id FROM (SELECT *, row_number() OVER (PARTITION BY round_even(x, -1), round_even(y, -1) ORDER BY source, id) AS n FROM ({_LAYERS})) WHERE n = 1")
def dedup_rounded_first_wins(spark, sf_dir):
    return labels.first_wins(_layers(spark, sf_dir), -1, [F.col("source"), F.col("id")]).select("source", "id")


@query(f"WITH a AS (SELECT DISTINCT date FROM ({OBSERVATIONS}) WHERE chm > 6.9), b AS (SELECT DISTINCT date FROM ({OBSERVATIONS}) WHERE ndvi > 0.7) SELECT strftime(date, '%Y%m%d') AS day, CASE WHEN date IN (SELECT date FROM b) THEN 'both' ELSE 'missing' END AS state FROM a")
def date_set_algebra(spark, sf_dir):
    o = roles.observations(spark, sf_dir)
    a, b = (o.filter(f).select("date").distinct() for f in ("chm > 6.9", "ndvi > 0.7"))
    both, missing = a.intersect(b).withColumn("state", F.lit("both")), a.subtract(b).withColumn("state", F.lit("missing"))
    return both.union(missing).select(F.date_format("date", "yyyyMMdd").alias("day"), "state")


@query(f"WITH d AS (SELECT * FROM ({points_sql('customer')}) WHERE id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000)) SELECT id FROM ({points_sql('customer')}) a WHERE NOT EXISTS (SELECT 1 FROM d WHERE round_even(d.x, 3) = round_even(a.x, 3) AND round_even(d.y, 3) = round_even(a.y, 3))")
def resume_anti_join(spark, sf_dir):
    p = roles.points(spark, sf_dir, "customer")
    scored = roles.table(spark, sf_dir, "customer").filter("c_acctbal < 2000").select(F.col("c_custkey").alias("id"))
    return labels.not_done(p, p.join(scored, "id", "left_semi")).select("id")


_DEG = "SELECT id, (x - 2715098) / 1e5 + 9 AS x, (y - 1120181) / 1e5 + 46 AS y FROM ({})"


@query(f"WITH a AS ({_DEG.format(points_sql('customer'))}), b AS ({_DEG.format(points_sql('supplier'))}) SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.00031)")
def degree_dedup(spark, sf_dir):
    deg = lambda n: roles.points(spark, sf_dir, n).withColumns({"x": (F.col("x") - X0) / 1e5 + 9, "y": (F.col("y") - Y0) / 1e5 + 46})
    return labels.new_points(deg("customer"), deg("supplier"), 0.00031).select("id")


@query(f"WITH a AS ({points_sql('customer')}), b AS (SELECT id, x + CASE WHEN id % 4 = 0 THEN 5 ELSE 0 END AS x, y FROM ({points_sql('customer')})) SELECT 'prior' AS side, a.id AS id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE abs(a.x - b.x) < 0.01 AND abs(a.y - b.y) < 0.01 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.01) UNION ALL SELECT 'edit', b.id FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE abs(a.x - b.x) < 0.01 AND abs(a.y - b.y) < 0.01 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.01)")
def missing_from_edit(spark, sf_dir):
    a = roles.points(spark, sf_dir, "customer")
    b = a.withColumn("x", F.col("x") + F.when(F.col("id") % 4 == 0, 5.0).otherwise(0.0))
    prior, edit = labels.new_points(a, b, 0.01), labels.new_points(b, a, 0.01)
    return prior.select(F.lit("prior").alias("side"), "id").union(edit.select(F.lit("edit"), "id"))


@query(f"""WITH p AS ({points_sql('customer')}), cells AS (SELECT *, CAST(floor((x - {X0}::DOUBLE) / 89.6::DOUBLE + 1e-6) AS BIGINT) AS c1, CAST(ceil((x - {X0}::DOUBLE - 102.4::DOUBLE) / 89.6::DOUBLE - 1e-6) AS BIGINT) AS c0, CAST(floor(({Y0}::DOUBLE - y) / 89.6::DOUBLE + 1e-6) AS BIGINT) AS r1, CAST(ceil(({Y0}::DOUBLE - y - 102.4::DOUBLE) / 89.6::DOUBLE - 1e-6) AS BIGINT) AS r0 FROM p),
  pc AS (SELECT id, c, r FROM cells, unnest(range(c0, c1 + 1)) t(c), unnest(range(r0, r1 + 1)) u(r)), m AS (SELECT c, r, CASE WHEN (c + r) % 4 = 0 THEN 'first' ELSE 'later' END AS date FROM (SELECT unnest(range(0, 15)) AS c), (SELECT unnest(range(0, 15)) AS r)),
  f AS (SELECT id, bool_or(coalesce(date = 'first', false)) AS a, bool_or(date IS NOT NULL) AS b FROM pc LEFT JOIN m USING (c, r) GROUP BY id) SELECT CASE WHEN a THEN 'in_first' WHEN b THEN 'in_other' ELSE 'outside' END AS place, count(*) AS n FROM f GROUP BY 1""")
def footprint_classification(spark, sf_dir):
    g = Grid()
    near = spatial.covering_cells(roles.points(spark, sf_dir, "customer"), g).select("id", "cell")
    m = spark.range(225).select((F.col("id") % 15).alias("c"), F.floor(F.col("id") / 15).alias("r"))
    m = m.select(g.key(F.col("c"), F.col("r")).alias("cell"), F.when((F.col("c") + F.col("r")) % 4 == 0, "first").otherwise("later").alias("date"))
    return labels.classify_footprint(near, m, F.col("date") == "first").groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, CAST(v = 'palm' AS INT) AS label, round(CASE WHEN v = 'palm' THEN ndvi + 0.1 ELSE ndvi END, 6) AS x, round(CASE WHEN v = 'palm' THEN chm + 0.1 ELSE chm END, 6) AS y FROM (SELECT event_id, ndvi, chm, CASE event_id % 3 WHEN 0 THEN 'palm' WHEN 1 THEN 'not_palm' ELSE 'unsure' END AS v FROM ({OBSERVATIONS})) WHERE v <> 'unsure'")
def verdict_routing(spark, sf_dir):
    o = roles.observations(spark, sf_dir)
    v = F.when(F.col("event_id") % 3 == 0, "palm").when(F.col("event_id") % 3 == 1, "not_palm").otherwise("unsure")
    rows = o.select("event_id", F.col("ndvi").alias("x"), F.col("chm").alias("y"), (F.col("ndvi") + 0.1).alias("corrected_x"), (F.col("chm") + 0.1).alias("corrected_y"), v.alias("verdict"))
    return rounded(labels.route_verdicts(rows).select("event_id", "label", "x", "y"))


@query("SELECT l_partkey AS name, l_shipmode_order AS dir FROM (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS l_shipmode_order, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def name_lookup_last_wins(spark, sf_dir):
    rows = roles.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("dir"))
    return labels.last_wins(rows, "name", F.col("dir"))


@query("SELECT p_partkey AS id, coalesce(lower(p_name) LIKE '%green%', false) OR coalesce(lower(p_type) LIKE '%steel%', false) AS hit FROM part")
def species_filter(spark, sf_dir):
    hit = lambda c, t: F.coalesce(F.lower(c).contains(t), F.lit(False))
    return roles.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (hit("p_name", "green") | hit("p_type", "steel")).alias("hit"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'none' WHEN quality = 1 THEN 'distinct' ELSE 'weak' END AS signal FROM labels WHERE toxic = 1 OR quality = 1")
def signal_split(spark, sf_dir):
    signal = F.when(F.col("toxic") == 1, "none").when(F.col("quality") == 1, "distinct").otherwise("weak")
    return roles.table(spark, sf_dir, "labels").select("doc_id", signal.alias("signal")).filter("signal in ('distinct', 'none')")


@query(f"SELECT tile, CASE WHEN bool_or(label = 1 AND prob > 0.7) THEN 'ff00ff00' WHEN bool_or(prob > 0.5) THEN 'ff00ffff' ELSE 'ff888888' END AS colour FROM ({CANDIDATES}) GROUP BY tile")
def tile_colour_case(spark, sf_dir):
    c = roles.candidates(spark, sf_dir)
    colour = F.when(F.bool_or((F.col("label") == 1) & (F.col("prob") > 0.7)), "ff00ff00").when(F.bool_or(F.col("prob") > 0.5), "ff00ffff").otherwise("ff888888")
    return c.groupBy("tile").agg(colour.alias("colour"))


@query(f"SELECT point, list_sort(list(DISTINCT strftime(date, '%Y%m%d')))[1] AS first_day, CAST(len(list(DISTINCT date)) AS INT) AS days FROM ({OBSERVATIONS}) GROUP BY point")
def group_paths_by_cell(spark, sf_dir):
    days = F.array_sort(F.collect_set(F.date_format("date", "yyyyMMdd")))
    return roles.observations(spark, sf_dir).groupBy("point").agg(days.alias("d")).select("point", F.col("d")[0].alias("first_day"), F.size("d").alias("days"))
