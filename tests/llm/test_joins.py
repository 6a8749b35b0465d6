"""What joins of the text operators may broadcast, how many rows they make, and into how many files their results go."""

import glob

from pyspark.sql import functions as F

from tesselon.llm import cluster, jaccard_join


def test_compressed_tables_are_not_broadcast_unasked(spark):
    """A stored table of 2 MB may be 100 MB in the driver: such broadcasts filled it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    ids = cluster.stored(spark.range(1_000_000).select(F.xxhash64("id").alias("id"), F.col("id").alias("v")).limit(400_000), "ids")
    plan = spark.range(5).join(ids, "id")._jdf.queryExecution().executedPlan().toString()
    both = ids.join(ids.withColumnRenamed("v", "w"), "id")._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == str(cluster.AUTO_BROADCAST_BYTES)
    assert "BroadcastHashJoin" not in both and "BuildRight" not in plan
    for kept in ("-1", "64k", "1000"):  # what is smaller stays
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        cluster.small_batches(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == kept
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_members_meet_larger_components_once(spark, monkeypatch):
    """Signatures with the same components of several sets make a row a member, not a row a member and signature."""
    counts, kept = {}, cluster.stored

    def stored(df, name):
        out = kept(df, name)
        counts[name] = out.count()
        return out

    sigs = [(s, i, 1, i, 1) for s in range(40) for i in range(20)]  # single sets in every signature
    sigs += [(s, 100 + i, 1, 100 + c, 9 + c) for s in range(40) for c in range(70) for i in (2 * c,)]
    sigs += [(99, 3, 1, 3, 1), (99, 700, 1, 700, 5)]
    member = spark.createDataFrame(sigs, "sig long, id long, ways int, component long, size long").withColumn("salt", F.lit(0))
    labels = spark.createDataFrame([(10_000 + k, c) for c, n in {x[3:] for x in sigs} if n > 1 for k in range(n)], "id long, component long")
    rank = F.struct("size", "component")
    top = member.groupBy("sig").agg(F.max(rank).alias("top"))
    minor = member.join(top, "sig").filter(rank < F.col("top")).drop("top")
    large = member.filter("size > 1").select("sig", F.col("component").alias("c"), F.col("size").alias("csize")).distinct()
    want = {tuple(r) for r in minor.join(large, "sig").filter(F.struct("size", "component") < F.struct("csize", "c")).select("id", "c", "csize").collect()}

    monkeypatch.setattr(cluster, "stored", stored)
    found, real = [], jaccard_join._asked
    monkeypatch.setattr(jaccard_join, "_asked", lambda *a: found.append(real(*a)) or found[0])
    monkeypatch.setattr(jaccard_join, "_blocked", lambda *a, **b: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(jaccard_join, "_verified", lambda *a, **b: spark.createDataFrame([], "a long, b long"))
    sets = spark.createDataFrame([], "id long, grams binary")
    jaccard_join._rest(member.drop("size").withColumns({"n": F.lit(10), "shared": F.lit(10)}), sets, labels, 4)
    got = [tuple(r) for r in found[0].collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert counts["held"] <= 2 * 90 + 2 < 40 * 20  # members by lists of 64


def test_narrow_tables_of_many_tasks_are_few_files(spark, monkeypatch, tmp_path):
    """Links and screened rows come from as many tasks as the input has partitions: a file each cost the executors processes."""
    monkeypatch.setattr(cluster, "new_path", lambda _, name, kept=cluster.new_path: kept(spark, name).replace(cluster.shared_dir(spark), f"file://{tmp_path}"))
    base = [" ".join(f"w{g}x{i}" for i in range(40)) for g in range(60)]
    rows = [(3 * g + k, f"{t} more{k}") for g, t in enumerate(base) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        got = {r.doc_id: r.component_id for r in jaccard_join.document_components(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: 3 * (i // 3) for i in range(180)}
    for name in ("links", "screened"):
        tables = glob.glob(f"{tmp_path}/{name}-*")
        assert tables and all(len(glob.glob(f"{t}/*.parquet")) <= 4 for t in tables), name
