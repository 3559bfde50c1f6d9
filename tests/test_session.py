import zipfile

from pyspark.sql import functions as F

from brindle import session


def test_spread_moves_small_scans_only(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100).repartition(9)
    assert session.spread(wide) is wide  # not a plain scan
    many = spark.range(0, 100, 1, 9)
    assert session.spread(many) is many


def test_materialise_cuts_the_lineage(spark):
    kept = session.materialise(spark.range(5).groupBy((F.col("id") % 2).alias("k")).count())
    assert sorted(map(tuple, kept.collect())) == [(0, 3), (1, 2)]
    assert "HashAggregate" not in kept._jdf.queryExecution().executedPlan().toString()


def test_one_row(spark):
    figures = spark.range(4).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = spark.range(2).withColumn("f", session.one_row(figures)).select("id", "f.*").orderBy("id").collect()
    assert list(map(tuple, got)) == [(0, 4, 3), (1, 4, 3)]


def test_package_is_shipped_where_workers_lack_it(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(spark.sparkContext, "addPyFile", sent.append)
    monkeypatch.setenv("PYTHONPATH", "/nowhere")
    monkeypatch.chdir("/")
    try:
        session.ship_package(spark)
        session.ship_package(spark)
        assert len(sent) == 1 and "brindle/session.py" in zipfile.ZipFile(sent[0]).namelist()
    finally:
        if hasattr(spark.sparkContext, "_brindle_shipped"):
            del spark.sparkContext._brindle_shipped
    monkeypatch.setenv("PYTHONPATH", session.os.path.dirname(session.os.path.dirname(session.os.path.abspath(session.__file__))))
    session.ship_package(spark)
    assert len(sent) == 1
