from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from marginalia.llm.shared import Scratch, files, shared_folder, trim


def fake(master, named=None, warehouse=None):
    seen = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: seen[-1] if seen else None, setCheckpointDir=seen.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named), sparkContext=context)


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        shared_folder(fake("spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(fake("local-cluster[2,1,1024]"))
    assert shared_folder(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(fake("local[2]"))


def test_few_rows_make_few_files_and_many_keep_their_partitions(spark):
    scratch = Scratch(spark, "t")
    rows = spark.range(1000).repartition(7)
    assert len(scratch.save(rows, "few", 1000).inputFiles()) == 1
    assert len(scratch.save(rows, "some", 1000, 300).inputFiles()) == 4
    assert len(scratch.save(rows, "all").inputFiles()) == 7 and len(scratch.save(rows, "many", 1000, 1).inputFiles()) == 7
    assert files(0) == 1 and files(50_001) == 2
    scratch.drop("few")
    trim()


def test_buckets_are_not_shuffled_again(spark):
    scratch = Scratch(spark, "t")
    left = scratch.save_by(spark.range(100).withColumn("x", F.col("id") * 2), "left", "id", 4)
    plan = left.groupBy("id").agg(F.max("x"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1] and left.count() == 100
    scratch.forget()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("left_")] == []


def test_the_setting_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.unset(name)
    Scratch(spark, "t").save(spark.range(10).groupBy((F.col("id") % 2).alias("k")).count(), "a")
    assert spark.conf.get(name) == "false"
