"""What an application has written goes when it is swept, and nothing else."""

from pyspark.sql import functions as F

from larkspur.llm.common import materialize, new_path, run_folder, sweep


def exists(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_sweep(spark, tmp_path):
    kept, one, other = f"file://{tmp_path}/kept", new_path(spark, "one"), new_path(spark, "other")
    for path in (kept, one, other):
        spark.range(5).write.parquet(path)
    sweep(spark, one)
    assert not exists(spark, one) and exists(spark, other)
    assert materialize(spark.range(7), "seven").agg(F.sum("id")).first()[0] == 21
    sweep(spark)
    assert not exists(spark, run_folder(spark)) and exists(spark, kept)
    assert materialize(spark.range(3), "again").count() == 3
