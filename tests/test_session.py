"""What intermediate tables leave behind."""

from pyspark.sql import functions as F

from semdex.session import materialize


def shuffle_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    table = materialize(counts.repartition(3, "count").join(spark.range(100).withColumnRenamed("id", "k").hint("merge"), "k"))
    assert shuffle_files(spark) <= before and spark.conf.get(setting) == was
    # the plans are whole: the same frames can be read and written again
    assert table.count() == 100 and counts.count() == 100 and materialize(counts).count() == 100
