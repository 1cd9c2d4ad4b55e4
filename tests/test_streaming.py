from pyspark.sql import functions as F

from colonnade.operators import stats
from colonnade.streaming import append_batches


def test_counts_of_a_stream_add_up(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    df.repartition(4).write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v double").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    append_batches(stream, lambda b: stats.describe(b, "v"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    parts = spark.read.parquet(str(tmp_path / "out"))
    assert parts.count() > 1
    assert parts.agg(F.sum("count"), F.sum("sum"), F.min("min"), F.max("max")).first() == (1000, 499500.0, 0.0, 999.0)
