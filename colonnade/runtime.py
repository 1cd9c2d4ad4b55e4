"""Session helpers shared by the operators: intermediate tables, guarded broadcast joins, partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A dimension is broadcast up to so many rows and so many bytes of text; with the few number columns used here it is then below 64 MB.
BROADCAST_ROWS, BROADCAST_TEXT = 200_000, 16_000_000
#: input (as stored, so several times that in memory) for each partition of an explicit shuffle, and the most of them
PART_BYTES, MOST_PARTS = 128 << 20, 100_000
#: sizes from here on stand for one that isn't known
UNKNOWN = 1 << 60


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session runs on this machine alone, as in
    tests, a local folder is made; elsewhere executors couldn't reach it, so it raises.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        there = tempfile.mkdtemp(prefix="colonnade-")
        atexit.register(shutil.rmtree, there, True)
        spark.sparkContext.setCheckpointDir(there)
    return there


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/colonnade/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that a frame reads; what the optimiser doesn't know the size of counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        size = int(str(leaves.next().stats().sizeInBytes()))
        total += size if size < UNKNOWN else 0
    return total


def partitions(df: DataFrame) -> int:
    """Partitions of an explicit shuffle of what ``df`` reads: ``spark.sql.shuffle.partitions``, or more, so that none takes over PART_BYTES of input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-input_bytes(df) // PART_BYTES), MOST_PARTS))


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as cores, for costly steps on a small input that came as a few files; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most: int | None = None) -> bool:
    """Whether a frame may be broadcast, by counting at most ``most`` + 1 of its rows and the bytes of its text, binaries and nested values."""
    most = BROADCAST_ROWS if most is None else most
    text = []
    for f in df.schema:
        v = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            text.append(F.octet_length(v))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            text.append(F.greatest(F.size(v), F.lit(0)) * 8)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text.append(F.octet_length(F.to_json(F.struct(v))))
    rows, *lengths = df.limit(most + 1).agg(F.count("*"), *[F.sum(F.coalesce(x, F.lit(0)).cast("long")) for x in text]).first()
    return rows <= most and sum(x or 0 for x in lengths) <= BROADCAST_TEXT


def join_dimension(facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "left", most: int | None = None) -> DataFrame:
    """Joins a dimension (one row per key) to a possibly skewed fact table; no row of the facts is lost, null keys match nothing.

    A dimension of counted small size is broadcast. Beyond, the facts' keys are counted (combined before the shuffle): those
    that hold more than a quarter of a task's share of rows, at most 4 x partitions keys, are salted by a hash of the whole
    row, and their dimension rows are repeated for each salt. It stays one join, so several in a row don't double the plan.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    if small(dimension, most):
        return facts.join(F.broadcast(dimension), on, how)
    spark, parts = facts.sparkSession, partitions(facts)
    keys = facts.groupBy(*on).agg(F.count("*").alias("__n"))
    limit = max(facts.count() // (4 * parts), 1)
    heavy = spark.createDataFrame(keys.filter(F.col("__n") > limit).drop("__n").collect(), facts.select(*on).schema).withColumn("__heavy", F.lit(True))
    salts = F.when(F.col("__heavy"), F.lit(parts)).otherwise(F.lit(1))
    salted = facts.join(F.broadcast(heavy), on, "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(parts))).otherwise(F.lit(0)).cast("int")).drop("__heavy")
    repeated = dimension.join(F.broadcast(heavy), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__heavy")
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")
