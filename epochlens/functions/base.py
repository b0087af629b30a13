"""Small helpers for columns and frames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; in local mode without the setting a temporary
    one, elsewhere an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def tables_root(spark: SparkSession) -> str:
    """Where this application's intermediate tables and sinks of queries are."""
    return f"{shared_root(spark)}/tables-{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def new_path(spark: SparkSession, name: str) -> str:
    """A place for a table, beside which nothing else is."""
    return f"{tables_root(spark)}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of this application, read back: for what is used several times. See release()."""
    path = f"{tables_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once results that are made of them have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A side of a join is broadcast up to this many rows and bytes, and shuffled beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def size_checked(df: DataFrame) -> DataFrame:
    """df as a written table, marked for broadcast if it is small by count and by size."""
    df = written(df, "side")
    size = F.length(F.to_json(F.struct(*df.columns))) if df.columns else F.lit(0)
    got = df.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return F.broadcast(df) if got["n"] <= BROADCAST_ROWS and (got["b"] or 0) <= BROADCAST_BYTES else df


def ranged_ranks(df: DataFrame, order: list, within: list[str], name: str) -> DataFrame:
    """df with the 1-based rank of each row in an order, or in the order of its group within.

    Rows are dealt into ranges and written with the number of their range, ranges are counted, and a row's rank is its
    place in its range plus the counts before; so no task ranks more than its range, and a lost executor changes nothing.
    """
    parts = written(df.repartitionByRange(*within, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__p", *within).agg(F.count("*").alias("__c"))
    earlier = W.partitionBy(*within).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("__p", *within, F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(W.partitionBy("__p", *within).orderBy(*order))
    return parts.withColumn("__n", nth).join(before, ["__p", *within]).withColumn(name, F.col("__before") + F.col("__n")).drop("__p", "__n", "__before")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to as many tasks as shuffles have, for steps whose work is far larger than their rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def digest_below(m: int, of: int) -> str:
    """What about m of so many digests in hex are below, and every one if m isn't less."""
    return f"{m * (1 << 48) // of:012x}" if m < of else "g"
