"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one in local mode and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are, in the shared folder."""
    return f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation before it.

    The table stays, as what is made of it is evaluated later; see release()."""
    spark = df.sparkSession
    path = f"{cut_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once results that are made of them have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cut_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


#: A side of a join is broadcast up to this many rows and bytes, and shuffled beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def if_small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small by count and by size. df has been written, so the count costs little."""
    text = [c for c, t in df.dtypes if t not in ("int", "bigint", "boolean", "double")]
    size = sum((F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) for c in text), F.lit(8 * len(df.columns)))
    got = df.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return F.broadcast(df) if got["n"] <= BROADCAST_ROWS and (got["b"] or 0) <= BROADCAST_BYTES else df


def width(spark: SparkSession) -> int:
    """Partitions for steps that are heavy on CPU, which Spark would otherwise coalesce by bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of keys, from batches sorted by them; only the open group waits."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = {k: batch.column(k)[batch.num_rows - 1] for k in keys}
        cutoff = batch.num_rows
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            col, value = batch.column(k), last[k].as_py()
            same &= np.asarray([x == value for x in col.to_pylist()]) if col.type in (pa.string(), pa.binary()) else (col.to_numpy(zero_copy_only=False) == value)
        cutoff = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cutoff:
            yield pa.Table.from_batches([*rest, batch.slice(0, cutoff)])
            rest = [batch.slice(cutoff)]
        elif rest and all(rest[0].column(k)[0].as_py() == last[k].as_py() for k in keys):
            rest.append(batch)
        else:
            if rest:
                yield pa.Table.from_batches(rest)
            rest = [batch]
    if rest:
        yield pa.Table.from_batches(rest)


def components(edges: DataFrame, step: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """Connected components of (a, b) long pairs, as (id, component): the smallest id each id reaches.

    Alternates large-star and small-star steps; each round is cut. Nodes without an edge to another node
    are absent. A node with very many edges is aggregated before the shuffle and split by skew joins.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = step(e, "cc")
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = step(small.where("a <> b").distinct(), "cc")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
