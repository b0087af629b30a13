"""Keep a corpus and its sums a bin up to date from a stream, each row once, whatever fails on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from epochlens.functions.base import exists
from epochlens.operators.sketches import bin_sketches, estimates, united
from epochlens.operators.sweep import interval_sums

DISTINCT = ["physical_object_id", "visual_cluster_id"]


def append_batch(batch: DataFrame, batch_id: int, root: str, size: int = 10) -> None:
    """Write a micro-batch's rows, sums and sketches below root, and last its entry in the ledger.

    Each has a folder of the batch's own and replaces what is there, so a batch that was stopped anywhere and comes again
    leaves the same tables. Only what the ledger names is ever read.
    """
    spark = batch.sparkSession
    folder = lambda kind: f"{root}/{kind}/batch={batch_id}"
    batch.write.mode("overwrite").parquet(folder("rows"))
    rows = spark.read.schema(batch.schema).parquet(folder("rows"))
    values = {c: F.col(c) for c in DISTINCT if c in batch.columns}
    sums = interval_sums(rows, size=size).drop("rows")
    bin_sketches(rows, values, size=size).join(sums, "bin_start").write.mode("overwrite").parquet(folder("sums"))
    spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode("overwrite").parquet(folder("ledger"))


def start_incremental(source: DataFrame, root: str, checkpoint: str, size: int = 10, id_col: str = "artwork_id", event_time: str | None = None, late: str = "30 days") -> StreamingQuery:
    """A streaming query that appends each id once and ends when the source is read through.

    Which ids were seen is the query's state, beside its checkpoint, so no batch reads the corpus. With event_time, an id
    is remembered until rows are later than late; without it, for ever. A folder belongs to one checkpoint.
    """
    spark = source.sparkSession
    if not exists(spark, f"{root}/owner"):
        spark.createDataFrame([(checkpoint,)], "value string").coalesce(1).write.text(f"{root}/owner")
    owner = spark.read.text(f"{root}/owner").first()["value"]
    if owner != checkpoint:  # its batches have numbers of their own
        raise ValueError(f"{root} belongs to another checkpoint, {owner}")
    seen = source.dropDuplicates([id_col]) if event_time is None else source.withWatermark(event_time, late).dropDuplicatesWithinWatermark([id_col])
    return seen.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch_id: append_batch(df, batch_id, root, size)).trigger(availableNow=True).start()


def _committed(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """The tables of the batches that the ledger names; None before the first."""
    if not exists(spark, f"{root}/ledger"):
        return None
    named = [r["batch"] for r in spark.read.schema("batch_id long, batch long").parquet(f"{root}/ledger").select("batch").distinct().collect()]
    if not named:
        return None
    return spark.read.option("basePath", f"{root}/{kind}").parquet(*[f"{root}/{kind}/batch={b}" for b in sorted(named)]).drop("batch")


def current_corpus(spark: SparkSession, root: str) -> DataFrame:
    """All rows so far."""
    rows = _committed(spark, root, "rows")
    if rows is None:
        raise ValueError("no batch was committed")
    return rows


def current_denominators(spark: SparkSession, root: str) -> DataFrame:
    """(bin_start, eligible_weight, row_count, and distinct estimates): sums of the batches' sums, not of their rows."""
    sums = _committed(spark, root, "sums")
    if sums is None:
        return spark.createDataFrame([], "bin_start int, eligible_weight double, row_count long")
    values = [c for c in DISTINCT if c in sums.columns]
    total = sums.groupBy("bin_start").agg(F.sum("weight").alias("eligible_weight"))
    counts = estimates(united(sums, values), values).withColumnRenamed("rows", "row_count")
    return total.join(counts, "bin_start")
