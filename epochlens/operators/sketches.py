"""Distinct counts a bin that batches can be merged into: sketches kept in a table, unioned as batches come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.operators.bins import bin_number

#: log2 of a sketch's registers: 16,384 of them, a standard error of 0.8 %, at most some 10 KB.
LOG_REGISTERS = 14


def bin_sketches(objects: DataFrame, values: dict[str, Column], keys: tuple[str, ...] = (), size: int = 10, start: str = "date_start", end: str = "date_end") -> DataFrame:
    """(*keys, bin_start, rows, one sketch for each of values): distinct values of the objects that overlap a bin.

    Objects are sketched by pairs of their first and last bin, partly before the shuffle; then each pair's sketches are
    unioned into its bins. So a row is sketched once, however many bins it overlaps. Null values and objects
    without dates don't count.
    """
    d = objects.where(F.col(start) <= F.col(end)).withColumns({"__first": bin_number(start, size), "__last": F.floor(F.when(F.col(end) == 0, -1).otherwise(F.col(end)) / size).cast("int")})
    pairs = d.groupBy(*keys, "__first", "__last").agg(F.count("*").alias("rows"), *[F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), F.lit(LOG_REGISTERS)).alias(k) for k, v in values.items()])
    each = pairs.withColumn("__bin", F.explode(F.when(F.col("__first") <= F.col("__last"), F.sequence("__first", "__last"))))
    each = each if size > 1 else each.where("__bin <> 0")
    return united(each.withColumn("bin_start", F.col("__bin") * size), list(values), keys)


def united(sketches: DataFrame, values: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of several batches, given as one table, with those of a bin unioned and its rows summed.

    Rows that several batches have count once among distinct values, but each time in rows.
    """
    return sketches.groupBy(*keys, "bin_start").agg(F.sum("rows").alias("rows"), *[F.hll_union_agg(v, F.lit(True)).alias(v) for v in values])


def estimates(sketches: DataFrame, values: list[str]) -> DataFrame:
    """sketches with the estimated number of distinct values in place of each sketch."""
    return sketches.withColumns({v: F.hll_sketch_estimate(v) for v in values})
