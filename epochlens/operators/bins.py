"""Weights of objects in time bins, denominators, and membership counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.dates import DateRules, bin_end, bin_key, bin_label, bin_start


def years_between(start: Column, end: Column) -> Column:
    """Years from start to end, both included, without year zero."""
    return end - start + 1 - ((start <= 0) & (end >= 0)).cast("int")


def centred_share(t: Column) -> Column:
    """The part of a triangle over 0 to 1, highest in the middle, that lies up to t."""
    return F.when(t <= 0.5, 2 * t * t).otherwise(1 - 2 * (1 - t) * (1 - t))


def bin_weights(objects: DataFrame, size: int = 10, id_col: str = "artwork_id", start: str = "date_start", end: str = "date_end", keep: tuple[str, ...] = (), centred: bool = False) -> DataFrame:
    """(id, *keep, bin_start, bin_end, weight): the share of each dated object's years in each bin it overlaps.

    The bins of an interval are generated from its ends, so no range join is needed; weights of an object sum
    to 1. Clip very wide intervals first: one row a bin is made. centred: years near the middle of an interval weigh
    more, by a triangle that is 0 at both ends; a bin's weight is the triangle's part over its years, in closed form.
    """
    d = objects.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    first, last = bin_start(F.col(start), size), bin_start(F.col(end), size)
    d = d.select(id_col, *keep, F.col(start).alias("__s"), F.col(end).alias("__e"), F.explode(F.sequence(first, last, F.lit(size))).alias("bin_start"))
    if size == 1:
        d = d.where("bin_start <> 0")
    d = d.withColumn("bin_end", bin_end(F.col("bin_start"), size))
    over = years_between(F.greatest("__s", "bin_start"), F.least("__e", "bin_end"))
    d = d.withColumn("__n", over).where("__n > 0")
    whole = years_between(F.col("__s"), F.col("__e"))
    weight = F.col("__n") / whole
    if centred:
        before = years_between(F.col("__s"), F.greatest("__s", F.when(F.col("bin_start") == 0, 1).otherwise(F.col("bin_start")))) - 1
        weight = centred_share((before + F.col("__n")) / whole) - centred_share(before / whole)
    return d.select(id_col, *keep, "bin_start", "bin_end", weight.alias("weight"))


def bin_number(year: str, size: int = 10) -> Column:
    """Which bin a year is in, counted from the one that starts at zero; a year zero, which doesn't exist, is the year 1."""
    return F.floor(F.when(F.col(year) == 0, 1).otherwise(F.col(year)) / size).cast("int")


def weight_in(bin_start: Column, size: int = 10, start: str = "date_start", end: str = "date_end") -> Column:
    """The weight of a dated object in one bin; zero or less where it doesn't reach into it."""
    over = years_between(F.greatest(F.col(start), bin_start), F.least(F.col(end), bin_end(bin_start, size)))
    return over / years_between(F.col(start), F.col(end))


def extent_bins(objects: DataFrame, rules: DateRules = DateRules(), start: str = "date_start", end: str = "date_end") -> DataFrame:
    """The gap-free bins from the earliest start to the latest end, widened (never narrowed) by the rules."""
    lo, hi = rules.reach(F.min(start), F.max(end))
    n = rules.bin_size
    d = objects.where(F.col(start).isNotNull() & F.col(end).isNotNull()).agg(lo.alias("lo"), hi.alias("hi")).where("lo is not null and hi is not null")
    d = d.select("lo", "hi", F.posexplode(F.sequence(bin_start(F.col("lo"), n), bin_start(F.col("hi"), n), F.lit(n))).alias("bin_index", "bin_start"))
    if n == 1:
        d = d.where("bin_start <> 0").withColumn("bin_index", F.col("bin_index") - ((F.col("bin_start") > 0) & (F.col("lo") < 0)).cast("int"))
    d = d.withColumn("bin_end", bin_end(F.col("bin_start"), n))
    return d.select("bin_index", bin_key(F.col("bin_start"), F.col("bin_end")).alias("bin_key"), "bin_start", "bin_end", bin_label(F.col("bin_start"), F.col("bin_end")).alias("bin_label"))


def denominators(weights: DataFrame, bins: DataFrame, physical: str = "physical_object_id", cluster: str = "visual_cluster_id", count_rows: bool = False, id_col: str = "artwork_id") -> DataFrame:
    """Per bin, zero-filled: the sum of weights, objects and distinct clusters.

    Objects are distinct physical ids, or rows with count_rows, as for filtered corpora; a missing cluster is
    then one of its own. Distinct ids are counted from sums a (bin, id), which are taken before the shuffle.
    """
    zero = F.lit(0)
    if count_rows:
        c = F.coalesce(F.col(cluster), F.concat(F.lit("row-"), F.col(id_col)))
        per = weights.groupBy("bin_start", c.alias("__c")).agg(F.sum("weight").alias("w"), F.count("*").alias("o"))
        per_bin = per.groupBy("bin_start").agg(F.sum("w").alias("w"), F.sum("o").alias("o"), F.count("__c").alias("c"))
    else:
        per = weights.groupBy("bin_start", F.col(physical).alias("__o")).agg(F.sum("weight").alias("w"))
        own = weights.groupBy("bin_start", F.col(cluster).alias("__c")).agg(F.lit(1)).groupBy("bin_start").agg(F.count("__c").alias("c"))
        per_bin = per.groupBy("bin_start").agg(F.sum("w").alias("w"), F.count("__o").alias("o")).join(own, "bin_start", "left")
    return bins.join(per_bin, "bin_start", "left").select(*bins.columns, F.coalesce("w", F.lit(0.0)).alias("eligible_weight"), F.coalesce("o", zero).alias("object_count"), F.coalesce("c", zero).alias("cluster_count"))


def row_sum_violations(weights: DataFrame, id_col: str = "artwork_id", tolerance: float = 1e-6) -> DataFrame:
    """Objects whose weights are negative, not finite, or don't sum to 1."""
    bad = (F.col("weight") < 0) | F.isnan("weight") | (F.abs("weight") == float("inf"))
    per_row = weights.groupBy(id_col).agg(F.sum("weight").alias("row_sum"), F.count_if(bad).alias("bad_weights"))
    return per_row.where((F.abs(F.col("row_sum") - 1) > tolerance) | (F.col("bad_weights") > 0) | F.isnan("row_sum"))


def denominator_violations(weights: DataFrame, denominators: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Bins whose stored denominator isn't the sum of their weights.

    Weights are summed as decimals of 18 places, whose sum has no rounding that grows with the rows; a bin with a weight
    that is none, such as NaN or one beyond 1e20, is summed as it is.
    """
    exact = F.col("weight").try_cast("decimal(38,18)")
    whole = F.count(exact) == F.count("weight")
    got = weights.groupBy("bin_start").agg(F.when(whole, F.try_sum(exact).cast("double")).alias("exact"), F.sum("weight").alias("plain"))
    got = got.select("bin_start", F.coalesce("exact", "plain").alias("actual"))
    both = denominators.select("bin_start", F.col("eligible_weight").alias("stored")).join(got, "bin_start", "full")
    both = both.select("bin_start", F.coalesce("stored", F.lit(0.0)).alias("stored"), F.coalesce("actual", F.lit(0.0)).alias("actual"))
    return both.where(F.abs(F.col("stored") - F.col("actual")) > tolerance)
