"""Time series of queries over shared bins, their peaks, windows and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MINIMUM_DENOMINATOR = 20.0
#: Rows in a query's control sample.
CONTROLS = 128


def series_points(hits: DataFrame, weights: DataFrame, denominators: DataFrame, queries: DataFrame, share: float | None = None, id_col: str = "artwork_id", cluster: str | None = "visual_cluster_id") -> DataFrame:
    """One row for each query and bin, zero-filled: hit_mass, share of the denominator, lift, value and counts.

    hits: distinct (query_id, id). share: the retrieved share p, whose lift is share / p and the value; without
    it, for phrase matches, the share is the value. A missing cluster is one of its own, and without a cluster
    column each object is.
    """
    if cluster is None:
        cluster = id_col
    hit_weights = hits.select("query_id", F.col("id").alias(id_col)).join(weights, id_col).withColumn("__c", F.coalesce(F.col(cluster).cast("string"), F.concat(F.lit("row-"), F.col(id_col).cast("string"))))
    return series_of_weights(hit_weights, denominators, queries, share, "__c")


def series_of_weights(hit_weights: DataFrame, denominators: DataFrame, queries: DataFrame, share: float | None = None, cluster: str = "visual_cluster_id") -> DataFrame:
    """series_points() from the weights of the hits themselves: (query_id, bin_start, weight, cluster), a row for each hit and bin.

    Clusters are counted from sums a (query, bin, cluster), which are taken before the shuffle.
    """
    per = hit_weights.groupBy("query_id", "bin_start", F.col(cluster).alias("__c")).agg(F.sum("weight").alias("m"), F.count("*").alias("o"))
    mass = per.groupBy("query_id", "bin_start").agg(F.sum("m").alias("m"), F.sum("o").alias("o"), F.count("__c").alias("c"))
    return points_of_mass(mass, denominators, queries, share)


def points_of_mass(mass: DataFrame, denominators: DataFrame, queries: DataFrame, share: float | None = None) -> DataFrame:
    """series_points() from (query_id, bin_start, m, o, c): the hits' mass, objects and clusters where there are any."""
    grid = denominators.join(queries.select("query_id").distinct())
    d = grid.join(mass, ["query_id", "bin_start"], "left")
    part = F.when(F.col("eligible_weight") > 0, F.coalesce("m", F.lit(0.0)) / F.col("eligible_weight")).otherwise(0.0)
    lift = part / share if share else F.lit(None).cast("double")
    return d.select("query_id", "bin_index", "bin_key", "bin_start", F.coalesce("m", F.lit(0.0)).alias("hit_mass"), part.alias("share"), lift.alias("lift"), (lift if share else part).alias("value"), F.coalesce("o", F.lit(0)).alias("object_count"), F.coalesce("c", F.lit(0)).alias("cluster_count"), F.col("eligible_weight").alias("denominator"), (F.col("eligible_weight") < MINIMUM_DENOMINATOR).alias("below_minimum"))


def relative_density(counts: DataFrame, bins: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key, hit_count, value): counts (query_id, key, hit_count) over the series' largest, zero-filled."""
    d = queries.select("query_id").distinct().join(bins.select("key")).join(counts, ["query_id", "key"], "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))
    top = F.max("hit_count").over(W.partitionBy("query_id"))
    return d.withColumn("value", F.when(top > 0, F.col("hit_count") / top).otherwise(0.0)).select("query_id", "key", "hit_count", "value")


def peak_bins(points: DataFrame, minimum: float | None = MINIMUM_DENOMINATOR, fallback: str = "all", bin_key: str | None = None) -> DataFrame:
    """The bin of the largest value of each query, the earliest of equals; with bin_key that bin, which must exist.

    Bins below the minimum denominator don't count; where all are below, the fallback is "all" bins or the
    "first" bin. minimum None ignores denominators.
    """
    if bin_key is not None:
        named = points.where(F.col("bin_key") == bin_key)
        if not named.limit(1).count():
            raise ValueError(f"no bin of the timeline is called {bin_key}")
        return named
    ok = F.lit(True) if minimum is None else F.col("denominator") >= minimum
    value = F.col("value") if fallback == "all" else F.when(ok, F.col("value"))
    order = W.partitionBy("query_id").orderBy(F.desc(ok), F.desc_nulls_last(value), "bin_index")
    return points.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def trimmed_timeline(bins: DataFrame, minimum: float = MINIMUM_DENOMINATOR) -> DataFrame:
    """bins without the thin ones at either end; thin ones inside stay, and all if every one is thin."""
    ok = (F.col("eligible_weight") >= minimum) & (F.col("eligible_weight") > 0)
    ends = bins.agg(F.min(F.when(ok, F.col("bin_index"))).alias("lo"), F.max(F.when(ok, F.col("bin_index"))).alias("hi"))
    return bins.join(F.broadcast(ends)).where(F.col("lo").isNull() | F.col("bin_index").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def timeline_viewport(points: DataFrame, tail: float = 0.1) -> DataFrame:
    """(viewport_start, viewport_end): bin indexes that hold the middle of every series' mass.

    Of each series, from the first bin at which a tenth of the mass has gone by, from either side; the union
    over series is widened by 6 % or two bins and kept within the bins.
    """
    mass = F.greatest(F.col("hit_mass"), F.lit(0.0))
    of = W.partitionBy("query_id")
    left = of.orderBy("bin_index").rowsBetween(W.unboundedPreceding, 0)
    right = of.orderBy(F.desc("bin_index")).rowsBetween(W.unboundedPreceding, 0)
    d = points.select("query_id", "bin_index", mass.alias("m")).select("*", F.sum("m").over(of).alias("t"), F.sum("m").over(left).alias("l"), F.sum("m").over(right).alias("r"))
    inside = lambda c: F.when((F.col("m") > 0) & (F.col(c) >= F.col("t") * tail), F.col("bin_index"))
    s = d.groupBy("query_id").agg(F.min(inside("l")).alias("a"), F.max(inside("r")).alias("b"), F.max("bin_index").alias("last"))
    s = s.agg(F.min(F.when(F.col("a") <= F.col("b"), F.col("a"))).alias("a"), F.max(F.when(F.col("a") <= F.col("b"), F.col("b"))).alias("b"), F.max("last").alias("last"))
    pad = F.greatest(F.lit(2), F.ceil((F.col("b") - F.col("a")) * 0.06))
    none = F.col("a").isNull()
    return s.select(F.when(none, 0).otherwise(F.greatest(F.lit(0), F.col("a") - pad)).cast("int").alias("viewport_start"), F.when(none, F.col("last")).otherwise(F.least(F.col("last"), F.col("b") + pad)).cast("int").alias("viewport_end"))


def stable_order(salt: Column, id_col: Column) -> Column:
    """A reproducible random order: the digest of salt and id."""
    return F.sha2(F.concat_ws(":", salt, id_col.cast("string")), 256)


def control_order(version: str = "v1") -> Column:
    """The stable random order of a query's control rows."""
    return stable_order(F.concat_ws(":", F.lit("controls"), F.lit(version), F.col("query_id").cast("string")), F.col("id"))


def control_statistics(hits: DataFrame, controls: DataFrame) -> DataFrame:
    """Per query: the hits' mean score, mean and population deviation of the control rows' scores, separation."""
    c = controls.groupBy("query_id").agg(F.avg("score").alias("cm"), F.stddev_pop("score").alias("cs"))
    d = hits.groupBy("query_id").agg(F.avg("score").alias("hit_mean")).join(c, "query_id", "left")
    gap = F.col("hit_mean") - F.col("cm")
    separation = F.when(F.col("cm").isNull(), 0.0).when(F.col("cs") > 1e-8, gap / F.col("cs")).when(gap > 0, 999.0).otherwise(0.0)
    return d.select("query_id", "hit_mean", F.coalesce("cm", "hit_mean").alias("control_mean"), F.coalesce("cs", F.lit(0.0)).alias("control_std"), separation.alias("separation"))


def prompt_jaccard(hits: DataFrame, prompt_hits: DataFrame) -> DataFrame:
    """(query_id, prompt_jaccard): the mean, over a query's prompts, of the Jaccard overlap of both hit sets.

    prompt_hits: (query_id, prompt_id, id). Overlaps are counted by joins; no set is collected.
    """
    prompts = prompt_hits.groupBy("query_id", "prompt_id").agg(F.count("*").alias("b"))
    both = prompt_hits.join(hits.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id", "prompt_id").agg(F.count("*").alias("ab"))
    own = hits.groupBy("query_id").agg(F.count("*").alias("a"))
    return mean_jaccard(prompts.join(own, "query_id", "left").join(both, ["query_id", "prompt_id"], "left"))


def mean_jaccard(counts: DataFrame) -> DataFrame:
    """(query_id, prompt_jaccard) from (query_id, prompt_id, a, b, ab), as retrieval.shared_hits() counts them: the hits of the
    query, of the prompt and of both."""
    shared, union = F.coalesce("ab", F.lit(0)), F.coalesce("a", F.lit(0)) + F.col("b") - F.coalesce("ab", F.lit(0))
    return counts.groupBy("query_id").agg(F.avg(F.when(union > 0, shared / union).otherwise(1.0)).alias("prompt_jaccard"))


def signal_diagnostics(statistics: DataFrame, jaccards: DataFrame, least_separation: float = 1.0, least_jaccard: float = 0.25) -> DataFrame:
    """statistics with prompt_jaccard, reasons and low_signal."""
    d = statistics.join(jaccards, "query_id", "left").withColumn("prompt_jaccard", F.coalesce("prompt_jaccard", F.lit(1.0)))
    why = F.array(F.when(F.col("separation") < least_separation, F.lit("weak separation from controls")), F.when(F.col("prompt_jaccard") < least_jaccard, F.lit("prompts disagree")))
    return d.withColumn("reasons", F.array_compact(why)).withColumn("low_signal", F.size("reasons") > 0)


def warnings(points: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """(query_id, warning): low signal, nothing found, and how many bins are sparse."""
    per = points.groupBy("query_id").agg(F.sum("hit_mass").alias("m"), F.count_if("below_minimum").alias("n"))
    out = per.where("m = 0").select("query_id", F.lit("no matches").alias("warning")).union(per.where("n > 0").select("query_id", F.format_string("%d bins are below the minimum denominator", "n")))
    if diagnostics is not None:
        out = out.union(diagnostics.where("low_signal").select("query_id", F.concat(F.lit("low signal: "), F.array_join("reasons", "; "))))
    return out
