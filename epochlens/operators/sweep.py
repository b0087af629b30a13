"""Sums over time bins by boundary events: a few rows an interval, however many bins it overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.functions.dates import bin_end
from epochlens.operators.bins import years_between
from epochlens.operators.series import points_of_mass


def _spans(objects: DataFrame, keep: list[Column], size: int, start: str, end: str) -> DataFrame:
    """(*keep, s, e, first, last): intervals without year zero at an end, and the numbers of their first and last bin."""
    s, e = F.when(F.col(start) == 0, 1).otherwise(F.col(start)), F.when(F.col(end) == 0, -1).otherwise(F.col(end))
    at = lambda y: F.floor(F.col(y) / size).cast("int")
    return objects.select(*keep, s.alias("s"), e.alias("e")).where("s <= e").withColumns({"first": at("s"), "last": at("e")})


def _filled(events: DataFrame, keys: list[str], level: list[str], size: int) -> DataFrame:
    """events with a row for each bin up to the next event of its keys, and level columns as running sums up to there."""
    of = W.partitionBy(*keys).orderBy("bin")
    upto = of.rowsBetween(W.unboundedPreceding, 0)
    d = events.withColumns({"next": F.lead("bin").over(of), **{f"{c}_now": F.sum(c).over(upto) for c in level}})
    to = F.greatest(F.coalesce(F.col("next"), F.col("bin") + 1) - 1, F.col("bin"))
    to = F.when(F.greatest(*[f"{c}_now" for c in level], F.lit(0)) > 0, to).otherwise(F.col("bin"))
    d = d.withColumn("at", F.explode(F.sequence("bin", to)))
    return d if size > 1 else d.where("at <> 0")


def interval_sums(objects: DataFrame, keys: tuple[str, ...] = (), size: int = 10, start: str = "date_start", end: str = "date_end") -> DataFrame:
    """(*keys, bin_start, weight, rows): what bin_weights() sums to by keys and bin, and how many objects overlap the bin.

    An object is four events at most: the years in its first bin, the start and the end of its full bins with the years
    in its last one, and its end. Events are counted by bin and by the object's length in years, in whole numbers and
    before the shuffle; running counts of a length give the years that it has in each bin, and the division by the
    length comes last, so a bin without objects is exactly zero. Objects without dates or with ends in the wrong order count nowhere.
    """
    d = _spans(objects, [F.col(k) for k in keys], size, start, end).withColumn("n", years_between(F.col("s"), F.col("e")).cast("long"))
    event = lambda at, years, full, rows: F.struct(at.alias("bin"), years.cast("long").alias("years"), F.lit(full).cast("long").alias("full"), F.lit(rows).cast("long").alias("rows"))
    none, after = F.lit(0), F.col("last") + 1
    head = years_between(F.col("s"), bin_end(F.col("first") * size, size))
    tail = years_between(F.col("last") * size, F.col("e"))
    inside = F.array(event(F.col("first"), F.col("n"), 0, 1), event(after, none, 0, -1))
    across = F.array(event(F.col("first"), head, 0, 1), event(F.col("first") + 1, none, 1, 0), event(F.col("last"), tail, -1, 0), event(after, none, 0, -1))
    d = d.select(*keys, "n", F.inline(F.when(F.col("first") == F.col("last"), inside).otherwise(across)))
    d = d.groupBy(*keys, "n", "bin").agg(*[F.sum(c).alias(c) for c in ("years", "full", "rows")])
    d = _filled(d, [*keys, "n"], ["full", "rows"], size)
    in_bin = F.lit(size) - F.when(F.col("at") == 0, 1).otherwise(0)
    years = F.when(F.col("at") == F.col("bin"), F.col("years")).otherwise(0) + F.col("full_now") * in_bin
    d = d.select(*keys, (F.col("at") * size).alias("bin_start"), (years / F.col("n")).alias("weight"), F.col("rows_now").alias("rows"))
    return d.groupBy(*keys, "bin_start").agg(F.sum("weight").alias("weight"), F.sum("rows").alias("rows")).where("rows > 0")


def interval_distinct(objects: DataFrame, value: Column, keys: tuple[str, ...] = (), size: int = 10, start: str = "date_start", end: str = "date_end") -> DataFrame:
    """(*keys, bin_start, n): how many distinct non-null values have an object in the bin, by keys.

    Intervals of a value are reduced to distinct pairs of bins before the shuffle; in their order each adds what reaches
    beyond all before it, as one event where that begins and one after it ends, and running sums count what is open.
    """
    d = _spans(objects, [*[F.col(k) for k in keys], value.alias("v")], size, start, end).where("v is not null").select(*keys, "v", "first", "last").distinct()
    before = F.max("last").over(W.partitionBy(*keys, "v").orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("first", F.greatest("first", before + 1)).where("first <= last")
    d = d.select(*keys, F.inline(F.array(F.struct(F.col("first").alias("bin"), F.lit(1).alias("open")), F.struct((F.col("last") + 1).alias("bin"), F.lit(-1).alias("open")))))
    d = _filled(d.groupBy(*keys, "bin").agg(F.sum("open").alias("open")), list(keys), ["open"], size)
    return d.where("open_now > 0").select(*keys, (F.col("at") * size).alias("bin_start"), F.col("open_now").alias("n"))


def own_cluster(cluster: str, id_col: str) -> Column:
    """The cluster as text, or one of its own for an object without."""
    return F.coalesce(F.col(cluster).cast("string"), F.concat(F.lit("row-"), F.col(id_col).cast("string")))


def interval_denominators(objects: DataFrame, bins: DataFrame, size: int = 10, physical: str = "physical_object_id", cluster: str = "visual_cluster_id", count_rows: bool = False, id_col: str = "artwork_id") -> DataFrame:
    """What bins.denominators() gives of the objects' weights, from the objects themselves."""
    sums = interval_sums(objects, size=size)
    clusters = interval_distinct(objects, own_cluster(cluster, id_col) if count_rows else F.col(cluster), size=size).withColumnRenamed("n", "c")
    per_bin = sums.withColumnRenamed("rows", "o") if count_rows else sums.drop("rows").join(interval_distinct(objects, F.col(physical), size=size).withColumnRenamed("n", "o"), "bin_start", "left")
    d = bins.join(per_bin, "bin_start", "left").join(clusters, "bin_start", "left")
    return d.select(*bins.columns, F.coalesce("weight", F.lit(0.0)).alias("eligible_weight"), F.coalesce("o", F.lit(0)).alias("object_count"), F.coalesce("c", F.lit(0)).alias("cluster_count"))


def interval_series(matched: DataFrame, denominators: DataFrame, queries: DataFrame, share: float | None = None, size: int = 10, cluster: str = "visual_cluster_id", id_col: str = "artwork_id") -> DataFrame:
    """What series.series_points() gives of the hits, from (query_id, object) rows with the objects' dates."""
    sums = interval_sums(matched, ("query_id",), size)
    clusters = interval_distinct(matched, own_cluster(cluster, id_col), ("query_id",), size)
    mass = sums.join(clusters, ["query_id", "bin_start"], "left").select("query_id", "bin_start", F.col("weight").alias("m"), F.col("rows").alias("o"), F.col("n").alias("c"))
    return points_of_mass(mass, denominators, queries, share)
