"""Sums by boundary events against a row for each bin, on catalogued objects and on very wide intervals."""

import random

import pytest
from pyspark.sql import functions as F

from epochlens.operators import bins, series, sweep
from epochlens.plans import testbed
from tests.oracle import SF


def rounded(df, *keys):
    return sorted((*(r[k] for k in keys), r["bin_start"], round(r["weight"], 6), r["rows"]) for r in df.collect())


def by_rows(objects, keys, size):
    w = bins.bin_weights(objects, size, keep=keys)
    return w.groupBy(*keys, "bin_start").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"))


def intervals(spark, n, wide, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randrange(-wide, wide)
        b = a + rng.choice([0, 1, 9, rng.randrange(wide)])
        rows.append((i, a or 1, b or 1, f"p{rng.randrange(n // 4)}", rng.choice([None, *"abc"]), rng.randrange(2)))
    rows += [rows[0], rows[1], (n, None, 5, "p", "a", 0), (n + 1, 5, None, "p", "a", 0), (n + 2, 9, 3, "p", "a", 0), (n + 3, -1, 1, None, None, 1), (n + 4, 10, 10, "p1", "a", 1), (n + 5, -9, -1, "p1", "b", 1)]
    return spark.createDataFrame(rows, "artwork_id int, date_start int, date_end int, physical_object_id string, visual_cluster_id string, query_id int")


@pytest.mark.parametrize("size", [1, 2, 10, 25])
def test_sums_equal_a_row_for_each_bin(spark, size):
    o = intervals(spark, 200, 60, size)
    for keys in ((), ("query_id",)):
        assert rounded(sweep.interval_sums(o, keys, size), *keys) == rounded(by_rows(o, keys, size), *keys)
    w = bins.bin_weights(o, size, keep=("visual_cluster_id", "query_id"))
    got = sweep.interval_distinct(o, F.col("visual_cluster_id"), ("query_id",), size)
    want = w.where("visual_cluster_id is not null").groupBy("query_id", "bin_start").agg(F.count_distinct("visual_cluster_id").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_intervals_of_ten_thousand_years(spark):
    o = intervals(spark, 120, 10_000, 9)
    assert rounded(sweep.interval_sums(o)) == rounded(by_rows(o, (), 10))
    # an interval is four events, however wide it is
    assert sweep.interval_sums(spark.createDataFrame([(1, 2_000_000)], "date_start int, date_end int"), size=1000).count() == 2001


def test_denominators_and_series_equal_those_of_weights(spark):
    o = testbed.objects(spark, SF)
    b = bins.extent_bins(o)
    w = bins.bin_weights(o, keep=("physical_object_id", "visual_cluster_id"))
    shown = lambda d: sorted((r["bin_index"], round(r["eligible_weight"], 6), r["object_count"], r["cluster_count"]) for r in d.collect())
    for rows in (False, True):
        assert shown(sweep.interval_denominators(o, b, count_rows=rows)) == shown(bins.denominators(w, b, count_rows=rows))
    d = bins.denominators(w, b)
    hits = o.where("facet <> '2-HIGH'").select(F.col("facet").alias("query_id"), F.col("artwork_id").alias("id"))
    points = lambda p: sorted((r["query_id"], r["bin_index"], round(r["hit_mass"], 6), round(r["lift"], 6), r["object_count"], r["cluster_count"]) for r in p.collect())
    matched = o.where("facet <> '2-HIGH'").withColumn("query_id", F.col("facet"))
    assert points(sweep.interval_series(matched, d, hits, 0.1)) == points(series.series_points(hits, w, d, hits, 0.1))


def test_a_bin_between_objects_is_empty(spark):
    o = spark.createDataFrame([(-500, -493), (13, 13), (700, 777)], "date_start int, date_end int")
    got = {r["bin_start"]: r["weight"] for r in sweep.interval_sums(o).collect()}
    assert set(got) == {-500, 10, *range(700, 780, 10)} and sum(got.values()) == pytest.approx(3)
    assert sweep.interval_sums(o.limit(0)).count() == 0 and sweep.interval_distinct(o.limit(0), F.col("date_start")).count() == 0


@pytest.mark.parametrize("size", [1, 10])
def test_centred_weights_equal_enumeration(spark, size):
    spans = [(i, s, e) for i, (s, e) in enumerate([(-25, 37), (1, 1), (-1, -1), (-1, 1), (7, 33), (-100, -91), (3, 4)])]
    got = {(r[0], r[1]): r[2] for r in bins.bin_weights(spark.createDataFrame(spans, "artwork_id int, date_start int, date_end int"), size, centred=True).select("artwork_id", "bin_start", "weight").collect()}
    part = lambda t: 2 * t * t if t <= 0.5 else 1 - 2 * (1 - t) ** 2
    want = {}
    for i, s, e in spans:
        years = [y for y in range(s, e + 1) if y]
        for n, y in enumerate(years):
            k = (i, y // size * size)
            want[k] = want.get(k, 0) + part((n + 1) / len(years)) - part(n / len(years))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert all(sum(w for (i, _), w in got.items() if i == k) == pytest.approx(1) for k, *_ in spans)


def test_denominators_are_compared_with_sums_that_dont_drift(spark):
    """A hundred thousand small weights beside a large one: added one by one they lose what the large one's places can't hold."""
    w = spark.range(100_000, numPartitions=1).select(F.when(F.col("id") == 0, 3e9).otherwise(1e-7).alias("weight"), F.lit(0).alias("bin_start"))
    stored = spark.createDataFrame([(0, 3e9 + 99_999e-7)], "bin_start int, eligible_weight double")
    assert bins.denominator_violations(w, stored).count() == 0
    wrong = spark.createDataFrame([(0, 3e9 + 99_000e-7)], "bin_start int, eligible_weight double")
    assert bins.denominator_violations(w, wrong).count() == 1
    nan = spark.createDataFrame([(0, float("nan")), (0, 1.0)], "bin_start int, weight double")
    assert bins.denominator_violations(nan, stored).count() == 1
