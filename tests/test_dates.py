import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from epochlens.functions import dates as D
from epochlens.operators import bins as B

COLUMNS = "date_start string, date_end string, date_display string, date_qualifier string"


def normal(spark, *row, rules=D.DateRules(), schema=COLUMNS):
    r = D.normalize_dates(spark.createDataFrame([row], schema), rules).first()
    return r["norm_start"], r["norm_end"], r["norm_qualifier"], r["norm_method"]


@pytest.mark.parametrize("row, want", [
    (("1880", "1890", "", ""), (1880, 1890, "range", "source_range")),
    (("1,880", None, "", ""), (1880, 1880, "exact", "source_exact")),
    (("1890", "1880", "", ""), (1880, 1890, "range", "source_range")),
    (("1880", "1880", "", "ca."), (1875, 1885, "circa", "source_circa")),
    (("1880", "1890", "", "circa"), (1880, 1890, "circa", "source_range")),
    (("1900", "", "", "before 1900"), (1875, 1899, "before", "source_before")),
    (("1900", "", "", "later than"), (1901, 1925, "after", "source_after")),
    (("", "", "ca. 1880", ""), (1875, 1885, "circa", "display_circa")),
    (("", "", "before 1900", ""), (1875, 1899, "before", "display_before")),
    (("", "", "After 1900", ""), (1901, 1925, "after", "display_after")),
    (("", "", "300-200 BCE", ""), (-300, -200, "range", "display_range")),
    (("", "", "300 BCE-200", ""), (-300, -200, "range", "display_range")),
    (("", "", "10 BC to 10 AD", ""), (-10, 10, "range", "display_range")),
    (("", "", "circa 1880–1890", ""), (1880, 1890, "circa", "display_range")),
    (("", "", "Undated", ""), (None, None, "unknown", "unknown")),
    (("", "", "spring", ""), (None, None, "unknown", "unknown")),
    (("inf", "1e3", "", ""), (1000, 1000, "exact", "source_exact")),
    (("12d", "5", "", ""), (5, 5, "exact", "source_exact")),
])
def test_normalize(spark, row, want):
    assert normal(spark, *row) == want


def test_errors_reject_or_fail(spark):
    df = spark.createDataFrame([("0", "5", "", ""), ("1.5", "", "", "")], COLUMNS)
    got = D.normalize_dates(df).collect()
    assert all(r["norm_error"] and r["norm_start"] is None for r in got)
    with pytest.raises(PySparkException):
        D.normalize_dates(df, on_error="fail").collect()


def test_column_presence_decides_not_emptiness(spark):
    assert normal(spark, "", "1800", schema="date_start string, date_begin string")[0] is None
    assert normal(spark, "1800", "true", schema="date_begin string, date_begin_bce string")[0] == -1800


def test_shift_year_skips_zero(spark):
    d = spark.createDataFrame([(-3, 5, 3), (3, -5, -3), (-1, 1, 1), (1, -1, -1), (5, 2, 7)], "y int, o int, want int")
    assert all(r["got"] == r["want"] for r in d.withColumn("got", D.shift_year(F.col("y"), F.col("o"))).collect())


def test_weights_of_ranges_and_across_zero(spark):
    d = spark.createDataFrame([("a", 1880, 1890), ("b", -2, 2), ("c", None, None)], "artwork_id string, date_start int, date_end int")
    got = {(r["artwork_id"], r["bin_start"]): r["weight"] for r in B.bin_weights(d).collect()}
    assert got[("a", 1880)] == pytest.approx(10 / 11) and got[("a", 1890)] == pytest.approx(1 / 11)
    assert got[("b", -10)] == 0.5 and got[("b", 0)] == 0.5 and len(got) == 4
    assert B.row_sum_violations(B.bin_weights(d)).count() == 0


def test_weights_equal_enumeration(spark):
    spans = [("r%d" % i, s, e) for i, (s, e) in enumerate([(-25, 37), (1, 1), (-1, -1), (-10, 9), (7, 33), (-100, -91)])]
    for size in (1, 3, 10):
        got = {(r[0], r[1]): r[2] for r in B.bin_weights(spark.createDataFrame(spans, "artwork_id string, date_start int, date_end int"), size).select("artwork_id", "bin_start", "weight").collect()}
        want = {}
        for i, s, e in spans:
            years = [y for y in range(s, e + 1) if y]
            for y in years:
                k = (i, y // size * size)
                want[k] = want.get(k, 0) + 1 / len(years)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_bins_widen_and_label(spark):
    d = spark.createDataFrame([("a", 5, 12)], "artwork_id string, date_start int, date_end int")
    got = [(r["bin_key"], r["bin_label"]) for r in B.extent_bins(d, D.DateRules(earliest=-5)).collect()]
    assert got == [("-10:-1", "10–1 BCE"), ("0:9", "1–9 CE"), ("10:19", "10–19 CE")]
    assert [r["bin_start"] for r in B.extent_bins(d.withColumn("date_start", F.lit(-2)).withColumn("date_end", F.lit(2)), D.DateRules(bin_size=1)).collect()] == [-2, -1, 1, 2]


def test_clip(spark):
    d = spark.createDataFrame([(1, 10), (5, 90), (95, 99), (None, None)], "norm_start int, norm_end int")
    assert sorted(map(tuple, D.clip_interval(d, D.DateRules(earliest=20, latest=50)).collect()), key=str) == [(20, 50), (None, None)]


def test_config_is_checked():
    for bad in ({"bin_size": 0}, {"earliest": 0}, {"earliest": 5, "latest": 1}, {"around": -1}):
        with pytest.raises(ValueError):
            D.DateRules(**bad)
