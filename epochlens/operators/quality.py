"""Profiles, filters and checks of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.functions.base import ranged_ranks
from epochlens.operators.bins import bin_weights, years_between


def coverage(df: DataFrame, dimensions: list[str], dated: str = "date_start", public: str = "public_domain", image: str = "image_available") -> DataFrame:
    """(dimension, value, row_count, dated_count, public_domain_count, image_count), one pass over the rows.

    A blank value, and false, count as unknown.
    """
    value = lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string").isin("", "false")), "unknown").otherwise(F.initcap(F.col(c).cast("string")) if dict(df.dtypes)[c] == "boolean" else F.col(c).cast("string"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), value(c).alias("value")) for c in dimensions])).alias("x")
    d = df.select(F.col(dated).isNotNull().alias("d"), F.coalesce(public, F.lit(False)).alias("p"), F.coalesce(image, F.lit(False)).alias("i"), pairs)
    return d.groupBy("x.dimension", "x.value").agg(F.count("*").alias("row_count"), F.count_if("d").alias("dated_count"), F.count_if("p").alias("public_domain_count"), F.count_if("i").alias("image_count"))


def build_counts(source: DataFrame, records: DataFrame, bins: DataFrame) -> DataFrame:
    """One row: rows read, canonical, dated and undated ones, bins, and records whose images nobody has reviewed."""
    of_records = records.agg(F.count("*").alias("canonical_rows"), F.count("date_start").alias("dated_rows"), F.count_if(F.col("date_start").isNull()).alias("unknown_date_rows"), F.count_if(F.col("permission_status") == "unreviewed").alias("unreviewed_images"))
    return source.agg(F.count("*").alias("input_rows")).join(of_records).join(bins.agg(F.count("*").alias("bins")))


def year_range(df: DataFrame, low: int, high: int, year: str = "date_start") -> DataFrame:
    """Rows whose year lies from low to high; undated ones go."""
    return df.where(F.col(year).between(low, high))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def facet_filter(df: DataFrame, filters: dict[str, list[str]], allowed: list[str]) -> DataFrame:
    """Rows that match every field in one of its values, regardless of case; list columns match by overlap."""
    types = dict(df.dtypes)
    for field, values in filters.items():
        if field not in allowed or field not in types:
            raise ValueError(f"{field} can't be filtered")
        wanted = sorted({v.strip().lower() for v in values} - {""})
        if not wanted:
            raise ValueError(f"{field} has no value")
        if types[field].startswith("array"):
            df = df.where(F.arrays_overlap(F.transform(field, lambda x: F.lower(x)), F.array(*map(F.lit, wanted))))
        else:
            df = df.where(F.lower(F.col(field).cast("string")).isin(wanted))
    return df


def named_view(df: DataFrame, view: DataFrame, id_col: str) -> DataFrame:
    """The dated rows whose id the view lists."""
    return df.where("date_start is not null and date_end is not null").join(view.select(id_col).distinct(), id_col, "left_semi")


def membership(df: DataFrame, ids: DataFrame, key: str, id_key: str, flag: str) -> DataFrame:
    """df with a flag that tells if its key is among ids."""
    known = ids.select(F.col(id_key).alias("__k")).distinct()
    return df.join(known, F.col(key) == F.col("__k"), "left").withColumn(flag, F.col("__k").isNotNull()).drop("__k")


def rights_gate(df: DataFrame, allow_unreviewed: bool = False) -> DataFrame:
    """Rows that block an embedding build, with the reason: unreviewed rights, or no image at all."""
    reason = F.when((F.col("permission_status") == "unreviewed") & ~F.lit(allow_unreviewed), "unreviewed").when((F.coalesce("image_url", F.lit("")) == "") & (F.coalesce("image_path", F.lit("")) == ""), "no image")
    return df.withColumn("gate_reason", reason).where("gate_reason is not null")


def with_images(corpus: DataFrame, images: DataFrame, key: str = "artwork_id") -> tuple[DataFrame, DataFrame]:
    """(joined, problems): corpus rows with their image row, whose columns win; ids without one or with several."""
    shared = [c for c in images.columns if c in corpus.columns and c != key]
    joined = corpus.drop(*shared).join(images, key, "left")
    problems = corpus.select(key).join(images.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")
    return joined, problems


def dense_offsets(df: DataFrame, key: str = "artwork_id", name: str = "embedding_offset") -> DataFrame:
    """df with the 0-based rank of key."""
    return ranged_ranks(df, [F.col(key)], [], name).withColumn(name, (F.col(name) - 1).cast("long"))


def first_seen(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def observed_write(df: DataFrame, path: str, metrics: dict[str, Column]) -> dict:
    """Write df as Parquet to a new path and return metrics of its rows, gathered by the tasks that write: no second scan."""
    seen = Observation()
    df.observe(seen, *[m.alias(k) for k, m in metrics.items()]).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return seen.get


#: What a bundle of objects and weights must not have any of.
FAULTS = ("undated", "reversed", "year_zero", "no_id", "outside", "bad_weights", "weight_off")


def write_bundle(objects: DataFrame, root: str, size: int = 10, id_col: str = "artwork_id", earliest: int | None = None, latest: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Write objects and their weights below root; one row about both, with what is wrong with them.

    Counted while the objects are written: rows, undated and reversed ones, those with a year zero, without an id and
    beyond the bounds. Counted while the weights are: rows, those that are negative, zero, not finite or over 1, and the sum of all, which
    must be the number of objects that have weights. ok says that every one of FAULTS is 0.
    """
    start, end = F.col("date_start"), F.col("date_end")
    low, high = F.lit(earliest).cast("int"), F.lit(latest).cast("int")
    dated = start.isNotNull() & end.isNotNull()
    weighed = dated & (start <= end) & (years_between(start, end) > 0)
    of_rows = observed_write(objects, f"{root}/objects", {
        "rows": F.count("*"), "undated": F.count_if(~dated), "reversed": F.count_if(start > end), "year_zero": F.count_if((start == 0) | (end == 0)), "no_id": F.count_if(F.col(id_col).isNull()),
        "outside": F.count_if((start < low) | (end > high)), "weighed": F.count_if(weighed), "first_year": F.min(start), "last_year": F.max(end),
    })
    w = F.col("weight")
    weights = bin_weights(objects.sparkSession.read.parquet(f"{root}/objects"), size, id_col)
    of_weights = observed_write(weights, f"{root}/weights", {"weights": F.count("*"), "bad_weights": F.count_if(F.isnan(w) | (w <= 0) | (w > 1 + tolerance)), "total": F.sum(w)})
    off = int(abs((of_weights["total"] or 0.0) - of_rows["weighed"]) > tolerance * max(1, of_rows["weighed"]))
    got = {**of_rows, **of_weights, "weight_off": off}
    kinds = {"first_year": "int", "last_year": "int", "total": "double"}
    row = {k: v for k, v in got.items() if k != "weighed"} | {"ok": not any(got[f] for f in FAULTS)}
    schema = ", ".join(f"{k} {kinds.get(k, 'boolean' if k == 'ok' else 'long')}" for k in row)
    return objects.sparkSession.createDataFrame([tuple(row.values())], schema)
