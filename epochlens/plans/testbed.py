"""Views of the driver's tables in the shapes that the operators read, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_year(day: Column) -> Column:
    """Months since the start of 1998 as historical years: there is no zero."""
    m = (F.year(day) - 1998) * 12 + F.month(day) - 1
    return F.when(m >= 0, m + 1).otherwise(m)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as catalogued objects whose intervals reach from order to shipment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority").dropDuplicates(["o_orderkey"])
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_linestatus")
    a, b = month_year(F.col("o_orderdate")), month_year(F.col("l_shipdate"))
    return i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("_", F.lit("L"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("artwork_id"),
        F.concat(F.lit("O_"), "l_orderkey").alias("physical_object_id"),
        F.concat(F.lit("P_"), "l_partkey").alias("visual_cluster_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("tags"),
        F.col("p_brand").alias("department"),
        F.col("o_orderpriority").alias("facet"),
        (F.col("l_linestatus") == "F").alias("public_domain"),
        F.least(a, b).cast("int").alias("date_start"),
        F.greatest(a, b).cast("int").alias("date_end"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as dated objects, with label as the facet."""
    y, w = (F.col("vec_id") * 37) % 400 - 200, F.col("vec_id") % 23
    skip = lambda c: F.when(c >= 0, c + 1).otherwise(c).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"), skip(y).alias("date_start"), skip(y + w).alias("date_end"))


def date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A display date for each document, of one of eight forms."""
    y = F.lit(100) + F.col("doc_id") % 1900
    s = y.cast("string")
    forms = [F.concat(F.lit("ca. "), s), F.concat(F.lit("before "), s), F.concat(F.lit("after "), s), F.concat(s, F.lit("–"), (y + 12).cast("string")), F.concat(s, F.lit(" BCE")), F.concat(s, F.lit("-"), (y - 50).cast("string"), F.lit(" BCE")), F.lit("Undated"), s]
    chosen = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        chosen = F.when(F.col("doc_id") % 8 == k, form).otherwise(chosen)
    return table(spark, sf_dir, "documents").select("doc_id", y.cast("int").alias("y"), chosen.alias("date_display"))


_M = "(year({0}) - 1998) * 12 + month({0}) - 1"
_H = f"(case when {_M} >= 0 then {_M} + 1 else {_M} end)"
_A, _B = _H.format("o_orderdate"), _H.format("l_shipdate")

#: The same objects, vectors, weights and bins as common table expressions.
OBJECTS_SQL = f"""objects as (
  select concat_ws('_', 'L', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int) artwork_id,
         'O_' || l_orderkey physical_object_id, 'P_' || l_partkey visual_cluster_id, p_name title, p_type tags,
         p_brand department, o_orderpriority facet, l_linestatus = 'F' public_domain,
         least({_A}, {_B})::int date_start, greatest({_A}, {_B})::int date_end
  from lineitem join (select o_orderkey, min(o_orderdate) o_orderdate, min(o_orderpriority) o_orderpriority from orders group by 1) on l_orderkey = o_orderkey
  join part on l_partkey = p_partkey)"""
VECTORS_SQL = """vectors as (
  select vec_id, embedding::double[] embedding, label::int label,
         (case when (vec_id * 37) % 400 - 200 >= 0 then (vec_id * 37) % 400 - 199 else (vec_id * 37) % 400 - 200 end)::int date_start,
         (case when (vec_id * 37) % 400 - 200 + vec_id % 23 >= 0 then (vec_id * 37) % 400 - 199 + vec_id % 23 else (vec_id * 37) % 400 - 200 + vec_id % 23 end)::int date_end
  from embeddings)"""


def weights_sql(source: str, key: str, keep: str = "", name: str = "weights", size: int = 10) -> str:
    """bin_weights() of a relation, by overlap of each interval with generated bins."""
    keep = keep and keep + ", "
    return f"""{name} as (
  select {key}, {keep}bin_start, bin_end, n::double / (date_end - date_start + 1 - (date_start <= 0 and date_end >= 0)::int) weight from (
    select *, least(date_end, bin_end) - greatest(date_start, bin_start) + 1 - (greatest(date_start, bin_start) <= 0 and least(date_end, bin_end) >= 0)::int n from (
      select *, case when bin_start = 0 then {max(1, size - 1)} else bin_start + {size - 1} end bin_end from (
        select *, unnest(range((floor(date_start / {size}.0) * {size})::int, (floor(date_end / {size}.0) * {size})::int + 1, {size}))::int bin_start from {source})))
  where n > 0)"""


def bins_sql(source: str, name: str = "bins", size: int = 10) -> str:
    return f"""{name} as (
  select (row_number() over (order by bin_start) - 1)::int bin_index, bin_start || ':' || bin_end bin_key, bin_start, bin_end from (
    select bin_start, case when bin_start = 0 then {max(1, size - 1)} else bin_start + {size - 1} end bin_end from (
      select unnest(range((floor(min(date_start) / {size}.0) * {size})::int, (floor(max(date_end) / {size}.0) * {size})::int + 1, {size}))::int bin_start from {source})))"""
