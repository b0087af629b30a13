"""Queries over the text index, sketches, ordered loads, array files, bundles and the series store, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.functions import text as X
from epochlens.functions.base import new_path, written
from epochlens.operators import bins as B
from epochlens.operators import judging as J
from epochlens.operators import quality as Q
from epochlens.operators import retrieval as R
from epochlens.operators import sketches as K
from epochlens.operators import sweep as SW
from epochlens.operators.store import SeriesStore
from epochlens.operators.textindex import TextIndex
from epochlens.plans import testbed as T
from epochlens.sources import files, npy


def _phrases(docs: DataFrame) -> DataFrame:
    """Words 3 to 5 of each document whose id is divisible by 50."""
    t = docs.where("doc_id % 50 = 0").select("doc_id", X.tokens(F.col("text")).alias("t")).where("size(t) >= 5")
    return t.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice("t", 3, 3), " ").alias("normalized"))


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often phrases of documents stand in all documents, by an index that took the documents in five parts."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    index = TextIndex(spark, new_path(spark, "index"), buckets=8)
    for part in range(5):
        index.append(d.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == part), "doc_id", ["text"])
    return index.phrases(_phrases(d)).select("query_id", F.col("id").alias("doc_id"), "n_hits")


def sketched_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts a bin from sketches of two batches, and whether they are within 5 % of the exact ones."""
    o = written(T.objects(spark, sf_dir).select("physical_object_id", "visual_cluster_id", "date_start", "date_end"), "objects")
    values = {c: F.col(c) for c in ("physical_object_id", "visual_cluster_id")}
    halves = [K.bin_sketches(o.where(F.pmod(F.xxhash64("physical_object_id"), F.lit(2)) == k), values) for k in range(2)]
    guess = K.estimates(K.united(halves[0].union(halves[1]), list(values)), list(values))
    exact = SW.interval_distinct(o, F.col("physical_object_id")).withColumnRenamed("n", "o").join(SW.interval_distinct(o, F.col("visual_cluster_id")).withColumnRenamed("n", "c"), "bin_start")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), F.col(b) * 0.05)
    d = guess.join(exact, "bin_start")
    return d.select("bin_start", F.col("rows").alias("row_count"), F.col("o").alias("object_count"), F.col("c").alias("cluster_count"), (near("physical_object_id", "o") & near("visual_cluster_id", "c")).alias("near"))


def ordered_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the order of their ids into a table with three unique keys, in two steps with a cursor between."""
    e = T.table(spark, sf_dir, "events").select("event_id", "user_id", F.concat_ws("-", "event_type", (F.col("event_id") % 41).cast("string")).alias("slot"), F.when(F.col("event_id") % 3 > 0, F.floor(F.col("value")).cast("long") % 300).alias("shelf"))
    keys = ["user_id", "slot", "shelf"]
    half = e.count() // 2
    first, cursor = files.ordered_insert(e, e.limit(0), keys, "event_id", limit=half)
    first = written(first, "inserted")
    rest, _ = files.ordered_insert(e, first, keys, "event_id", after=cursor)
    return first.union(rest).withColumn("shelf", F.coalesce("shelf", F.lit(-1)))


def bundle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What writing the dated documents and their weights tells of them; every seventh is undated, every eleventh reversed."""
    o = T.date_strings(spark, sf_dir).select(F.col("doc_id").alias("artwork_id"), F.when(F.col("doc_id") % 7 > 0, F.col("y")).alias("date_start"), (F.col("y") + F.when(F.col("doc_id") % 11 == 0, -3).otherwise(F.col("doc_id") % 90)).cast("int").alias("date_end"))
    return Q.write_bundle(o, new_path(spark, "bundle"), earliest=110, latest=1900).withColumn("total", F.round("total", 6))


def denominator_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored denominators of which every fifth bin's is spoiled, against the weights."""
    o = written(T.objects(spark, sf_dir).select("artwork_id", "physical_object_id", "visual_cluster_id", "date_start", "date_end"), "objects")
    d = SW.interval_denominators(o, B.extent_bins(o)).withColumn("eligible_weight", F.col("eligible_weight") + F.when(F.col("bin_index") % 5 == 0, 1.0).otherwise(0.0))
    return B.denominator_violations(B.bin_weights(o), d).select("bin_start", F.round("stored", 5).alias("stored"), F.round("actual", 5).alias("actual"))


def npy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to array files in the order of their ids and back, their lengths checked."""
    npy.register(spark)
    v = T.table(spark, sf_dir, "embeddings").where("label <> 3")
    path = new_path(spark, "vectors")
    v.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("embedding").write.format("npy").mode("append").save(path)
    d = spark.read.format("npy").option("checkNorms", "true").load(path)
    return d.select("row", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0], 5).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def stored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts a type and user group out of a store that was asked for some of them before; computed tells which call did."""
    e = T.table(spark, sf_dir, "events").withColumn("user_group", F.col("user_id") % 10)
    store = SeriesStore(spark, new_path(spark, "series"), "v1")
    asked = store.keyed(e.select("event_type", "user_group").distinct(), {"event_type": F.col("event_type"), "user_group": F.col("user_group").cast("string")})

    def compute(call: int):
        return lambda missing: e.join(missing, ["event_type", "user_group"]).groupBy("series_key", "event_type", "user_group").agg(F.count("*").alias("n"), F.lit(call).alias("computed"))

    store.fetch(asked.where("user_group < 4"), compute(1))
    return store.fetch(asked, compute(2)).select("event_type", "user_group", "n", "computed")


def centred_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.date_strings(spark, sf_dir).select("doc_id", (F.col("y") - 900).alias("a"), (F.col("y") - 900 + F.col("doc_id") % 83).alias("b"))
    year = lambda c: F.when(F.col(c) >= 0, F.col(c) + 1).otherwise(F.col(c)).cast("int")
    o = o.select("doc_id", year("a").alias("date_start"), year("b").alias("date_end"))
    return B.bin_weights(o, id_col="doc_id", centred=True).select("doc_id", "bin_start", F.round("weight", 9).alias("weight"))


def graded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and discounted gain of each query's hits, with the labels of the same ids as judgments."""
    v = T.vectors(spark, sf_dir)
    hits = R.exact_topk(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 0.05)
    judged = T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + 2 * (F.lit(1) - F.col("toxic"))).alias("gain"))
    d = J.graded(hits, judged, k=10, relevant=3)
    return d.select("query_id", "judged", F.round("precision", 6).alias("precision"), F.round("dcg", 6).alias("dcg"), F.round("ndcg", 6).alias("ndcg"))


def topk_without_each_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.vectors(spark, sf_dir)
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return J.topk_without_each(queries, v, "label", 5).withColumn("score", F.round("score", 6))


QUERIES = [centred_weights, graded_hits, topk_without_each_label, phrase_hits, sketched_denominators, ordered_insert, bundle_report, denominator_violations, npy_round_trip, stored_series]

SQL = {
    "centred_weights": """with t as (select doc_id, (100 + doc_id % 1900)::int - 900 a, (100 + doc_id % 1900)::int - 900 + doc_id % 83 b from documents),
      y as (select doc_id, a, b, unnest(range(a, b + 1)) t from t),
      p as (select doc_id, (floor((case when t >= 0 then t + 1 else t end) / 10.0) * 10)::int bin_start, (t - a)::double / (b - a + 1) lo, (t - a + 1)::double / (b - a + 1) hi from y),
      c as (select doc_id, bin_start, case when hi <= 0.5 then 2 * hi * hi else 1 - 2 * (1 - hi) * (1 - hi) end - case when lo <= 0.5 then 2 * lo * lo else 1 - 2 * (1 - lo) * (1 - lo) end w from p)
      select doc_id, bin_start, round(sum(w), 9) weight from c group by all""",
    "graded_hits": f"""with {T.VECTORS_SQL}, s as (select q.vec_id query_id, c.vec_id id, list_dot_product(q.embedding, c.embedding) score from vectors q, vectors c where q.vec_id % 50 = 0),
      h as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from s) where rank <= 10),
      j as (select doc_id id, max(quality + 2 * (1 - toxic))::double gain from labels where quality is not null and toxic is not null group by 1),
      i as (select sum((2 ** gain - 1) / log2(r + 1)) ideal from (select gain, row_number() over (order by gain desc, id) r from j) where r <= 10),
      g as (select h.*, coalesce(gain, 0) gain from h left join j using (id))
      select query_id, count(*) filter (gain > 0) judged, round(count(*) filter (gain >= 3) / 10.0, 6)::double as precision, round(sum((2 ** gain - 1) / log2(rank + 1)), 6) dcg, round(sum((2 ** gain - 1) / log2(rank + 1)) / (select ideal from i), 6) ndcg from g group by 1""",
    "topk_without_each_label": f"""with {T.VECTORS_SQL}, s as (select q.vec_id query_id, c.vec_id id, c.label, list_dot_product(q.embedding, c.embedding) score from vectors q, vectors c where q.vec_id % 50 = 0),
      r as (select query_id, g.label left_out, id, score, row_number() over (partition by query_id, g.label order by score desc, id) rank from s, (select distinct label from vectors where label is not null) g where s.label is distinct from g.label)
      select query_id, left_out, id, round(score, 6) score, rank::int rank from r where rank <= 5""",
    "phrase_hits": r"""with t as (select doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+') t from documents),
      q as (select doc_id query_id, t[3] a, t[4] b, t[5] c from t where doc_id % 50 = 0 and len(t) >= 5),
      s as (select query_id, doc_id, len(list_filter(range(1, len(t) - 1), lambda i: t[i] = a and t[i + 1] = b and t[i + 2] = c)) n from q, t
            where contains(' ' || array_to_string(t, ' ') || ' ', ' ' || a || ' ' || b || ' ' || c || ' '))
      select query_id, doc_id, n::bigint n_hits from s where n > 0""",
    "sketched_denominators": f"""with {T.OBJECTS_SQL}, {T.weights_sql('objects', 'artwork_id', 'physical_object_id, visual_cluster_id')}
      select bin_start, count(*) row_count, count(distinct physical_object_id) object_count, count(distinct visual_cluster_id) cluster_count, true near from weights group by 1""",
    "ordered_insert": """with recursive e as (select row_number() over (order by event_id) n, event_id, user_id, event_type || '-' || event_id % 41 slot, case when event_id % 3 > 0 then floor(value)::bigint % 300 end shelf from events),
      s as (select 0::bigint n, []::bigint[] got, []::bigint[] users, []::varchar[] slots, []::bigint[] shelves union all
            select n, case when ok then list_append(got, event_id) else got end, case when ok then list_append(users, user_id) else users end, case when ok then list_append(slots, slot) else slots end, case when ok and shelf is not null then list_append(shelves, shelf) else shelves end
            from (select e.*, got, users, slots, shelves, not (list_contains(users, user_id) or list_contains(slots, slot) or coalesce(list_contains(shelves, shelf), false)) ok from s join e on e.n = s.n + 1))
      select event_id, user_id, slot, coalesce(shelf, -1) shelf from e where event_id in (select unnest(got) from s where n = (select max(n) from e))""",
    "bundle_report": """with y as (select doc_id, (100 + doc_id % 1900)::int y from documents),
      o as (select case when doc_id % 7 > 0 then y end s, y + case when doc_id % 11 = 0 then -3 else doc_id % 90 end e from y),
      w as (select unnest(range((floor(s / 10.0) * 10)::int, (floor(e / 10.0) * 10)::int + 1, 10)) from o where s <= e)
      select count(*) as rows, count(*) filter (s is null) undated, count(*) filter (s > e) reversed, 0::bigint year_zero, 0::bigint no_id, count(*) filter (coalesce(s < 110, false) or e > 1900) outside, min(s)::int first_year, max(e)::int last_year,
             (select count(*) from w) weights, 0::bigint bad_weights, count(*) filter (s <= e)::double total, 0::bigint weight_off, false ok from o""",
    "denominator_violations": f"""with {T.OBJECTS_SQL}, {T.weights_sql('objects', 'artwork_id')}, {T.bins_sql('objects')}, d as (select bin_start, sum(weight) w from weights group by 1)
      select bin_start, round(coalesce(w, 0) + 1, 5) stored, round(coalesce(w, 0), 5) actual from bins left join d using (bin_start) where bin_index % 5 = 0""",
    "npy_round_trip": "select row_number() over (order by vec_id) - 1 as row, len(embedding)::int dim, round(embedding[1]::double, 5) as first, round(list_sum(embedding::double[]), 4) total from embeddings where label <> 3",
    "stored_series": "select event_type, user_id % 10 user_group, count(*) n, case when user_id % 10 < 4 then 1 else 2 end::int computed from events group by all",
}
