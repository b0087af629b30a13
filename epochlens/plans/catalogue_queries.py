"""Queries over sources and sinks, cards, images, encoders and terms, each with its DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.functions import encoders as N
from epochlens.functions import text as X
from epochlens.functions import vectors as V
from epochlens.functions.base import new_path, written
from epochlens.operators import bins as B
from epochlens.operators import canonical as C
from epochlens.operators import evidence as E
from epochlens.operators import quality as Q
from epochlens.operators import series as S
from epochlens.plans import testbed as T
from epochlens.sources import files


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with line breaks, commas and quotes through the CSV sink and the CSV source."""
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit('"'), F.col("text"), F.lit(',"')).alias("title"), F.lit("").alias("culture"))
    path = new_path(spark, "corpus")
    files.write_corpus(d, path, ["id", "title", "culture"], "csv")
    return files.read_corpus_csv(spark, path, ("id", "title")).select("id", F.md5("title").alias("digest"), "culture")


def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "objects")
    files.write_corpus(T.objects(spark, sf_dir), path, ["artwork_id", "title", "date_start"])
    return spark.read.parquet(path)


def weights_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of two bins out of the weight sink."""
    path = new_path(spark, "weights")
    files.write_weights(B.bin_weights(T.objects(spark, sf_dir)), path)
    return spark.read.parquet(path).where("bin_start in (0, 10)").select("artwork_id", "bin_start", F.round("weight", 9).alias("weight"))


def typed_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "customer").select(F.concat(F.lit("C_"), "c_custkey").alias("artwork_id"), F.when(F.col("c_custkey") % 7 == 0, "unknown").otherwise(F.col("c_custkey").cast("string")).alias("date_start"), F.when(F.col("c_nationkey") % 2 == 0, " True").otherwise("no").alias("public_domain"))
    path = new_path(spark, "typed")
    files.write_corpus(c, path, kind="csv")
    out = files.read_typed_corpus(files.read_corpus_csv(spark, path), ("date_start",), ("public_domain",))
    return out.withColumn("dateStart", F.coalesce("dateStart", F.lit(-1)))


def denominators_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = written(T.objects(spark, sf_dir), "objects")
    d = B.denominators(B.bin_weights(o, keep=("physical_object_id", "visual_cluster_id")), B.extent_bins(o))
    d = d.withColumnsRenamed({"object_count": "physical_object_count", "cluster_count": "visual_cluster_count"})
    path = new_path(spark, "denominators")
    files.write_corpus(d, path, kind="csv")
    return files.read_denominators(spark, path).drop("bin_label").withColumn("eligible_weight", F.round("eligible_weight", 5))


def embeddings_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through JSON, of which every third is spoiled, checked on reading."""
    v = T.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding")).alias("embedding"))
    path = new_path(spark, "vectors.json")
    v.write.json(path)
    read = files.read_embeddings(spark, path)
    return V.norm_violations(read, "vec_id").select("vec_id", "dim", F.round("norm", 4).alias("norm"))


def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of nations out of a snapshot file of one JSON object."""
    path = new_path(spark, "ids.json")
    n = T.table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.count("*").alias("total"), F.collect_list("n_nationkey").alias("objectIDs"))).alias("value"))
    n.write.text(path)
    return files.read_id_list(spark, path)


def manifest_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build's manifest says of its bins, artefacts and counts."""
    o = written(T.objects(spark, sf_dir), "objects")
    root = new_path(spark, "build")
    files.write_corpus(o, f"{root}/corpus")
    files.write_weights(B.bin_weights(o), f"{root}/weights")
    entries = files.table_entry(spark, root, "corpus", spark.read.parquet(f"{root}/corpus")).union(files.table_entry(spark, root, "weights", spark.read.parquet(f"{root}/weights")))
    m = files.build_manifest(o.agg(F.count("*").alias("canonical_rows")), B.extent_bins(o), entries, {"bin_size": 10}, "dates-1")
    m = m.select(F.from_json("manifest", "retrieved_at string, counts struct<canonical_rows: bigint>, date_rules struct<version: string>, bins array<struct<bin_index: int, bin_key: string>>, files array<struct<path: string, bytes: bigint, sha256: string, rows: bigint>>").alias("m"))
    total = F.aggregate("m.files", F.lit(0).cast("bigint"), lambda s, x: s + x["rows"])
    return m.select(F.explode("m.bins").alias("b"), total.alias("artefact_rows"), "m.counts.canonical_rows", "m.retrieved_at", "m.date_rules.version").select("b.bin_index", "b.bin_key", "artefact_rows", "canonical_rows", "retrieved_at", "version")


def checksum_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' files against a manifest in which one digest is wrong and one file is missing."""
    found = written(files.inventory(spark, sf_dir), "inventory")
    spoiled = found.withColumn("sha256", F.when(F.col("path") == "nation.parquet", F.lit("0")).otherwise(F.col("sha256"))).where("path in ('nation.parquet', 'region.parquet', 'part.parquet')")
    return files.checksum_mismatches(found, spoiled.union(found.where("path = 'region.parquet'").withColumn("path", F.lit("gone.parquet"))))


def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.year_range(T.vectors(spark, sf_dir), -50, 60).select("vec_id", "date_start")


def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose image row is missing or not the only one."""
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artwork_id"))
    p = T.table(spark, sf_dir, "pages").select((F.col("page_id") - F.col("page_id") % 3).alias("artwork_id"), F.col("url").alias("image_url"))
    return Q.with_images(c, p)[1]


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.first_seen(T.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def canonical_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record in its fixed order, as JSON, with offsets."""
    d = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("MET_"), F.col("doc_id").cast("string")).alias("object_ID"), F.col("lang").alias("title"), F.lit("1900").alias("date_begin"))
    c = C.canonical_corpus(C.canonical_records(d))
    return c.select("artwork_id", "embedding_offset", F.lit(",".join(c.columns)).alias("columns"), F.concat_ws("|", "institution", "source_id", "title", "date_start", "image_available").alias("shown"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("title"), F.lit("").alias("artist"), F.col("lang").alias("credit_line"), (F.col("doc_id") % 2 == 0).alias("public_domain"), F.concat(F.lit("u/"), "doc_id").alias("image_url"), F.lit(0.5).alias("weight"), F.col("n_chars").cast("int").alias("date_start"))
    y = T.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max(F.when(F.col("quality") == 1, "fine")).alias("title"), (F.max("toxic") == 0).alias("public_domain"))
    local = T.table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("id"))
    return E.evidence_cards(d, y, local)


def evidence_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(spark, sf_dir).select("id", "artwork_id", "visual_cluster_id", "title", "artist", "institution", "image_url", "date_display", "date_start", "date_qualifier", F.coalesce("raw_score", F.lit(-1.0)).alias("raw_score"), "contribution_weight", "contributor", "credit_line", "public_domain")


def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.vectors(spark, sf_dir).select("vec_id", "label")
    chosen = written(E.salted_sample(v, "seed-7", 40, "vec_id", F.col("label") != 3), "chosen")
    return E.selection_summary(v, chosen, "seed-7", 40, "vec_id")


def chosen_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type by hour, at one hour."""
    e = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("query_id"), F.date_format("ts", "HH").alias("bin_key"))
    return S.peak_bins(e.groupBy("query_id", "bin_key").agg(F.count("*").alias("value")), bin_key="12")


def series_object_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series in which each object is a cluster of its own."""
    o = written(T.objects(spark, sf_dir), "objects")
    w = B.bin_weights(o, keep=("physical_object_id", "visual_cluster_id"))
    hits = o.where("tags = 'ECONOMY'").select(F.lit("economy").alias("query_id"), F.col("artwork_id").alias("id"))
    p = S.series_points(hits, w, B.denominators(w, B.extent_bins(o)), hits, cluster=None)
    return p.select("query_id", "bin_index", F.round("value", 7).alias("value"), "object_count", "cluster_count")


def prompt_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.table(spark, sf_dir, "part").select(F.lower("p_name").alias("normalized")).distinct()
    return N.expand_prompts(t)


def encoded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names through an encoder of length, letters e, and one; its version is checked."""
    t = T.table(spark, sf_dir, "part").select("p_name").distinct()
    toy = lambda texts: np.array([[len(x), x.count("e"), 1.0] for x in texts])
    out = N.require_model(N.encode(t, toy, "p_name", "p_name", 3, "toy", "1"), "toy", "1")
    return out.select("id", F.posexplode("embedding").alias("pos", "x"), "model").withColumn("x", F.round(F.col("x").cast("double"), 5))


def static_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with a stored vector, and those without."""
    t = T.table(spark, sf_dir, "part").select(F.lower("p_name").alias("normalized")).distinct()
    stored = T.table(spark, sf_dir, "part").where("length(p_name) % 2 = 0").select(F.upper("p_name").alias("text"), F.array(F.length("p_name").cast("double")).alias("embedding")).distinct()
    found, missing = N.static_vectors(t, stored)
    return found.select("normalized", F.col("embedding")[0].alias("x")).union(missing.select("normalized", F.lit(-1.0)))


def fixture_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.table(spark, sf_dir, "part").select("p_name").distinct()
    return t.select("p_name", F.posexplode(V.fixture_vector(F.col("p_name"), 32)).alias("pos", "x")).withColumn("x", F.round("x", 6))


def normalized_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.table(spark, sf_dir, "part").select(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \t x ")).alias("term")).distinct()
    return t.select("term", X.normalize_term(F.col("term")).alias("normalized"))


def artist_and_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit(" "), "source", F.lit("\nborn 1900"))).alias("artist"), F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "/abs/x.jpg").otherwise(F.concat("lang", F.lit(".jpg"))).alias("path"))
    return d.select("doc_id", C.artist_first_line(F.col("artist")).alias("artist"), F.coalesce(C.image_path(F.lit("/root/images//"), F.col("path")), F.lit("none")).alias("path"))


QUERIES = [csv_round_trip, parquet_round_trip, weights_round_trip, typed_reread, denominators_round_trip, embeddings_round_trip, id_list, manifest_bins, checksum_mismatches, year_range, image_manifest, first_seen, canonical_corpus, evidence_cards, selection_summary, chosen_bin, series_object_clusters, prompt_expansion, encoded_terms, static_vectors, fixture_vectors, normalized_terms, artist_and_image]

SQL = {
    "csv_round_trip": """select doc_id::varchar id, md5('"' || text || ',"') digest, '' culture from documents""",
    "parquet_round_trip": f"with {T.OBJECTS_SQL} select artwork_id, title, date_start from objects",
    "weights_round_trip": f"with {T.OBJECTS_SQL}, {T.weights_sql('objects', 'artwork_id')} select artwork_id, bin_start, round(weight, 9) weight from weights where bin_start in (0, 10)",
    "typed_reread": """select 'C_' || c_custkey "artworkId", case when c_custkey % 7 = 0 then -1 else c_custkey end::int "dateStart", c_nationkey % 2 = 0 "publicDomain" from customer""",
    "denominators_round_trip": f"""with {T.OBJECTS_SQL}, {T.weights_sql('objects', 'artwork_id', 'physical_object_id, visual_cluster_id')}, {T.bins_sql('objects')},
      d as (select bin_start, sum(weight) w, count(distinct physical_object_id) o, count(distinct visual_cluster_id) c from weights group by 1)
      select bin_index, bin_key, bin_start, bin_end, round(coalesce(w, 0), 5) eligible_weight, coalesce(o, 0) physical_object_count, coalesce(c, 0) visual_cluster_count from bins left join d using (bin_start)""",
    "embeddings_round_trip": "select vec_id, len(embedding)::int dim, round(2 * sqrt(list_dot_product(embedding::double[], embedding::double[])), 4) norm from embeddings where vec_id % 3 = 0",
    "id_list": "select n_nationkey::bigint object_id from nation",
    "manifest_bins": f"""with {T.OBJECTS_SQL}, {T.weights_sql('objects', 'artwork_id')}, {T.bins_sql('objects')}
      select bin_index, bin_key, (select count(*) from objects) + (select count(*) from weights) artefact_rows, (select count(*) from objects) canonical_rows, 'not-recorded' retrieved_at, 'dates-1' as version from bins""",
    "checksum_mismatches": "select * from (values ('nation.parquet', 'digest'), ('gone.parquet', 'missing')) t(path, reason)",
    "year_range": f"with {T.VECTORS_SQL} select vec_id, date_start from vectors where date_start between -50 and 60",
    "image_manifest": "with p as (select page_id - page_id % 3 k, count(*) n from pages group by 1) select c_custkey artwork_id, coalesce(n, 0) n from customer left join p on k = c_custkey where coalesce(n, 0) <> 1",
    "first_seen": "select user_id, min(event_id) event_id, arg_min(event_type, event_id) event_type from events group by 1",
    "canonical_corpus": f"""select 'MET_' || doc_id artwork_id, row_number() over (order by 'MET_' || doc_id) - 1 embedding_offset, '{",".join(C.CANONICAL_FIELDS)}' as columns, 'met|' || doc_id || '|' || lang || '|1900|false' shown from documents""",
    "evidence_cards": """with y as (select doc_id, max(case when quality = 1 then 'fine' end) t, max(toxic) = 0 ok from labels group by 1), d as (select d.*, doc_id::varchar id, t, doc_id % 2 = 0 and coalesce(ok, true) pub from documents d left join y using (doc_id))
      select id, id artwork_id, id visual_cluster_id, coalesce(t, case when doc_id % 3 > 0 then source end, 'Untitled') title, 'Unknown artist' artist, 'Unknown institution' institution,
             case when doc_id % 5 = 0 then '/v1/images/' || id when pub then 'u/' || id else '' end image_url, 'Unknown date' date_display, n_chars::int date_start, 'exact' date_qualifier, -1.0::double raw_score, 0.5::double contribution_weight,
             true contributor, coalesce(lang, '') credit_line, pub public_domain from d""",
    "selection_summary": """with r as (select sha256('seed-7' || chr(31) || vec_id) h, label <> 3 ok from embeddings), c as (select h from r where ok order by h limit 40), n as (select count(*) k, max(h) last from c)
      select 40 requested_rows, k prepared_rows, (select count(*) from r) eligible_candidates, (select count(*) from r where k < 40 or h <= last) examined_candidates, (select count(*) from r where k < 40 or h <= last) - k sample_failures from n""",
    "chosen_bin": "select event_type query_id, '12' bin_key, count(*) as value from events where strftime(ts, '%H') = '12' group by 1",
    "series_object_clusters": f"""with {T.OBJECTS_SQL}, {T.weights_sql('objects', 'artwork_id', 'tags')}, {T.bins_sql('objects')},
      d as (select bin_start, sum(weight) w, sum(case when tags = 'ECONOMY' then weight else 0 end) m, count(*) filter (tags = 'ECONOMY') n from weights group by 1)
      select 'economy' query_id, bin_index, round(case when w > 0 then m / w else 0 end, 7) as value, coalesce(n, 0) object_count, coalesce(n, 0) cluster_count from bins left join d using (bin_start)""",
    "prompt_expansion": """with t as (select distinct lower(p_name) normalized from part), p(prompt_id, a) as (values (0, ''), (1, 'a photograph of '), (2, 'a museum object showing ')) select normalized, prompt_id, a || normalized prompt from t, p""",
    "encoded_terms": """with t as (select distinct p_name id from part), v as (select id, [len(id)::double, len(id) - len(replace(id, 'e', '')), 1.0] v from t)
      select id, i - 1 pos, round((v[i] / sqrt(list_dot_product(v, v)))::float::double, 5) x, 'toy' model from v, (values (1), (2), (3)) k(i)""",
    "static_vectors": "select distinct lower(p_name) normalized, case when len(p_name) % 2 = 0 then len(p_name) else -1 end::double x from part",
    "fixture_vectors": """with t as (select distinct p_name from part), h as (select p_name, sha256(p_name || chr(31) || '0') h from t), v as (select p_name, [('0x' || substr(h, i * 2 + 1, 2))::int - 127.5::double for i in range(0, 32)] v from h)
      select p_name, (i - 1)::int pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) x from v, range(1, 33) r(i)""",
    "normalized_terms": "select distinct '  ' || upper(p_name) || ' ' || chr(9) || ' x ' term, lower(p_name) || ' x' normalized from part",
    "artist_and_image": """select doc_id, case when doc_id % 4 = 0 then 'Unknown artist' else source end artist, case doc_id % 3 when 0 then 'none' when 1 then '/abs/x.jpg' else '/root/images/' || lang || '.jpg' end path from documents""",
}
