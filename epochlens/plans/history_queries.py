"""Queries over objects, dates, coverage and loads, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.functions import dates as D
from epochlens.functions.base import written
from epochlens.operators import bins as B
from epochlens.operators import canonical as C
from epochlens.operators import quality as Q
from epochlens.operators import sweep as SW
from epochlens.plans import testbed as T
from epochlens.sources import files as S

W_OBJECTS = T.weights_sql("objects", "artwork_id", "physical_object_id, visual_cluster_id")
FACETS = {"department": ["brand#1", "Brand#2", "BRAND#3"], "facet": ["1-URGENT", "2-HIGH"]}


def interval_bin_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bin_weights(T.objects(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


def bin_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = written(T.objects(spark, sf_dir).select("physical_object_id", "visual_cluster_id", "date_start", "date_end"), "objects")
    return SW.interval_denominators(o, B.extent_bins(o)).withColumn("eligible_weight", F.round("eligible_weight", 5)).drop("bin_label")


def filtered_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = written(T.objects(spark, sf_dir), "objects")
    kept = Q.facet_filter(o, FACETS, ["department", "facet"])
    return SW.interval_denominators(kept, B.extent_bins(o), count_rows=True).withColumn("eligible_weight", F.round("eligible_weight", 5)).drop("bin_label")


def row_sum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights with every hundredth order's doubled, so that there is something to find."""
    w = B.bin_weights(T.objects(spark, sf_dir), keep=("physical_object_id",))
    spoiled = w.withColumn("weight", F.when(F.col("physical_object_id").endswith("00"), F.col("weight") * 2).otherwise(F.col("weight")))
    return B.row_sum_violations(spoiled).select("artwork_id", F.round("row_sum", 6).alias("row_sum"), "bad_weights")


def coverage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.objects(spark, sf_dir).withColumn("image_available", F.col("tags") == "ECONOMY")
    return Q.coverage(o, ["department", "tags", "facet", "public_domain"])


def build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.date_strings(spark, sf_dir).join(T.table(spark, sf_dir, "labels"), "doc_id", "left")
    r = D.normalize_dates(d).select(F.col("norm_start").alias("date_start"), F.col("norm_end").alias("date_end"), C.permission_status(F.col("quality") == 1, F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("permission_status"))
    return Q.build_counts(T.table(spark, sf_dir, "documents"), r, B.extent_bins(r))


def _museum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.date_strings(spark, sf_dir)
    i = F.col("doc_id")
    raw = d.select(
        F.when(i % 17 == 0, "x").otherwise(i.cast("string")).alias("Object ID"), F.when(i % 3 == 0, "True").otherwise("False").alias("Is Public Domain"),
        F.col("date_display").alias("Object Date"), F.when(i % 2 == 0, "0").otherwise((F.col("y") - 900).cast("string")).alias("Object Begin Date"), F.when(i % 2 == 0, "0").otherwise(F.col("y").cast("string")).alias("Object End Date"),
        F.concat(F.lit(" title "), i.cast("string")).alias("Title"), F.when(i % 5 == 0, "Paris").otherwise("").alias("City"), F.lit("France").alias("Country"),
    )
    ids = d.where("doc_id % 4 = 1").select("doc_id")
    return C.museum_rows(raw, ids)


def eligibility_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts = C.museum_corpus(_museum(spark, sf_dir), D.DateRules(earliest=150, latest=1700))
    return counts


def museum_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = C.museum_corpus(_museum(spark, sf_dir), D.DateRules(earliest=150, latest=1700))
    return kept.select("artwork_id", "title", "geography", "date_start", "date_end", "date_qualifier", "image_rights_uri")


def _normalized(d: DataFrame) -> DataFrame:
    """Undated rows show 0, which is no year."""
    years = [F.coalesce(c, F.lit(0)).alias(c) for c in ("norm_start", "norm_end")]
    return d.select("doc_id", "norm_display", *years, "norm_qualifier", "norm_method")


def date_normalize_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(D.normalize_dates(T.date_strings(spark, sf_dir)))


def date_normalize_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = T.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 7 == 0, "").otherwise((i % 300 + 1).cast("string")).alias("date_begin"), F.when(i % 11 == 0, "unknown").otherwise(F.concat((i % 200 + 1).cast("string"), F.lit(".0"))).alias("date_end"),
        F.when(i % 3 == 0, "True").otherwise("").alias("date_begin_bce"), F.when(i % 6 == 0, "yes").otherwise("").alias("date_end_bce"),
        F.when(i % 5 == 0, "ca.").when(i % 5 == 1, "before 1900").when(i % 5 == 2, "post").otherwise("").alias("date_qualifier"),
    )
    return _normalized(D.normalize_dates(d))


def shift_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.objects(spark, sf_dir).select("date_start", "date_end").distinct()
    return o.select("date_start", "date_end", D.shift_year(F.col("date_start"), 25).alias("later"), D.shift_year(F.col("date_end"), -25).alias("earlier"), D.format_year(F.col("date_start")).alias("shown"))


def bin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.extent_bins(T.objects(spark, sf_dir), D.DateRules(earliest=-120, latest=30))


def canonical_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = T.table(spark, sf_dir, "documents").select(
        F.concat(F.when(i % 4 == 0, "MET_").when(i % 4 == 1, "aic_").when(i % 4 == 2, "Other_A_").otherwise(""), i.cast("string")).alias("object_ID"),
        F.when(i % 6 == 0, "null").otherwise(F.concat(F.lit(" "), F.col("lang"))).alias("title"), F.when(i % 9 == 0, F.col("source")).alias("artist"), F.col("lang").alias("artist_name"),
        F.when(i % 2 == 0, '["oil", " canvas ", ""]').otherwise("bronze").alias("materials"), F.when(i % 3 == 0, '["cast"]').otherwise("").alias("techniques"),
        (i % 1000 + 1).cast("string").alias("date_begin"), F.when(i % 5 == 0, "T").when(i % 5 == 1, "no").otherwise("").alias("public_domain"),
        F.when(i % 8 == 0, "AB12").otherwise("").alias("image_sha256"), F.when(i % 3 == 1, "u").otherwise("").alias("image_url"), F.when(i % 7 == 0, "yes").otherwise("").alias("image_use_permitted"),
    )
    out = C.canonical_records(raw, revision="r1")
    return out.select("artwork_id", "institution", "source_id", "source_record_url", "visual_cluster_id", "title", "artist", "medium", "date_start", "date_qualifier", "public_domain", "image_available", "permission_status", "source_dataset_version")


def image_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.select(F.col("doc_id").alias("artwork_id"), C.permission_status(F.col("quality") == 1, F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("permission_status"), F.when(F.col("doc_id") % 10 > 0, "u").alias("image_url"), F.lit(None).cast("string").alias("image_path"))
    return Q.rights_gate(d).select("artwork_id", "permission_status", "gate_reason")


def two_source_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.col("c_name").alias("title"), (F.col("c_nationkey") % 2 == 0).alias("public_domain"))
    name = F.when(F.col("page_id") % 2 == 0, "MET_").when(F.col("page_id") % 3 == 0, " Met_").otherwise("MET2_")
    u = T.table(spark, sf_dir, "pages").select((F.col("page_id") * 7919 % 1009).alias("place"), F.concat(name, (F.col("page_id") % 500).cast("string")).alias("object_ID"), F.col("url").alias("image_url"))
    return C.two_source_intersection(c, u, order=("place",))


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epochlens.operators.evidence import salted_sample

    v = T.vectors(spark, sf_dir).select("vec_id", "label")
    return salted_sample(v, "seed-7", 40, "vec_id", F.col("label") != 3)


def membership_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return Q.membership(d, T.table(spark, sf_dir, "labels"), "doc_id", "doc_id", "labelled")


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicates(T.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def dense_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dense_offsets(T.objects(spark, sf_dir).select("artwork_id", "title"))


def named_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.vectors(spark, sf_dir)
    return Q.named_view(v, v.where("label in (1, 4)"), "vec_id").select("vec_id", "label", "date_start", "date_end")


def image_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://images.metmuseum.org/a/original/b/original/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("ftp://x/original/y")
    return T.table(spark, sf_dir, "pages").select("page_id", C.image_url_downscale(url).alias("image_url"), C.safe_id(F.col("url")).alias("url_is_safe_id"))


def _split_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = T.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0")


def incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _split_events(spark, sf_dir)
    return S.new_rows(new, old, "event_id")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return S.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


def load_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load_status(T.table(spark, sf_dir, "events"), "event_id")


def manifest_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.inventory(spark, sf_dir)


QUERIES = [interval_bin_weights, bin_denominators, filtered_denominators, row_sum_violations, coverage_profile, build_counts, eligibility_rejects, museum_corpus, date_normalize_display, date_normalize_source, shift_year, bin_labels, canonical_projection, image_permission, two_source_intersection, seeded_sample, membership_flag, duplicate_ids, dense_offsets, named_view, image_downscale, incremental_load, upsert_latest, load_status, manifest_inventory]

_Y = "(100 + doc_id % 1900)::int"
_BY = lambda xs: "case doc_id % 8 " + " ".join(f"when {k} then {x}" for k, x in enumerate(xs)) + " end"
_SHIFT = lambda y, o: f"({y} + {o} + case when {y} < 0 and {y} + {o} >= 0 then 1 when {y} > 0 and {y} + {o} <= 0 then -1 else 0 end)"
_LO = _BY(["y - 5", "y - 25", "y + 1", "y", "-y", "-y", "null", "y"])
_HI = _BY(["y + 5", "y - 1", "y + 25", "y + 12", "-y", "50 - y", "null", "y"])
_TEXT = _BY(["'ca. ' || y", "'before ' || y", "'after ' || y", "y || '–' || (y + 12)", "y || ' BCE'", "y || '-' || (y - 50) || ' BCE'", "'Undated'", "y::varchar"])
_MUSEUM_SQL = f"""t as (select doc_id, {_Y} y from documents),
n as (select doc_id, {_TEXT} shown, case when doc_id % 2 = 1 then case when y - 900 = 0 then y else least(y - 900, y) end else {_LO} end lo, case when doc_id % 2 = 1 then y else {_HI} end hi, doc_id % 3 = 0 pub, doc_id % 4 = 1 img from t),
r as (select *, case when doc_id % 17 = 0 then 'bad_id' when lo is null then 'no_date' when hi < 150 or lo > 1700 then 'out_of_bounds' end reason from n)"""
_FMT = lambda y: f"case when {y} < 0 then abs({y}) || ' BCE' else ({y})::varchar end"

SQL = {
    "interval_bin_weights": f"with {T.OBJECTS_SQL}, {T.weights_sql('objects', 'artwork_id')} select artwork_id, bin_start, bin_end, round(weight, 9) weight from weights",
    "bin_denominators": f"""with {T.OBJECTS_SQL}, {W_OBJECTS}, {T.bins_sql('objects')},
      d as (select bin_start, sum(weight) w, count(distinct physical_object_id) o, count(distinct visual_cluster_id) c from weights group by 1)
      select bin_start, bin_index, bin_key, bin_end, round(coalesce(w, 0), 5) eligible_weight, coalesce(o, 0) object_count, coalesce(c, 0) cluster_count from bins left join d using (bin_start)""",
    "filtered_denominators": f"""with {T.OBJECTS_SQL}, kept as (select * from objects where lower(department) in ('brand#1', 'brand#2', 'brand#3') and facet in ('1-URGENT', '2-HIGH')),
      {T.weights_sql('kept', 'artwork_id', 'physical_object_id, visual_cluster_id')}, {T.bins_sql('objects')},
      d as (select bin_start, sum(weight) w, count(*) o, count(distinct visual_cluster_id) c from weights group by 1)
      select bin_start, bin_index, bin_key, bin_end, round(coalesce(w, 0), 5) eligible_weight, coalesce(o, 0) object_count, coalesce(c, 0) cluster_count from bins left join d using (bin_start)""",
    "row_sum_violations": f"""with {T.OBJECTS_SQL}, {T.weights_sql('objects', 'artwork_id', 'physical_object_id')}
      select artwork_id, round(sum(weight * case when physical_object_id like '%00' then 2 else 1 end), 6) row_sum, 0::bigint bad_weights from weights where physical_object_id like '%00' group by 1""",
    "coverage_profile": f"""with {T.OBJECTS_SQL}, x as (select *, tags = 'ECONOMY' img from objects),
      u as (select 'department' dimension, department as value, * exclude (department) from x union all by name select 'tags' dimension, tags as value, * exclude (tags) from x union all by name select 'facet' dimension, facet as value, * exclude (facet) from x
            union all by name select 'public_domain' dimension, case when public_domain then 'True' else 'unknown' end as value, * from x)
      select dimension, value, count(*) row_count, count(*) dated_count, count(*) filter (public_domain) public_domain_count, count(*) filter (img) image_count from u group by 1, 2""",
    "build_counts": f"""with r as (select doc_id, y, {_LO} lo, {_HI} hi, case when quality = 1 then 'p' when toxic = 1 then 'e' else 'u' end s from (select doc_id, {_Y} y from documents) left join labels using (doc_id))
      select (select count(*) from documents) input_rows, count(*) canonical_rows, count(lo) dated_rows, count(*) filter (lo is null) unknown_date_rows, count(*) filter (s = 'u') unreviewed_images,
             (floor(max(hi) / 10.0) - floor(min(lo) / 10.0) + 1)::bigint bins from r""",
    "eligibility_rejects": f"with {_MUSEUM_SQL} select count(*) as input, count(*) filter (reason is null) kept, count(*) filter (reason = 'bad_id') bad_id, count(*) filter (reason = 'no_date') no_date, count(*) filter (reason = 'out_of_bounds') out_of_bounds, count(*) filter (doc_id % 17 <> 0 and not pub) not_public_domain, count(*) filter (doc_id % 17 <> 0 and not img) no_image from r",
    "museum_corpus": f"""with {_MUSEUM_SQL}, k as (select *, greatest(lo, 150)::int date_start, least(hi, 1700)::int date_end from r where reason is null)
      select 'MET_' || doc_id artwork_id, 'title ' || doc_id title, case when doc_id % 5 = 0 then 'Paris; France' else 'France' end geography, date_start, date_end, case when date_start = date_end then 'exact' else 'range' end date_qualifier,
             case when pub and img then '{C.CC0}' else '' end image_rights_uri from k""",
    "date_normalize_display": f"""with t as (select doc_id, {_Y} y from documents)
      select doc_id, {_TEXT} norm_display, coalesce({_LO}, 0)::int norm_start, coalesce({_HI}, 0)::int norm_end, {_BY(["'circa'", "'before'", "'after'", "'range'", "'exact'", "'range'", "'unknown'", "'exact'"])} norm_qualifier,
             {_BY(["'display_circa'", "'display_before'", "'display_after'", "'display_range'", "'display_exact'", "'display_range'", "'unknown'", "'display_exact'"])} norm_method from t""",
    "date_normalize_source": f"""with t as (select doc_id, case when doc_id % 7 = 0 then null else (doc_id % 300 + 1) * case when doc_id % 3 = 0 then -1 else 1 end end a,
             case when doc_id % 11 = 0 then null else (doc_id % 200 + 1) * case when doc_id % 6 = 0 then -1 else 1 end end b from documents),
      u as (select doc_id, least(coalesce(a, b), coalesce(b, a)) lo, greatest(coalesce(a, b), coalesce(b, a)) hi, case doc_id % 5 when 0 then 'circa' when 1 then 'before' when 2 then 'after' else '' end q from t),
      v as (select *, case when q <> '' then q when lo = hi then 'exact' else 'range' end k from u),
      w as (select doc_id, k, lo is null none, case when k = 'circa' and lo = hi then {_SHIFT('lo', '-5')} when k = 'before' then {_SHIFT('hi', '-25')} when k = 'after' then {_SHIFT('lo', '1')} else lo end s,
             case when k = 'circa' and lo = hi then {_SHIFT('hi', '5')} when k = 'before' then {_SHIFT('hi', '-1')} when k = 'after' then {_SHIFT('lo', '25')} else hi end e,
             case when k in ('before', 'after') or k = 'circa' and lo = hi then 'source_' || k when lo = hi then 'source_exact' else 'source_range' end m from v)
      select doc_id, case when none then 'Unknown' when k = 'before' then 'before ' || {_FMT(_SHIFT('e', '1'))} when k = 'after' then 'after ' || {_FMT(_SHIFT('s', '-1'))} when s = e then {_FMT('s')} else {_FMT('s')} || '–' || {_FMT('e')} end norm_display,
             coalesce(s, 0)::int norm_start, coalesce(e, 0)::int norm_end, case when none then 'unknown' else k end norm_qualifier, case when none then 'unknown' else m end norm_method from w""",
    "shift_year": f"with {T.OBJECTS_SQL}, x as (select distinct date_start, date_end from objects) select date_start, date_end, {_SHIFT('date_start', '25')}::int later, {_SHIFT('date_end', '-25')}::int earlier, {_FMT('date_start')} shown from x",
    "bin_labels": f"""with {T.OBJECTS_SQL}, e as (select least(min(date_start), -120) date_start, greatest(max(date_end), 30) date_end from objects), {T.bins_sql('e')}
      select *, case when bin_start < 0 and bin_end < 0 then abs(bin_start) || '–' || abs(bin_end) || ' BCE' else greatest(bin_start, 1) || '–' || bin_end || ' CE' end bin_label from bins""",
    "canonical_projection": """with i as (select *, doc_id i, case doc_id % 4 when 0 then 'MET_' when 1 then 'aic_' when 2 then 'Other_A_' else '' end || doc_id oid from documents),
      j as (select *, case i % 4 when 0 then 'met' when 1 then 'aic' when 2 then 'other' else 'unknown' end inst, case when i % 4 = 2 then 'A_' || i else i::varchar end sid from i)
      select oid artwork_id, inst institution, sid source_id, case inst when 'met' then 'https://www.metmuseum.org/art/collection/search/' || sid when 'aic' then 'https://www.artic.edu/artworks/' || sid else '' end source_record_url,
             case when i % 8 = 0 then 'sha256:ab12' else 'object:' || oid end visual_cluster_id, case when i % 6 = 0 then '' else lang end title, case when i % 9 = 0 then source else lang end artist,
             case when i % 2 = 0 then 'oil; canvas' else 'bronze' end || case when i % 3 = 0 then '; cast' else '' end medium, (i % 1000 + 1)::int date_start, 'exact' date_qualifier,
             case i % 5 when 0 then true when 1 then false end public_domain, i % 3 = 1 image_available, case when i % 5 = 0 then 'public-domain' when i % 7 = 0 then 'explicitly-permitted' else 'unreviewed' end permission_status, 'r1' source_dataset_version from j""",
    "image_permission": """with x as (select d.doc_id artwork_id, case when quality = 1 then 'public-domain' when toxic = 1 then 'explicitly-permitted' else 'unreviewed' end permission_status from documents d left join labels l using (doc_id)),
      y as (select *, case when permission_status = 'unreviewed' then 'unreviewed' when artwork_id % 10 = 0 then 'no image' end gate_reason from x) select * from y where gate_reason is not null""",
    "two_source_intersection": """with u as (select page_id * 7919 % 1009 place, case when page_id % 2 = 0 then 'MET_' when page_id % 3 = 0 then 'Met_' else 'MET2_' end || page_id % 500 id, (page_id % 500)::varchar source_id, trim(url) url from pages where page_id % 2 = 0 or page_id % 3 = 0),
      f as (select id, source_id, url image_url from (select *, row_number() over (partition by id order by place, url) r from u where url <> '') where r = 1)
      select source_id, c_name title, true public_domain, id artwork_id, image_url from customer join f on source_id = c_custkey::varchar where c_nationkey % 2 = 0""",
    "seeded_sample": "select vec_id, label::int label, sha256('seed-7' || chr(31) || vec_id) sample_rank from embeddings where label <> 3 order by 3, 1 limit 40",
    "membership_flag": "select doc_id, lang, doc_id in (select doc_id from labels) labelled from documents",
    "duplicate_ids": "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1",
    "dense_offsets": f"with {T.OBJECTS_SQL} select artwork_id, title, row_number() over (order by artwork_id) - 1 embedding_offset from objects",
    "named_view": f"with {T.VECTORS_SQL} select vec_id, label, date_start, date_end from vectors where label in (1, 4)",
    "image_downscale": r"select page_id, case page_id % 3 when 0 then 'https://images.metmuseum.org/a/web-large/b/original/' || page_id when 1 then url else '' end image_url, regexp_full_match(url, '[A-Za-z0-9_.:-]+') url_is_safe_id from pages",
    "incremental_load": "select event_id, user_id, event_type, value from events where event_id % 2 = 0 and event_id % 3 = 0",
    "upsert_latest": "select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events group by 1",
    "load_status": "select count(*) row_count, max(event_id) last_row_id from events",
}
