"""Queries over series, retrieval, diagnostics and evidence, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.functions import text as X
from epochlens.functions import vectors as V
from epochlens.functions.base import spread, written
from epochlens.operators import bins as B
from epochlens.operators import evidence as E
from epochlens.operators import retrieval as R
from epochlens.operators import series as S
from epochlens.operators import sweep as SW
from epochlens.plans import testbed as T

#: Terms of the keyword queries: id and normalized text.
TERMS = [("t0", "red widget"), ("t1", "small ring"), ("t2", "economy"), ("t3", "widget")]
SHARE = 0.05


def _terms(spark: SparkSession, stem: bool = False) -> DataFrame:
    return X.phrase_tokens(spark.createDataFrame(TERMS, "query_id string, normalized string"), stem)


def _keyword(spark: SparkSession, sf_dir: str, field: str | None = None, stem: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, matches, objects): objects are written once; names and types are few, so phrases are matched on the distinct
    ones and joined back; sums over bins come from the intervals of the objects and of the matches."""
    o = written(T.objects(spark, sf_dir), "objects")
    parts = o.select("title", "tags").distinct().withColumn("part", F.xxhash64("title", "tags"))
    hits = X.phrase_matches(X.tokenized(parts, "part", ["title", "tags"], stem), _terms(spark, stem), field)
    found = parts.join(hits, F.col("part") == F.col("id")).select("title", "tags", "query_id")
    matched = o.join(found, ["title", "tags"])
    points = SW.interval_series(matched, SW.interval_denominators(o, B.extent_bins(o)), _terms(spark))
    return points, matched.select("query_id", F.col("artwork_id").alias("id")), o


def _shown(points: DataFrame) -> DataFrame:
    return points.select("query_id", "bin_index", "bin_key", F.round("hit_mass", 5).alias("hit_mass"), F.round("value", 7).alias("value"), "object_count", "cluster_count", "below_minimum")


def keyword_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_keyword(spark, sf_dir)[0])


def keyword_fielded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_keyword(spark, sf_dir, "tags")[0])


def keyword_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_keyword(spark, sf_dir, stem=True)[0])


def keyword_total_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, matches, o = _keyword(spark, sf_dir)
    eligible = matches.join(o.where("public_domain").select(F.col("artwork_id").alias("id")), "id", "left_semi").groupBy("query_id").agg(F.count_distinct("id").alias("eligible_matches"))
    return matches.groupBy("query_id").agg(F.count_distinct("id").alias("total_matches")).join(eligible, "query_id", "left").withColumn("eligible_matches", F.coalesce("eligible_matches", F.lit(0)))


def peak_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.peak_bins(_keyword(spark, sf_dir)[0]).select("query_id", "bin_key", F.round("value", 7).alias("value"))


def timeline_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = written(T.objects(spark, sf_dir).select("physical_object_id", "visual_cluster_id", "date_start", "date_end"), "objects")
    d = SW.interval_denominators(o, B.extent_bins(o))
    return S.trimmed_timeline(d, 2000.0).select("bin_index", "bin_key", F.round("eligible_weight", 5).alias("eligible_weight"))


def timeline_viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.timeline_viewport(_keyword(spark, sf_dir)[0].withColumn("hit_mass", F.round("hit_mass", 6)))


def series_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.warnings(_keyword(spark, sf_dir, "tags")[0])


def relative_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("query_id"), F.date_format("ts", "HH").alias("key"))
    counts = e.groupBy("query_id", "key").agg(F.count("*").alias("hit_count"))
    return S.relative_density(counts, e.select("key").distinct(), counts).withColumn("value", F.round("value", 7))


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def tokenize_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.tokenized(T.table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return d.select("id", F.length("toks").alias("n_chars"), F.md5("toks").alias("digest"))


def hash_vectorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.hash_vectorize(T.table(spark, sf_dir, "pages"), "page_id", "url")
    return v.select(F.col("id").alias("page_id"), "index", F.round("value", 6).alias("value"))


def split_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.table(spark, sf_dir, "part").select(F.concat(F.lit('"'), "p_name", F.lit(', new", '), F.upper("p_type"), F.lit(", "), F.lower("p_type")).alias("query")).distinct()
    return X.split_query_terms(names)


def series_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    return p.select("p_name", "p_brand", X.series_key({"query": F.col("p_name"), "view": F.col("p_brand"), "metric": F.lit("share")}).alias("series_key"))


def _queries(vectors: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 50."""
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = T.vectors(spark, sf_dir)
    return v, written(R.exact_topk(_queries(v), v, SHARE), "hits")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


def topk_filtered_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.vectors(spark, sf_dir)
    return R.exact_topk(_queries(v), v.where("label in (1, 2, 3)"), SHARE).withColumn("score", F.round("score", 6))


def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.score_thresholds(_hits(spark, sf_dir)[1]).select("query_id", F.round("threshold", 6).alias("threshold"), "k")


def _denominators(v: DataFrame) -> DataFrame:
    return SW.interval_denominators(v, B.extent_bins(v), physical="vec_id", cluster="cluster", id_col="vec_id")


def concentration_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, hits = _hits(spark, sf_dir)
    v = v.withColumn("cluster", F.col("vec_id") % 50)
    matched = hits.select("query_id", F.col("id").alias("vec_id")).join(v.drop("embedding"), "vec_id")
    p = SW.interval_series(matched, _denominators(v), hits, SHARE, cluster="cluster", id_col="vec_id")
    return p.select("query_id", "bin_index", "bin_key", F.round("hit_mass", 6).alias("hit_mass"), F.round("share", 7).alias("share"), F.round("lift", 6).alias("lift"), "object_count", "cluster_count")


def _prompts(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 50 between 1 and 3").select((F.col("vec_id") - F.col("vec_id") % 50).alias("query_id"), F.col("vec_id").alias("prompt_id"), "embedding")


def _prompt_jaccard(v: DataFrame) -> DataFrame:
    prompts = _prompts(v)
    return S.mean_jaccard(R.shared_hits(_queries(v), prompts, v, SHARE))


def prompt_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompt_jaccard(T.vectors(spark, sf_dir)).withColumn("prompt_jaccard", F.round("prompt_jaccard", 6))


def prompt_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.mean_vectors(_prompts(T.vectors(spark, sf_dir)), "query_id")
    return m.select("query_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, hits = _hits(spark, sf_dir)
    controls = R.pair_scores(R.sampled_others(hits, _queries(v), v, S.CONTROLS, S.control_order()), _queries(v), v)
    return S.signal_diagnostics(S.control_statistics(hits, controls), _prompt_jaccard(v))


def signal_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 5).alias(c) for c in ("hit_mean", "control_mean", "control_std", "separation", "prompt_jaccard")]
    return _diagnostics(spark, sf_dir).select("query_id", *rounded, F.array_join("reasons", "; ").alias("reasons"), "low_signal")


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the place of each query's last hit: the hits grow with the square of the rows, so they are weighed where the rows are."""
    v = T.vectors(spark, sf_dir)
    corpus, c, queries = (written(spread(d), "corpus") for d in (v.select(F.col("vec_id").alias("id"), "embedding"), E.dated(v, "vec_id"), _queries(v)))
    n, bound = R.largest_score(queries, corpus)
    places = R.last_places(queries, corpus, R.retrieval_size(n, SHARE), bound).join(queries, "query_id")
    places = written(places.select("query_id", "embedding", F.col("score").alias("below"), F.col("last_id").alias("below_id")), "places")
    mass = R.hit_mass(places, c, bound).withColumns({x: F.lit(None).cast("long") for x in "oc"})  # a peak takes no counts
    points = S.points_of_mass(mass, _denominators(v.withColumn("cluster", F.col("vec_id") % 50)), places, SHARE)
    return E.slices_at(places, c, S.peak_bins(points), bound)


def evidence_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir).withColumns({"score": F.round("score", 6), "weight": F.round("weight", 6)})


def evidence_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.interleaved(_slices(spark, sf_dir)).select("query_id", "bin_key", "id", "slice", "ord")


def _contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that match a term and have weight in the term's peak bin."""
    points, matches, o = _keyword(spark, sf_dir)
    peaks = F.broadcast(S.peak_bins(points).select("query_id", "bin_key", "bin_start"))  # a row a term
    rows = o.join(peaks).where(B.weight_in(F.col("bin_start")) > 0)  # before the shuffle, as most rows are in other bins
    rows = rows.select("query_id", F.col("artwork_id").alias("id"), "bin_key", "public_domain", (F.col("tags") == "ECONOMY").alias("image_available"), F.regexp_extract("artwork_id", "^L_([0-9]+)_", 1).cast("bigint").alias("number"))
    return matches.join(rows, ["query_id", "id"])


def evidence_tiered_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tiered_pool(_contributors(spark, sf_dir)).select("query_id", "bin_key", "id", "tier", "rank")


def evidence_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lcg_sample(_contributors(spark, sf_dir), E.fnv1a32("red widget:0:9"), "number").select("query_id", "id", "public_domain", "rank")


def evidence_image_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.image_first(_contributors(spark, sf_dir)).select("query_id", "id", "image_available", "rank")


QUERIES = [keyword_frequency, keyword_fielded, keyword_stemmed, keyword_total_matches, peak_bin, timeline_trim, timeline_viewport, series_warnings, relative_density, tokenize_documents, tokenize_stem, hash_vectorize, split_query_terms, series_key, vector_topk, topk_filtered_first, score_threshold, concentration_lift, prompt_jaccard, prompt_mean_vector, signal_diagnostics, evidence_slices, evidence_interleaved, evidence_tiered_pool, evidence_lcg, evidence_image_first]

_TERMS = "terms(query_id, phrase) as (values " + ", ".join(f"('{i}', ' {t} ')" for i, t in TERMS) + ")"
_TOKS = lambda c: rf"' ' || array_to_string(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), ' ') || ' '"


def _keyword_sql(fields: str) -> str:
    hit = " or ".join(f"contains({_TOKS(f)}, phrase)" for f in fields.split())
    return f"""{T.OBJECTS_SQL}, {_TERMS}, {T.weights_sql('objects', 'artwork_id', 'physical_object_id, visual_cluster_id')}, {T.bins_sql('objects')},
      d as (select bin_start, sum(weight) denominator from weights group by 1),
      p as (select distinct title, tags from objects), m as (select query_id, artwork_id, title, tags, public_domain from objects join (select * from p, terms where {hit}) using (title, tags)),
      s as (select query_id, bin_start, sum(weight) mass, count(*) o, count(distinct visual_cluster_id) c from m join weights using (artwork_id) group by 1, 2),
      points as (select query_id, bin_index, bin_key, bin_start, coalesce(mass, 0) hit_mass, case when denominator > 0 then coalesce(mass, 0) / denominator else 0 end as value, coalesce(o, 0) object_count, coalesce(c, 0) cluster_count, coalesce(denominator, 0) denominator
        from bins cross join terms left join d using (bin_start) left join s using (query_id, bin_start))"""


_POINTS = "select query_id, bin_index, bin_key, round(hit_mass, 5) hit_mass, round(value, 7) as value, object_count, cluster_count, denominator < 20 below_minimum from points"
_TOP = lambda queries, corpus, name: f"""{name}_k as (select greatest(1, ceil({SHARE} * count(*)))::int k from {corpus}),
      {name}_s as (select q.query_id, c.vec_id id, list_dot_product(q.embedding, c.embedding) score from {queries} q, {corpus} c),
      {name} as (select query_id, id, score, rank::int rank, k from (select *, row_number() over (partition by query_id order by score desc, id) rank from {name}_s), {name}_k where rank <= k)"""  # noqa: E731
_VEC = f"{T.VECTORS_SQL}, q as (select vec_id query_id, embedding from vectors where vec_id % 50 = 0), {_TOP('q', 'vectors', 'hits')}"
_LIFT = f"""{_VEC}, cv as (select *, vec_id % 50 as cluster from vectors), {T.weights_sql('cv', 'vec_id', 'cluster')}, {T.bins_sql('vectors')},
      d as (select bin_start, sum(weight) denominator from weights group by 1),
      s as (select query_id, bin_start, sum(weight) mass, count(*) o, count(distinct cluster) c from hits join weights on id = vec_id group by 1, 2),
      points as (select query_id, bin_index, bin_key, bin_start, coalesce(mass, 0) hit_mass, case when denominator > 0 then coalesce(mass, 0) / denominator else 0 end share, coalesce(o, 0) object_count, coalesce(c, 0) cluster_count, coalesce(denominator, 0) denominator
        from bins cross join q left join d using (bin_start) left join s using (query_id, bin_start))"""
_PROMPT = f"""{_VEC}, pq as (select vec_id query_id, embedding from vectors where vec_id % 50 between 1 and 3), {_TOP('pq', 'vectors', 'phits')},
      pj as (select p.query_id prompt_id, p.query_id - p.query_id % 50 query_id, count(h.id) ab, count(*) b from phits p left join hits h on h.query_id = p.query_id - p.query_id % 50 and h.id = p.id group by 1, 2),
      j as (select query_id, avg(ab::double / ((select k from hits_k) + b - ab)) prompt_jaccard from pj group by 1)"""
_EVIDENCE = f"""{_LIFT}, pk as (select query_id, bin_key, bin_start from (select *, row_number() over (partition by query_id order by denominator >= 20 desc, share desc, bin_index) r from points) where r = 1),
      th as (select query_id, min(score) threshold from hits group by 1),
      period as (select a.query_id, bin_key, a.id, a.score, weight, h.id is not null contributor, threshold from hits_s a join pk using (query_id) join weights w on w.vec_id = a.id and w.bin_start = pk.bin_start join th using (query_id) left join hits h on h.query_id = a.query_id and h.id = a.id),
      mid as (select *, row_number() over (partition by query_id order by score, id) - 1 i, (count(*) over (partition by query_id) - 1) / 2.0 m from period where contributor),
      sl as (select query_id, bin_key, id, score, weight, contributor, 'strongest' slice, row_number() over (partition by query_id order by score desc, id) rank, 1 p from period where contributor
        union all select query_id, bin_key, id, score, weight, contributor, 'representative', row_number() over (partition by query_id order by abs(i - m), id), 2 from mid
        union all select query_id, bin_key, id, score, weight, contributor, 'borderline', row_number() over (partition by query_id order by abs(score - threshold), id), 3 from period
        union all select query_id, bin_key, id, score, weight, contributor, 'random_contributors', row_number() over (partition by query_id order by sha256('contributor:' || query_id || ':' || bin_key || ':' || id), id), 4 from period where contributor
        union all select query_id, bin_key, id, score, weight, contributor, 'best_non_contributors', row_number() over (partition by query_id order by score desc, id), 5 from period where not contributor
        union all select query_id, bin_key, id, score, weight, contributor, 'random_denominator', row_number() over (partition by query_id order by sha256('denominator:' || query_id || ':' || bin_key || ':' || id), id), 6 from period)"""
_CONTRIBUTORS = f"""{_keyword_sql('title tags')}, pk as (select query_id, bin_key, bin_start peak from (select *, row_number() over (partition by query_id order by denominator >= 20 desc, value desc, bin_index) r from points) where r = 1),
      con as (select query_id, artwork_id id, bin_key, public_domain, tags = 'ECONOMY' image_available, regexp_extract(artwork_id, '^L_([0-9]+)_', 1)::bigint number from m join pk using (query_id) join weights using (artwork_id) where bin_start = peak)"""

SQL = {
    "keyword_frequency": f"with {_keyword_sql('title tags')} {_POINTS}",
    "keyword_fielded": f"with {_keyword_sql('tags')} {_POINTS}",
    "keyword_total_matches": f"with {_keyword_sql('title tags')} select query_id, count(distinct artwork_id) total_matches, count(distinct artwork_id) filter (public_domain) eligible_matches from m group by 1",
    "peak_bin": f"with {_keyword_sql('title tags')} select query_id, bin_key, round(value, 7) as value from (select *, row_number() over (partition by query_id order by denominator >= 20 desc, value desc, bin_index) r from points) where r = 1",
    "timeline_trim": f"""with {T.OBJECTS_SQL}, {T.weights_sql('objects', 'artwork_id')}, {T.bins_sql('objects')}, x as (select bin_index, bin_key, coalesce(sum(weight), 0) w from bins left join weights using (bin_start) group by 1, 2)
      select bin_index, bin_key, round(w, 5) eligible_weight from x where bin_index between coalesce((select min(bin_index) from x where w >= 2000), -1e9) and coalesce((select max(bin_index) from x where w >= 2000), 1e9)""",
    "timeline_viewport": f"""with {_keyword_sql('title tags')}, z as (select query_id, bin_index, round(hit_mass, 6) h from points),
      y as (select *, sum(h) over (partition by query_id) t, sum(h) over (partition by query_id order by bin_index) l, sum(h) over (partition by query_id order by bin_index desc) r from z),
      x as (select query_id, min(bin_index) filter (h > 0 and l >= t * 0.1) a, max(bin_index) filter (h > 0 and r >= t * 0.1) b, max(bin_index) last from y group by 1),
      w as (select min(a) filter (a <= b) a, max(b) filter (a <= b) b, max(last) last from x)
      select greatest(0, a - greatest(2, ceil((b - a) * 0.06)))::int viewport_start, least(last, b + greatest(2, ceil((b - a) * 0.06)))::int viewport_end from w""",
    "series_warnings": f"""with {_keyword_sql('tags')}, x as (select query_id, sum(hit_mass) m, count(*) filter (denominator < 20) n from points group by 1)
      select query_id, 'no matches' warning from x where m = 0 union all select query_id, n || ' bins are below the minimum denominator' from x where n > 0""",
    "relative_density": """with c as (select event_type query_id, strftime(ts, '%H') as key, count(*) n from events group by 1, 2), g as (select * from (select distinct query_id from c), (select distinct key from c))
      select query_id, key, coalesce(n, 0) hit_count, round(coalesce(n, 0)::double / max(n) over (partition by query_id), 7) as value from g left join c using (query_id, key)""",
    "tokenize_documents": r"with t as (select doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+') t from documents) select doc_id, len(t)::bigint n_tokens, len(list_distinct(t))::bigint n_distinct from t",
    "hash_vectorize": r"""with u as (select page_id, lower(upper(coalesce(url, ''))) u, regexp_extract_all(lower(upper(coalesce(url, ''))), '[\p{L}\p{N}_]+') ws from pages),
      t as (select page_id, unnest(case when len(ws) > 0 then ws else [u] end) w from u), c as (select page_id, w, count(*) n, sha256(w) h from t group by 1, 2),
      p as (select page_id, n, h, unnest(range(0, 8)) i from c),
      s as (select page_id, (('0x' || substr(h, i * 4 + 1, 4))::int % 64)::int as index, sum(case when ('0x' || substr(h, 33 + i * 2, 2))::int % 2 = 1 then n else -n end) s from p group by 1, 2),
      m as (select page_id, sqrt(sum(s * s)) norm from s group by 1)
      select page_id, index, round(s / norm, 6) as value from s join m using (page_id) where norm > 0 and s <> 0""",
    "split_query_terms": """with q as (select distinct '"' || p_name || ', new", ' || upper(p_type) || ', ' || lower(p_type) query, p_name || ', new' a, upper(p_type) b from part),
      t as (select query, 0 ord, a label from q union all select query, 1, b from q)
      select query, ord, 'q-' || substr(sha256(lower(label)), 1, 12) query_id, label, lower(label) normalized, null::varchar error from t""",
    "series_key": """select distinct p_name, p_brand, sha256('{"metric":"share","query":"' || p_name || '","view":"' || p_brand || '"}') series_key from part""",
    "vector_topk": f"with {_VEC} select query_id, id, round(score, 6) score, rank, k from hits",
    "topk_filtered_first": f"with {T.VECTORS_SQL}, q as (select vec_id query_id, embedding from vectors where vec_id % 50 = 0), c as (select * from vectors where label in (1, 2, 3)), {_TOP('q', 'c', 'hits')} select query_id, id, round(score, 6) score, rank, k from hits",
    "score_threshold": f"with {_VEC} select query_id, round(min(score), 6) threshold, max(k) k from hits group by 1",
    "concentration_lift": f"with {_LIFT} select query_id, bin_index, bin_key, round(hit_mass, 6) hit_mass, round(share, 7) share, round(share / {SHARE}, 6) lift, object_count, cluster_count from points",
    "prompt_jaccard": f"with {_PROMPT} select query_id, round(prompt_jaccard, 6) prompt_jaccard from j",
    "prompt_mean_vector": f"""with {T.VECTORS_SQL}, n as (select vec_id - vec_id % 50 query_id, embedding, sqrt(list_dot_product(embedding, embedding)) l from vectors where vec_id % 50 between 1 and 3),
      e as (select query_id, unnest(embedding) / l x, generate_subscripts(embedding, 1) - 1 pos from n), a as (select query_id, pos, avg(x) x from e group by 1, 2), b as (select *, sqrt(sum(x * x) over (partition by query_id)) l from a)
      select query_id, pos::int pos, round(x / l, 6) x from b""",
    "signal_diagnostics": f"""with {_PROMPT}, rest as (select s.*, row_number() over (partition by s.query_id order by sha256('controls:v1:' || s.query_id || ':' || s.id), s.id) r from hits_s s left join hits h on h.query_id = s.query_id and h.id = s.id where h.id is null),
      c as (select query_id, avg(score) cm, stddev_pop(score) cs from rest where r <= 128 group by 1), h as (select query_id, avg(score) hm from hits group by 1), z as (select *, (hm - cm) / cs sep from h join c using (query_id) join j using (query_id))
      select query_id, round(hm, 5) hit_mean, round(cm, 5) control_mean, round(cs, 5) control_std, round(sep, 5) separation, round(prompt_jaccard, 5) prompt_jaccard,
             concat_ws('; ', case when sep < 1 then 'weak separation from controls' end, case when prompt_jaccard < 0.25 then 'prompts disagree' end) reasons, sep < 1 or prompt_jaccard < 0.25 low_signal from z""",
    "evidence_slices": f"with {_EVIDENCE} select query_id, bin_key, slice, rank::int rank, id, round(score, 6) score, round(weight, 6) weight, contributor from sl where rank <= 3",
    "evidence_interleaved": f"""with {_EVIDENCE}, f as (select *, row_number() over (partition by query_id, id order by rank, p) f from sl where rank <= 3)
      select query_id, bin_key, id, slice, (row_number() over (partition by query_id order by rank, p))::int ord from f where f = 1""",
    "evidence_tiered_pool": f"""with {_CONTRIBUTORS}, t as (select *, case when public_domain and image_available then 0 when public_domain then 1 else 2 end tier from con), b as (select *, min(tier) over (partition by query_id) best from t),
      r as (select *, row_number() over (partition by query_id order by sha256('evidence:' || query_id || ':' || bin_key || ':' || id), id) rank from b where tier = best)
      select query_id, bin_key, id, tier, rank::int rank from r where rank <= 25""",
    "evidence_lcg": f"""with {_CONTRIBUTORS}, r as (select *, row_number() over (partition by query_id order by public_domain desc, abs((number * 1103515245 + {E.fnv1a32('red widget:0:9')}) % 2147483647), number, id) rank from con)
      select query_id, id, public_domain, rank::int rank from r where rank <= 25""",
    "evidence_image_first": f"with {_CONTRIBUTORS}, r as (select *, row_number() over (partition by query_id order by image_available desc, id) rank from con) select query_id, id, image_available, rank::int rank from r where rank <= 12",
}
