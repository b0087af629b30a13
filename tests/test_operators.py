import hashlib
import os
import sqlite3
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.functions.base import new_path
from epochlens.functions import encoders, text, vectors
from epochlens.operators import bins, canonical, evidence, quality, retrieval, series
from epochlens.functions.dates import DateRules
from epochlens.sources import files


def test_porter_agrees_with_full_text_index():
    words = "horses relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky as is 18th no ties caresses".split()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize = 'porter unicode61 remove_diacritics 2')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    for i, w in enumerate(words):
        con.execute("insert into t(rowid, x) values (?, ?)", (i, w))
    want = dict(con.execute("select doc, term from v").fetchall())
    assert {w: text.porter(w) for w in words} == {w: want[i] for i, w in enumerate(words)}


def test_tokens_fold_and_split(spark):
    d = spark.createDataFrame([("Élan no_underscore 18th straße 東京 x²",)], "s string").select(text.tokens(F.col("s")).alias("t"))
    assert d.first()["t"] == ["elan", "no", "underscore", "18th", "straße", "東京", "x²"]


def test_phrases_stay_in_one_field(spark):
    d = spark.createDataFrame([(10, "Horses running", "ship"), (11, "big", "horse, running free"), (12, "horse", "running"), (13, None, "")], "id int, title string, tags string")
    terms = text.phrase_tokens(spark.createDataFrame([("q", "horse running"), ("none", "!!")], "query_id string, normalized string"))
    toks = text.tokenized(d, "id", ["title", "tags"])
    assert sorted(r["id"] for r in text.phrase_matches(toks, terms).collect()) == [10, 11]
    assert [r["id"] for r in text.phrase_matches(toks, terms, "title").collect()] == [10]


def test_split_query_terms(spark):
    rows = [('"still life, fruit", Horse , horse',), ('a ""b"" c',), ('"open',), ("a,,b",), ("x" * 501,), ("1,2,3,4,5,6",), ("Straße, STRASSE",), ("ＡＢ  c",)]
    got = {}
    for r in text.split_query_terms(spark.createDataFrame(rows, "query string")).collect():
        got.setdefault(r["query"], []).append(r["normalized"] if r["error"] is None else r["error"])
    assert got[rows[0][0]] == ["still life, fruit", "horse"]
    assert got['"open'] == ["unmatched quote"] and got["a,,b"] == ["empty term"] and got["1,2,3,4,5,6"] == ["too many terms"]
    assert got['a ""b"" c'] == ["a b c"] and got["x" * 501] == ["query is too long"]
    more = ['"a ""b"" c, d" e,f', '""",""" , x', ' "" ', "", 'a"b,c"d,"e"', 'p,"P",ｐ', '\u3000é\u2003,\tz\n']
    want = [[('a "b" c, d e', 'a "b" c, d e'), ("f", "f")], [('","', '","'), ("x", "x")], "empty term", "empty term", [("ab,cd", "ab,cd"), ("e", "e")], [("p", "p")], [("é", "é"), ("z", "z")]]
    rows = text.split_query_terms(spark.createDataFrame([(q,) for q in more] + [(None,)], "query string")).orderBy("query", "ord").collect()
    for q, w in zip([*more, None], [*want, "empty term"]):
        mine = [r for r in rows if r["query"] == q]
        assert [(r["label"], r["normalized"]) for r in mine] == w if isinstance(w, list) else [r["error"] for r in mine] == [w]
        assert all(r["query_id"] == "q-" + hashlib.sha256(r["normalized"].encode()).hexdigest()[:12] and r["ord"] == i for i, r in enumerate(mine) if r["error"] is None)
    assert got["Straße, STRASSE"] == ["straße", "strasse"] and got["ＡＢ  c"] == ["ab c"]


def test_series_and_peak(spark):
    o = spark.createDataFrame([(1, 1880, 1880, "c1"), (2, 1900, 1900, "c1"), (3, 1901, 1901, None), (4, 1902, 1902, "c2")], "artwork_id int, date_start int, date_end int, visual_cluster_id string")
    w = bins.bin_weights(o, keep=("visual_cluster_id",))
    d = bins.denominators(w, bins.extent_bins(o), count_rows=True)
    hits = spark.createDataFrame([("q", 1), ("q", 2)], "query_id string, id int")
    p = {r["bin_start"]: r for r in series.series_points(hits, w, d, hits).collect()}
    assert [p[b]["value"] for b in (1880, 1890, 1900)] == [1.0, 0.0, pytest.approx(1 / 3)]
    lift = {r["bin_start"]: r["lift"] for r in series.series_points(hits, w, d, hits, 0.01).collect()}
    assert lift[1900] == pytest.approx(100 / 3)
    peaks = series.series_points(hits, w, d, hits)
    assert series.peak_bins(peaks).first()["bin_start"] == 1880
    assert series.peak_bins(peaks, 2.0).first()["bin_start"] == 1900


def test_viewport_and_trim(spark):
    points = spark.createDataFrame([("q", i, float(m)) for i, m in enumerate([1, 0, 0, 0, 20, 30, 20, 0, 0, 0, 0, 1])], "query_id string, bin_index int, hit_mass double")
    assert tuple(series.timeline_viewport(points).first()) == (2, 8)
    assert tuple(series.timeline_viewport(points.withColumn("hit_mass", F.lit(0.0))).first()) == (0, 11)
    b = spark.createDataFrame([(0, 1.0), (1, 30.0), (2, 0.0), (3, 40.0), (4, 2.0)], "bin_index int, eligible_weight double")
    assert sorted(r[0] for r in series.trimmed_timeline(b).select("bin_index").collect()) == [1, 2, 3]
    assert series.trimmed_timeline(b, 1e9).count() == 5


def test_topk_ties_and_filter_first(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], i % 2) for i in range(10)], "vec_id int, embedding array<double>, label int")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert sorted(r["id"] for r in retrieval.exact_topk(q, v, 0.3).collect()) == [1, 3, 5]
    assert sorted(r["id"] for r in retrieval.exact_topk(q, v.where("label = 0"), 0.3).collect()) == [0, 2]


def test_topk_by_ranges_equals_window(spark):
    v = spark.range(500, numPartitions=6).select(F.col("id").alias("vec_id"), F.array((F.col("id") * 7 % 50).cast("double"), F.lit(1.0)).alias("embedding"))
    q = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [-1.0, 0.5])], "query_id string, embedding array<double>")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id", "score", "k").collect()))
    assert rows(retrieval.exact_topk(q, v, 0.1, group_limit=1)) == rows(retrieval.exact_topk(q, v, 0.1))


def test_dense_offsets(spark):
    d = spark.range(400, numPartitions=5).select(F.sha2(F.col("id").cast("string"), 256).alias("artwork_id"))
    got = sorted((r["artwork_id"], r["embedding_offset"]) for r in quality.dense_offsets(d).collect())
    assert [k for _, k in got] == list(range(400))


def test_vectors(spark):
    d = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    assert [r[0] for r in d.select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], None]
    assert {r["id"] for r in vectors.norm_violations(d, "id", "v").collect()} == {1, 2}
    f = spark.range(1).select(vectors.fixture_vector(F.lit("a"), 40).alias("v")).first()["v"]
    assert len(f) == 40 and np.linalg.norm(f) == pytest.approx(1)


def test_no_controls_and_constant_controls(spark):
    scores = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.1), ("q", 3, 0.1)], "query_id string, id int, score double")
    r = series.control_statistics(scores.where("id = 1"), scores.where("id > 1")).first()
    assert r["separation"] == 999.0
    assert series.control_statistics(scores, scores.limit(0)).first()["separation"] == 0.0


def test_canonical_details(spark):
    d = spark.createDataFrame([("MET_A_1", '["oil", " x "]', "null", "yes"), ("plain", "stone", "t", None), ("", "a", "b", "no")], "object_id string, materials string, title string, public_domain string")
    got = canonical.canonical_records(d).collect()
    assert (got[0]["institution"], got[0]["source_id"], got[0]["medium"], got[0]["title"], got[0]["public_domain"]) == ("met", "A_1", "oil; x", "", True)
    assert (got[1]["institution"], got[1]["source_id"], got[1]["public_domain"], got[1]["medium"]) == ("unknown", "plain", None, "stone")
    assert got[2]["reject_reason"] == "no id"
    with pytest.raises(ValueError, match="lacks columns"):
        canonical.museum_rows(spark.createDataFrame([("1",)], "`Object ID` string"))


def test_museum_rejects(spark):
    columns = ["Object ID", "Is Public Domain", "Object Date", "Object Begin Date", "Object End Date"]
    rows = [("1", "True", "", "1880", "1890"), ("2", "False", "", "1800", "1810"), ("3", "True", "", "1700", "1700"), ("4", "True", "Unknown", "0", "0"), ("5", "True", "", "-30", "-20"), ("6", "True", "", "-400000", "-300000")]
    ids = spark.createDataFrame([(1,), (2,), (4,), (5,)], "i int")
    kept, counts = canonical.museum_corpus(canonical.museum_rows(spark.createDataFrame(rows, columns), ids), DateRules(earliest=-15000, latest=2030))
    c = counts.first().asDict()
    assert c == {"input": 6, "kept": 4, "bad_id": 0, "no_date": 1, "out_of_bounds": 1, "not_public_domain": 1, "no_image": 2}
    assert kept.count() == 4


def test_image_url_and_paths(spark):
    d = spark.createDataFrame([("https://images.metmuseum.org/a/original/original/1.jpg",), ("http://x.org/original/1",), ("ftp://x/1",), (None,)], "u string")
    assert [r[0] for r in d.select(canonical.image_url_downscale(F.col("u"))).collect()] == ["https://images.metmuseum.org/a/web-large/original/1.jpg", "http://x.org/original/1", "", ""]
    p = spark.createDataFrame([("/r", "/abs"), ("/r/", "rel"), ("/r", "")], "r string, p string")
    assert [r[0] for r in p.select(canonical.image_path(F.col("r"), F.col("p"))).collect()] == ["/abs", "/r/rel", None]


def test_quality(spark):
    d = spark.createDataFrame([("a", "X", ["u", "v"]), ("b", "y", ["w"]), ("c", None, None)], "id string, f string, l array<string>")
    assert [r["id"] for r in quality.facet_filter(d, {"f": ["x", " "], "l": ["V"]}, ["f", "l"]).collect()] == ["a"]
    for bad in ({"id": ["a"]}, {"f": [" "]}):
        with pytest.raises(ValueError):
            quality.facet_filter(d, bad, ["f"])
    joined, problems = quality.with_images(d, spark.createDataFrame([("a", "i"), ("b", "i"), ("b", "j")], "id string, f string"), "id")
    assert {r["id"] for r in problems.collect()} == {"b", "c"}
    assert quality.first_seen(spark.createDataFrame([(1, "k"), (0, "k")], "o int, k string"), "k", "o").first()["o"] == 0


def test_evidence_cards_and_lcg(spark):
    rows = spark.createDataFrame([("1", "", "art", True), ("2", None, "", True)], "id string, title string, artist string, public_domain boolean")
    detail = spark.createDataFrame([("1", "Better", False), ("2", None, None)], "id string, title string, public_domain boolean")
    got = {r["id"]: r for r in evidence.evidence_cards(rows, detail).collect()}
    assert got["1"]["title"] == "Better" and not got["1"]["public_domain"]
    assert got["2"]["title"] == "Untitled" and got["2"]["public_domain"] and got["2"]["artist"] == "Unknown artist"
    assert evidence.fnv1a32("") == 2166136261 and evidence.fnv1a32("a") == 0xE40C292C


def test_csv_round_trip_and_guards(spark):
    d = tempfile.mkdtemp(prefix="spark-csv-")
    path = f"{d}/in.csv"
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write('object_ID,title\r\n1,"two\nlines, ""quoted"""\r\n2,\r\n')
    got = files.read_corpus_csv(spark, path, ("object_ID",)).collect()
    assert [tuple(r) for r in got] == [("1", 'two\nlines, "quoted"'), ("2", "")]
    with pytest.raises(ValueError, match="lacks"):
        files.read_corpus_csv(spark, path, ("Z", "A"))
    for bad in (("x/dirty.csv", ["a"]), ("x.csv", ["title_error"]), ("x.csv", ["Error_Type"])):
        with pytest.raises(ValueError, match="dirty"):
            files.reject_dirty(*bad)
    with open(f"{d}/ids.json", "w") as f:
        f.write('{"total": 3, "objectIDs": [3, 1, 3]}')
    assert sorted(r[0] for r in files.read_id_list(spark, f"{d}/ids.json").collect()) == [1, 3]


def test_inventory_and_checksums(spark):
    d = tempfile.mkdtemp(prefix="spark-inv-")
    for name in "ab":
        with open(f"{d}/{name}.txt", "w") as f:
            f.write(name)
    found = files.inventory(spark, d)
    manifest = found.union(spark.createDataFrame([("gone", 1, "x"), ("../up", 1, "x")], "path string, bytes long, sha256 string")).withColumn("sha256", F.when(F.col("path") == "a.txt", "0").otherwise(F.col("sha256")))
    assert {tuple(r) for r in files.checksum_mismatches(found, manifest).collect()} == {("gone", "missing"), ("../up", "outside"), ("a.txt", "digest")}
    m = files.build_manifest(spark.range(1).select(F.lit(1).alias("n")), spark.createDataFrame([(0, "0:9", 0, 9)], "bin_index int, bin_key string, bin_start int, bin_end int"), found, {"bin_size": 10})
    assert m.first()["manifest"] == m.first()["manifest"] and "0:9" in m.first()["manifest"]


def test_new_rows_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    new = spark.createDataFrame([(1, "z"), (3, "b"), (4, "c"), (4, "d")], "k int, s string")
    assert [tuple(r) for r in files.ordered_insert(new, old, ["k", "s"], "k")[0].collect()] == [(4, "c")]


def test_encoder_hooks(spark):
    t = spark.createDataFrame([(1, "horse"), (2, "ship")], "id int, normalized string")
    p = encoders.expand_prompts(t)
    assert p.count() == 6 and p.where("prompt_id = 0 and id = 1").first()["prompt"] == "horse"
    v = encoders.encode(t, lambda xs: np.array([[len(x), 1.0] for x in xs]), "normalized", "id", 2)
    assert np.linalg.norm(v.first()["embedding"]) == pytest.approx(1, abs=1e-6)
    found, missing = encoders.static_vectors(t, spark.createDataFrame([("HORSE", [1.0])], "text string, embedding array<double>"))
    assert found.count() == 1 and missing.first()["normalized"] == "ship"
    with pytest.raises(ValueError):
        encoders.expand_prompts(t, ["no place"])


def test_chosen_bins_and_models_must_exist(spark):
    points = spark.createDataFrame([("q", "0:9", 0, 1.0, 30.0)], "query_id string, bin_key string, bin_index int, value double, denominator double")
    assert series.peak_bins(points, bin_key="0:9").count() == 1
    with pytest.raises(ValueError, match="10:19"):
        series.peak_bins(points, bin_key="10:19")
    made = encoders.encode(spark.createDataFrame([("a",)], "t string"), lambda xs: np.ones((len(xs), 2)), "t", "t", 2, "m", "1")
    assert encoders.require_model(made, "m", "1").count() == 1
    with pytest.raises(ValueError, match="don't go"):
        encoders.require_model(made, "m", "2")


def test_cards_have_all_fields(spark):
    rows = spark.createDataFrame([("a b/ü", True, "u", 0.5, 0.25, False), ("c", False, "u", None, 1.0, True)], "id string, public_domain boolean, image_url string, score double, weight double, contributor boolean")
    got = {r["id"]: r for r in evidence.evidence_cards(rows, local_images=spark.createDataFrame([("a b/ü",)], "id string")).collect()}
    assert tuple(got["c"].asDict())[1:] == evidence.CARD_FIELDS and len(evidence.CARD_FIELDS) == 19
    assert got["a b/ü"]["image_url"] == "/v1/images/a%20b%2F%C3%BC" and got["c"]["image_url"] == "" and got["c"]["date_qualifier"] == "exact"
    assert (got["a b/ü"]["raw_score"], got["a b/ü"]["contribution_weight"], got["a b/ü"]["contributor"]) == (0.5, 0.25, False)


def test_a_bins_weights_are_several_files(spark):
    path = new_path(spark, "weights")
    w = spark.range(4000).select("id", F.lit(10).alias("bin_start"), F.lit(0.5).alias("weight"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_weights(w, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = spark.read.parquet(path)
    sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 2000


def test_stemming_shuffles_no_token(spark):
    rows = [(1, "Running horses ran"), (1, "horses"), (2, None), (3, "..."), (4, "relational " * 3000)]
    d = text.tokenized(spark.createDataFrame(rows, "id int, body string"), "id", ["body"])
    assert sorted(map(tuple, d.collect()))[:2] == [(1, "body", " hors "), (1, "body", " run hors ran ")] and d.count() == 3
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_inventory_in_parts(spark, monkeypatch):
    """Files over a part are hashed by several tasks: the digests are those of the whole bytes."""
    d = tempfile.mkdtemp(prefix="spark-parts-")
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, 300_000, np.uint8).tobytes()
    mark = b"\xef\xbb\xbf"
    contents = {"noise.parquet": noise, "ended.bin": noise + b"\n", "marked.csv": mark + noise, "marked_ended.csv": mark + noise + b"\n", "twice.csv": mark + mark + noise,
                "feeds.txt": b"\n" * 200_000, "long line.txt": b"x" * 250_000 + b"\r\n" + b"\0" * 9, "a=1/odd [x]{y}.txt": noise[::-1], "named.gz": noise, "small.txt": b"a"}
    os.makedirs(f"{d}/a=1")
    for name, data in contents.items():
        with open(f"{d}/{name}", "wb") as f:
            f.write(data)
    monkeypatch.setattr(files, "PART_BYTES", 64 << 10)
    parted, alone = [], files.sha256_in_parts
    monkeypatch.setattr(files, "sha256_in_parts", lambda s, path, n: parted.append(path) or alone(s, path, n))
    found = {r["path"]: (r["bytes"], r["sha256"]) for r in files.inventory(spark, d).collect()}
    assert found == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}
    assert len(parted) == 8


def test_manifest_inventory_reads_a_split_a_task(spark, monkeypatch):
    from epochlens.plans import history_queries

    d = tempfile.mkdtemp(prefix="spark-manifest-")
    data = np.random.default_rng(4).integers(0, 256, 200_000, np.uint8).tobytes()
    for name in ("lineitem.parquet", "orders.parquet"):
        with open(f"{d}/{name}", "wb") as f:
            f.write(data + name.encode())
    monkeypatch.setattr(files, "PART_BYTES", 64 << 10)
    jobs, run = [], type(spark.sparkContext).runJob
    monkeypatch.setattr(type(spark.sparkContext), "runJob", lambda sc, rdd, f, partitions=None, *a: jobs.append(partitions) or run(sc, rdd, f, partitions, *a))
    found = {r["path"]: r["sha256"] for r in history_queries.manifest_inventory(spark, d).collect()}
    assert found == {n: hashlib.sha256(data + n.encode()).hexdigest() for n in ("lineitem.parquet", "orders.parquet")}
    assert sorted(jobs) == [[i] for i in range(4) for _ in range(2)]


def test_inventory_reads_long_lines_and_compressed_names_in_parts(spark, monkeypatch):
    """No task reads a file of one line, or one named as compressed, as a whole."""
    d = tempfile.mkdtemp(prefix="spark-ranges-")
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, 3_000_001, np.uint8).tobytes()
    contents = {"run.bin": b"\0" * 3_000_000, "run in lines.csv": noise[:700_000] + b"x" * 1_500_000 + noise[-700_001:], "packed, {a}.gz": noise, "ended.bz2": noise[:2_000_000] + b"\n"}
    for name, data in contents.items():
        with open(f"{d}/{name}", "wb") as f:
            f.write(data)
    monkeypatch.setattr(files, "PART_BYTES", 256 << 10)
    sc = spark.sparkContext
    stages = lambda: {s.stageId(): s for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()))}
    earlier = set(stages())
    found = {r["path"]: (r["bytes"], r["sha256"]) for r in files.inventory(spark, d).collect()}
    assert found == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    read = [s.inputBytes() / s.numTasks() for k, s in stages().items() if k not in earlier]
    assert len(read) > 40 and 200_000 < max(read) < 600_000
