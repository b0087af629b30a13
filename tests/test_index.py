"""Text index, sketches, ordered insert, array files, bundles, stored series and streamed batches against plain Python."""

import random
import re
import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.functions import vectors
from epochlens.functions.base import new_path, release, tables_root, written
from epochlens.operators import bins, canonical, quality, sketches, sweep, textindex
from epochlens.operators.store import SeriesStore
from epochlens.sources import files, npy
from epochlens.sources.segments import Segments
from epochlens.streaming import incremental


def phrase_count(text, phrase):
    t, p = re.findall(r"[a-z0-9]+", (text or "").lower()), phrase.split()
    return sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1)) if p else 0


def test_phrases_by_shifted_positions(spark, monkeypatch):
    monkeypatch.setattr(textindex, "FAN", 3)
    rng = random.Random(1)
    words = ["a", "b", "c", "horse", "horses", "running", "run"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40))), rng.choice([None, "", "a b", "A, B. c"])) for i in range(120)]
    rows += [(3, "a b", None), (500, "a " * 5000, None), (501, None, None)]
    index = textindex.TextIndex(spark, new_path(spark, "index"), buckets=5)
    with pytest.raises(ValueError, match="no segment"):
        index.postings()
    schema = "id long, body string, note string"
    for k in range(5):
        index.append(spark.createDataFrame(rows[k::5], schema), "id", ["body", "note"])
    index.append(spark.createDataFrame(rows[::5], schema), "id", ["body", "note"])  # again: counts once
    assert sorted(s["tier"] for s in index.store.live()[1]) == [1, 1]
    phrases = ["a", "a b", "b a b", "horse running", "c c c c", "nothing here", "", "a a a a a a a"]
    terms = spark.createDataFrame(list(enumerate(phrases)), "query_id int, normalized string")
    want = Counter()
    for i, body, note in rows:
        for q, p in enumerate(phrases):
            for field, text in (("body", body), ("note", note)):
                want[q, i, field] += phrase_count(text, p)
    want = {k: n for k, n in want.items() if n}
    found = lambda df: {(r["query_id"], r["id"], r["field"]): r["n_hits"] for r in df.collect()}
    assert found(index.phrases(terms)) == want
    assert found(index.phrases(terms, "note")) == {k: n for k, n in want.items() if k[2] == "note"}
    stemmed = found(index.phrases(terms.where("query_id = 3"), stem=True))
    one = lambda t: re.sub("horses", "horse", re.sub("running", "run", t or ""))
    assert stemmed == {(3, i, "body"): n for i, body, _ in rows if (n := phrase_count(one(body), "horse run"))}
    index.store.vacuum()
    assert found(index.phrases(terms)) == want


def test_a_version_is_written_once(spark):
    s = Segments(spark, new_path(spark, "store"))
    a = s.write(spark.range(3))
    s.register(0, [{"name": a}])
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        s.register(0, [])
    s.write(spark.range(9))  # of a writer that was lost
    assert s.read(s.live()[1]).count() == 3
    s.vacuum()
    assert s.read(s.live()[1]).count() == 3


def insert_loop(rows, existing, keys, order):
    used = [{r[k] for r in existing if r[k] is not None} for k in keys]
    out = []
    for r in sorted(rows, key=lambda r: r[order]):
        if not any(r[k] is not None and r[k] in u for k, u in zip(keys, used, strict=True)):
            out.append(r)
            for k, u in zip(keys, used, strict=True):
                u.add(r[k])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ordered_insert_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i * 7, rng.choice([None, *range(40)]), rng.choice([None, "s", *map(str, range(60))]), rng.randrange(90)) for i in range(300)]
    rng.shuffle(rows)
    old = [(-1, 3, "7", 1), (-2, None, None, 2)]
    schema = "n long, a int, b string, c int"
    d, e = spark.createDataFrame(rows, schema), spark.createDataFrame(old, schema)
    want = insert_loop(rows, old, (1, 2, 3), 0)
    got, cursor = files.ordered_insert(d, e, ["a", "b", "c"], "n")
    assert sorted(map(tuple, got.collect())) == sorted(want) and cursor == 299 * 7
    held, cursor = e, None
    for _ in range(4):  # the same by steps
        step, cursor = files.ordered_insert(d, held, ["a", "b", "c"], "n", after=cursor, limit=80)
        held = written(held.union(step), "held")
    assert sorted(map(tuple, held.where("n >= 0").collect())) == sorted(want)
    nothing, same = files.ordered_insert(d, held, ["a", "b", "c"], "n", after=cursor)
    assert nothing.count() == 0 and same == cursor


def test_ordered_insert_of_chains_and_repeats(spark):
    y = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (2, "y", 3)], "k int, s string, n int")
    assert [tuple(r) for r in files.ordered_insert(y, y.limit(0), ["k", "s"], "n")[0].collect()] == [(1, "y", 1)]
    chain = spark.createDataFrame([(i // 2, (i + 1) // 2, i) for i in range(12)] + [(0, 0, 0), (None, None, 50), (None, None, 51)], "k int, s int, n int")
    got = sorted(r["n"] for r in files.ordered_insert(chain, chain.limit(0), ["k", "s"], "n")[0].collect())
    assert got == [0, 2, 4, 6, 8, 10, 50, 51]


def test_sketches_merge(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-60, 60) or 1, f"p{rng.randrange(3000)}", None if i % 9 == 0 else i % 13) for i in range(6000)]
    o = spark.createDataFrame([(s, s + rng.choice([0, 5, 25]) or 1, p, c) for s, p, c in rows] + [(None, 4, "x", 1), (9, 1, "x", 1)], "date_start int, date_end int, p string, c int")
    values = {"p": F.col("p"), "c": F.col("c")}
    whole = {r["bin_start"]: r for r in sketches.estimates(sketches.bin_sketches(o, values), list(values)).collect()}
    parts = [sketches.bin_sketches(o.where(F.pmod(F.xxhash64("p", "c"), F.lit(3)) == k), values) for k in range(3)]
    merged = {r["bin_start"]: r for r in sketches.estimates(sketches.united(parts[0].union(parts[1]).union(parts[2]), list(values)), list(values)).collect()}
    sums = {r["bin_start"]: r["rows"] for r in sweep.interval_sums(o).collect()}
    exact = {r["bin_start"]: r["n"] for r in sweep.interval_distinct(o, F.col("p")).collect()}
    assert set(whole) == set(merged) == set(exact) and {b: r["rows"] for b, r in merged.items()} == sums
    for b, n in exact.items():
        assert abs(whole[b]["p"] - n) <= max(1, 0.05 * n) and abs(merged[b]["p"] - whole[b]["p"]) <= max(1, 0.05 * n) and whole[b]["c"] == merged[b]["c"] == 13


def test_array_files(spark, tmp_path):
    npy.register(spark)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 6)).astype(np.float32)
    np.save(tmp_path / "x.npy", x)
    got = spark.read.format("npy").option("partitionBytes", 4000).option("batchRows", 37).load(str(tmp_path / "x.npy"))
    assert got.rdd.getNumPartitions() > 3
    rows = sorted(map(tuple, got.collect()))
    assert [r[0] for r in rows] == list(range(1000)) and np.array_equal(np.array([r[1] for r in rows], np.float32), x)
    with pytest.raises(Exception, match="not of length 1"):
        spark.read.format("npy").option("checkNorms", "true").load(str(tmp_path / "x.npy")).collect()
    out = str(tmp_path / "out")
    got.repartitionByRange(4, "row").sortWithinPartitions("row").select("embedding").write.format("npy").option("partRows", 100).mode("append").save(out)
    again = sorted(map(tuple, spark.read.format("npy").load(out).collect()))
    assert again == rows
    with pytest.raises(Exception, match="FileExistsError|exists"):
        got.select("embedding").write.format("npy").mode("append").save(out)
    np.save(tmp_path / "bad.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="matrix of numbers"):
        spark.read.format("npy").load(str(tmp_path / "bad.npy")).collect()
    uneven = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        uneven.write.format("npy").mode("append").save(str(tmp_path / "uneven"))
    with pytest.raises(Exception, match="not committed"):
        spark.read.format("npy").load(str(tmp_path / "uneven")).collect()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_sparse_array_files(spark, tmp_path, save):
    npy.register(spark)
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(500, 9)) * (rng.random((500, 9)) < 0.3)
    dense[100:160] = 0
    r, c = np.nonzero(dense)
    save(tmp_path / "w.npz", data=dense[r, c], indices=c.astype(np.int32), indptr=np.searchsorted(r, np.arange(501)).astype(np.int32), shape=np.array(dense.shape), format=np.array(b"csr"))
    d = spark.read.format("csr").option("partitionBytes", 2000).option("batchRows", 23).load(str(tmp_path / "w.npz"))
    assert (d.rdd.getNumPartitions() > 3) == (save is np.savez)
    assert sorted(map(tuple, d.collect())) == [(int(a), int(b), float(dense[a, b])) for a, b in zip(r, c, strict=True)]


def test_bundles_are_judged_while_written(spark):
    o = spark.createDataFrame([(1, 5, 25), (2, -3, 4), (3, 7, 7)], "artwork_id int, date_start int, date_end int")
    path = new_path(spark, "bundle")
    r = quality.write_bundle(o, path).first()
    assert r["ok"] and r["total"] == pytest.approx(3) and r["rows"] == 3 and spark.read.parquet(f"{path}/objects").count() == 3
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        quality.write_bundle(o, path)
    bad = spark.createDataFrame([(1, None, 5), (None, 9, 3), (3, 0, 0), (4, 1, 900)], "artwork_id int, date_start int, date_end int")
    r = quality.write_bundle(bad, new_path(spark, "bundle"), latest=500).first()
    assert not r["ok"] and (r["undated"], r["reversed"], r["year_zero"], r["no_id"], r["outside"], r["weight_off"]) == (1, 1, 1, 1, 1, 0)
    r = quality.write_bundle(bad.limit(0), new_path(spark, "bundle")).first()
    assert r["ok"] and r["rows"] == 0


def test_a_sink_is_written_once(spark):
    path = new_path(spark, "sink")
    for kind in ("csv", "parquet"):
        files.write_corpus(spark.range(3), f"{path}/{kind}", kind=kind)
        with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
            files.write_corpus(spark.range(3), f"{path}/{kind}", kind=kind)


def test_series_are_computed_once(spark):
    calls = []

    def compute(missing):
        calls.append(sorted(r["name"] for r in missing.collect()))
        return missing.select("series_key", "name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("bin"))

    root = new_path(spark, "series")
    ask = lambda names, version="v1", flag="x": (s := SeriesStore(spark, root, version)).fetch(s.keyed(spark.createDataFrame([(n,) for n in names], "name string"), {"name": F.col("name"), "flag": F.lit(flag)}), compute)
    assert ask(["a", "b", "a"]).count() == 6 and ask(["b", "a"]).count() == 6
    assert ask(["b", "c"]).count() == 6 and calls == [["a", "b"], ["c"]]
    assert ask(["b"], "v2").count() == 3 and ask(["b"], flag="y").count() == 3 and calls[2:] == [["b"], ["b"]]
    SeriesStore(spark, root, "v1").evict(3)
    assert ask(["b"]).count() == 3 and len(calls) == 5 or calls[-1] == ["b"]
    ask(["a"])
    assert calls[-1] == ["a"]


def rows_for(lo, hi):
    return [(i, 10 * (i % 5) + 1, 10 * (i % 5) + 12, f"p{i % 7}", f"c{i % 3}") for i in range(lo, hi)]


STREAMED = "artwork_id long, date_start int, date_end int, physical_object_id string, visual_cluster_id string"


def test_a_batch_that_was_stopped_and_comes_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    first, second = (spark.createDataFrame(rows_for(*x), STREAMED) for x in ((0, 40), (40, 90)))
    incremental.append_batch(first, 0, root)
    whole = lambda: (sorted(map(tuple, incremental.current_corpus(spark, root).collect())), sorted((r["bin_start"], round(r["eligible_weight"], 9), r["row_count"], r["physical_object_id"]) for r in incremental.current_denominators(spark, root).collect()))
    before = whole()
    for name in ("interval_sums", "bin_sketches"):  # stopped between its writes
        with monkeypatch.context() as m:
            m.setattr(incremental, name, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                incremental.append_batch(second, 1, root)
        assert whole() == before
    for _ in range(2):  # and done twice
        incremental.append_batch(second, 1, root)
        rows, sums = whole()
        assert rows == sorted(rows_for(0, 90))
    o = spark.createDataFrame(rows_for(0, 90), STREAMED)
    want = {r["bin_start"]: (round(r["weight"], 9), r["rows"]) for r in sweep.interval_sums(o).collect()}
    assert {b: (w, n) for b, w, n, _ in sums} == want and all(p == 7 for *_, p in sums)


def test_a_stream_adds_each_id_once(spark, tmp_path):
    root, check, source = (str(tmp_path / x) for x in ("root", "check", "in"))
    run = lambda: incremental.start_incremental(spark.readStream.schema(STREAMED).parquet(source), root, check).awaitTermination()
    spark.createDataFrame(rows_for(0, 30), STREAMED).write.parquet(source)
    run()
    spark.createDataFrame(rows_for(20, 50), STREAMED).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(map(tuple, incremental.current_corpus(spark, root).collect())) == sorted(rows_for(0, 50))
    with pytest.raises(ValueError, match="another"):
        incremental.start_incremental(spark.readStream.schema(STREAMED).parquet(source), root, str(tmp_path / "other"))
    shutil.rmtree(root)


def test_hashed_features_follow_their_definition(spark):
    import hashlib

    texts = ["Straße STRASSE x_1", "", None, "!!! ?", "ΣΊΣΥΦΟΣ σίσυφος", "a a b"]
    got = {}
    for r in vectors.hash_vectorize(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", 16).collect():
        got.setdefault(r["id"], {})[r["index"]] = r["value"]
    for i, t in enumerate(texts):
        t = (t or "").casefold()
        row = np.zeros(16)
        for w in re.findall(r"\w+", t) or [t]:
            h = hashlib.sha256(w.encode()).digest()
            for k in range(8):
                row[int.from_bytes(h[2 * k : 2 * k + 2], "big") % 16] += 1 if h[16 + k] % 2 else -1
        row /= np.linalg.norm(row) or 1
        assert got.get(i, {}) == pytest.approx({j: v for j, v in enumerate(row) if v}), t


def test_first_address_of_an_object_id_counts(spark):
    c = spark.createDataFrame([("1", True), ("2", False), ("3", None), ("4", True)], "source_id string, public_domain boolean")
    u = spark.createDataFrame([(2, "MET_1", "b"), (1, " met_1 ", "z"), (3, "MET_1", "a"), (0, "MET_1", " "), (0, "METX_1", "q"), (0, "MET_2", "r"), (0, "MET_4", None), (5, "MET4", "s")], "n int, object_ID string, image_url string")
    got = canonical.two_source_intersection(c, u, order=("n",))
    assert sorted((r["source_id"], r["artwork_id"], r["image_url"]) for r in got.collect()) == [("1", "MET_1", "b"), ("1", "met_1", "z")]


def test_released_tables_are_gone(spark):
    other = spark.newSession()
    path = tables_root(other)
    written(other.range(3), "gone")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(p)
    release(other)
    assert not fs.exists(p)


def test_denominator_violations(spark):
    o = spark.createDataFrame([(1, 1, 19), (2, 5, 5)], "artwork_id int, date_start int, date_end int")
    d = sweep.interval_sums(o).select("bin_start", F.col("weight").alias("eligible_weight"))
    assert bins.denominator_violations(bins.bin_weights(o), d).count() == 0
    assert [r["bin_start"] for r in bins.denominator_violations(bins.bin_weights(o), d.where("bin_start = 10")).collect()] == [0]


def test_a_phrase_of_common_words_costs_no_list_a_term(spark):
    """Many terms of the same words read each posting list once: what meets is rows, not terms times rows."""
    index = textindex.TextIndex(spark, new_path(spark, "index"), buckets=2)
    rows = [(i, f"a b {'c' * (i % 3)} a b") for i in range(60)]
    index.append(spark.createDataFrame(rows, "id long, body string"), "id", ["body"])
    terms = spark.createDataFrame([(q, "a b") for q in range(200)], "query_id int, normalized string")
    hits = index.phrases(terms)
    assert {(r["query_id"], r["id"]): r["n_hits"] for r in hits.collect()} == {(q, i): 2 for q in range(200) for i in range(60)}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.count("Generate explode") == 1


@pytest.mark.parametrize("texts, tokens, most", [(4000, 2_000_000, 200_000), (7, 60, 200_000), (7, 60, 0)])
def test_a_word_has_one_row_a_block(spark, monkeypatch, texts, tokens, most):
    """Blocks of any size, phrases with and without codes, a query of two phrases, and texts of more than 2^16 words."""
    monkeypatch.setattr(textindex, "TEXTS", texts)
    monkeypatch.setattr(textindex, "TOKENS", tokens)
    monkeypatch.setattr(textindex, "BROADCAST_ROWS", most)
    rng = random.Random(5)
    rows = [(f"r{i % 150}", " ".join(rng.choice("abcd") for _ in range(rng.randrange(30)))) for i in range(200)]
    rows += [("long", "a b " * 40_000 + "c d a"), ("no", ""), ("none", None)]
    d = spark.createDataFrame(rows + rows[:40], "id string, body string")  # rows that are there twice count once
    index = textindex.TextIndex(spark, new_path(spark, "index"), buckets=3)
    index.append(d, "id", ["body"])
    blocks = index.postings().select("block").distinct().count()
    assert index.postings().where("word = 'a'").count() <= blocks <= 4 if texts == 4000 else blocks > 25
    assert index.postings().where("word is null").count() == blocks
    index.append(d.where("id > 'r5'"), "id", ["body"])  # again, in other blocks
    terms = [(1, "a"), (2, "a b"), (2, "b a"), (3, "c d a"), (4, "b c d a b"), (5, "e"), (6, "a b")]
    want = Counter()
    for i, text in set(rows):
        for q, p in terms:
            want[q, i] += phrase_count(text, p)
    got = index.phrases(spark.createDataFrame(terms, "query_id int, normalized string"))
    assert {(r["query_id"], r["id"]): r["n_hits"] for r in got.collect()} == {k: n for k, n in want.items() if n}
    assert index.phrases(spark.createDataFrame([(9, "-")], "query_id int, normalized string")).count() == 0
