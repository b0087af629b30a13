"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlens.llm import decontaminate, itq, langid, mixing, neardup, pii, suffixtree, tokens, toxicity, urls
import corpus_pipeline
from epochlens.llm.common import components, cut, cut_dir, release, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node long, size string, score int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (4, "one two three four five six"), (4, "another text under the same id"), (None, "no id at all"), (5, LONG), (6, LONG), (7, "!!! 123")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", None if i == 2 else "s", 0, "clash", -1, "x", 9) for i, t in rows], SCHEMA)


def empty(spark):
    return docs(spark).limit(0)


LABELS = "doc_id long, quality int, toxic int"


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(20)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tokens_small_cases(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/test-cache"
    for _ in range(2):  # the second run finds everything in the cache
        got = tokens.count_tokens(docs(spark), path, cache).collect()
        assert len(got) == len(ROWS)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in ROWS}) == stored.select("digest").distinct().count()
    lib = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert Counter(map(tuple, got)) == want
    assert tokens.count_tokens(empty(spark), path, cache + "-e").count() == 0


def test_part_counter_equals_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(1)
    alphabet = ["a", "b", "don't", " ", "  ", "\n", "\t", " \n", "é", "１", "🙂", "\x1c", "\x85", "\u3000", "<|endoftext|>", "!!", "7", "中", "\r"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(15))) for _ in range(3000)]
    lib = Tokenizer.from_file(path)
    assert tokens.PartCounter(path).counts(texts) == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]


def test_part_counter_of_a_tokenizer_that_joins_over_spaces(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    base = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert tokens.parts_at_spaces(base)
    spaced = {"id": len(base["model"]["vocab"]) + 7, "content": "new york", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    for k, change in enumerate([{"normalizer": {"type": "Replace", "pattern": {"String": " a"}, "content": "a"}}, {"added_tokens": [*base["added_tokens"], spaced]}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}]):
        path = str(tmp_path / f"{k}.json")
        json.dump(base | change, open(path, "w", encoding="utf-8"))
        lib, texts = Tokenizer.from_file(path), ["in new york a b", "a new  york", "x a a a", ""]
        assert not tokens.parts_at_spaces(base | change)
        assert tokens.PartCounter(path).counts(texts) == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]


def test_letters_are_not_tried_against_every_sign(monkeypatch):
    seen = []

    class Signs:
        findall = staticmethod(lambda text, letters=langid.LETTERS: seen.append(text) or letters.findall(text))

    every = "".join(f"ab{c}cd " for c in map(chr, range(0x3400)) if not c.isspace())
    want = [w.encode() for w in langid.LETTERS.findall(every.lower())]
    monkeypatch.setattr(langid, "LETTERS", Signs)
    assert langid.pieces("two words, 12 of them " * 50 + "x½y") == [b"two", b"words", b"of", b"them"] * 50 + [b"x", b"y"]
    assert seen == ["x½y"]
    assert langid.pieces(every) == want
    model = langid.LanguageModel(["de", "en"], langid.new_parameters(2))
    assert model.predict(["½ ² 12", "", None])[0] == ["und"] * 3
    assert model.predict(["x½y, two"]) == model.predict(["two x y"])
    model.predict(["é" * 100_000])
    assert max(map(len, model.place)) <= langid.PIECE


def test_letters_and_pieces():
    assert langid.pieces("12 ² ½ Ⅷ _ ३") == [] and langid.pieces("Abc² éß一") == ["abc".encode(), "éß一".encode()]
    long = "é" * 100 + "中" * 40
    assert b"".join(langid.pieces(long)).decode() == long and all(p.decode() and len(p) <= langid.PIECE for p in langid.pieces(long))


def test_near_duplicates_small_cases(spark):
    got = [(r["id"], r["class_id"]) for r in neardup.near_duplicates(docs(spark)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (4, 4), (None, None), (5, 5), (6, 5), (7, 7)], key=str)
    kept = neardup.one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:3]) for r in kept.collect()) == sorted([("1", ""), ("2", ""), ("3", " \n\t"), ("4", "one"), ("4", "ano"), ("None", "no "), ("5", LONG[:3]), ("7", "!!!")])
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.one_of_each(empty(spark)).count() == 0


def brute_classes(texts, threshold=0.8):
    words = neardup.Words()
    sets = [neardup.shingles(words.of(t)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and neardup.prob_jaccard(sets[i], sets[j]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force_on_a_large_group(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(120)], []
    for _ in range(150):  # copies with a few to many edits, most pairs of which lie around the threshold
        t = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8])):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join(word() for _ in range(60)) for _ in range(20)] + [texts[0]] * 5
    got = {r["id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_tiles_find_what_one_tile_finds(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    test_near_duplicates_equal_brute_force_on_a_large_group(spark)


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 60).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 60), rng.integers(1, 6, 60)
    a, b = np.repeat(e[:45], wa[:45]), np.repeat(e[15:], wb[15:])
    x, y = dict(zip(e[:45], wa)), dict(zip(e[15:], wb[15:]))
    want = sum(1 / sum(max(x.get(o, 0) / x[d], y.get(o, 0) / y[d]) for o in set(x) | set(y)) for d in set(x) & set(y))
    assert neardup.prob_jaccard(a, b) == pytest.approx(want)
    elements, doc = np.r_[e[:45], e[15:]], np.r_[np.zeros(45, int), np.ones(45, int)]
    s = neardup.prob_minhash(elements, np.r_[wa[:45], wb[15:]].astype(float), doc, 2, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.04)


def test_mixing_small_cases(spark):
    got = mixing.systematic_mix(docs(spark)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["mix_copies"] <= 3 for r in got)
    by = {r["source"]: r for r in got}
    assert by[None]["mix_source_size"] == 0 and by[None]["mix_target"] == 0
    assert by["s"]["mix_target"] == by["s"]["mix_source_size"]
    assert mixing.systematic_mix(empty(spark)).count() == 0
    copies = Counter(r["doc_id"] for r in mixing.emit_copies(mixing.systematic_mix(docs(spark))).collect())
    assert sum(copies.values()) == sum(r["mix_copies"] for r in got)


def test_mixing_reaches_targets_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), s) for i, s in enumerate(["a"] * 1500 + ["b"] * 900 + ["c"] * 12)]
    got = mixing.systematic_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, size = Counter(), {}, {}
    for r in got:
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
        target[r["source"]], size[r["source"]] = r["mix_target"], r["mix_source_size"]
    assert target["c"] == 3 * size["c"] and taken["c"] == target["c"]
    rest = sum(size.values()) - target["c"]
    assert target["a"] == pytest.approx(rest / 3) and target["b"] == pytest.approx(rest * 2 / 3)
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in "ab")


def test_language_small_cases(spark):
    en, fr = "the cat with the thing and that other", "le chat avec la chose et les autres été"
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(80)] + [(200, None, "en"), (201, "12 !!", None), (None, en, "en"), (202, LONG, None)]
    out = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == len(rows) and got[200] == ("und", 0.0) == got[201] and got[None][0] == "en" and got[202][0] in ("en", "fr")
    assert all(got[i][0] == ("en" if i % 2 else "fr") for i in range(80))
    assert {r["id"]: r["held_out"] for r in out}[7] == (zlib.crc32(b"7") % 4 == 2)
    assert langid.predict_languages(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.new_parameters(3, 5).items()}
    x, y = rng.integers(97, 103, (6, 5)).astype(np.uint8), rng.integers(0, 3, 6)
    _, g = langid.gradients(p, x, y)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        p[k][i] += 1e-3
        a, _ = langid.gradients(p, x, y)
        p[k][i] -= 2e-3
        b, _ = langid.gradients(p, x, y)
        p[k][i] += 1e-3
        assert (a - b) / 2e-3 == pytest.approx(g[k][i], rel=0.02)


def test_suffix_tree_base_and_learning(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["New york City", "los angeles", "a b c"]) for _ in range(40))) for i in range(200)] + [(900, None), (901, ""), (None, "New york"), (7, "unseen words\x85here"), (902, LONG)]
    out = suffixtree.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    toks = [(i, [w for w in (t or "").encode().lower().split()] + [b"\n"]) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    assert len(out) == len(rows)
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == Counter((i, held(i), len(t), sum(w in c for w in t), n, round(base(t), 6)) for i, t in toks)
    unseen = [r for r in out if r["id"] is not None and r["id"] < 200 and r["held_out"]]
    assert sum(r["score"] for r in unseen) > 0.75 * sum(r["base_score"] for r in unseen)
    assert suffixtree.score_documents(empty(spark)).count() == 0


def test_suffix_tree_probabilities_sum_to_one():
    base = np.log10(np.array([0.4, 0.3, 0.2, 0.1]))
    tree = suffixtree.SuffixTree(base)
    tree.add_level(np.array([0, 1]), np.zeros(2, int), np.array([100, 90]), np.array([0, 0, 1]), np.array([1, 2, 0]), np.array([70, 20, 85]))
    tree.add_level(np.array([0 * tree.width + 1]), np.array([1]), np.array([70]), np.array([0, 0]), np.array([0, 2]), np.array([10, 58]))
    assert all(not np.isnan(x).any() for x in tree.left)
    for context in ([0], [0, 1], [2, 0], [2, 1], [3, 3]):
        x = lambda w: np.array([tree.start, *context, w])
        assert sum(10 ** (tree.gain(x(w))[-1] + base[w]) for w in range(4)) == pytest.approx(1)


def brute_tree_scores(texts, train):
    """log10 P of the texts by a plain suffix tree of dictionaries, learned from some of them."""
    split = lambda t: [*t.encode().lower().split(), b"\n"]
    toks = [split(t) for t in texts]
    c = Counter(w for t, k in zip(toks, train) if k for w in t)
    n = sum(c.values())
    base = lambda w: (c[w] + 0.1) / (n + 0.1 * (len(c) + 1))
    least_context, least_next = (max(suffixtree.LEAST, r * n**0.5) for r in (suffixtree.CONTEXT_ROOT, suffixtree.NEXT_ROOT))
    grams = Counter()
    for t, k in zip(toks, train):
        for i in range(len(t) if k else 0):
            whole = ["<s>", *t[: i + 1]]
            grams.update(tuple(whole[-j - 1 :]) for j in range(1, min(9, len(whole))))
    total = Counter()
    for g, m in grams.items():
        total[g[:-1]] += m
    states = {}

    def p(context, w):
        while context and context not in states:
            context = context[1:]
        if not context:
            return base(w)
        kept, left = states[context]
        return kept[w] if w in kept else left * p(context[1:], w)

    some = [(w,) for w, m in [*c.items(), ("<s>", sum(train))] if m >= least_context and w != b"\n"]
    follow = {}
    for g, m in grams.items():
        follow.setdefault(g[:-1], {})[g[-1]] = m
    size = {x: c[x[0]] if x[0] != "<s>" else sum(train) for x in some}
    while some:
        new = {}
        for x in some:
            nxt = {w: m for w, m in follow.get(x, {}).items() if m >= least_next}
            q = {w: p(x[1:], w) for w in nxt}
            mine = {w: (m + suffixtree.SMOOTHING * q[w]) / (size[x] + suffixtree.SMOOTHING) for w, m in nxt.items()}
            rest, before = max(1 - sum(mine.values()), 1e-9), max(1 - sum(q.values()), 1e-9)
            apart = size[x] * (sum(mine[w] * math.log(mine[w] / q[w]) for w in nxt) + rest * math.log(rest / before))
            if nxt and apart >= suffixtree.DIVERGENCE * math.log(max(size[x], 2)) * (len(nxt) + 1):
                new[x] = mine, rest / before
        states |= new
        size = {(*x, w): m for x in some for w, m in follow.get(x, {}).items() if m >= max(least_context, least_next) and w != b"\n" and (*x[1:], w) in new}
        some = list(size)
    return [sum(math.log10(p(("<s>", *t[:i]), w)) for i, w in enumerate(t)) for t in toks], max(map(len, states), default=0)


def test_suffix_tree_equals_a_plain_one(spark):
    rng = random.Random(9)
    phrase = lambda: rng.choice(["a b c d", "x b c e", "a b c d e f g", "p q r s", "z q r t"])
    texts = [" ".join(phrase() if rng.random() < 0.6 else rng.choice("abcdefgpqrstxyz") for _ in range(30)) for _ in range(250)]
    train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(250)]
    want, depth = brute_tree_scores(texts, train)
    got = {int(r["id"]): r["score"] for r in suffixtree.score_documents(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")).collect()}
    assert depth >= 3 and [got[i] for i in range(250)] == pytest.approx(want)


def test_toxicity_small_cases(spark):
    rng = random.Random(6)
    clean = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(20)), 0) for i in range(300)]
    toxic = [(i, " ".join(rng.choice("alpha beta gamma idiot".split()) for _ in range(20)), 1) for i in range(300, 400)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in clean + toxic] + [(None, 0, 1), (1, 0, None)], LABELS)
    d = docs(spark, [(i, t) for i, t, _ in clean + toxic] + [(900 + (i or 0), t) for i, t in ROWS])
    out = toxicity.score_documents(d, labels).collect()
    assert len(out) == len(clean + toxic) + len(ROWS) and all(0 <= r["toxic_score"] <= 1 for r in out)
    got = {r["doc_id"]: r["toxic_predicted"] for r in out}
    assert sum(got[i] != y for i, _, y in clean + toxic) <= 2
    assert got[901] == 0 and got[902] == 0
    named = d.withColumnRenamed("doc_id", "i d").select(F.col("i d").cast("string").alias("doc_id"), "text", F.lit(1).alias("scored"), F.lit(2).alias("__t"))
    again = toxicity.score_documents(named, labels.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()
    assert {int(r["doc_id"]): r["toxic_score"] for r in again} == {r["doc_id"]: r["toxic_score"] for r in out} and {(r["scored"], r["__t"]) for r in again} == {(1, 2)}
    assert toxicity.score_documents(empty(spark), labels).count() == 0
    assert {r["toxic_score"] for r in toxicity.score_documents(docs(spark), labels.limit(0)).collect()} == {0.0}


def test_block_max_index_is_exact():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(700):
        v = rng.random(int(rng.integers(1, 6)))
        rows.append((np.sort(rng.choice(40, len(v), replace=False)), v / np.linalg.norm(v)))
    rows += rows[:100]  # ties
    dense = np.zeros((800, 40))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(rows, 40)
    for n in range(50):
        t, w = np.sort(rng.choice(40, 4, replace=False)), rng.random(4)
        out = np.zeros(800, bool)
        out[n] = n % 2 == 0
        scores = np.where(out, 0, np.round(dense[:, t] @ w, 12))
        ids, s = index.nearest((t, w), 10, out if n % 2 == 0 else None)
        want = [i for i in np.lexsort((np.arange(800), -scores))[:10] if scores[i] > 0]
        assert ids.tolist() == want and np.allclose(s, scores[want])


def test_block_max_index_reads_whole_lists_when_most_blocks_count(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(np.unique([0, *rng.choice(30, 6, replace=False)]), rng.random(7)) for _ in range(800)]
    rows = [(t, w[: len(t)]) for t, w in rows]
    rows += rows[:100]  # ties
    index = toxicity.BlockMaxIndex(rows, 30)
    dense = np.zeros((900, 30))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    asked, cells = [], toxicity.BlockMaxIndex._scores
    monkeypatch.setattr(toxicity.BlockMaxIndex, "_scores", lambda self, t, w, blocks: asked.append(len(blocks)) or cells(self, t, w, blocks))
    for n in range(20):
        t, w = rows[n]
        ids, s = index.nearest((t, w), 10)
        scores = np.round(dense[:, t] @ w, 12)
        assert ids.tolist() == np.lexsort((np.arange(900), -scores))[:10].tolist() and np.allclose(s, scores[ids])
        whole = index._whole_scores(t, w)
        assert whole[:100].tolist() == whole[800:].tolist()  # to the last bit
    assert max(asked, default=0) <= toxicity.FIRST_BLOCKS


def test_toxicity_numbers_a_texts_terms_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    letters = "ab_9éßİ中\U00020000½²Ⅷ \n-+.\x00\u0301\ud800"
    texts = ["".join(rng.choice(list(letters), n)) for n in range(300)] + ["", "Classified a class", "x" * 1000, "".join(map(chr, range(0x3000)))]
    vocabulary = sorted({t for x in texts for t in toxicity.terms_of(x)})[::2]
    number = {t: i for i, t in enumerate(vocabulary)}
    want = [[number.get(t, -1) for t in toxicity.terms_of(x)] for x in texts]
    numbered = toxicity.Numbered(vocabulary)
    monkeypatch.setattr(toxicity, "terms_of", None)
    assert [numbered.of(x).tolist() for x in texts] == want and numbered.of(None).tolist() == []
    assert toxicity.Numbered([]).of("ab cd").tolist() == [-1, -1]


def test_toxicity_equals_brute_force_under_any_partitioning(spark):
    sf = "/root/testdata/sf0.001"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: (r["toxic_score"], r["toxic_evidence"]) for r in toxicity.score_documents(d.repartition(7), y.repartition(3)).collect()}
    assert got == {r["doc_id"]: (r["toxic_score"], r["toxic_evidence"]) for r in toxicity.score_documents(d.coalesce(1), y).collect()}
    model = toxicity.fit(d, y)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    rows = np.zeros((model.index.n, len(model.terms)))
    rows[model.index.rows, np.repeat(np.arange(len(model.terms)), np.diff(model.index.starts[:: model.index.n_blocks]))] = model.index.weights
    names = sorted(model.terms, key=model.terms.get)
    for i, text in texts.items():
        best = -1
        words = [x for w in re.findall(r"\w+", (text or "").lower()) for x in [w[:4], *("+" + w[at : at + 4] for at in range(4, len(w), 4))]]
        n = -(-len(words) // toxicity.PASSAGE)
        size = -(-len(words) // max(n, 1))
        for k in range(n):
            c = Counter(words[k * size : (k + 1) * size])
            v = np.array([c[t] * w for t, w in zip(names, model.idf)])
            if not v.any():
                continue
            s = rows @ (v / np.linalg.norm(v))
            near = [j for j in np.lexsort((np.arange(len(s)), -np.round(s, 12)))[: toxicity.NEIGHBOURS] if s[j] > 0]
            w = s[near] ** 2 * model.row_weight[near]
            best = max(best, ((w * model.labels[near]).sum() + model.prior) / (w.sum() + 1)) if near else best
        at = max(0, np.searchsorted(model.steps, best + 1e-12, side="right") - 1)
        assert got[i][0] == pytest.approx(model.empty if best < 0 else min(1, max(0, model.levels[at])))


def test_near_copies_among_examples_count_once(spark):
    base = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(base[:299] + [f"edit{i}"])) for i in range(20)] + [(100 + i, " ".join(f"v{(i * 31 + j) % 997}" for j in range(50))) for i in range(6)]
    known = spark.createDataFrame([(i, 1) for i, _ in rows], "id long, toxic int")
    got = {r["id"] for r in toxicity.examples_of(spark.createDataFrame(rows, "id long, text string"), known, 50).collect()}
    assert len([i for i in got if i < 100]) == 1 and len([i for i in got if i >= 100]) == 6


def test_decontamination_small_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(10, item), (11, item.upper()), (12, "too short"), (13, None), (14, "")], "item_id long, text string")
    rows = [*ROWS, (20, LONG + " " + item + " " + LONG), (21, item[: len(item) // 2]), (22, item.replace(" ", ", ")), (None, item)]
    got = decontaminate.contaminated(docs(spark, rows), items).collect()
    assert sorted((str(r["id"]), r["item"], r["item_copies"], r["containment"]) for r in got) == [("20", 10, 2, 1.0), ("22", 10, 2, 1.0), ("None", 10, 2, 1.0)]
    kept = decontaminate.without_contaminated(docs(spark, rows), items)
    assert kept.columns == docs(spark).columns and kept.count() == len(rows) - 3
    assert decontaminate.contaminated(empty(spark), items).count() == 0 == decontaminate.contaminated(docs(spark), items.limit(0)).count()


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([("a", "Forty Two"), ("b", "yes"), ("c", "one two three four"), ("d", "forty-two"), ("e", "...")], "item_id string, text string")
    rows = [("x", LONG + " it is forty, two. " + LONG), ("y", "forty and two"), ("z", "one two three four five"), ("n", None), ("w", "oh YES")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id string, text string"), items).collect()
    assert sorted((r["id"], r["item"], r["item_copies"], r["containment"]) for r in got) == [("w", "b", 1, 1.0), ("x", "a", 2, 1.0), ("z", "c", 1, 1.0)]


NAMES = ["__id", "__mark", "__m", "__t", "__new_text", "row", "mark", "found", "gaps", "found_id", "s_id", "xs", "scored", "i d"]


def test_any_names_and_text_ids(spark):
    d = docs(spark).drop("id").select(F.col("doc_id").cast("string").alias("doc_id"), "text", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)])
    d = d.union(d.where("doc_id = '5'").withColumn("row", F.lit(77)))  # equal in id and text alone
    items = spark.createDataFrame([("q", "one two three four five six")], "item_id string, text string")
    want = sorted(("None" if i is None else str(i), (t or "")[:3]) for i, t in ROWS)
    key = lambda rows: sorted((str(r["doc_id"]), (r["text"] or "")[:3]) for r in rows)
    one = neardup.one_of_each(d)
    assert one.columns == d.columns and key(one.collect()) == key([r for r in d.dropDuplicates(["doc_id", "text"]).collect() if r["doc_id"] != "6"])
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in neardup.one_of_each(d.repartition(5)).collect()}
    left = decontaminate.without_contaminated(d, items)
    assert left.columns == d.columns and key(left.collect()) == sorted([x for x in want if x[1] != "one"] + [("5", LONG[:3])])
    changed = pii.replace_entities(d.withColumn("text", F.concat("text", F.lit(" a.b@x.com"))), "k")
    assert changed.columns == [*d.columns, "pii_entities"] and changed.count() == len(ROWS) + 1 and changed.where("text like '%a.b@x.com%'").count() == 0
    assert {tuple(r[c] for c in NAMES) for r in changed.where("row <> 77").collect()} == {tuple(range(len(NAMES)))}


def test_surrogates_of_a_full_space_get_longer(spark):
    rows = [(i, f"{chr(97 + i)}@x.com +1234{i % 10}") for i in range(26)]
    out = [r["text"].split()[0] for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert len(set(out)) == 26 and not set(out) & {t.split()[0] for _, t in rows} and len({x.split("@")[1] for x in out}) == 1


def test_pipeline_small_cases(spark, tmp_path):
    sf = str(tmp_path)
    d = docs(spark, [*ROWS, (8, "write to a.b@x.com today please, it is about the plan")]).drop("id").select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)])
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 0, 1), (7, 0, None)], LABELS)
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, "")], "item_id long, text string")
    for name, df in {"documents": d, "labels": labels, "benchmark": items}.items():
        df.write.parquet(f"{sf}/a/{name}.parquet")
        df.limit(0).write.parquet(f"{sf}/b/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{sf}/a")
    rows = out.collect()
    assert out.columns == d.columns and all(tuple(r[c] for c in NAMES) == tuple(range(len(NAMES))) for r in rows)
    assert {r["doc_id"] for r in rows} <= {None, 1, 2, 3, 4, 5, 7, 8}
    assert not any("a.b@x.com" in (r["text"] or "") or (r["text"] or "").startswith("one two") for r in rows) and "5" in {str(r["doc_id"]) for r in rows} and 6 not in {r["doc_id"] for r in rows}
    none = corpus_pipeline.run(spark, f"{sf}/b")
    assert none.columns == d.columns and none.count() == 0


def test_release_deletes_the_tables(spark):
    import os

    kept = cut(spark.range(3), "test")
    path = cut_dir(spark).removeprefix("file://")
    assert kept.count() == 3 and os.listdir(path)
    release(spark)
    assert not os.path.exists(path)


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(30):
        center = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 9))):
            rows.append(((center + rng.normal(size=32) * rng.choice([0.02, 0.2, 0.3])).tolist(), g % 3))
    rows += [(rows[0][0], 0)] * 4 + [(rows[0][0], None), (None, 1), ([0.0] * 32, 1), ([float("nan")] * 32, 1), ([None] * 32, 1), ([1.0] * 5, 1)]
    data = [(i, v, y) for i, (v, y) in enumerate(rows)]
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq.embedding_links(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    x, ok = itq.unit_rows([v for v, _ in rows])
    near = (x @ x.T >= 0.93) & ok & ok[:, None] & (np.array([[a is not None and a == b for _, b in rows] for _, a in rows]))
    np.fill_diagonal(near, False)
    reach = near | np.eye(len(rows), dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    want = {i: (int(near[i].sum()), int(np.flatnonzero(reach[i])[0]), int(np.flatnonzero(reach[i])[0]) == i) for i in range(len(rows))}
    agree = sum(got[i] == want[i] for i in want) / len(want)
    found = sum(v[0] for v in got.values()) / sum(v[0] for v in want.values())
    assert len(got) == len(want) and agree >= 0.9 and 0.9 <= found <= 1
    assert itq.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def links_by_brute_force(rows, threshold=0.93):
    """{id: (links, component)} of (id, vector, label) rows by all pairs."""
    near, reach = {}, {}
    for i, v, y in rows:
        near[i] = []
        if v is None or y is None or None in v or not np.isfinite(v).all() or not np.any(v):
            continue
        x = np.array(v) / np.linalg.norm(v)
        near[i] = [j for j, w, z in rows if j != i and z == y and w is not None and len(w) == len(v) and None not in w and np.isfinite(w).all() and np.any(w) and x @ (np.array(w) / np.linalg.norm(w)) >= threshold]
    for i in sorted(near):
        todo = [i] if i not in reach else []
        while todo:
            j = todo.pop()
            if j not in reach:
                reach[j] = i
                todo += near[j]
    return {i: (len(near[i]), reach[i]) for i in near}


@pytest.mark.parametrize("tile, a_bucket", [(2048, 64), (7, 64), (2048, 0.001), (7, 0.001)])
def test_embedding_links_of_the_given_table(spark, monkeypatch, tile, a_bucket):
    monkeypatch.setattr(itq, "TILE", tile)
    monkeypatch.setattr(itq, "ROWS_A_BUCKET", a_bucket)  # with the small one keys are of 19 bits, and probed
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rng = np.random.default_rng(2)
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in table.collect()]
    # near copies around a common vector, and around others
    rows += [(10_000 + i, (np.array(rows[i % 40 if i % 2 else 3][1]) + rng.normal(size=64) * 0.03).tolist(), rows[i % 40 if i % 2 else 3][2]) for i in range(160)]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in itq.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = links_by_brute_force(rows)
    found, all_links = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all_links > 3000 and 0.97 * all_links <= found <= all_links and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)


@pytest.mark.parametrize("dim", [2, 4, 8, 16])
def test_embedding_links_of_short_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(60, dim))
    x = np.r_[base, base[rng.integers(0, 60, 240)] + rng.normal(size=(240, dim)) * 0.25]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.93
    got = {r["id"]: r["n_links"] for r in itq.embedding_links(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    want = near.sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.97 * want.sum() > 100


def test_embedding_links_of_any_labels_lengths_and_ids(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 0.0]
    rows = [("p", a, 1.2), ("q", [2 * x for x in a], 1.2), ("r", a, 1.7), ("s", b, 1.2), ("t", b, 1.2), ("u", [], 1.2), ("v", [], 1.2), ("w", a, 0.0), ("x", a, -0.0), ("y", [1e200] * 3, 1.2), ("z", [2e200] * 3, 1.2)]
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq.embedding_links(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label double")).collect()}
    pair = {"p": "q", "s": "t", "w": "x", "y": "z"}
    assert got == {i: (1, x, i == x) for x, y in pair.items() for i in (x, y)} | {i: (0, i, True) for i in "ruv"}
    texts = spark.createDataFrame([(1, a, "m"), (2, a, "m"), (3, a, "n")], "vec_id int, embedding array<float>, label string")
    assert {r["id"]: r["n_links"] for r in itq.embedding_links(texts).collect()} == {1: 1, 2: 1, 3: 0}


def test_surrogates(spark):
    rows = [*ROWS, (30, "Mr. John Smith met ANNA Kovacs. Dr. Smith, Frau Anna Müller; г-н Иван Петров."), (31, "+1 (555) 123-4567 or +1 555 123 4567; DE89 3704 0044 0532 0130 00 and DE89370400440532013000; 4111-1111-1111-1111, 4111111111111111; 123-45-6789"), (32, 'a.b@x.com A.B@X.COM ab@x.com c@x.com 10.0.0.1. token = "abcDEF0123456789xyz"')]
    out = pii.replace_entities(docs(spark, rows).withColumn("pii_entities", F.lit("clash")), "k").collect()
    got = {r["doc_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and all(r["pii_entities"] == 0 for r in out if r["doc_id"] is None or r["doc_id"] < 30)
    assert Counter(str(t) for _, t in ROWS) == Counter(str(r["text"]) for r in out if r["doc_id"] is None or r["doc_id"] < 30)
    words = got[30].split()
    assert not {"John", "Smith", "ANNA", "Kovacs.", "Anna", "Müller;", "Иван", "Петров."} & set(words)
    assert words[2] == words[7].rstrip(",") and words[4].isupper() and words[4].lower() == words[9].lower() and words[0] == "Mr."
    number = [x for x in got[31].replace(";", ",").split(", ")]
    digits = lambda x: "".join(ch for ch in x if ch.isalnum())
    assert digits(number[0].split(" or ")[0]) == digits(number[0].split(" or ")[1])
    a, b = number[1].split(" and ")
    assert digits(a) == digits(b) and a[:2] == "DE" and a[4] == " " and int("".join(str(int(ch, 36)) for ch in digits(b)[4:] + digits(b)[:4])) % 97 == 1
    card = digits(number[2])
    assert card == number[3] and number[2][4] == "-" and sum(sum(divmod(int(ch) * (1 + i % 2), 10)) for i, ch in enumerate(reversed(card))) % 10 == 0
    mail = got[32].split()
    assert mail[1] == mail[0].upper() and len({mail[0], mail[2], mail[3]}) == 3 and len({m.lower().split("@")[1] for m in mail[:4]}) == 1
    assert mail[0][1] == "." and mail[0].endswith(".com") and "10.0.0.1" not in got[32] and "abcDEF" not in got[32]
    again = {r["doc_id"]: r["text"] for r in pii.replace_entities(docs(spark, rows), "k").collect()}
    other = {r["doc_id"]: r["text"] for r in pii.replace_entities(docs(spark, rows), "k2").collect()}
    assert again == got and other[32] != got[32]
    assert pii.replace_entities(empty(spark), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"Mr. {a}{b}") for i, (a, b) in enumerate((x, y) for x in "ABCDEFGHIJKLMNOPQRST" for y in ("orelin", "asteva", "unther", "ibberton", "esk", "olmes"))]
    out = [r["text"] for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert len(set(out)) == len(rows) and not set(out) & {t for _, t in rows}


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_urls_small_cases(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/1?q#f"), (3, "http://www.example.com/en/1"), (None, "https://x.net/es/"), (4, "https://x.net?es/"), (5, "ftp://fooexample.com/en/x"), (6, "http://"), (7, "a://b://c/d"), (8, "http://h.org/" + "x/" * 3000)]
    pages = spark.createDataFrame([(i, u, "clash", 0) for i, u in rows], "page_id long, url string, host string, n int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (5, 1, 0), (None, 0, 0), (4, None, 1)], LABELS)
    got = sorted(((str(r["id"]), r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, labels, RULES).collect() if r["rule"] or r["id"] in (1, 2, 4, 6, 7)), key=str)
    assert got == sorted([("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "a.example.com", "/en/1", "example.com/en/", "block"), ("3", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("None", "x.net", "/es/", "net/es/", "block"), ("4", "x.net", "", None, "allow"), ("5", "fooexample.com", "/en/x", "com/", "allow"), ("6", "", "", None, "allow"), ("7", "b:", "//c/d", None, "allow")], key=str)
    assert urls.judge_urls(pages, labels, RULES).count() == len(rows)
    assert urls.judge_urls(pages.limit(0), labels, RULES).count() == 0
    assert urls.judge_urls(pages, labels.limit(0), []).where("verdict = 'block'").count() == 0


def test_templates_generalise_merge_and_reject(spark):
    rows, labels = [], []
    for i in range(400):
        part = ("spam", "news", "blog")[i % 3]
        rows.append((i, f"https://h.org/{part}/{'slug-' + chr(97 + i % 26) + chr(97 + i // 26 % 26)}/{i}"))
        labels.append((i, 0 if part == "spam" else 1, 0))
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, LABELS), []).collect()
    assert {(r["template"], r["verdict"]) for r in got} == {("/spam/*/<n>", "block"), ("/blog|news/*/<n>", "allow")}


def test_templates_of_long_paths_and_small_nodes(spark):
    deep = "x/" * 2000
    rows = [f"https://h.org/{deep}{i % 2}/p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["https://few.org/a/b", "https://few.org/a/c", "https://few.org/a"]
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), spark.createDataFrame([], LABELS), []).collect()
    # digits are written #, the segments behind are a wildcard
    assert {r["template"] for r in got if r["host"] == "h.org"} == {f"/{deep}<n>/*"}
    assert {(r["path"], r["template"]) for r in got if r["host"] == "few.org"} == {("/a/b", "/a/**"), ("/a/c", "/a/**"), ("/a", "/a")}
    assert {r["verdict"] for r in got} == {"allow"}
