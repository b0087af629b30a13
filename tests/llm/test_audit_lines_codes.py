"""Filter audit, line dedup and vector codes against brute force, with nulls, repeats, ties, long texts and empty tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from epochlens.llm import filteraudit as A
from epochlens.llm import linededup, productcodes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n long, part string, lists string, digest string, first long"
LABELS = "doc_id long, quality int, toxic int"
sorted_sets = st.lists(st.integers(0, 60), max_size=40).map(lambda xs: sorted(set(xs)))


@given(st.lists(sorted_sets, min_size=1, max_size=5))
def test_merges_of_posting_lists_equal_sets(lists):
    every = sorted(set().union(*lists))
    assert A.union(lists) == every
    for xs in lists:
        rest = sorted(set().union(*[ys for ys in lists if ys is not xs]))
        assert A.difference(xs, rest) == sorted(set(xs) - set(rest)) and A.shared(xs, rest) == len(set(xs) & set(rest))
    assert all(A.gallop(xs, x, at) == max(at, sum(y < x for y in xs)) for xs in lists for x in range(-1, 62, 7) for at in range(len(xs)))


def audit_rows(seed, n):
    rng = random.Random(seed)
    pool = [None, "", " \t ", "x", "A B C", "one two " * 40, "word$ " * 60, " ".join(f"w{i}" for i in range(60)), "é" * 30 + "ABC", " ".join(f"W{i}" for i in range(70)), "  \xa0 | " + " ".join(map(str, range(55)))]
    rows = [(rng.choice([None, *range(n)]), rng.choice([*pool, " ".join(f"t{rng.randrange(90)}" for _ in range(60))]), rng.choice([None, "", "s1", "s2"])) for _ in range(n)]
    return [*rows, *rows[:5], (n + 1, "long " * 200_000, "s1"), (n + 2, " ".join(f"v{i}" for i in range(60_000)), "s2")]


def brute_audit(rows, labels):
    first = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            first[t or ""].append(i)
    said = defaultdict(lambda: [False, False])
    for i, q, x in labels:
        if i is not None:
            said[i] = [said[i][0] or q == 1, said[i][1] or x == 1]
    docs = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and min(first[t]) < i}
        docs[s or ""].append((frozenset(k for k in fails if fails[k]), *(said[i] if i is not None else (False, False))))
    out = Counter()
    for part, ds in docs.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            for f in order:
                total[f] += sum(f in d[0] and not d[0] & set(order[: order.index(f)]) for d in ds)
        for order in itertools.permutations("ABCDE"):
            left = ds
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                out[part, "".join(order), step, len(left), len(gone), sum(f in d[0] for d in ds) - len(gone), sum(d[0] == {f} for d in ds), sum(d[1] for d in gone), sum(d[2] for d in gone), total[f]] += 1
    return out


def test_filter_audit_equals_brute_force(spark):
    rows = audit_rows(1, 160)
    labels = [(i % 90 if i % 17 else None, i % 3 % 2 if i % 5 else None, i % 7 == 0) for i in range(120)]
    docs = spark.createDataFrame([(*r, -1, "clash", "clash", "clash", 0) for r in rows], DOCS).repartition(3)
    said = spark.createDataFrame([(i, q, int(x)) for i, q, x in labels], LABELS)
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = A.filter_audit(docs, said)
    assert got.columns == cols and {t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    assert Counter(tuple(r) for r in got.collect()) == brute_audit(rows, labels)
    assert A.filter_audit(docs.limit(0), said).count() == 0
    assert A.filter_audit(docs, said.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_posting_lists_are_sorted_ranges(spark, monkeypatch):
    monkeypatch.setattr(A, "RANGE", 64)
    rows = [(i, "x$" if i % 3 else " ".join(f"w{k}" for k in range(60)), "s" if i % 4 else "r") for i in range(1000)]
    flags = A.failures(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([], LABELS))
    lists = A.posting_lists(flags).collect()
    assert max(r["n"] for r in lists) <= 64 and sum(r["n"] for r in lists) == 1000
    for r in lists:
        assert all(xs == sorted(set(xs)) and all(0 <= x < r["n"] for x in xs) for xs in r["lists"])
    assert sum(len(r["lists"][3]) for r in lists) == sum(i % 3 > 0 for i in range(1000))


def brute_lines(texts, least_docs, least_chars):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or count[key(x)] < least_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    pool = ["", " ", "\t\r", "Menu", " menu ", "MENU\r", "é", "É", "\xa0menu", "İ", "i̇", "a" * 3000, "(c) 2020", "x", " ", "x y"]
    texts = ["\n".join(rng.choice([*pool, f"own {rng.randrange(300)}"]) for _ in range(rng.randrange(12))) for _ in range(80)]
    texts += [None, "", None, "\n", "\n\n", texts[0], texts[0], "Menu\n" * 50_000 + "own line", "\n".join(f"l{i}" for i in range(30_000))]
    rows = [(rng.choice([None, 1, *range(90)]), t, i, "clash", 7, [9]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, nth int, line_digest string, n_lines int, line_dropped array<int>").repartition(4)
    for least_docs, least_chars in ((10, 1), (2, 3), (1, 1), (3, 0)):
        got = linededup.dedup_lines(docs, least_docs, least_chars)
        assert got.columns == ["doc_id", "text", "nth", "line_digest", "line_dropped", "n_lines", "n_dropped"]
        want = brute_lines(texts, least_docs, least_chars)
        out = {r["nth"]: r for r in got.collect()}
        assert len(out) == len(rows)
        for i, (text, n, gone) in enumerate(want):
            assert (out[i]["text"], out[i]["n_lines"], out[i]["n_dropped"], out[i]["doc_id"]) == (text, n, gone, rows[i][0]), i
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_beyond_a_broadcast(spark, monkeypatch):
    from epochlens.llm import common

    texts = [f"a{i % 5}\nb{i % 40}\nown{i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: r for i, r in enumerate(brute_lines(texts, 10, 1))}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(docs).collect()} == want


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    length = len(kept[0][1])
    sizes = [length // parts + (p < length % parts) for p in range(parts)]
    ends = [sum(sizes[:p]) for p in range(parts + 1)]
    cut = lambda v, p: v[ends[p] : ends[p + 1]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    same = [r for r in kept if len(r[1]) == length]
    books = [[list(cut(r[1], p)) for r in kept[:entries] if len(r[1]) == length] for p in range(parts)]
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (apart(v, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for r in same:
                own[nearest(cut(r[1], p), book)].append(cut(r[1], p))
            books[p] = [[sum(x) // len(own[e]) for x in zip(*own[e], strict=True)] if e in own else b for e, b in enumerate(book)]
    sha = hashlib.sha256(",".join(str(x) for book in books for b in book for x in b).encode()).hexdigest()
    out, by_label = [], Counter()
    for i, v, lab in kept:
        code = [nearest(cut(v, p), books[p]) for p in range(parts)] if len(v) == length else None
        error = code and sum(apart(cut(v, p), books[p][c]) for p, c in enumerate(code))
        by_label[lab] += error or 0
        out.append((i, code and "".join(f"{c:02x}" for c in code), error, lab))
    fits = {lab for _, _, e, lab in out if e is not None}
    long = lambda x: x if x is not None and x < 1 << 63 else None
    return Counter((i, code, long(e), long(by_label[lab]) if lab in fits else None, sha) for i, code, e, lab in out)


VECTORS = "vec_id long, embedding array<double>, label int, ints string, code string, l int"


def coded(spark, rows, **kwargs):
    d = spark.createDataFrame([(*r, "clash", "clash", 0) for r in rows], VECTORS).repartition(3)
    return Counter(tuple(r) for r in productcodes.compress(d, **kwargs).collect())


def test_vector_codes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    for dim, n, spread in ((16, 150, 1.0), (19, 60, 0.05), (8, 9, 1.0), (3, 40, 1.0), (16, 60, 0.0), (8, 50, 3e8)):
        rows = [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]
        rows += [*rows[:3], (None, rows[0][1], 5), (7, rows[4][1], 1), (8, None, 1), (9, [None] * dim, 1), (-1, [math.nan] * dim, 1), (-2, [math.inf] + [0.0] * (dim - 1), 3), (n + 1, [0.5], 4), (n + 2, [], 4)]
        rng.shuffle(rows)
        monkeypatch.setattr(productcodes, "CELLS", rng.choice([3, 20_000]))
        assert coded(spark, rows) == brute_codes(rows), dim


def test_vector_codes_without_vectors(spark):
    assert coded(spark, [(1, None, 2), (2, [math.nan], 2)]) == Counter()
    assert coded(spark, [(1, [], 2), (2, [], None)]) == brute_codes([(1, [], 2), (2, [], None)])
    only = productcodes.compress(spark.createDataFrame([], "vec_id string, embedding array<float>, label string"))
    assert only.count() == 0 and only.columns == ["id", "code", "error", "label_error", "codebooks_sha256"]


def test_a_cell_keeps_every_entry_that_can_be_nearest():
    rng = np.random.default_rng(5)
    book = rng.integers(-2000, 2000, (16, 4))
    cells = productcodes.Cells(book)
    part = rng.integers(-3000, 3000, (5000, 4))
    may = cells.candidates(part)
    best = ((part[:, None, :] - book) ** 2).sum(2)
    assert may[np.arange(len(part)), best.argmin(1)].all() and may.mean() < 0.6
    entry, apart = cells.nearest(part)
    assert (entry == best.argmin(1)).all() and (apart == best.min(1)).all() and 0 < len(cells.seen) < len(part)
