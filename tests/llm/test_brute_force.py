"""Queries that SQL can't express, and the pipeline, against plain versions on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from epochlens.llm import pii, urls
from epochlens.llm import queries as Q
from tests.llm.test_small_cases import brute_classes
from tests.oracle import SF


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=lambda r: r[0])


def test_op2_equals_the_library(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for doc_id, text, *_ in documents:
        n = len(lib.encode(text or "", add_special_tokens=False).ids)
        want[doc_id] = (len((text or "").encode()), n, n > 512)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in Q.op2_token_counts(spark, SF).collect()} == want


def test_op3_equals_all_pairs(spark, documents):
    ids = [r[0] for r in documents]
    classes = brute_classes([r[1] for r in documents])
    assert {r["doc_id"]: r["class_id"] for r in Q.op3_near_duplicates(spark, SF).collect()} == {i: ids[c] for i, c in zip(ids, classes)}


def test_op6_base_equals_counting(spark, documents):
    toks = {r[0]: (r[1] or "").encode().lower().split() + [b"\n"] for r in documents}
    c = Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    for r in Q.op6_suffix_tree(spark, SF).collect():
        t = toks[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in c for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))


def z(a, n, b, m):
    p, q = (a + 0.5) / (n + 1), (b + 0.5) / (m + 1)
    return (p - q) / math.sqrt(p * (1 - p) / (n + 1) + q * (1 - q) / (m + 1))


def sides(some, c):
    """By child of some: where its label share and its leaf share stand against the others'."""
    out = {}
    for s in some:
        a = [sum(c[x][i] for x in some if x != s) for i in range(4)]
        zs = z(c[s][1], c[s][2], a[1], a[2]), z(c[s][3], c[s][0], a[3], a[0])
        out[s] = tuple((v >= urls.ALIKE_Z) - (v <= -urls.ALIKE_Z) for v in zs)
    return out


def child_names(c):
    """Branch names of one node's children {segment: (n, bad, labelled, ends)}."""
    n, y = sum(x[0] for x in c.values()), sum(x[2] for x in c.values())
    bad = sum(x[1] for x in c.values())
    apart = lambda x: x[2] >= urls.FEW and abs(z(x[1], x[2], bad - x[1], y - x[2])) >= urls.APART_Z
    own = {s for s, x in c.items() if x[0] >= max(n**0.5, urls.FEW) or x[2] >= max(y**0.5, urls.FEW) or apart(x)}
    if len(c) - len(own) >= urls.FEW:
        return {s: s if s in own else "*" for s in c}
    groups, out = defaultdict(list), {}
    for s, side in sides(c, c).items():
        groups[side].append(s)
    for some in groups.values():
        inner = sides(some, c) if len(some) > 1 else {some[0]: (0, 0)}
        merged = [s for s in some if inner[s] == (0, 0)]
        out |= {s: "|".join(sorted(merged)) if s in merged else s for s in some}
    return out


def brute_templates(paths):
    """(host, typed): template, for {(host, typed): (n, bad, labelled)}."""
    out = {}

    def go(prefix, some):
        if all(not rest for _, rest in some):
            out.update({k: prefix for k, _ in some})
            return
        if len({rest for _, rest in some}) > 1 and not any(rest[:1] == () for _, rest in some) and len({rest[0] for _, rest in some}) == 1 or len({rest for _, rest in some}) == 1:
            return go(prefix + "/" + some[0][1][0], [(k, rest[1:]) for k, rest in some])
        out.update({k: prefix for k, rest in some if not rest})
        going = [(k, rest) for k, rest in some if rest]
        if sum(paths[k][0] for k, _ in some) < urls.FEW:
            out.update({k: prefix + "/**" for k, _ in going})
            return
        c = defaultdict(lambda: [0, 0.0, 0, 0])
        for k, rest in going:
            n, bad, labelled = paths[k]
            for i, v in enumerate((n, bad, labelled, n if len(rest) == 1 else 0)):
                c[rest[0]][i] += v
        names = child_names(c)
        for name in set(names.values()):
            branch = [(k, rest[1:]) for k, rest in going if names[rest[0]] == name]
            out.update({k: f"{prefix}/{name}" for k, rest in branch if not rest})
            if any(rest for _, rest in branch):
                go(f"{prefix}/{name}", [(k, rest) for k, rest in branch if rest])

    for host in {h for h, _ in paths}:
        go("", [((h, t), tuple(t.removeprefix("/").split("/"))) for h, t in paths if h == host])
    return out


def test_op1_equals_a_plain_tree(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    label = {r["doc_id"]: 1 - r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    parts, counts = {}, defaultdict(lambda: (0, 0.0, 0))
    for i, u in pages.items():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")
        typed = re.sub(r"(?<=/)[0-9]+(?=[/.]|$)", "<n>", path)
        typed = re.sub(r"[0-9]+", "#", typed)
        parts[i] = host, path, typed
        n, bad, labelled = counts[host, typed]
        counts[host, typed] = n + 1, bad + label.get(i, 0), labelled + (i in label)
    tree = brute_templates(counts)
    overall = sum(c[1] for c in counts.values()) / sum(c[2] for c in counts.values())
    by_host, by_template = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (host, typed), (_, bad, labelled) in counts.items():
        for x in (by_host[host], by_template[host, tree[host, typed]]):
            x[0] += bad
            x[1] += labelled
    for r in Q.op1_url_templates(spark, SF).collect():
        host, path, typed = parts[r["page_id"]]
        fits = [(len(h + p), h + p, v) for v, h, p in Q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else None
        share = (by_host[host][0] + 5 * overall) / (by_host[host][1] + 5)
        share = (by_template[host, tree[host, typed]][0] + 5 * share) / (by_template[host, tree[host, typed]][1] + 5)
        assert (r["host"], r["path"], r["rule"], r["template"]) == (host, path, rule and rule[0], tree[host, typed])
        impure = share >= max(2 * overall, 0.5) and share - overall >= 3 * math.sqrt(overall * (1 - overall) / (by_template[host, tree[host, typed]][1] + 5))
        assert r["bad_share"] == pytest.approx(share) and r["verdict"] == (rule[1] if rule else "block" if impure else "allow")


def test_op10_leaves_no_entity_and_all_else(spark, documents):
    planted = re.compile(r"[\w.]+@[\w.]+\.com|\b\d{1,3}(?:\.\d{1,3}){3}\b|(?<!\d)\d{16}(?!\d)|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![A-Za-z0-9])[0-9a-fA-F]{40}(?![A-Za-z0-9])")
    got = {r["doc_id"]: (r["text"], r["pii_entities"]) for r in Q.op10_surrogates(spark, SF).collect()}
    forward, back = {}, {}
    for doc_id, text, *_ in documents:
        old, new = planted.findall(text), planted.findall(got[doc_id][0])
        # sixteen digits that fail the check digit of cards are some other number and stay
        others = [k for k, a in enumerate(old) if re.fullmatch(r"\d{16}", a) and sum(sum(divmod(int(ch) * (1 + i % 2), 10)) for i, ch in enumerate(reversed(a))) % 10]
        assert all(old[k] == new[k] for k in others) and got[doc_id][1] <= len(old) - len(others)
        old, new = ([x for k, x in enumerate(xs) if k not in others] for xs in (old, new))
        assert len(old) == len(new) and planted.sub("#", text) == planted.sub("#", got[doc_id][0]) and got[doc_id][1] >= len(old)
        for a, b in zip(old, new):
            assert a != b and forward.setdefault(a.lower(), b.lower()) == b.lower() and back.setdefault(b.lower(), a.lower()) == a.lower()
    assert len(forward) > 5 and not set(back) & set(forward)


def brute_mix(rows):
    """Copies of (doc_id, text, source) rows, by the definition."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    keys = sorted({(s is None, s or "") for _, _, s in rows})
    by = {k: [(words(t), hashlib.md5(f"mix-1|{i}".encode()).hexdigest(), i) for i, t, s in rows if (s is None, s or "") == k] for k in keys}
    size, weight = {k: sum(x[0] for x in v) for k, v in by.items()}, {k: 1 + n % 3 for n, k in enumerate(keys)}
    free, left, target = set(keys), sum(size.values()), {}
    while free:
        level = left / sum(weight[k] for k in free)
        over = {k for k in free if level * weight[k] > 3 * size[k]}
        for k in over or free:
            target[k] = 3 * size[k] if over else level * weight[k]
            left -= target[k] if over else 0
        free -= over or free
    copies = {}
    for k, v in by.items():
        rate = target[k] / size[k] if size[k] else 0
        name = "1" if k[0] else "0" + k[1]
        u = int(hashlib.md5(f"mix-1|{name}".encode()).hexdigest()[:8], 16) / 2**32
        for n, (_, _, i) in enumerate(sorted(v, key=lambda x: (-x[0], x[1])), 1):
            copies[i] = min(3, math.floor(n * rate + u) - math.floor((n - 1) * rate + u))
    return copies


def test_pipeline_equals_plain_stages(spark, documents):
    toxic = {r["doc_id"] for r in Q.op7_toxicity(spark, SF).where("predicted = 1").collect()}
    rows = [r for r in documents if r[0] not in toxic]
    classes = brute_classes([r[1] for r in rows])
    rows = [r for k, r in enumerate(rows) if classes[k] == k]
    shingles = lambda t: {" ".join(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)}
    items = [s for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (s := shingles(r["text"]))]
    rows = [r for r in rows if not any(len(s & mine) >= 0.8 * len(s) for mine in [shingles(r[1])] for s in items)]
    replaced = {r["doc_id"]: r["text"] for r in pii.replace_entities(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), key="surrogates-1").collect()}
    copies = brute_mix([(r[0], replaced[r[0]], r[3]) for r in rows])
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter({(r[0], replaced[r[0]], r[3]): copies[r[0]] for r in rows if copies[r[0]]})
