"""Cases in which an operator did less than its whole job."""

import random
import re
import zlib

from epochlens.llm import queries as Q
from epochlens.llm import pii, suffixtree, toxicity, urls


def test_op7_has_a_vector_for_nearly_all_toxic_texts(spark):
    sf = "/root/testdata/sf0.1"
    held = Q.op7_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1"), "doc_id")
    got = held.selectExpr("count(*) n", "sum(predicted) hit", "sum(cast(size(evidence) = 0 as int)) none").first()
    assert got["n"] == 144 and got["hit"] >= 123 and got["none"] <= 12


def test_op1_keeps_populated_sections_among_many(spark):
    pages, labels = [], []
    for i in range(3000):
        part = i % 30
        pages.append((i, f"https://h.org/section-{chr(97 + part % 26)}{chr(97 + part // 26)}/{i}"))
        labels.append((i, 0 if part == 7 else 1, 0))
    # a section without labels stands by its pages, single ones are a wildcard
    pages += [(3000 + i, f"https://h.org/unlabelled/{i}") for i in range(100)] + [(4000 + i, f"https://h.org/once-{chr(97 + i)}/{i}") for i in range(26)]
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), []).collect()
    blocked = {r["id"] for r in got if r["verdict"] == "block"}
    assert blocked == {i for i in range(3000) if i % 30 == 7}
    found = {r["template"] for r in got}
    assert {"/section-ha/<n>", "/section-aa/<n>", "/unlabelled/<n>", "/*/<n>"} <= found and len(found) == 32


def test_op6_keeps_contexts_of_a_fifteen_thousandth(spark):
    rng = random.Random(8)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(1000))) for i in range(200)]
    some = [i for i, _ in rows if not held(i)][:14]
    rows = [(i, t + " zeta omega" if i in some else t) for i, t in rows]
    new = next(i for i in range(1000, 2000) if held(i))
    r = suffixtree.score_documents(spark.createDataFrame([*rows, (new, "w1 zeta omega w2")], "doc_id long, text string")).where(f"id = {new}").first()
    assert 10_000 < r["train_tokens"] / 14 < 20_000 and r["score"] - r["base_score"] > 1


def test_op10_hint_holds_for_the_shortest_numbers():
    for x in ("+12345", "+123456", "+1 2345", "+123-45", "(12)345678", "123 456 7890", "123-45-6789", "1.1.1.1", "1234123412341", "340000000000000"):
        assert any(re.search(p, x) for p in (pii.PHONE, pii.SSN, pii.IP, pii.CARD)) and re.search(pii.HINT, x), x


def test_op7_reads_words_to_their_end():
    assert toxicity.terms_of("Assassin assess, ab") == ["assa", "+ssin", "asse", "+ss", "ab"]
    run = "".join(chr(0x4E00 + i) for i in range(19))
    assert "".join(t.lstrip("+") for t in toxicity.terms_of(run)) == run
    assert len({tuple(toxicity.terms_of(w)) for w in ("class", "classified", "asset", "assess")}) == 4


def test_op1_blocks_a_small_bad_section_and_no_good_one(spark):
    pages, labels = [], []
    put = lambda section, n, bad: [(pages.append((len(pages), f"https://h.org/{section}/{len(pages)}")), labels.append((len(labels), int(not bad and True), 0)) if labelled else labels.append((len(labels), None, 0))) for labelled in [k < n // 4 or bad and k < 20 for k in range(n)]]
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    for i in range(60):
        put(f"good-{name(i)}", 400, False)
    for i in range(40):
        put(f"small-{name(i)}", 50, False)
    first = len(pages)
    put("casino", 90, True)
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), []).where("verdict = 'block'").collect()
    assert {r["id"] for r in got} == set(range(first, first + 90)) and {r["template"] for r in got} == {"/casino/<n>"}
