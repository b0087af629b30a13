"""Runs of a million characters, for each kind of entity, pass the surrogates and the pipeline's stage."""

import corpus_pipeline
from epochlens.llm import pii

MEGA = 1_000_000
RUNS = {
    "name": "Mr. A" + "b" * MEGA,
    "hyphens": "Mr. A" + "-b" * (MEGA // 2),
    "known": "John A" + "’b" * (MEGA // 2),
    "mail": "x@" + "a." * (MEGA // 2) + "com",
    "user": "a." * (MEGA // 2) + "@x.com",
    "ip": "1." * (MEGA // 2),
    "iban": "DE89 " + "3704 " * (MEGA // 5),
    "secret": "token=" + "aB3-" * (MEGA // 4),
    "hex": "token=" + "0aF" * (MEGA // 3),
    "key": "0aF" * (MEGA // 3),
    "card": "4111 " * (MEGA // 5),
    "ssn": "123-45-" * (MEGA // 7),
    "phone": "+1" + " 234" * (MEGA // 4),
    "brackets": "(555) " * (MEGA // 6),
    "plus": "+" * MEGA,
    "titles": "Mr. John " * (MEGA // 9),
    "blanks": " " * MEGA,
}


def test_runs_of_a_million_characters(spark):
    rows = [(k, t) for k, t in enumerate(RUNS.values())]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    got = {r["doc_id"]: r for r in pii.replace_entities(docs, "k").collect()}
    of = lambda name: got[list(RUNS).index(name)]
    for name in ("name", "hyphens", "known", "secret", "hex"):
        assert of(name)["pii_entities"] >= 1 and of(name)["text"] != RUNS[name], name
    assert len(of("secret")["text"]) == len(RUNS["secret"]) and "aB3-aB3-aB3-" not in of("secret")["text"]
    for name in ("key", "plus", "blanks", "ip"):
        assert of(name)["text"] == RUNS[name], name
    few = docs.where(docs.doc_id.isin([list(RUNS).index(n) for n in ("name", "mail", "secret")]))
    staged = corpus_pipeline.replace_personal_data(spark, few, "")
    assert staged.columns == docs.columns and len(staged.collect()) == 3


def test_many_entities_in_one_text(spark):
    text = " ".join(f"u{i}@x{i % 7}.com" for i in range(30_000))
    r = pii.replace_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    made = r["text"].split()
    assert r["pii_entities"] == 30_000 and len(set(made)) == 30_000 and not set(made) & set(text.split())
    assert len({m.split("@")[1] for m in made}) <= 7  # short domains may meet in one
