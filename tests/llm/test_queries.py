import pytest

import corpus_pipeline
from epochlens.llm import queries as Q
from tests.oracle import SF, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert rows_of(Q.queries()[name](spark, SF).toPandas()) == sql_rows(Q.oracle_sql()[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))


def test_held_out_language_and_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = Q.op5_language(spark, sf).join(docs, "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int)) a").first()["a"]
    assert lang >= 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    hit = Q.op7_toxicity(spark, sf).join(labels, "doc_id").where("held_out and predicted = 1").selectExpr("avg(toxic) p").first()["p"]
    assert hit >= 0.8


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == docs.columns and 0 < out.count() <= 3 * docs.count()
    toxic = {r["doc_id"] for r in Q.op7_toxicity(spark, SF).where("predicted = 1").collect()}
    leaked = {r["doc_id"] for r in Q.op8_contaminated(spark, SF).collect()}
    assert not (toxic | leaked) & {r["doc_id"] for r in out.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mix"]
