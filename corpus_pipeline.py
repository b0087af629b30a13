"""A training corpus from raw documents: toxicity, near-duplicates, benchmark passages, personal data, mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.llm import decontaminate, mixing, neardup, pii, toxicity
from epochlens.llm.common import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go.

    Null and empty texts are predicted by the share of toxic ones among such examples; rows that repeat an id or a
    text go or stay together; columns keep their names; without labels of both kinds, and of an empty table, all stay.
    """
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.where("toxic_predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of the smallest id.

    Texts without words, null and empty ones included, all stay; rows equal in id and text are one document. See
    neardup.one_of_each() for ties.
    """
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; rows that repeat an id are judged by their own text; an empty benchmark keeps all.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the new text.

    Null texts stay null; equal entities have equal surrogates in all documents; other columns stay as they are, but
    a column pii_entities gets the number of replacements.
    """
    done = pii.replace_entities(docs, key="surrogates-1")
    n = F.when(F.col("pii_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document once for each copy that it gets.

    A null source is one of its own; a source without words takes none, so its null and empty texts go with it; elsewhere
    an empty text takes its source's rate. Columns named mix_* by the operator are dropped.
    """
    return mixing.emit_copies(mixing.systematic_mix(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("mix", mix_sources),
]

#: The stages run trained models, signatures and keyed replacement, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of sf_dir, each on the whole of what the one before kept.

    A stage's rows are written to the shared folder before the next reads them, so a lost executor costs no stage
    again. Empty tables give an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
