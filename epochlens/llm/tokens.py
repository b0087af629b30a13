"""Token counts with a digest cache: only texts that no earlier run has counted are encoded."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.llm.common import cut

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: A single space between two characters that aren't white space: no token of a byte-level BPE that puts
#: a leading space with the word spans it, so the parts on either side can be counted on their own.
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
PARTS_KEPT = 400_000


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def parts_at_spaces(tokenizer: dict) -> bool:
    """Whether a tokenizer, by its file, never joins tokens over BOUNDARY: a byte-level BPE that splits with its regular
    expression, without normalizer, and whose added tokens hold no white space and take none from their sides."""
    pre, added = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("added_tokens") or []
    plain = all(not re.search(r"\s", t["content"]) and not t.get("lstrip") and not t.get("rstrip") for t in added)
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not tokenizer.get("normalizer") and plain


class PartCounter:
    """Token counts of texts as sums over parts between BOUNDARY spaces, or, with a tokenizer that may join over these, of whole
    texts; counts of parts seen are kept, up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.in_parts = parts_at_spaces(json.loads(Path(path).read_text(encoding="utf-8")))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def counts(self, texts: Iterable[str]) -> list[int]:
        parts = []
        for text in texts:
            first, *rest = BOUNDARY.split(text) if self.in_parts else [text]
            parts.append([first, *[" " + x for x in rest]])
        if len(self.known) > PARTS_KEPT:
            self.known = {}
        known = self.known
        new = list({x for p in parts for x in p} - known.keys())
        for i in range(0, len(new), 2000):
            for x, e in zip(new[i : i + 2000], self.tokenizer.encode_batch_fast(new[i : i + 2000], add_special_tokens=False), strict=True):
                known[x] = len(e.ids)
        get = known.__getitem__
        return [sum(map(get, p)) for p in parts]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PartCounter(path)
        for batch in batches:
            n = batch.num_rows
            for i in range(0, n, 256):
                part = batch.slice(i, 256)
                got = counter.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(got, pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache, empty where nothing has been written yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of docs.

    The content is normalised only in ways that keep the count: null becomes the empty text. Its sha-256 and
    the sha-256 of the tokenizer file are looked up in the cache; of the texts that miss, one row a digest
    is encoded and appended, so a later run, or a run after a failure, encodes nothing twice. Two runs that
    append at once may store a digest twice with the same count, which the look-up folds.

    Representatives are joined on (id, digest), which spreads the texts evenly however many copies one has.
    Rows that repeat an id get a row each; a null id is kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    d = docs.select(docs[id_col].alias("id"), text.alias("text"), F.sha2(text, 256).alias("hex"), F.octet_length(text).cast("long").alias("n_bytes"))
    d = d.withColumn("digest", F.unhex("hex")).drop("hex")
    cached = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    missed = d.groupBy("digest").agg(F.min("id").alias("id")).join(cached, "digest", "left_anti")
    missed = missed.select(F.col("digest").alias("m_digest"), F.col("id").alias("m_id")).hint("shuffle_hash")
    texts = d.select("id", "digest", "text").join(missed, (F.col("digest") == F.col("m_digest")) & F.col("id").eqNullSafe(F.col("m_id")), "left_semi")
    fresh = texts.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    known = cut(read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return d.drop("text").join(known, "digest").select("id", "n_bytes", "n_tokens")
