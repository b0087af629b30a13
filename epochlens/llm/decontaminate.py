"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.functions.base import bound
from epochlens.llm.common import cut, if_small, unused

SHINGLE, THRESHOLD = 5, 0.8
#: Minima kept of an item; items with fewer shingles keep them all.
SKETCH = 16
#: Of contained items, at most this share is missed by the sketch.
MISSED = 1e-6


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(w: Column, sizes: list[int], one: Callable[[list[Column]], Column], kind: str) -> Column:
    """Runs of so many words, of each size in turn, given by one; w is an array of words that is named often, so bind it."""
    def of(k: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
        return F.when(F.size(w) >= k, F.transform(at, lambda i: one([w[i + j] for j in range(k)]))).otherwise(F.array().cast(f"array<{kind}>"))

    return F.concat(*[of(k) for k in sizes])


def shingle_hashes(text: Column, sizes: list[int]) -> Column:
    return bound(words(text), lambda w: shingles(w, sizes, lambda x: F.xxhash64(*x), "bigint"))


def shingle_texts(text: Column, sizes: list[int]) -> Column:
    return bound(words(text), lambda w: shingles(w, sizes, lambda x: F.concat_ws(" ", *x), "string"))


def least_hits(k: int, threshold: float, missed: float = MISSED) -> int:
    """The largest m so that k minima, each in the document with probability threshold, give fewer than m hits at most so often."""
    tail, m = 0.0, 0
    while m < k and tail + (p := comb(k, m) * threshold**m * (1 - threshold) ** (k - m)) <= missed:
        tail, m = tail + p, m + 1
    return max(1, m)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, mark, item, item_copies, item_shingles, shared_shingles, containment): items whose 5-word shingles lie in a document to at least threshold. mark is the xxhash64 of the text.

    Items are partitioned by size (powers of two of their distinct shingles). A partition fixes how many
    MinHash minima (the shingles of the smallest hashes) its items keep and how many of these a document must
    have: containment is the probability that a minimum is in the document, so a binomial bound gives the
    number, whatever the document's length. A document is searched with all its shingles, but only for items
    that can fit it by size. Candidates are verified on the texts of the shingles themselves.

    Items with the same shingles are one item, named by the smallest id, with their count. An item of fewer than five
    words is one shingle of all its words, and documents are then searched for runs of that length too; items and
    documents without a word, null and empty ones included, match nothing. Rows that repeat both id and text give
    one result. Empty tables give an empty result. Ids may be of any type that sorts.
    """
    lengths = items.select(F.least(F.size(words(items[item_text_col])), F.lit(SHINGLE)).alias("n")).where("n > 0").distinct()
    sizes = sorted({r["n"] for r in lengths.collect()} | {SHINGLE})  # five numbers at most
    text, n = items[item_text_col], F.size(words(items[item_text_col]))

    def own(make: Callable[[Column, list[int]], Column]) -> Column:
        """The shingles of an item: of five words, or of all it has."""
        out = make(text, [SHINGLE])
        for k in sizes[:-1]:
            out = F.when(n == k, make(text, [k])).otherwise(out)
        return out

    it = items.select(items[item_col].alias("item"), F.array_sort(F.array_distinct(own(shingle_texts))).alias("texts"), F.array_distinct(own(shingle_hashes)).alias("hashes")).where(F.size("texts") > 0)
    it = it.withColumn("same", F.sha2(F.array_join("texts", "\n"), 256)).groupBy("same").agg(F.min(F.struct("item", "texts", "hashes")).alias("x"), F.count("*").alias("item_copies"))
    it = cut(it.select("x.*", "item_copies", F.size("x.texts").alias("q")).withColumn("size_class", F.floor(F.log2("q")).cast("int")), "items")
    by_hash = W.partitionBy("item").orderBy(F.xxhash64("h", F.lit(7)), "h")
    sketch = it.select("item", "q", "size_class", F.explode("hashes").alias("h")).withColumn("nth", F.row_number().over(by_hash))
    sketch = sketch.where(F.col("nth") <= F.when(F.col("size_class") >= 4, SKETCH).otherwise(F.col("q")))
    need = F.when(F.col("size_class") >= 4, least_hits(SKETCH, threshold)).otherwise(F.ceil(F.col("q") * threshold - 1e-9))
    sketch = cut(sketch.select("item", "q", "h", need.cast("int").alias("need")), "sketch")

    d = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    hashed = d.select("id", "mark", shingle_hashes(F.col("text"), sizes).alias("s")).where(F.size("s") > 0)
    probes = hashed.select("id", "mark", F.size("s").alias("n"), F.explode("s").alias("h"))
    hits = probes.join(if_small(sketch), "h").where(F.col("n") >= F.col("q") * threshold - 1e-9)
    hits = hits.select("id", "mark", "item", "need", "h").distinct().groupBy("id", "mark", "item").agg(F.count("*").alias("hits"), F.first("need").alias("need")).where("hits >= need")
    pairs = cut(hits.select("id", "mark", "item"), "candidates")

    right = pairs.select(F.col("id").alias("c_id"), F.col("mark").alias("c_mark"), F.col("item"))
    found = d.join(if_small(right), F.col("id").eqNullSafe(F.col("c_id")) & (F.col("mark") == F.col("c_mark")))
    found = found.select("id", "mark", "item", shingle_texts(F.col("text"), sizes).alias("mine")).join(if_small(it.select("item", "texts", "item_copies", "q")), "item")
    found = found.select("id", "mark", "item", "item_copies", F.col("q").alias("item_shingles"), F.size(F.array_intersect("texts", "mine")).alias("shared_shingles"))
    found = found.where(F.col("shared_shingles") >= F.col("item_shingles") * threshold - 1e-9).distinct()
    return found.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that hold no item; rows whose text is null or empty stay.

    Rows that repeat an id or a text are judged by their own text. Columns keep their names, whatever they are; an
    empty table of docs gives an empty result, one of items keeps all.
    """
    found = contaminated(docs, items, id_col=id_col, text_col=text_col, **how)
    f_id, f_mark = unused(docs, "found_id"), unused(docs, "found_mark")
    found = cut(found.select(F.col("id").alias(f_id), F.col("mark").alias(f_mark)).distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(F.col(f_id)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(f_mark))
    return docs.join(if_small(found), same, "left_anti")


DECONTAMINATE_SQL = r"""
with iw as (select item_id, w, least(len(w), 5) n from (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') w from benchmark) where len(w) > 0),
i as (select distinct item_id, unnest([array_to_string(w[x : x + n - 1], ' ') for x in range(1, len(w) - n + 2)]) s from iw),
k as (select item_id, string_agg(s, chr(10) order by s) same, count(*) q from i group by item_id),
r as (select same, min(item_id) item_id, count(*) item_copies, min(q) q from k group by same),
ri as (select i.item_id, i.s, r.item_copies, r.q from i join r using (item_id)),
dw as (select doc_id, hash(text) mark, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') w from documents),
d as (select distinct doc_id, mark, unnest([array_to_string(w[x : x + n - 1], ' ') for x in range(1, len(w) - n + 2)]) s from dw, (select distinct n from iw) where len(w) >= n),
m as (select doc_id, mark, item_id, item_copies, q, count(*) n from d join ri using (s) group by all having count(*) >= q * 0.8 - 1e-9)
select doc_id, item_id, item_copies::bigint item_copies, q::int item_shingles, max(n)::int shared_shingles, max(n)::double / q containment
from m group by doc_id, item_id, item_copies, q
"""
