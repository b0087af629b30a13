"""Audit how filters of a corpus interact: what each removes, in every order, from sorted posting lists."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.functions.base import bound
from epochlens.llm.common import cut
from epochlens.llm.mixing import WORD

#: Documents of one part in one row of posting lists, at most.
RANGE = 8_192


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by name that a text tells alone: A few words, B repeated words, C capitals, D signs."""
    words = bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    return {
        "A": words["n"] < 50,
        "B": words["d"].cast("long") * 100 < words["n"].cast("long") * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, id, A, B, C, D, E, good, toxic) a document: the filters it fails, and what labels say of it.

    E fails a text that a document of a smaller id has too, in any part. Only digests are shuffled for it: the smallest
    id of a digest is found with map-side minima, and digests of one document take no part in the join. A null text is
    empty; a null part is the empty string; a null id is neither smaller nor larger than another; rows that repeat an
    id are documents of their own and fail alike; several labels of an id count as good or toxic if one is.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    d = docs.select(F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[id_col].alias("id"), F.sha2(text, 256).alias("digest"), *[c.alias(k) for k, c in text_filters(text).items()])
    d = cut(d, "audit-flags")
    firsts = d.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    said = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    d = d.join(firsts, "digest", "left").join(said, F.col("id") == F.col("l_id"), "left")
    no = F.lit(False)
    return d.select("part", "id", *"ABCD", F.coalesce(F.col("first") < F.col("id"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def posting_lists(flags: DataFrame, filters: str = "ABCDE", marks: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """Sorted posting lists: a row (part, n, lists, marked) for each id range of a part, of RANGE documents at most.

    lists has one list for each filter, marked one for each mark: the places of the documents that fail or bear it, in
    the order of ids of that range. Ranges are dealt over tasks by (part, id), so a large part is many ranges and a
    task streams through its own; rows that repeat an id have places of their own.
    """
    names = [*filters, *marks]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part")
            runs = pc.run_end_encode(parts)
            lo = 0
            for end, part in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                for at in range(lo, end, RANGE):
                    rows = batch.slice(at, min(RANGE, end - at))
                    held = [np.flatnonzero(rows.column(c).to_numpy(zero_copy_only=False)).astype(np.int32) for c in names]
                    yield pa.RecordBatch.from_pylist([{"part": part, "n": rows.num_rows, "lists": held[: len(filters)], "marked": held[len(filters) :]}], schema=shape)
                lo = end

    shape = pa.schema([("part", pa.string()), ("n", pa.int64()), ("lists", pa.list_(pa.list_(pa.int32()))), ("marked", pa.list_(pa.list_(pa.int32())))])
    ranged = flags.repartitionByRange("part", "id").sortWithinPartitions("part", "id").select("part", *names)
    return ranged.mapInArrow(lists, "part string, n long, lists array<array<int>>, marked array<array<int>>")


def gallop(xs: list[int], x: int, at: int) -> int:
    """The first place from at on whose value is x or more: steps that double, then bisection of the last one."""
    step = 1
    while at + step < len(xs) and xs[at + step] < x:
        step *= 2
    return bisect_left(xs, x, at + step // 2, min(at + step + 1, len(xs)))


def union(lists: list[list[int]]) -> list[int]:
    """The sorted union of sorted lists: the list with the smallest head gives all up to the next head at once."""
    out: list[int] = []
    at = [0] * len(lists)
    live = [k for k, xs in enumerate(lists) if xs]
    while len(live) > 1:
        live.sort(key=lambda k: lists[k][at[k]])
        k, head = live[0], lists[live[1]][at[live[1]]]
        xs = lists[k]
        to = gallop(xs, head, at[k])
        out += xs[at[k] : to]
        # the next head comes from its own list, once
        at[k] = to + (to < len(xs) and xs[to] == head)
        if at[k] == len(xs):
            live.remove(k)
    for k in live:
        out += lists[k][at[k] :]
    return out


def difference(xs: list[int], ys: list[int]) -> list[int]:
    """What of a sorted list xs is not in ys: stretches of xs between members of ys are taken at once."""
    out: list[int] = []
    i = j = 0
    while i < len(xs) and j < len(ys):
        if xs[i] < ys[j]:
            to = gallop(xs, ys[j], i)
            out += xs[i:to]
            i = to
        elif xs[i] > ys[j]:
            j = gallop(ys, xs[i], j)
        else:
            i, j = i + 1, j + 1
    return out + xs[i:]


def shared(xs: list[int], ys: list[int]) -> int:
    """How many values two sorted lists share."""
    return len(xs) - len(difference(xs, ys))


def merged_sizes(lists: DataFrame, filters: str = "ABCDE", marks: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """(part, before, filter, removed, fails, n, one column a mark): sums over ranges, for each filter and set before it.

    Each range merges the lists of the filters before into their union, and takes from it what a filter removes: its
    list less that union. before is the sorted string of the filters before. A row a set and filter, zeros included.
    """
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                held = dict(zip(filters, row["lists"], strict=True))
                for k in range(len(filters)):
                    for before in combinations(sorted(filters), k):
                        gone = union([held[f] for f in before])
                        for f in filters:
                            if f not in before:
                                removed = difference(held[f], gone)
                                out.append({"part": row["part"], "before": "".join(before), "filter": f, "removed": len(removed), "fails": len(held[f]), "n": row["n"], **{m: shared(removed, xs) for m, xs in zip(marks, row["marked"], strict=True)}})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    counts = ["removed", "fails", "n", *marks]
    shape = pa.schema([("part", pa.string()), ("before", pa.string()), ("filter", pa.string()), *[(c, pa.int64()) for c in counts]])
    each = lists.mapInArrow(sizes, "part string, before string, filter string, " + ", ".join(f"{c} long" for c in counts))
    return each.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in counts])


def audit(lists: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """What each filter removes at each step of every order of the filters, a row a part, order and step.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley as long counts within the part. What a
    step removes depends on the set of the filters before it alone, so the sums of merged_sizes() hold every order;
    shapley weighs a set by the number of orders that begin with it. An empty table gives no rows.
    """
    spark, k = lists.sparkSession, len(filters)
    sums = cut(merged_sizes(lists, filters), "audit-sums")
    others = spark.createDataFrame([(f, "".join(sorted(set(filters) - {f}))) for f in filters], "filter string, before string")
    weights = F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)])
    share = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * weights[F.length("before")]).cast("long").alias("shapley"))
    alone = sums.join(F.broadcast(others), ["filter", "before"]).select("part", "filter", F.col("removed").alias("unique_fails"))
    orders = [("".join(o), i + 1, f, "".join(sorted(o[:i]))) for o in permutations(filters) for i, f in enumerate(o)]
    steps = sums.join(F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter string, before string")), ["filter", "before"])
    steps = steps.join(share, ["part", "filter"]).join(alone, ["part", "filter"])
    gone = F.sum("removed").over(W.partitionBy("part", "filter_order").orderBy("step"))
    return steps.select("part", "filter_order", "step", (F.col("n") - gone).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """audit() of the five filters over docs; columns: id_col, text_col and part_col.

    Nulls, repeated rows and ties as failures() has them; very long texts are judged whole, one at a time; further
    columns of docs, whatever their names, take no part.
    """
    return audit(cut(posting_lists(failures(docs, labels, **columns)), "audit-lists"))


AUDIT_SQL = r"""
with t as (select doc_id, coalesce(source, '') part, coalesce(text, '') text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') words, min(doc_id) over (partition by text) first_id from t),
l as (select doc_id, max((coalesce(quality = 1, false))::int) good, max((coalesce(toxic = 1, false))::int) toxic from labels group by 1),
m as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
             (len(words) < 50)::int a, (100 * len(list_distinct(words)) < 65 * len(words))::int b,
             (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::int c,
             regexp_matches(text, '[#$%&*|]')::int d, coalesce((first_id < w.doc_id)::int, 0) e
      from w left join l on w.doc_id = l.doc_id),
g as (select part, a + 2 * b + 4 * c + 8 * d + 16 * e mask, count(*) n, sum(good) good, sum(toxic) toxic from m group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) f, unnest([1, 2, 4, 8, 16]) bit),
o as (select f1.f || f2.f || f3.f || f4.f || f5.f filter_order, unnest([1, 2, 3, 4, 5]) step,
             unnest([f1.f, f2.f, f3.f, f4.f, f5.f]) f, unnest([f1.bit, f2.bit, f3.bit, f4.bit, f5.bit]) bit,
             unnest([0, f1.bit, f1.bit + f2.bit, f1.bit + f2.bit + f3.bit, 31 - f5.bit]) before
      from f f1, f f2, f f3, f f4, f f5 where f1.bit | f2.bit | f3.bit | f4.bit | f5.bit = 31),
s as (select part, filter_order, step, f,
             sum(case when mask & (before | bit) = 0 then n else 0 end)::bigint kept,
             sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end)::bigint removed,
             sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end)::bigint redundant,
             sum(case when mask = bit then n else 0 end)::bigint unique_fails,
             sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end)::bigint good_lost,
             sum(case when mask & bit > 0 and mask & before = 0 then toxic else 0 end)::bigint toxic_lost
      from g, o group by all)
select part, filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, f))::bigint shapley
from s
"""
