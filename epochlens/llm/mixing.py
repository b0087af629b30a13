"""Mix sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Targets of sources from (k, source_size): a share of all sizes by weight, at most max_repeats times the
    source's own size; what is cut off goes to the others by weight. One row a source, so one task is enough."""
    by_key, by_cap, every = W.orderBy("k"), W.orderBy("cap_ratio", "k"), W.partitionBy(F.lit(0))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    w = F.array(*map(F.lit, weights))[(F.row_number().over(by_key) - 1) % len(weights)]
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeats)
    s = s.withColumn("cap_ratio", F.col("cap") / F.col("w"))
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    level = F.min(F.when(F.col("level") <= F.col("cap_ratio"), F.struct("cap_ratio", "k", "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("w"))
    s = s.withColumn("target", target)
    return s.select("k", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def systematic_mix(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Add mix_size, mix_source_size, mix_target and mix_copies to every document.

    Within a source, documents are ordered by size and then by a keyed digest of their id; each expects
    target / source size copies. The prefix sum of these, plus one keyed random offset a source, gives a copy
    for each integer that it crosses. Order by size spreads the copies evenly over sizes, so the words taken
    stay near the target. The prefix sum is assembled from counts a (source, size) and (source, size, digest
    prefix), so no task holds a whole source.

    A null source is a source of its own and comes last; a null or empty text has size 0; rows that repeat an
    id are documents of their own. Sources without words get target 0. Columns with these four names are
    replaced. An empty table gives an empty result.
    """
    made = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    d = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c not in made]).alias("row"),
        F.when(docs[source_col].isNull(), "1").otherwise(F.concat(F.lit("0"), docs[source_col].cast("string"))).alias("k"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        F.md5(F.concat(F.lit(seed + "|"), F.coalesce(docs[id_col].cast("string"), F.lit("")))).alias("digest"),
        F.xxhash64(docs[text_col]).alias("tie"),
    ).withColumn("salt", F.substring("digest", 1, 2))
    cell = ["k", "size", "salt"]
    cells = d.groupBy(cell).agg(F.count("*").alias("n"))
    sizes = cells.groupBy("k", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(sizes.groupBy("k").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeats)
    larger = W.partitionBy("k").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("k", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("k", "size", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("before")).join(targets, "k")
    cells = cells.withColumn("in_size", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sizes, ["k", "size"]).select(*cell, (F.col("before") + F.col("in_size")).alias("before"), "source_size", "target", "rate")
    d = d.withColumn("nth", F.row_number().over(W.partitionBy(*cell).orderBy("digest", "tie"))).join(cells, cell)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), "k")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rank = F.col("before") + F.col("nth")
    crossed = F.floor(rank * F.col("rate") + offset) - F.floor((rank - 1) * F.col("rate") + offset)
    return d.select("row.*", F.col("size").alias(made[0]), F.col("source_size").alias(made[1]), F.col("target").alias(made[2]), F.least(crossed, F.lit(max_repeats)).cast("long").alias(made[3]))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row for each copy that systematic_mix gives a document, without the columns it added."""
    out = mixed.where("mix_copies > 0").withColumn("mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return out.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")


MIX_SQL = r"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         md5('mix-1|' || coalesce(doc_id::varchar, '')) digest
  from documents),
s as (select k, sum(size)::bigint source_size from d group by k),
w as (select *, 1 + (row_number() over (order by k) - 1) % 3 w, source_size * 3 cap from s),
c as (select *, cap::double / w cap_ratio from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap_ratio, k rows between unbounded preceding and 1 preceding), 0))::double
             / (sum(w) over () - coalesce(sum(w) over (order by cap_ratio, k rows between unbounded preceding and 1 preceding), 0))::double lvl from c),
f as (select lvl from l where lvl <= cap_ratio order by cap_ratio, k limit 1),
t as (select k, source_size, least(cap::double, coalesce((select lvl from f), 0) * w) target from l),
r as (select d.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end rate,
             ('0x' || substr(md5('mix-1|' || k), 1, 8))::bigint::double / 4294967296.0 o,
             row_number() over (partition by k order by size desc, digest) n
      from d join t using (k))
select doc_id, size, source_size, target,
       (least(floor(n * rate + o) - floor((n - 1) * rate + o), 3))::bigint * size taken
from r
"""
