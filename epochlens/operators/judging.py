"""How good retrieved rows are by judgments, and how much they depend on one group of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.functions.base import size_checked, written
from epochlens.operators.retrieval import best_rows, largest_score


def graded(hits: DataFrame, judgments: DataFrame, k: int = 10, relevant: float = 1.0) -> DataFrame:
    """(query_id, judged, precision, dcg, ideal_dcg, ndcg) of the first k hits (query_id, id, rank) of each query.

    judgments has (query_id, id, gain), or (id, gain) that hold for all queries; a row without one has gain 0, of several
    the largest counts. precision is the share of k whose gain is relevant or more. A hit adds 2^gain - 1, divided by the
    log of its rank, and the ideal order is that of all judged gains; without any gain ndcg is null.
    """
    keys = [c for c in ("query_id", "id") if c in judgments.columns]
    j = judgments.where("id is not null and gain is not null").groupBy(*keys).agg(F.max("gain").cast("double").alias("gain"))
    worth = lambda rank: (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col(rank) + 1)
    first = hits.where(F.col("rank") <= k).select("query_id", "id", "rank").join(j, keys, "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    own = first.groupBy("query_id").agg(F.count_if(F.col("gain") > 0).alias("judged"), (F.count_if(F.col("gain") >= relevant) / k).alias("precision"), F.sum(worth("rank")).alias("dcg"))
    if "query_id" in keys:
        best = j.withColumn("__r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("gain"), "id"))).where(F.col("__r") <= k)
        own = own.join(best.groupBy("query_id").agg(F.sum(worth("__r")).alias("ideal_dcg")), "query_id", "left")
    else:
        top = j.orderBy(F.desc("gain"), "id").limit(k).withColumn("__r", F.row_number().over(W.orderBy(F.desc("gain"), "id")))  # k rows
        own = own.join(F.broadcast(top.agg(F.sum(worth("__r")).alias("ideal_dcg"))))
    return own.withColumn("ideal_dcg", F.coalesce("ideal_dcg", F.lit(0.0))).withColumn("ndcg", F.when(F.col("ideal_dcg") > 0, F.col("dcg") / F.col("ideal_dcg")))


#: Groups that can be left out in turn; each is one more query beside every query.
MOST_GROUPS = 200


def topk_without_each(queries: DataFrame, corpus: DataFrame, group: str, k: int, id_col: str = "vec_id") -> DataFrame:
    """(query_id, left_out, id, score, rank): the best k rows of each query when all rows of one group are left out, for each group.

    The best k of every group are retrieved, once; whatever group is left out, the best of the rest are among them. Rows
    without a group are a group of their own that is never left out.
    """
    names = [r[group] for r in corpus.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).limit(MOST_GROUPS + 1).collect()]
    if len(names) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups can't be left out one by one")
    codes = size_checked(corpus.select(F.col(group).alias("__g")).distinct().withColumn("code", F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("__g")), F.lit(0)) if names else F.lit(0)))
    rows = corpus.join(codes, F.col(group).eqNullSafe(F.col("__g"))).select(F.col(id_col).alias("id"), "embedding", F.col("code").alias("first"), F.col("code").alias("last"))
    _, bound = largest_score(queries, rows)
    each = queries.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    best = best_rows(each.select(F.struct("query_id", "bin").alias("query_id"), "embedding", "bin"), rows, k, bound) if names else None
    if best is None:
        return corpus.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, left_out {dict(corpus.dtypes)[group]}, id {dict(corpus.dtypes)[id_col]}, score double, rank int")
    best = written(best.select("query_id.query_id", F.col("query_id.bin").alias("own"), "id", "score"), "group-best")
    each = best.withColumn("out", F.explode(F.filter(F.sequence(F.lit(1), F.lit(len(names))), lambda g: g != F.col("own"))))
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "out").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.array(*map(F.lit, names))[F.col("out") - 1].alias("left_out"), "id", "score", "rank")
