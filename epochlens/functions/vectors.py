"""Vectors as arrays of doubles: norms, products, hashed features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions.base import bound


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """v / |v|; null where |v| is zero or not finite."""
    n = l2_norm(v)
    return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: x / n))


def norm_violations(vectors: DataFrame, id_col: str, vector_col: str = "embedding", tolerance: float = 5e-3) -> DataFrame:
    """Vectors whose length differs from 1, or that hold null or non-finite components, or are of another dimension."""
    d = vectors.select(F.col(id_col), F.size(vector_col).alias("dim"), l2_norm(F.col(vector_col)).alias("norm"))
    usual = d.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).select(F.col("dim").alias("usual_dim"))
    return d.join(F.broadcast(usual)).where(F.col("norm").isNull() | F.isnan("norm") | (F.abs(F.col("norm") - 1) > tolerance) | (F.col("dim") != F.col("usual_dim"))).drop("usual_dim")


def casefolded(c: Column) -> Column:
    """Text folded for comparison without case: as Unicode folds it, but for letters of very few scripts."""
    return F.lower(F.replace(F.upper(c), F.lit("Σ"), F.lit("σ")))


def hash_vectorize(docs: DataFrame, id_col: str, text_col: str, dim: int = 64, adds: int = 8) -> DataFrame:
    """(id, index, value): L2-normalized feature hashes, sparse.

    A token's digest gives `adds` indexes, of two bytes each from its start on, modulo dim, and as many signs, each by the
    last bit of a byte from its middle on, odd ones up. A text without a token is one token, the whole of it. Tokens are counted a document
    first, so a digest is taken once a document and token. A null text is empty.
    """
    words = lambda t: bound(F.regexp_extract_all(t, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(t)))
    word = F.explode(bound(casefolded(F.coalesce(F.col(text_col), F.lit(""))), words))
    counts = docs.select(F.col(id_col).alias("id"), word.alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    hexed = counts.withColumn("h", F.sha2("token", 256))
    number = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("int")
    each = F.explode(F.array(*[F.struct((number(4 * i + 1, 4) % dim).alias("index"), (number(33 + 2 * i, 2) % 2).alias("odd")) for i in range(adds)]))
    parts = hexed.select("id", "n", each.alias("p")).select("id", "n", "p.*")
    sums = parts.groupBy("id", "index").agg(F.sum(F.when(F.col("odd") == 1, F.col("n")).otherwise(-F.col("n"))).alias("s"))
    norm = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("s") * F.col("s")).cast("double")).alias("norm"))
    return sums.join(norm, "id").where("norm > 0 and s <> 0").select("id", "index", (F.col("s") / F.col("norm")).alias("value"))


def fixture_vector(seed: Column, dim: int) -> Column:
    """A reproducible unit vector from a digest stream of the seed."""
    block = lambda i: F.sha2(F.concat_ws("\x1f", seed, i.cast("string")), 256)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(-(-dim // 32) - 1)), block), "")
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5)
    return l2_normalize(raw)


def mean_vectors(vectors: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """(key, embedding): the normalized mean of a key's normalized vectors, element by element."""
    d = vectors.select(key, F.posexplode(l2_normalize(F.col(vector_col))).alias("at", "x"))
    d = d.groupBy(key, "at").agg(F.avg("x").alias("x")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    return d.select(key, l2_normalize(F.col("xs.x")).alias("embedding"))
