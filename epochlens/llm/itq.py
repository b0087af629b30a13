"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochlens.llm.common import components, cut, if_small, whole_groups, width

#: Vectors that the rotation is learned from, chosen by a hash of the id; every vector is indexed.
SAMPLE, ITERATIONS = 4000, 30
#: Bits of a code at least: those of shorter vectors have signs along further axes, through the origin and drawn at random.
LEAST_CODE = 64
#: Tables that codes are looked up in. At cosine 0.93 a bit differs with probability 0.12, so two codes share all 8 bits
#: of a table with 0.36 and one of 16 tables with 0.999.
TABLES = 16
#: Key bits of a table: so many that a bucket of evenly spread codes has ROWS_A_BUCKET rows, within these bounds.
LEAST_BITS, MOST_BITS, ROWS_A_BUCKET = 8, 20, 64
#: Keys of up to so many bits are looked up as they are, which finds 0.98 of pairs at 0.93; longer ones also with one bit
#: changed, which finds 0.99 with 20 bits.
EXACT_BITS = 10
#: Codes that differ in more than this share of their bits aren't compared: 4.5 deviations above the mean of 64 bits at 0.93.
MOST_APART = 0.3
#: Rows of a bucket that are compared with each other at once.
TILE = 2048


def unit_rows(vectors: list[list[float] | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, of the largest length there is, and which rows have one: null, zero, shorter and non-finite ones don't."""
    dim = max((len(v) for v in vectors if v), default=0)
    ok = np.array([v is not None and len(v) == dim and dim > 0 and None not in v for v in vectors], bool)
    x = np.zeros((len(vectors), dim))
    if ok.any():
        x[ok] = np.array([v for v, k in zip(vectors, ok, strict=True) if k], np.float64)
    ok &= np.isfinite(x).all(1)
    x[~ok] = 0
    top = np.abs(x).max(1, initial=0)
    ok &= top > 0
    x = x / np.where(top > 0, top, 1)[:, None]  # so that squares neither overflow nor vanish
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(ok, norm, 1)[:, None], ok


def learn_rotation(x: np.ndarray, iterations: int = ITERATIONS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection onto rotated principal axes, whose signs lose least: alternate codes and rotation."""
    mean = x.mean(0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T) if len(x) > 1 else np.eye(x.shape[1]))
    v = (x - mean) @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    for _ in range(iterations):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def code_bits(dim: int) -> int:
    return max(dim, LEAST_CODE)


def coded_rows(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Packed codes of unit vectors: signs along the rotated axes, and for short vectors along further ones. Two vectors at
    an angle differ in a further bit with the angle's share of a half turn, whatever the dimension."""
    dim = x.shape[1]
    further = np.random.default_rng(7).normal(size=(dim, code_bits(dim) - dim))
    return np.packbits(np.c_[(x - mean) @ projection >= 0, x @ further >= 0], axis=1)


def table_bits(dim: int, bits: int, tables: int = TABLES, seed: int = 6) -> np.ndarray:
    """Which code bits each table takes, table by table: shuffles of all bits, one after another, cut into pieces."""
    rng = np.random.default_rng(seed)
    bits, order = min(bits, dim), np.arange(dim)
    while len(order) < tables * bits:
        order = np.r_[order, rng.permutation(dim)]
    return order[: tables * bits].reshape(tables, bits)


def table_keys(codes: np.ndarray, bits: int) -> np.ndarray:
    """Keys of codes (rows by code bits) in every table."""
    picks = table_bits(codes.shape[1], bits)
    return (codes[:, picks] * (1 << np.arange(picks.shape[1]))).sum(2).astype(np.int32)


def unpacked(codes: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    return np.unpackbits(packed, axis=1, count=dim)


#: What a tile of a bucket is told by.
BUCKET = ["of", "place", "key", "tile"]


def _codes(rotations: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Unit vectors and their codes. A length that the sample hasn't is projected onto random axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(rotations)
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            unit, code, size = [None] * len(vectors), [None] * len(vectors), [len(v) if v else 0 for v in vectors]
            for dim in set(size) - {0}:
                if dim not in known:
                    known[dim] = np.zeros(dim), np.linalg.qr(np.random.default_rng(5).normal(size=(dim, dim)))[0]
                rows = [i for i, d in enumerate(size) if d == dim]
                x, ok = unit_rows([vectors[i] for i in rows])
                mean, projection = known[dim]
                packed = coded_rows(x, mean, projection)
                for i, v, c, fine in zip(rows, x, packed, ok, strict=True):
                    if fine:
                        unit[i], code[i] = v.tobytes(), c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(size, pa.int32()), pa.array(code, pa.binary()), pa.array(unit, pa.binary())], ["id", "label", "dim", "code", "unit"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node in every table under its key, and with long keys as a probe under those with a one turned to zero; of two
    codes that differ in one bit of a table so exactly one meets the other."""
    for batch in batches:
        node, of, dim, bits, code = (batch.column(c) for c in ("node", "of", "dim", "bits", "code"))
        dim, bits = dim.to_numpy(), bits.to_numpy()
        for d, b in {*zip(dim.tolist(), bits.tolist(), strict=True)}:
            rows = np.flatnonzero((dim == d) & (bits == b))
            keys = table_keys(unpacked(code.take(pa.array(rows)), code_bits(d)), b)
            at, place = (x.ravel() for x in np.indices(keys.shape))
            key, probe = keys.ravel(), np.zeros(keys.size, bool)
            if b > EXACT_BITS:
                one = (key[:, None] >> np.arange(min(b, code_bits(d)))) & 1
                i, bit = np.nonzero(one)
                at, place, key, probe = np.r_[at, at[i]], np.r_[place, place[i]], np.r_[key, key[i] - (1 << bit)], np.r_[probe, np.ones(len(i), bool)]
            take = pa.array(rows[at])
            yield pa.RecordBatch.from_arrays([node.take(take), of.take(take), pa.array(place, pa.int32()), pa.array(key, pa.int32()), pa.array(probe), pa.array(np.full(len(at), d), pa.int32()), pa.array(np.full(len(at), b), pa.int32()), code.take(take)], ["node", "of", "place", "key", "probe", "dim", "bits", "code"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for t in whole_groups(batches, BUCKET):
        of, place, key, tile = (t.column(c).to_numpy() for c in BUCKET)
        starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (place[1:] != place[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
        for i, j in zip(starts, np.r_[starts[1:], len(of)], strict=True):
            if j - i > 1:
                yield t.slice(i, j - i)


def _meeting(t: pa.Table) -> np.ndarray:
    """Which rows of a tile are compared: not two probes, across the sides of a tile of two blocks, and in the first table
    in which the two meet. Their codes tell all that, and must not be too far apart."""
    probe, side = t.column("probe").to_numpy(), t.column("side").to_numpy()
    dim, bits, place = (int(t.column(c)[0].as_py()) for c in ("dim", "bits", "place"))
    length = code_bits(dim)
    code = unpacked(t.column("code"), length)
    ok = ~(probe[:, None] & probe[None, :])
    np.fill_diagonal(ok, False)
    if t.column("tile")[0].as_py() < 0:
        ok &= side[:, None] != side[None, :]
    plain = code.astype(np.float32)
    ones = plain.sum(1)
    ok &= ones[:, None] + ones[None, :] - 2 * (plain @ plain.T) <= MOST_APART * length
    if place and ok.any():
        keys = table_keys(code, bits)
        reach = 1 if bits > EXACT_BITS else 0
        a, b = np.nonzero(np.triu(ok))
        early = np.zeros(len(a), bool)
        for k in range(place):
            early |= np.bitwise_count(keys[a, k] ^ keys[b, k]) <= reach
        ok[a[early], b[early]] = ok[b[early], a[early]] = False
    return ok


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that have another to be compared with, without codes' neighbours: vectors are fetched for these alone."""
    for t in _tiles(batches):
        hit = _meeting(t).any(1)
        if hit.any():
            yield from t.filter(pa.array(hit)).combine_chunks().to_batches()


def _compared(threshold: float):
    """For each node of a tile that links with another there: how many vectors those are, and the smallest node that
    the tile's links reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches):
            unit = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(t.num_rows, -1)
            near = (unit @ unit.T >= threshold) & _meeting(t)
            hit = np.flatnonzero(near.any(1))
            if not len(hit):
                continue
            node, copies = t.column("node").to_numpy()[hit], t.column("copies").to_numpy()[hit]
            near = near[np.ix_(hit, hit)]
            reach, was = np.arange(len(hit)), None
            while was is None or (reach != was).any():
                was = reach
                reach = np.minimum(reach, np.where(near, reach[None, :], len(hit)).min(1, initial=len(hit)))
                reach = reach[reach]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(near @ copies), pa.array(node[reach])], ["node", "n", "to"])

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row of vectors, which link within a label at cosine >= threshold.

    Rotations are fitted to a bounded sample, one for each length of vectors in it; all vectors are coded and put into
    every table under a key of bits of their code. Keys get longer with the number of vectors of a label, and long
    ones are also looked up with one bit changed, so buckets don't grow with the table. Vectors with equal label and
    direction are one node that counts as often as it occurs. Buckets hold codes alone, in tiles of bounded
    size; vectors are fetched for nodes with a code nearby and compared in double precision, each pair in the first table
    in which it meets. A tile puts out counts and a reach for each node, never pairs.

    Null labels, and vectors that are null, zero or hold null or non-finite components, link with nothing and are their
    own component; so are vectors of different lengths to each other. Labels and ids may be of any type that sorts.
    Rows that repeat an id are vectors of their own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    label = vectors[label_col]
    if isinstance(vectors.schema[label_col].dataType, (T.FloatType, T.DoubleType)):
        label = label + F.lit(0.0)  # minus zero is zero
    rows = vectors.select(vectors[id_col].alias("id"), label.cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("embedding"))
    learned = rows.where("embedding is not null").orderBy(F.xxhash64("id", F.lit(9)), "id").limit(sample).select("embedding").collect()
    rotations = {}
    for dim in {len(r[0]) for r in learned} - {0}:
        x, ok = unit_rows([r[0] for r in learned if len(r[0]) == dim])
        if ok.sum() > 1:
            rotations[dim] = learn_rotation(x[ok])
    coded = rows.mapInArrow(_codes(rotations), f"id {rows.schema['id'].dataType.simpleString()}, label string, dim int, code binary, unit binary")
    of = F.when(F.col("label").isNotNull() & F.col("unit").isNotNull(), F.xxhash64("label", "dim"))
    coded = cut(coded.withColumn("of", of).withColumn("node", F.when(of.isNotNull(), F.xxhash64("of", "unit"))), "codes")
    nodes = coded.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first(F.struct("of", "dim", "code", "unit")).alias("x")).select("node", "copies", "x.*")
    nodes = cut(nodes, "vectors")
    sizes = cut(nodes.groupBy("of").agg(F.count("*").alias("n")), "label-sizes")
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / ROWS_A_BUCKET)).cast("int"), F.lit(LEAST_BITS)), F.lit(MOST_BITS))
    wide = nodes.join(if_small(sizes.select("of", bits.alias("bits"))), "of").select("node", "of", "dim", "bits", "code")
    placed = cut(wide.mapInArrow(_placed, "node long, of long, place int, key int, probe boolean, dim int, bits int, code binary"), "places")
    shared = placed.groupBy("of", "place", "key").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("own")).where("n > 1 and own > 0")
    placed = placed.join(shared.select("of", "place", "key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")), ["of", "place", "key"])
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    tile = F.when(F.col("mine") == F.col("other"), tile).otherwise(-1 - tile)
    placed = placed.select("node", "of", "place", "key", tile.alias("tile"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "probe", "dim", "bits", "code")
    in_tiles = lambda df: df.repartition(width(spark), *BUCKET).sortWithinPartitions(*BUCKET)
    flagged = cut(in_tiles(placed).mapInArrow(_flagged, placed.schema), "flagged")
    full = flagged.join(nodes.select("node", "copies", "unit"), "node")
    found = cut(in_tiles(full).mapInArrow(_compared(threshold), "node long, n long, to long"), "vector-links")
    reached = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    first = coded.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    named = first.join(reached.withColumnRenamed("id", "r_node"), F.col("node") == F.col("r_node"), "left").join(links, "node", "left")
    named = named.select("node", F.coalesce("component", "node").alias("component"), "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = cut(named.join(smallest, "component").select("node", "n_links", "component_id"), "components")
    out = coded.select("id", "node").join(named, "node", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
