"""Compress vectors to codes: one codebook a part of the vector, learned and searched in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import cut, if_small

#: A component x becomes the integer floor(SCALE * x).
SCALE = 4096
#: Cells of the grid are 2 ** CELL_BITS wide in each component; a task remembers at most CELLS of them at once.
CELL_BITS, CELLS = 8, 20_000

#: One array of entries (entry, component) for each part.
Books = list[np.ndarray]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows whose vector is neither null nor holds a null or non-finite component."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & ~bad)


class Cells:
    """Which entries of a part's codebook may be nearest to a vector of a grid cell, remembered by cell.

    Over the box of a cell each entry has a least and a greatest distance. One whose least distance is above the smallest
    of all greatest ones is dominated: some other entry is nearer wherever in the box the vector is. The rest are kept as
    a bit mask, and vectors are compared with these alone, exactly.
    """

    def __init__(self, book: np.ndarray):
        self.book, self.seen = book, {}

    def masks(self, cells: np.ndarray) -> np.ndarray:
        """Entries that aren't dominated, (cell, entry), for rows of cell coordinates."""
        low = cells.astype(self.book.dtype) << CELL_BITS
        high = low + ((1 << CELL_BITS) - 1)
        below, above = low[:, None, :] - self.book, self.book - high[:, None, :]
        outside = np.maximum(np.maximum(below, above), 0)
        farthest = np.maximum(-below, -above)
        least, greatest = (outside * outside).sum(2), (farthest * farthest).sum(2)
        return least <= greatest.min(1)[:, None]

    def candidates(self, part: np.ndarray) -> np.ndarray:
        """The same by row of a part's vectors: each distinct cell is looked up once and judged if it is new."""
        cells = np.ascontiguousarray((part >> CELL_BITS).astype(np.int64))
        keys, where = np.unique(cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel(), return_index=True, return_inverse=True)[1:]
        names = [cells[i].tobytes() for i in keys]
        new = [i for i, name in enumerate(names) if name not in self.seen]
        found = {}
        if new:
            if len(self.seen) + len(new) > CELLS:
                found, self.seen = self.seen, {}
            self.seen.update(zip((names[i] for i in new), self.masks(cells[keys[new]]), strict=True))
        return np.array([self.seen[n] if n in self.seen else found[n] for n in names])[where.ravel()]

    def nearest(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry and its squared distance; ties go to the lower index."""
        if not part.shape[1]:
            return np.zeros(len(part), np.int64), np.zeros(len(part), self.book.dtype)
        rows, entries = np.nonzero(self.candidates(part))
        apart = part[rows] - self.book[entries]
        apart = (apart * apart).sum(1)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.minimum.reduceat(apart, starts)
        first = np.flatnonzero(apart == least[rows])
        first = first[np.r_[True, rows[first][1:] != rows[first][:-1]]]
        return entries[first], least


def parted(batch: pa.RecordBatch, parts: int, books: Books) -> list[np.ndarray]:
    """The batch's vectors, one matrix a part: parts differ by one component at most, longer ones first."""
    whole = np.array(batch.column("ints").to_pylist(), dtype=object if books[0].dtype == object else np.int64)
    return np.array_split(whole.reshape(batch.num_rows, sum(b.shape[1] for b in books)), parts, axis=1)


def learned(ints: DataFrame, books: Books, rounds: int) -> Books:
    """The codebooks after some rounds over the written table ints: each assigns all vectors and moves the entries.

    A task adds up its vectors by part and entry; sums are merged in a shuffle, and parts x entries of them reach the
    driver: as many numbers as the codebooks have, whatever the number of vectors.
    """
    parts = len(books)
    wide = books[0].dtype == object
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], books: Books = books) -> Iterator[pa.RecordBatch]:
            cells = [Cells(b) for b in books]
            total, count = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                if batch.num_rows:
                    for p, part in enumerate(parted(batch, parts, books)):
                        entry, _ = cells[p].nearest(part)
                        np.add.at(total[p], entry, part)
                        np.add.at(count[p], entry, 1)
            rows = [(p, e, i, str(x), int(count[p][e])) for p in range(parts) for e in range(len(books[p])) if count[p][e] for i, x in enumerate(total[p][e])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int32()] * 3 + [pa.string(), pa.int64()], strict=True)], ["part", "entry", "at", "total", "n"])

        got = ints.select("ints").mapInArrow(sums, "part int, entry int, at int, total string, n long")
        got = got.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in got.collect():
            books[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books if not wide else [b.astype(object) for b in books]


def digest(books: Books) -> str:
    """The sha-256 of all components as decimal numbers, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for each usable vector.

    Vectors are cut into consecutive parts; a part's codebook starts as that part of the vectors of smallest id and is
    moved in rounds, see learned(). The code has two hex digits a part, the index of its nearest entry; error is the sum
    of squared distances, label_error that of all vectors of the label, nulls together. All of it is in integers, so that
    no order of rows or tasks changes a result; components beyond what 64 bits can square are worked with in Python's
    integers, those beyond 64 bits count as the nearest long, and an error that is too large for a long is null.

    Rows with a null vector, or a null or non-finite component, are dropped. Rows that repeat an id are vectors of their
    own; equal ids start in the order of their components, null ids last; fewer vectors than entries give fewer
    entries. All vectors have the length of the first by id; one of another length has a null code and error and moves
    nothing. Where parts don't divide the length, the first ones are longer by one. Other columns take no part. An empty
    table gives no rows.
    """
    d = usable(vectors, id_col, vec_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("ints"))
    bounds = d.select(F.max(F.array_max(F.transform("ints", lambda x: F.abs(x.cast("decimal(20,0)"))))).alias("most"), F.max(F.size("ints")).alias("length")).first()
    if bounds["length"] is None:
        return d.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    wide = 4 * int(bounds["most"] or 0) ** 2 * max(1, bounds["length"]) >= 1 << 62
    ints = cut(d, "codes-ints")
    first = ints.orderBy(F.asc_nulls_last("id"), "ints").limit(entries).collect()
    length = len(first[0]["ints"])
    start = [r["ints"] for r in first if len(r["ints"]) == length]
    start = np.array(start, dtype=object if wide else np.int64).reshape(len(start), length)
    same = ints.where(F.size("ints") == length)
    books = learned(same, np.array_split(start, parts, axis=1), rounds)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                found = [c.nearest(part) for c, part in zip(cells, parted(batch, parts, books), strict=True)]
                code = ["".join(f"{e:02x}" for e in row) for row in zip(*(f[0].tolist() for f in found), strict=True)]
                error = [str(sum(row)) for row in zip(*(f[1].tolist() for f in found), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code), pa.array(error)], ["id", "label", "code", "error"])

    kind = dict(ints.dtypes)
    coded = same.mapInArrow(codes, f"id {kind['id']}, label {kind['label']}, code string, error string")
    rest = ints.where(F.size("ints") != length).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("error"))
    coded = cut(coded.unionByName(rest).withColumn("error", F.col("error").try_cast("decimal(38,0)")), "codes")
    by_label = cut(coded.groupBy(F.col("label").alias("l")).agg(F.try_sum("error").alias("label_error")), "codes-labels")
    joined = coded.join(if_small(by_label), F.col("label").eqNullSafe(F.col("l")), "left")
    long = lambda c: F.col(c).try_cast("long").alias(c)
    return joined.select("id", "code", long("error"), long("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    books = [f"b0 as materialized (select p, e, i, x from (select *, dense_rank() over (order by vec_id) - 1 e from v) where e < {entries})"]
    for k in range(rounds + 1):
        books.append(f"""a{k} as materialized (
  select vec_id, p, min(d * {entries} + e) % {entries} e, min(d) d from (
    select v.vec_id, v.p, b.e, sum((v.x - b.x) * (v.x - b.x))::bigint d from v join b{k} b on v.p = b.p and v.i = b.i group by all) group by all)""")
        if k < rounds:
            books.append(f"""b{k + 1} as materialized (
  select b.p, b.e, b.i, coalesce(m.x, b.x) x from b{k} b left join (
    select v.p, a.e, v.i, ((sum(v.x)::bigint - ((sum(v.x)::bigint % count(*)) + count(*)) % count(*)) // count(*))::bigint x
    from v join a{k} a on v.vec_id = a.vec_id and v.p = a.p group by all) m on b.p = m.p and b.e = m.e and b.i = m.i)""")
    steps = ",\n".join(books)
    return f"""
with s as (
  select vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select vec_id, len(embedding) // {parts} w, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 pos from s),
v as materialized (select vec_id, (pos // w)::int p, (pos % w)::int i, floor(x * {SCALE})::bigint x from c),
{steps},
r as (select vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) code, sum(d)::bigint error from a{rounds} group by vec_id)
select r.vec_id, code, error, (sum(error) over (partition by label))::bigint label_error,
       (select sha256(string_agg(x::varchar, ',' order by p, e, i)) from b{rounds}) codebooks_sha256
from r join s using (vec_id)
"""


CODES_SQL = _codes_sql()
