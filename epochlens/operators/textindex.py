"""A positional inverted index over text columns, kept as segments of sorted posting lists, and phrase search on it."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.functions.base import BROADCAST_ROWS, size_checked
from epochlens.functions.text import stem_word, token_text, tokens
from epochlens.sources.segments import Segments

#: Posting lists are dealt into buckets by their word; a query reads the buckets of its words.
BUCKETS = 64
#: Where the rows are that say which texts a block has, beside the buckets of words.
TEXTS_BUCKET = -1
#: Tasks that share a bucket while segments are merged, so that a word of most documents isn't one task.
SALTS = 8
#: So many segments of one tier are merged into one of the next.
FAN = 4
#: Texts of a block at most, and tokens after which no further text is taken into it.
TEXTS, TOKENS = 4000, 2_000_000
#: What the codes of a run's words are multiplied by, word by word, modulo 2^64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _packed(lengths: np.ndarray, values: np.ndarray, kind: type) -> pa.Array:
    """Lists of such lengths as bytes, which are handed on, sorted and written whole."""
    values = np.ascontiguousarray(values, kind)
    ends = np.append(0, np.cumsum(lengths * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _block(name: str, ids: pa.Array, rows: pa.Array, fields: list, lists: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of one block: one that lists its texts, and one for each word, in the order of words, which makes merging cheap."""
    words = pc.dictionary_encode(lists.flatten())
    by_word = pc.sort_indices(words.dictionary)
    nth = np.empty(len(by_word), np.int64)
    nth[by_word.to_numpy()] = np.arange(len(by_word))
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(lists)), size)
    pos = np.arange(len(words)) - np.repeat(size.cumsum() - size, size)
    key = nth[words.indices.to_numpy()] * len(lists) + text
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # of each word in each text
    word, of = np.divmod(key[first], len(lists))
    n, times = np.bincount(word), np.diff(np.append(first, len(key)))
    none = lambda field, k: pa.nulls(k, schema.field(field).type)
    one = lambda values, field: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(schema.field(field).type)
    own = [pa.array([name]), none("word", 1), one(ids, "ids"), one(rows, "rows"), one(pa.array(fields), "fields"), none("texts", 1), none("times", 1), none("positions", 1)]
    k, wide = len(words.dictionary), np.uint16 if size.max() < 1 << 16 else np.uint32
    in_all = np.add.reduceat(times, np.append(0, np.cumsum(n)[:-1]))
    each = [pa.array([name] * k), words.dictionary.take(by_word), none("ids", k), none("rows", k), none("fields", k), _packed(n, of, np.uint32), _packed(n, times, wide), _packed(in_all, pos[order], wide)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b.cast(a.type)]) for a, b in zip(own, each, strict=True)], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch], fields: list[str], prefix: str, schema: pa.Schema, most: int, tokens: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's rows (id, row, f0, f1, ...), which are in order of id and row; equal ones in these are one."""
    task, block, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), strict=True))
        batch = batch.filter(pa.array([key != before for key, before in zip(keys, [last, *keys], strict=False)]))
        last = keys[-1]
        for k, field in enumerate(fields):
            lists = pc.split_pattern(batch.column(f"f{k}"), " ")
            some = pc.not_equal(batch.column(f"f{k}"), "")
            lists, ids, rows = lists.filter(some), batch.column("id").filter(some), batch.column("row").filter(some)
            size, at = lists.value_lengths().to_numpy(zero_copy_only=False).cumsum(), 0
            while at < len(lists):
                end = min(at + most, int(np.searchsorted(size, (size[at - 1] if at else 0) + tokens)) + 1)
                n = min(end, len(lists)) - at
                yield _block(f"{prefix}-{task}-{block}", ids.slice(at, n), rows.slice(at, n), [field] * n, lists.slice(at, n), schema)
                at, block = at + n, block + 1


def _code(words: Iterable[np.ndarray]) -> np.ndarray:
    """Codes of runs from the codes of their first words, of their second ones, and so on."""
    code = np.uint64(0)
    for own in words:
        code = code * FACTOR + own
    return code


def _unpacked(lists: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of lists, number of the text, position) of each token, from the rows of one block's words."""
    packed = {c: b"".join(lists.column(c).to_pylist()) for c in ("texts", "times", "positions")}
    text = np.frombuffer(packed["texts"], np.uint32)
    wide = np.uint16 if len(packed["times"]) == 2 * len(text) else np.uint32
    times, pos = (np.frombuffer(packed[c], wide).astype(np.int64) for c in ("times", "positions"))
    of = np.repeat(np.arange(lists.num_rows), pc.binary_length(lists.column("texts")).to_numpy() // 4)
    return np.repeat(of, times), np.repeat(text.astype(np.int64), times), pos


def _runs(table: pa.Table, field: str | None, lengths: list[int], codes: dict | None, schema: pa.Schema) -> pa.Table:
    """(id, row, field, phrase, n) of one block: runs of neighbouring words, as long as some phrase is, and how often each
    stands in a text; with codes, of all runs those whose code is one of a phrase of that length."""
    own, lists = table.filter(pc.is_null(table.column("as"))), table.filter(pc.is_valid(table.column("as")))
    out = [schema.empty_table()]
    if not lists.num_rows:
        return out[0]
    ids, rows, fields = (own.column(c).combine_chunks().flatten() for c in ("ids", "rows", "fields"))
    words, coded = pc.dictionary_encode(lists.column("as").combine_chunks()), lists.column("code").to_numpy().astype(np.int64).view(np.uint64)
    nth = words.indices.to_numpy()  # words of one stem are one
    word, text, pos = _unpacked(lists)
    if field is not None:
        keep = pc.equal(fields, field).to_numpy(zero_copy_only=False)[text]
        text, pos, word = text[keep], pos[keep], word[keep]
    # places count on from text to text, with a gap that no run bridges
    place = text * (pos.max(initial=0) + max(lengths) + 1) + pos
    order = np.argsort(place)
    place, text, word = place[order], text[order], word[order]
    for n in lengths:
        if len(place) < n:
            continue
        at = np.flatnonzero(place[n - 1 :] - place[: len(place) - n + 1] == n - 1)
        if codes is not None:
            code, of = _code(coded[word[at + i]] for i in range(n)), codes[n]
            at = at[of[np.minimum(np.searchsorted(of, code), len(of) - 1)] == code]
        if len(at):
            found, count = np.unique(np.stack([text[at], *[nth[word[at + i]] for i in range(n)]], 1), axis=0, return_counts=True)
            phrase = pc.binary_join_element_wise(*[words.dictionary.take(pa.array(found[:, i + 1])) for i in range(n)], " ")
            of = pa.array(found[:, 0])
            out.append(pa.Table.from_arrays([ids.take(of), rows.take(of), fields.take(of), phrase, pa.array(count)], schema=schema))
    return pa.concat_tables(out)


class TextIndex:
    """Posting lists in segments below root.

    An append deals its rows by a digest into tasks, and each task cuts its own into blocks of at most TEXTS texts (one
    field of a row). Of a block, a word has one row: the numbers of the texts where it stands, how often in each, and its
    positions there, counted in tokens, as bytes; and one row of the block has ids, rows and fields of its texts. row is a digest of
    a row's texts, so that rows that repeat an id stay apart. Each append writes one segment and registers it; FAN segments
    of a tier are merged into one, so n appends leave about log n segments, and each list is rewritten as often.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.store, self.buckets = Segments(spark, root), buckets

    def append(self, docs: DataFrame, id_col: str, fields: list[str]) -> None:
        """Add the rows of docs. Null and token-less texts have no postings; rows that are equal in id and texts are one.

        Only texts are shuffled, and in an order of their own, so that a task that runs again makes the same blocks.
        """
        from pyspark.sql.pandas.types import to_arrow_schema

        row = F.xxhash64(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
        d = docs.select(F.col(id_col).alias("id"), row.alias("row"), *[F.col(f).alias(f"f{k}") for k, f in enumerate(fields)])
        d = d.repartition("id", "row").sortWithinPartitions("id", "row").select("id", "row", *[token_text(F.col(f"f{k}")).alias(f"f{k}") for k in range(len(fields))])
        kinds = f"block string, word string, ids array<{dict(d.dtypes)['id']}>, rows array<long>, fields array<string>, texts binary, times binary, positions binary"
        schema, prefix = to_arrow_schema(self.store.spark.createDataFrame([], kinds).schema), uuid.uuid4().hex
        most = TEXTS, TOKENS
        blocks = d.mapInArrow(lambda batches: _blocks(batches, fields, prefix, schema, *most), kinds)
        blocks = blocks.withColumn("bucket", F.when(F.col("word").isNull(), TEXTS_BUCKET).otherwise(bucket_of(F.col("word"), self.buckets)))
        version, segments = self.store.live()
        self.store.register(version, [*segments, {"name": self.store.write(blocks, ["bucket"]), "tier": 0}])
        self._merge()

    def _merge(self) -> None:
        """Merge while some tier has FAN segments. A merged segment is sorted by word within each file of a bucket."""
        while True:
            version, segments = self.store.live()
            tiers = [s["tier"] for s in segments]
            full = sorted(t for t in set(tiers) if tiers.count(t) >= FAN)
            if not full:
                return
            old = [s for s in segments if s["tier"] == full[0]]
            dealt = self.store.read(old).repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(SALTS)))
            merged = self.store.write(dealt.sortWithinPartitions("bucket", "word"), ["bucket"])
            self.store.register(version, [*[s for s in segments if s not in old], {"name": merged, "tier": full[0] + 1}])

    def postings(self) -> DataFrame:
        """The rows of all live blocks."""
        segments = self.store.live()[1]
        if not segments:
            raise ValueError("the index has no segment")
        return self.store.read(segments)

    def vocabulary(self) -> DataFrame:
        """(word, bucket, stem) of every word, each stemmed once."""
        return self.postings().where("word is not null").select("word", "bucket").distinct().withColumn("stem", stem_word(F.col("word")))

    def phrases(self, terms: DataFrame, field: str | None = None, stem: bool = False) -> DataFrame:
        """(query_id, id, field, n_hits): how often the phrase of a term (query_id, normalized) stands in a field of a row.

        The distinct words of all phrases are joined to their posting lists alone, each read once from the buckets that hold
        them. The lists of a block then meet in one place, and runs of neighbouring positions, as long as some phrase is, are
        joined to the phrases that they spell; so what is shuffled grows with the postings, however many terms there are. Up
        to BROADCAST_ROWS phrases, runs that spell none are left out where they are found, by codes.
        Rows that repeat an id count together. stem: words of one stem are alike. Terms without a word find nothing.
        """
        from pyspark.sql.pandas.types import to_arrow_schema

        t = terms.select("query_id", tokens(F.col("normalized")).alias("toks")).where("size(toks) > 0")
        if stem:
            t = t.select("query_id", F.posexplode("toks").alias("k", "word")).withColumn("word", stem_word(F.col("word")))
            t = t.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("toks"))
        t = size_checked(t.select("query_id", F.size("toks").alias("n"), F.array_join("toks", " ").alias("phrase")))
        words = t.select(F.explode(F.split("phrase", " ")).alias("as")).distinct()
        if stem:
            words = words.join(self.vocabulary().withColumnRenamed("stem", "as"), "as")
        else:
            words = words.select("as", F.col("as").alias("word"), bucket_of(F.col("as"), self.buckets).alias("bucket"))
        words = size_checked(words)
        buckets = [r["bucket"] for r in words.select("bucket").distinct().collect()]  # BUCKETS at most
        phrases = t.groupBy("phrase").agg(F.first("n").alias("n"))
        counted = {r["n"]: r["k"] for r in phrases.groupBy("n").agg(F.count("*").alias("k")).collect()}  # a row a length
        lengths, codes = sorted(counted), None
        if sum(counted.values()) <= BROADCAST_ROWS:
            codes = {n: [] for n in lengths}
            for r in phrases.select("n", F.transform(F.split("phrase", " "), lambda w: F.xxhash64(w)).alias("codes")).collect():
                codes[r["n"]].append(r["codes"])
            codes = {n: np.unique(_code(np.array(c, np.int64).view(np.uint64).T)) for n, c in codes.items()}
        p = self.postings().where(F.col("bucket").isin([*buckets, TEXTS_BUCKET]))
        lists = p.join(words, ["bucket", "word"]).select("block", "as", F.xxhash64("as").alias("code"), "ids", "rows", "fields", "texts", "times", "positions")
        texts = p.where("word is null").select("block", F.lit(None).cast("string").alias("as"), F.lit(0).cast("long").alias("code"), "ids", "rows", "fields", "texts", "times", "positions")
        kinds = f"id {dict(p.dtypes)['ids'][len('array<') : -1]}, row long, field string, phrase string, n long"
        schema = to_arrow_schema(p.sparkSession.createDataFrame([], kinds).schema)
        found = lists.union(texts).groupBy("block").applyInArrow(lambda table: _runs(table, field, lengths, codes, schema), kinds)
        # a row of texts that several segments have counts once; then rows of one id together, which are where these are
        found = found.repartition("phrase", "id", "field").groupBy("phrase", "id", "row", "field").agg(F.max("n").alias("n")).groupBy("phrase", "id", "field").agg(F.sum("n").alias("n_hits"))
        found = found.join(t.drop("n"), "phrase").select("query_id", "id", "field", "n_hits")
        one = not t.groupBy("query_id").count().where("count > 1").limit(1).count()
        return found if one else found.groupBy("query_id", "id", "field").agg(F.sum("n_hits").alias("n_hits"))
