"""Reading and writing corpora, checksums, manifests, and idempotent loads."""

from __future__ import annotations

import hashlib
import json
import os
import re
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.functions.base import ranged_ranks, written
from epochlens.functions.digests import Sha256, resumable

ERROR_COLUMNS = ("error_type", "error_subtype")
#: Bytes of a file that one task reads for its digest, and of a record where a file is read in records.
PART_BYTES, RECORD_BYTES = 128 << 20, 64 << 10


def read_corpus_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as text, quotes and line breaks inside them allowed; raises without a header or a required column."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=False)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    if not any(names):
        raise ValueError("the CSV has no header")
    if missing := sorted(set(required) - set(names)):
        raise ValueError("the CSV lacks columns: " + ", ".join(missing))
    reject_dirty(path, names)
    return df.toDF(*names).select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])


def reject_dirty(path: str, columns: list[str]) -> None:
    """Error-injected inputs name themselves or have error columns."""
    bad = sorted(c for c in columns if c.lower() in ERROR_COLUMNS or c.lower().endswith("_error"))
    if bad or "dirty" in os.path.basename(path.rstrip("/")).lower():
        raise ValueError("the input is marked as dirty: " + ", ".join(bad or [path]))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct integer ids of a JSON list, bare or under objectIDs."""
    text = spark.read.text(path, wholetext=True)
    ids = F.coalesce(F.from_json(F.get_json_object("value", "$.objectIDs"), "array<bigint>"), F.from_json("value", "array<bigint>"))
    return text.select(F.explode(ids).alias("object_id")).where("object_id is not null").distinct()


def write_corpus(df: DataFrame, path: str, fields: list[str] | None = None, kind: str = "parquet") -> None:
    """Write once: an existing path is an error. Parquet is zstd; CSV has a header and empty texts for nulls."""
    out = df.select(*fields) if fields else df
    if kind == "csv":
        out.write.mode("errorifexists").csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        out.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_weights(weights: DataFrame, path: str) -> None:
    """The weight matrix as a long table, ordered so that a read of few bins skips the rest.

    Ranges go by bin and then by a digest of the row, so a large bin is many tasks and files.
    """
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in weights.columns])
    weights.repartitionByRange("bin_start", digest).sortWithinPartitions("bin_start").write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_typed_corpus(df: DataFrame, integers: tuple[str, ...], booleans: tuple[str, ...]) -> DataFrame:
    """snake_case to camelCase, with typed columns; text that is no integer becomes null."""
    camel = lambda s: s.split("_")[0] + "".join(x[:1].upper() + x[1:] for x in s.split("_")[1:])
    typed = lambda c: F.col(c).try_cast("int") if c in integers else F.lower(F.trim(c)).isin("1", "true", "yes") if c in booleans else F.col(c)
    return df.select([typed(c).alias(camel(c)) for c in df.columns])


def read_denominators(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    want = {"bin_index": "int", "bin_key": "string", "bin_start": "int", "bin_end": "int", "bin_label": "string", "eligible_weight": "double", "physical_object_count": "bigint", "visual_cluster_count": "bigint"}
    return df.select([F.col(c).try_cast(t).alias(c) for c, t in want.items() if c in df.columns]).orderBy("bin_index")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path) if path.endswith(".json") else spark.read.parquet(path)
    return df.withColumn("embedding", F.col("embedding").cast("array<float>"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256) of every file below root, hashed where it is read; a file over PART_BYTES a part at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").split("://")[-1].replace(".", r"\.") + "/", "")
    digested = [base.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")]
    large = files.where(F.col("length") > PART_BYTES).select("path", "length").collect() if resumable() else []
    if not large:
        return files.select(*digested)
    digest = lambda r: sha256_in_ranges(spark, *r) if named_as_compressed(spark, r["path"]) else sha256_in_parts(spark, *r)
    with ThreadPool(min(len(large), spark.sparkContext.defaultParallelism)) as pool:
        digests = pool.map(inheritable_thread_target(spark)(digest), large, 1)
    rows = [(*r, d) for r, d in zip(large, digests)]
    parted = spark.createDataFrame(rows, "path string, length bigint, sha256 string").select(base.alias("path"), F.col("length").alias("bytes"), "sha256")
    return files.where(F.col("length") <= PART_BYTES).select(*digested).union(parted)


def literal_path(path: str) -> str:
    """A path that is read as it is, not as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def named_as_compressed(spark: SparkSession, path: str) -> bool:
    """Whether Spark's text source would unpack a file of that name."""
    hadoop = spark._jvm.org.apache.hadoop
    return hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(hadoop.fs.Path(path)) is not None


def hashed_on(batches, plain: bytes, marked: bytes, size: int):
    """(plain, marked, size, at): the states of the two digests after a split's lines, the bytes so far, where the split starts."""
    a, b, at = Sha256(plain), Sha256(marked), None
    for batch in batches:
        lines = batch.column(0).to_pylist()
        if lines:
            data = b"\n".join([b"", *lines] if size else lines)
            a.update(data), b.update(data)
            size, at = size + len(data) + (0 if size else 1), batch.column(1)[0].as_py()
    if at is not None:
        yield pa.RecordBatch.from_pydict({"plain": [a.state()], "marked": [b.state()], "size": [size], "at": [at]})


def sha256_in_parts(spark: SparkSession, path: str, length: int) -> str:
    """The SHA-256 of one file, whose splits are read by one task each, in order; the digest's state goes from task to task.

    The text source gives a file's bytes unchanged, a row a line, but for line feeds, which are put back, and for a byte
    order mark, which it leaves out: so a digest with a mark goes along. The length tells if there was one, and if the
    last line ended in a line feed. Reading a line stops after an eighth of a part, and a file with such a line is read in
    ranges instead, as its line would be one row of one task.
    """
    session = spark.newSession()  # split sizes are settings of a session
    for k, v in spark.conf.getAll.items():
        if session.conf.get(k, None) != v and (spark.conf.isModifiable(k) or not k.startswith("spark.")):
            session.conf.set(k, v)
    session.conf.set("spark.sql.files.maxPartitionBytes", str(PART_BYTES))
    session.conf.set("spark.sql.files.minPartitionNum", "1")
    reader = session.read.option("mapreduce.input.linerecordreader.line.maxlength", PART_BYTES // 8)
    text = reader.text(literal_path(path), lineSep="\n", recursiveFileLookup=True)
    lines = text.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("at"))
    state, last = (Sha256().state(), Sha256().update(b"\xef\xbb\xbf").state(), 0), -1
    for split in range(lines.rdd.getNumPartitions()):
        after = lines.mapInArrow(lambda batches, s=state: hashed_on(batches, *s), "plain binary, marked binary, size bigint, at bigint")
        for r in spark.sparkContext.runJob(after.rdd, list, [split]):  # none if no line begins in the split
            if r["at"] <= last:
                raise ValueError(f"the splits of {path} are not in order")
            state, last = (bytes(r["plain"]), bytes(r["marked"]), r["size"]), r["at"]
        if state[2] + 4 < min((split + 1) * PART_BYTES, length):  # more is missing than a mark and a line feed
            return sha256_in_ranges(spark, path, length)
    plain, marked = Sha256(state[0]), Sha256(state[1])
    ends = {0: plain.update(b"\n"), 1: Sha256(state[0]), -3: marked.update(b"\n"), -2: Sha256(state[1])}
    if state[2] - length not in ends:
        return sha256_in_ranges(spark, path, length)
    return ends[state[2] - length].hexdigest()


def hashed_records(records, path: str, state: bytes, size: int) -> tuple[bytes, int]:
    """The digest's state after a split's records, and the bytes so far."""
    digest = Sha256(state)
    for at, data in records:
        if at != size:
            raise ValueError(f"the records of {path} are not in order")
        digest.update(bytes(data))
        size += len(data)
    return digest.state(), size


def sha256_in_ranges(spark: SparkSession, path: str, length: int) -> str:
    """As sha256_in_parts, for any bytes: splits are read in records of fixed length.

    Hadoop takes a shorter last record for an error, so the last split is cut into smaller ones, twice, and what is left of
    the file is read by the byte. The file is mounted under a name without suffix, comma or wildcard, so nothing is unpacked.
    """
    mount, hadoop = "digest" + hashlib.sha256(path.encode()).hexdigest()[:32], "org.apache.hadoop"
    link = {f"fs.viewfs.mounttable.{mount}.link./file": spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()}
    state, size = Sha256().state(), 0
    for split, whole in ((PART_BYTES, True), (PART_BYTES >> 4, True), (PART_BYTES >> 8, True), (PART_BYTES >> 8, False)):
        cut = {f"mapreduce.input.fileinputformat.split.{k}": str(split) for k in ("minsize", "maxsize")}
        conf = link | cut | {"fixedlengthinputformat.record.length": str(min(RECORD_BYTES, split) if whole else 1)}
        records = spark.sparkContext.newAPIHadoopFile(f"viewfs://{mount}/file", f"{hadoop}.mapreduce.lib.input.FixedLengthInputFormat", f"{hadoop}.io.LongWritable", f"{hadoop}.io.BytesWritable", conf=conf)
        for k in range(size // split, records.getNumPartitions() - whole):
            [(state, size)] = spark.sparkContext.runJob(records, lambda rows, s=(state, size): [hashed_records(rows, path, *s)], [k])
    if size != length:
        raise ValueError(f"{path} changed while it was read")
    return Sha256(state).hexdigest()


def checksum_mismatches(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the manifest that are missing, outside the root, or of another size or digest."""
    f = found.select("path", F.col("bytes").alias("f_bytes"), F.col("sha256").alias("f_sha"))
    why = F.when(F.col("path").startswith("/") | F.col("path").contains(".."), "outside").when(F.col("f_sha").isNull(), "missing").when(F.col("f_bytes") != F.col("bytes"), "size").when(F.col("f_sha") != F.lower("sha256"), "digest")
    return manifest.join(f, "path", "left").select("path", why.alias("reason")).where("reason is not null")


def utc_timestamp(c):
    """ISO time in UTC, or "not-recorded"."""
    return F.coalesce(F.date_format(F.to_utc_timestamp(c.try_cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("not-recorded"))


def table_entry(spark: SparkSession, root: str, name: str, rows: DataFrame) -> DataFrame:
    """(path, bytes, sha256, rows) of a table that was written to root/name: its files' sizes summed, the digest of their
    digests in order of path, and its number of rows."""
    files = inventory(spark, f"{root.rstrip('/')}/{name}").where(~F.col("path").rlike("(^|/)[._]"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: x["sha256"])
    of_files = files.agg(F.lit(name).alias("path"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(parts, ""), 256).alias("sha256"))
    return of_files.join(rows.agg(F.count("*").alias("rows")))


def build_manifest(counts: DataFrame, bins: DataFrame, files: DataFrame, rules: dict, rules_version: str = "", retrieved_at: str | None = None) -> DataFrame:
    """One row, manifest: JSON of counts, rules, bins and artefacts, in a fixed order.

    files has a row an artefact (path, bytes, sha256, and rows where known), such as table_entry() gives, so what meets
    in one row is as long as the lists of artefacts and bins; retrieved_at is given in UTC or as not recorded.
    """
    b = bins.agg(F.array_sort(F.collect_list(F.struct("bin_index", "bin_key", "bin_start", "bin_end"))).alias("bins"))
    f = files.agg(F.array_sort(F.collect_list(F.struct("path", *[c for c in files.columns if c != "path"]))).alias("files"))
    c = counts.select(F.struct(*counts.columns).alias("counts"))
    version = F.struct(F.lit(rules_version).alias("version"), F.lit(json.dumps(rules, sort_keys=True)).alias("rules"))
    return c.join(b).join(f).select(F.to_json(F.struct(utc_timestamp(F.lit(retrieved_at)).alias("retrieved_at"), "counts", version.alias("date_rules"), "bins", "files")).alias("manifest"))


def ordered_insert(incoming: DataFrame, existing: DataFrame, keys: list[str], order: str, after=None, limit: int | None = None) -> tuple[DataFrame, object]:
    """(rows, cursor): what inserting incoming rows one by one, in order, into existing leaves new, and how far it came.

    A row is passed over if an existing row, or one inserted before it, has its value in any unique key; null values conflict
    with none, and a row that is passed over stops no other. Rows count in the order of a column, and in that of a digest
    of the row where it is equal. With after, only rows beyond it take part; with limit, only so many of these; the cursor
    is the last row's value of the order column, inserted or not, to go on after, or after itself where none is left.

    In rounds: of the rows that are still open, the ones that come first in each of their keys are inserted, and the others
    that share a value with one of these are passed over. Both are found by minima a value and a join, written each
    time. Random orders take about as many rounds as the log of the rows; a chain of conflicts as many as its length.
    """
    open_rows = incoming.where(F.col(order).isNotNull()) if after is None else incoming.where(F.col(order) > F.lit(after))
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in incoming.columns])
    if limit is not None:
        open_rows = open_rows.orderBy(order, digest).limit(limit)
    rows = written(ranged_ranks(open_rows.withColumn("__d", digest), [F.col(order), F.col("__d")], [], "__place"), "insert")
    cursor = rows.agg(F.max(order).alias("c")).first()["c"]
    values = F.array(*[F.struct(F.lit(i).alias("key"), F.col(f"`{k}`").cast("string").alias("value")) for i, k in enumerate(keys)])
    held = existing.select(F.explode(values).alias("x")).select("x.*").where("value is not null").distinct()
    claims = rows.select("__place", F.explode(values).alias("x")).select("__place", "x.*").where("value is not null")
    stopped = claims.join(held, ["key", "value"], "left_semi").select("__place").distinct()
    claims = written(claims.join(stopped, "__place", "left_anti"), "claims")
    inserted = rows.join(stopped, "__place", "left_anti").join(claims.select("__place").distinct(), "__place", "left_anti").select("__place")
    while claims.limit(1).count():
        first = claims.groupBy("key", "value").agg(F.min("__place").alias("first"))
        judged = written(claims.join(first, ["key", "value"]), "judged")
        taken = written(judged.groupBy("__place").agg(F.bool_and(F.col("first") == F.col("__place")).alias("ok")).where("ok").select("__place"), "taken")
        beaten = judged.join(taken.select(F.col("__place").alias("first")), "first", "left_semi").select("__place").distinct()
        claims = written(claims.join(beaten, "__place", "left_anti"), "claims")
        inserted = inserted.union(taken)
    return rows.join(inserted, "__place", "left_semi").select(incoming.columns), after if cursor is None else cursor


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key no existing row has, one a key: the first by the digest of its columns; null keys all stay."""
    out = incoming.join(existing.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    first = W.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in incoming.columns]))
    return out.withColumn("__r", F.row_number().over(first)).where(F.col(key).isNull() | (F.col("__r") == 1)).select(incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key: the one of the highest version, incoming before existing."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    order = W.partitionBy(key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__new")


def load_status(df: DataFrame, row_id: str) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.max(row_id).alias("last_row_id"))
