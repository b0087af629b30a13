"""numpy's array files as a Spark data source: matrices of vectors (.npy) and sparse matrices in rows (.npz).

    register(spark)
    spark.read.format("npy").load("folder/of/parts")            # row, embedding
    vectors.write.format("npy").save("folder")                  # from row, embedding
    spark.read.format("csr").load("weights.npz")                # row, column, value

A folder of .npy parts is one matrix, its rows counted through the parts in order of name. Each partition reads a range of
rows by its place in the file. Paths are local or of any file system that Arrow opens.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of an array that one partition reads, rows of one batch, and rows of one written part, where the options
#: partitionBytes, batchRows and partRows don't say otherwise.
PARTITION_BYTES, BATCH_ROWS, PART_ROWS = 64 << 20, 8_192, 65_536
#: Lists the parts that a committed write consists of.
MANIFEST = "_parts.json"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def parts_of(path: str, suffix: str) -> list[str]:
    """The file at path, or the parts in the folder at path: those of its manifest, else all by name."""
    fs, where = opened(path)
    info = fs.get_file_info(where)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(where)))
    if MANIFEST in names:
        with fs.open_input_stream(f"{where}/{MANIFEST}") as f:
            names = json.loads(f.read())
    elif f"{MANIFEST}.open" in names:
        raise ValueError(f"{path} holds a write that was not committed")
    return [f"{path.rstrip('/')}/{n}" for n in names if n.endswith(suffix)]


@dataclass
class Header:
    rows: int
    width: int
    dtype: np.dtype
    start: int


def header(path: str) -> Header:
    """Shape, type and place of the data of a .npy file of one or two dimensions in row order."""
    fs, where = opened(path)
    with fs.open_input_file(where) as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        if len(shape) not in (1, 2) or by_column and len(shape) == 2 or dtype.hasobject or dtype.kind not in "fiu":
            raise ValueError(f"{path} is not a matrix of numbers in row order")
        return Header(shape[0], shape[1] if len(shape) == 2 else 1, dtype, f.tell())


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    rows: int
    before: int

    def __init__(self, path: str, first: int, rows: int, before: int):
        super().__init__(None)
        self.path, self.first, self.rows, self.before = path, first, rows, before


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.check_norms = options["path"], str(options.get("checkNorms", "")).lower() == "true"
        self.bytes, self.batch = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("batchRows", BATCH_ROWS))

    def partitions(self) -> list[Rows]:
        out, before = [], 0
        for part in parts_of(self.path, ".npy"):
            h = header(part)
            step = max(1, self.bytes // max(1, h.width * h.dtype.itemsize))
            out += [Rows(part, at, min(step, h.rows - at), before + at) for at in range(0, h.rows, step)]
            before += h.rows
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h = header(partition.path)
        fs, where = opened(partition.path)
        with fs.open_input_file(where) as f:
            for at in range(0, partition.rows, self.batch):
                n = min(self.batch, partition.rows - at)
                size = h.width * h.dtype.itemsize
                f.seek(h.start + (partition.first + at) * size)
                raw = f.read(n * size)
                if len(raw) != n * size:
                    raise ValueError(f"{partition.path} is cut short")
                matrix = np.frombuffer(raw, h.dtype).reshape(n, h.width).astype(np.float64 if h.dtype.itemsize > 4 else np.float32)
                if self.check_norms and not (np.abs(np.linalg.norm(matrix.astype(np.float64), axis=1) - 1) <= 5e-3).all():
                    raise ValueError(f"{partition.path} holds vectors that are not of length 1")
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * h.width)
                first = partition.before + at
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(ends, pa.array(matrix.ravel().astype(np.float64)))], ["row", "embedding"])


@dataclass
class Parts(WriterCommitMessage):
    names: list[str]
    width: int | None


class NpyWriter(DataSourceWriter):
    """Parts of bounded size, which count once the manifest names them. Rows go in the order of their partitions."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.run, self.rows = options["path"].rstrip("/"), uuid.uuid4().hex[:12], int(options.get("partRows", PART_ROWS))
        fs, where = opened(self.path)
        if fs.get_file_info(where).type != pafs.FileType.NotFound and not overwrite:
            raise FileExistsError(self.path)
        fs.create_dir(where)
        with fs.open_output_stream(f"{where}/{MANIFEST}.open") as f:
            f.write(b"")

    def write(self, iterator) -> Parts:
        from pyspark import TaskContext

        context, names, rows, width = TaskContext.get(), [], [], None
        fs, where = opened(self.path)

        def flush() -> None:
            name = f"part-{context.partitionId():06d}-{len(names):05d}-{self.run}-{context.attemptNumber()}.npy"
            with fs.open_output_stream(f"{where}/{name}") as f:
                np.lib.format.write_array(f, np.array(rows, np.float32), allow_pickle=False)
            names.append(name)
            rows.clear()

        for row in iterator:
            vector = row["embedding"]
            if vector is None or width is not None and len(vector) != width:
                raise ValueError("vectors must be given and of one length")
            width = len(vector)
            rows.append(vector)
            if len(rows) == self.rows:
                flush()
        if rows:
            flush()
        return Parts(names, width)

    def commit(self, messages: list[Parts | None]) -> None:
        widths = {m.width for m in messages if m and m.width is not None}
        if len(widths) > 1:
            raise ValueError("vectors must be of one length")
        fs, where = opened(self.path)
        with fs.open_output_stream(f"{where}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        fs.delete_file(f"{where}/{MANIFEST}.open")

    def abort(self, messages: list[Parts | None]) -> None:
        fs, where = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{where}/{name}")


class NpySource(DataSource):
    """Matrices of vectors. Option checkNorms: reading fails on a vector that isn't of length 1."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, embedding array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


class CsrReader(DataSourceReader):
    """A .npz of data, indices, indptr and shape. Arrays that are stored as they are, are read by ranges of rows; of
    compressed ones a file is one partition, which streams through it."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes, self.batch = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("batchRows", BATCH_ROWS))

    def _arrays(self, path: str) -> tuple[dict[str, tuple[int, Header]], bool]:
        """Place and header of each array in a file, and whether all are stored uncompressed."""
        fs, where = opened(path)
        found, plain = {}, True
        with fs.open_input_file(where) as f, zipfile.ZipFile(f) as z:
            for entry in z.infolist():
                with z.open(entry) as member:
                    version = np.lib.format.read_magic(member)
                    shape, _, dtype = np.lib.format.read_array_header_1_0(member) if version == (1, 0) else np.lib.format.read_array_header_2_0(member)
                    skip = entry.file_size - int(np.prod(shape)) * dtype.itemsize
                f.seek(entry.header_offset + 26)  # where a local header has the lengths of the name and of what follows it
                lengths = np.frombuffer(f.read(4), "<u2")
                start = entry.header_offset + 30 + int(lengths[0]) + int(lengths[1]) + skip
                found[entry.filename.removesuffix(".npy")] = start, Header(shape[0] if shape else 1, 1, dtype, start)
                plain &= entry.compress_type == zipfile.ZIP_STORED
        if missing := {"data", "indices", "indptr"} - set(found):
            raise ValueError(f"{path} lacks arrays: " + ", ".join(sorted(missing)))
        return found, plain

    def partitions(self) -> list[Rows]:
        out, before = [], 0
        for part in parts_of(self.path, ".npz"):
            arrays, plain = self._arrays(part)
            rows = arrays["indptr"][1].rows - 1
            per_row = max(1, arrays["data"][1].rows * 12 // max(1, rows))
            step = max(1, self.bytes // per_row) if plain else max(1, rows)
            out += [Rows(part, at, min(step, rows - at), before + at) for at in range(0, rows, step)]
            before += rows
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        arrays, plain = self._arrays(partition.path)
        fs, where = opened(partition.path)
        if plain:
            with fs.open_input_file(where) as f:
                def values(name: str, at: int, n: int) -> np.ndarray:
                    start, h = arrays[name]
                    f.seek(start + at * h.dtype.itemsize)
                    return np.frombuffer(f.read(n * h.dtype.itemsize), h.dtype)

                yield from self._batches(partition, values)
            return
        with fs.open_input_file(where) as f, zipfile.ZipFile(f) as z:
            streams = {n: z.open(f"{n}.npy") for n in ("data", "indices", "indptr")}
            for s in streams.values():
                version = np.lib.format.read_magic(s)
                _ = np.lib.format.read_array_header_1_0(s) if version == (1, 0) else np.lib.format.read_array_header_2_0(s)
            last = np.zeros(0, arrays["indptr"][1].dtype)

            def values(name: str, at: int, n: int) -> np.ndarray:
                nonlocal last
                dtype = arrays[name][1].dtype
                if name != "indptr":
                    return np.frombuffer(streams[name].read(n * dtype.itemsize), dtype)
                # the end of one batch's rows is the start of the next one's
                last = np.r_[last[-1:], np.frombuffer(streams[name].read((n - len(last[-1:])) * dtype.itemsize), dtype)]
                return last

            yield from self._batches(partition, values)

    def _batches(self, partition: Rows, values) -> Iterator[pa.RecordBatch]:
        for at in range(0, partition.rows, self.batch):
            n = min(self.batch, partition.rows - at)
            ends = values("indptr", partition.first + at, n + 1).astype(np.int64)
            lo, size = int(ends[0]), int(ends[-1] - ends[0])
            rows = np.repeat(np.arange(n) + partition.before + at, np.diff(ends))
            columns, data = values("indices", lo, size), values("data", lo, size)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(columns.astype(np.int64)), pa.array(data.astype(np.float64))], ["row", "column", "value"])


class CsrSource(DataSource):
    """Sparse matrices in compressed rows, a row for each stored value."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "row long, column long, value double"

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats npy and csr known to a session."""
    spark.dataSource.register(NpySource)
    spark.dataSource.register(CsrSource)
