"""Vector files: ``.fvecs``, ``.ivecs``, ``.bvecs`` style rows and ``.bin``/``.fbin``/``.ibin`` matrices.

``*vecs``: each row is an int32 length and that many 4-byte numbers.
``*bin``: a uint32 row count, a uint32 column count, then all rows.
Row number is the id.  A file is read by ranges of rows, many tasks to a file.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffix to (number type, rows carry their length).
KINDS = {".fvecs": ("<f4", True), ".ivecs": ("<i4", True), ".bin": ("<f4", False), ".fbin": ("<f4", False), ".ibin": ("<i4", False)}
RECORD = 4


def kind_of(path: str) -> tuple[str, bool]:
    suffix = os.path.splitext(path)[1]
    if suffix not in KINDS:
        raise ValueError(f"{path}: one of {', '.join(KINDS)}")
    return KINDS[suffix]


def element(path: str) -> str:
    return "float" if kind_of(path)[0] == "<f4" else "int"


#: Bytes that a task reads at a time, and how many such ranges it takes.
RANGE_BYTES, RANGES = 8 << 20, 8


def locate(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI that every worker can open, and the path on it."""
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), os.path.abspath(path))


def exists(path: str) -> bool:
    system, at = locate(path)
    return system.get_file_info(at).type != FileType.NotFound


def size(path: str) -> int:
    """Bytes of a file; one that is not there is an error."""
    system, at = locate(path)
    info = system.get_file_info(at)
    if info.type != FileType.File:
        raise FileNotFoundError(path)
    return info.size


def _ranges(spark: SparkSession, path: str, start: int, stride: int, skip: int, rows: int, number: str) -> DataFrame:
    """(vec_id, embedding): ``rows`` rows of ``stride`` bytes from byte ``start`` on, numbers after ``skip`` bytes; each task opens the file and reads its ranges only."""
    per, kind = max(1, RANGE_BYTES // stride), "<i4" if number == "<i4" else "<f4"
    pieces = -(-rows // per)
    cells = spark.range(0, pieces, 1, max(1, min(pieces, -(-pieces // RANGES) if pieces > 64 else pieces)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = locate(path)
        with system.open_input_file(at) as f:
            for batch in batches:
                for piece in batch.column(0).to_pylist():
                    first = piece * per
                    n = min(per, rows - first)
                    m = np.frombuffer(f.read_at(n * stride, start + first * stride), np.uint8).reshape(n, stride)[:, skip:]
                    m = np.ascontiguousarray(m).view(number)
                    for k in range(0, n, 4096):
                        yield _rows(np.arange(first + k, first + min(n, k + 4096)), m[k : k + 4096].astype(kind), kind)

    return cells.mapInArrow(run, f"vec_id long, embedding array<{'int' if kind == '<i4' else 'float'}>")


def read(spark: SparkSession, path: str, vector_name: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of one file, or of the parts that ``write_parts`` left in a folder, in order.

    A file of any size is read by ranges of rows, many tasks to a file; the
    driver looks at its header and length only.  The path must be one that the
    workers can open, on a cluster a shared one.
    """
    number, carried = kind_of(path)
    system, at = locate(path)
    if system.get_file_info(at).type == FileType.Directory:
        names = sorted(i.base_name for i in system.get_file_info(FileSelector(at)) if i.base_name.startswith("part-"))
        return _one_after_another([read(spark, f"{path}/{name}", vector_name) for name in names], [shape(f"{path}/{name}")[0] for name in names], spark, vector_name, element(path))
    rows, cols = shape(path)
    start, skip = (0, 4) if carried else (8, 0)
    if not rows or not cols:
        return spark.createDataFrame([], f"vec_id long, {vector_name} array<{element(path)}>")
    return _ranges(spark, path, start, skip + RECORD * cols, skip, rows, number).withColumnRenamed("embedding", vector_name)


def shape(path: str) -> tuple[int, int]:
    """(rows, columns) of a file, from its header and length."""
    _, carried = kind_of(path)
    system, at = locate(path)
    length = size(path)
    with system.open_input_file(at) as f:
        head = f.read_at(min(8, length), 0)
    if carried:
        if length < 4:
            return 0, 0
        cols = struct.unpack("<i", head[:4])[0]
        if cols < 0 or length % (4 + RECORD * cols):
            raise ValueError(f"{path}: {length} bytes are no whole rows of {cols} numbers")
        return length // (4 + RECORD * cols), cols
    rows, cols = struct.unpack("<II", head)
    if length < 8 + rows * cols * RECORD:
        raise ValueError(f"{path}: {length} bytes are less than {rows} rows of {cols} numbers")
    return rows, cols


def _one_after_another(parts: list[DataFrame], counts: list[int], spark: SparkSession, vector_name: str, kind: str) -> DataFrame:
    """Several tables as one, ids running on."""
    out, before = spark.createDataFrame([], f"vec_id long, {vector_name} array<{kind}>"), 0
    for part, n in zip(parts, counts, strict=True):
        out = out.unionByName(part.withColumn("vec_id", F.col("vec_id") + before))
        before += n
    return out


def _rows(ids: np.ndarray, m: np.ndarray, number: str) -> pa.RecordBatch:
    kind = pa.float32() if number == "<f4" else pa.int32()
    lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).ravel(), kind), m.shape[1]).cast(pa.list_(kind)) if m.size else pa.array([[]] * len(ids), pa.list_(kind))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["vec_id", "embedding"])


def write(vectors: DataFrame, path: str, id_name: str = "vec_id", vector_name: str = "embedding") -> int:
    """One file of the vectors in order of id; returns how many.

    The format is one file with rows in order, so rows pass through the driver,
    one partition at a time; ``write_parts`` writes large tables in parallel.
    """
    number, carried = kind_of(path)
    ordered = vectors.select(F.col(id_name).alias("id"), F.col(vector_name).cast(f"array<{element(path)}>").alias("v")).orderBy("id")
    n, dims = 0, 0
    if not carried:  # the header comes first
        count = ordered.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    system, at = locate(path)
    with system.open_output_stream(at) as out:
        if not carried:
            out.write(struct.pack("<II", count["n"], count["dims"] or 0))
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            if n and len(row["v"]) != dims:
                raise ValueError(f"vectors of {dims} and of {len(row['v'])} numbers")
            dims = len(row["v"])
            out.write((struct.pack("<i", dims) if carried else b"") + np.array(row["v"], number).tobytes())
            n += 1
    return n


def write_parts(vectors: DataFrame, path: str, id_name: str = "vec_id", vector_name: str = "embedding") -> int:
    """A folder of files in order of id, each written by the task that holds its rows; returns how many rows.

    ``path`` ends in a known suffix and names the folder; ``read`` takes it as
    one file.  A part is written under a name of its attempt and moved when
    whole, so a task that runs again leaves no half part.
    """
    number, carried = kind_of(path)
    suffix = os.path.splitext(path)[1]
    system, at = locate(path)
    system.create_dir(at, recursive=True)
    ordered = vectors.select(F.col(id_name).cast("long").alias("id"), F.col(vector_name).cast(f"array<{element(path)}>").alias("v")).where("v is not null")
    ordered = ordered.repartitionByRange("id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = locate(path)
        context, n, dims = TaskContext.get(), 0, 0
        own, final = f"{at}/_attempt-{context.taskAttemptId()}", f"{at}/part-{context.partitionId():05d}{suffix}"
        body: list[bytes] = []
        with system.open_output_stream(own) as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                widths = batch.column(1).value_lengths().to_numpy()
                if (widths != (dims or widths[0])).any():
                    raise ValueError(f"vectors of {dims or widths[0]} numbers and of others")
                dims = int(widths[0])
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(number).reshape(-1, dims)
                if carried:
                    out.write(np.hstack([np.full((len(m), 1), dims, "<i4").view(number), m]).tobytes())
                else:
                    body.append(m.tobytes())  # the header, which comes first, holds the number of rows
                n += len(m)
            if not carried and n:
                out.write(struct.pack("<II", n, dims))
                for part in body:
                    out.write(part)
        if n:
            system.move(own, final)
        else:
            system.delete_file(own)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return ordered.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def convert(spark: SparkSession, source: str, target: str) -> int:
    """Rewrites a vector file in the format of another suffix."""
    return write(read(spark, source), target)


def npy_shape(path: str) -> tuple[int, int, int, str]:
    """(rows, columns, first byte, number type) of a ``.npy`` matrix stored row by row."""
    system, at = locate(path)
    with system.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        dims, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if len(dims) != 2 or by_column or kind.hasobject or kind.byteorder == ">":
            raise ValueError(f"{path}: a little-endian matrix stored row by row")
        return dims[0], dims[1], f.tell(), kind.str


def read_npy(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    """(vec_id, embedding) of a ``.npy`` matrix, the first ``keep`` rows; by ranges of rows."""
    rows, cols, start, kind = npy_shape(path)
    rows = rows if keep is None else min(rows, keep)
    if not rows or not cols:
        return spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = _ranges(spark, path, start, cols * np.dtype(kind).itemsize, 0, rows, kind)
    return found.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))


def merge_npy(spark: SparkSession, paths: list[str], keep: int) -> DataFrame:
    """The first ``keep`` rows of several ``.npy`` matrices one after another, ids running on."""
    counts, used = [], []
    for path in paths:
        if sum(counts) >= keep:
            break
        counts.append(min(npy_shape(path)[0], keep - sum(counts)))
        used.append(path)
    return _one_after_another([read_npy(spark, p, n) for p, n in zip(used, counts, strict=True)], counts, spark, "embedding", "float")
