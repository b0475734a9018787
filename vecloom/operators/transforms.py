"""Statistics per dimension, principal axes, random rotations, query samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import matrix, rows_of


def dimension_statistics(vectors: DataFrame, vector_name: str = "embedding") -> DataFrame:
    """(dim, mean, variance): population variance; sums per partition, then per dimension."""
    flat = vectors.select(F.posexplode(F.col(vector_name).cast("array<double>")).alias("dim", "v"))
    return flat.groupBy("dim").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))


def variances(vectors: DataFrame, vector_name: str = "embedding") -> np.ndarray:
    """The variances as an array; one number a dimension comes to the driver."""
    rows = dimension_statistics(vectors, vector_name).collect()
    return np.array([r["variance"] for r in sorted(rows, key=lambda r: r["dim"])])


def random_rotation(dims: int, seed: int) -> np.ndarray:
    """An orthogonal matrix from the QR decomposition of a random one."""
    q, r = np.linalg.qr(np.random.default_rng(seed).uniform(-1, 1, (dims, dims)))
    return (q * np.sign(np.diag(r))).T


def rotate(vectors: DataFrame, turn: np.ndarray, shift: np.ndarray | None = None, vector_name: str = "embedding") -> DataFrame:
    """``(x - shift) @ turn`` for each vector; other columns stay."""
    at = vectors.columns.index(vector_name)
    shift = np.zeros(turn.shape[0]) if shift is None else shift

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns]
            columns[at] = rows_of((matrix(batch.column(at)) - shift) @ turn)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    df = vectors.withColumn(vector_name, F.col(vector_name).cast("array<double>"))
    return df.mapInArrow(apply, df.schema)


def principal_axes(vectors: DataFrame, vector_name: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): all axes, most variance first, from products summed by row of the matrix.

    A partition sends each row of its d by d products once; rows are summed in
    parallel and only the d sums come to the driver.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            x = matrix(batch.column(0))
            x = np.hstack([np.ones((len(x), 1)), x])
            sums = x.T @ x if sums is None else sums + x.T @ x
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), rows_of(sums)], ["row", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, v in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
                sums[row] = sums[row] + v if row in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), rows_of(np.array(list(sums.values())))], ["row", "v"])

    v = vectors.select(F.col(vector_name).cast("array<double>").alias("v")).where("v is not null")
    rows = v.mapInArrow(products, "row int, v array<double>").repartition("row").mapInArrow(add, "row int, v array<double>").collect()
    s = np.array([r["v"] for r in sorted(rows, key=lambda r: r["row"])])
    n, mean = s[0, 0], s[0, 1:] / s[0, 0]
    values, axes = np.linalg.eigh(s[1:, 1:] / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)]
    # One sign for each axis, so that runs agree.
    return mean, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(axes))] < 0, -1.0, 1.0)


def holdout(vectors: DataFrame, n: int, seed: int = 0, id_name: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(queries, rest): ``n`` rows by a hash of their ids, and all others."""
    key = F.xxhash64(F.lit(seed), F.col(id_name))
    queries = vectors.orderBy(key, id_name).limit(n)
    return queries, vectors.join(queries.select(id_name), id_name, "left_anti")


def first_rows(parts: list[DataFrame], n: int, id_name: str = "vec_id") -> DataFrame:
    """The first ``n`` rows of several tables read one after another."""
    out = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_part", F.lit(i)))
    return out.orderBy("_part", id_name).limit(n).drop("_part")
