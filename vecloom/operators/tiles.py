"""Tiles: many vectors as one row, so that joins move and pair few rows and numpy works on matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

TILE = 2048
#: What may be broadcast or shipped with a closure, in bytes.
SMALL_BYTES = 64 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column as a double matrix; all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def compact(df: DataFrame, name: str) -> Column:
    """The vectors of a column as shuffles should move them: floats stay floats, half the bytes, since ``matrix`` widens them; else doubles."""
    kind = df.schema[name].dataType
    return F.col(name) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(name).cast("array<double>")


def rows_of(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())) if len(m) else pa.array([], pa.list_(pa.float64()))


TILES = "n int, ids binary, data binary"


def tiles(vectors: DataFrame, id_name: str, vector_name: str, size: int = TILE) -> DataFrame:
    """(n, ids, data): the vectors as they lie in partitions, ``size`` to a row; no shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column(0).to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix(part.column(1)).tobytes()], pa.binary())], ["n", "ids", "data"])

    usable = vectors.select(F.col(id_name).cast("long").alias("id"), F.col(vector_name).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return usable.mapInArrow(pack, TILES)


def untile(n: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, np.float64).reshape(n, -1)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt to as many tasks as shuffles have, by columns if any: few rows that stand for much work, which would else end in a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds, and no negative zero; in numpy, since Spark rounds doubles one decimal object at a time."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = x * 10.0**digits
        near = np.abs(y) < 2.0**52  # beyond it there are no such digits
        return np.where(near, np.copysign(np.floor(np.abs(y) + 0.5), y) / 10.0**digits, x) + 0.0


def is_small(df: DataFrame, row_bytes: int) -> bool:
    """Whether ``df`` fits SMALL_BYTES; counts at most that many rows."""
    most = SMALL_BYTES // max(1, row_bytes)
    return df.limit(most + 1).count() <= most
