"""Exact nearest neighbours over tiles, and the check of a ground truth against them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..plans.config import IP, L2, check_distance
from .tiles import TILE, dealt, is_small, rounded, tiles, untile


def distances(x: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    """Queries by rows of ``x``: squared distances, or inner products; squared distances within ``error_of``."""
    s = q @ x.T
    return s if kind == IP else np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * s, 0.0)


def error_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How far ``distances`` may be off for each query: the rounding of sums of squares as large as these."""
    reach = np.sqrt((q * q).sum(axis=1)) + np.sqrt((x * x).sum(axis=1).max(initial=0.0))
    return np.finfo(np.float64).eps * (x.shape[1] + 8) * reach**2


def squares(x: np.ndarray, q: np.ndarray, slack: float = 1e-9) -> np.ndarray:
    """All squared distances, queries by rows of ``x``: a matrix product about the rows' mean, and differences where that may be off by more than ``slack``."""
    fine = np.isfinite(x).all(axis=1)
    middle = x[fine].mean(axis=0) if fine.any() else np.zeros(x.shape[1])
    with np.errstate(invalid="ignore", over="ignore"):
        x_mid, q_mid = np.where(fine[:, None], x - middle, 0.0), q - middle
        out = distances(x_mid, q_mid, L2)
        for j in np.flatnonzero(~fine):
            out[:, j] = ((q - x[j]) ** 2).sum(axis=1)
        for i in np.flatnonzero(~(error_of(x_mid, q_mid) <= slack)):
            out[i] = ((x - q[i]) ** 2).sum(axis=1)
    return out


def nearest(x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the ``k`` best rows of ``x`` for each query, ties to the smaller id.

    A matrix product about the rows' mean finds all rows that rounding may let
    into the best; their distances are then taken from the differences, so that
    long vectors and near copies rank as they should.
    """
    k = min(k, len(x))
    if kind == IP or not len(q) or not k:
        d = distances(x, q, kind)
        at = leading(d, ids, k, kind)
        return at, np.take_along_axis(d, at, axis=1)
    middle = x.mean(axis=0)
    x_mid, q_mid = x - middle, q - middle
    about = distances(x_mid, q_mid, kind)
    bar = np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * error_of(x_mid, q_mid)
    out, values = np.zeros((len(q), k), np.int64), np.zeros((len(q), k))
    inside = about <= bar[:, None]
    if k == 1 and inside.sum() == len(q):
        out = inside.argmax(axis=1)[:, None]
        return out, ((x[out[:, 0]] - q) ** 2).sum(axis=1)[:, None]
    for i in range(len(q)):
        near = np.flatnonzero(inside[i])
        if len(near) < k:  # components that are no numbers
            near = np.arange(len(x))
        exact = ((x[near] - q[i]) ** 2).sum(axis=1)
        order = np.lexsort((ids[near], exact))[:k]
        out[i], values[i] = near[order], exact[order]
    return out, values


def leading(values: np.ndarray, ids: np.ndarray, k: int, kind: str) -> np.ndarray:
    """Places of the ``k`` best of each row, ties to the smaller id."""
    sign = -1.0 if kind == IP else 1.0
    v = sign * values
    if v.shape[1] > 4 * k:
        bar = np.partition(v, k - 1, axis=1)[:, k - 1 : k]
        out = np.zeros((len(v), k), np.int64)
        for i in range(len(v)):
            at = np.flatnonzero(v[i] <= bar[i])
            out[i] = at[np.lexsort((ids[at], v[i, at]))[:k]]
        return out
    return np.stack([np.lexsort((ids, row))[:k] for row in v]) if len(v) else np.zeros((0, k), np.int64)


def ranked(found: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, rank, vec_id, dist): of each query the best, limited before the shuffle."""
    order = F.desc("dist") if kind == IP else F.asc("dist")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "dist")


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int, kind: str = L2, id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries`` (query_id, embedding).

    Tiles of queries meet tiles of vectors; the smaller side is broadcast when
    its size is within bounds.  A pair of tiles leaves k rows a query.
    """
    check_distance(kind)
    base = tiles(vectors, id_name, vector_name)
    ask = tiles(queries, "query_id", vector_name, TILE // 2).select(F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    first = queries.select(F.size(vector_name).alias("d")).first()
    if is_small(queries, 8 * max(1, first["d"] if first else 1)):
        ask = F.broadcast(ask)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (dict(zip(batch.schema.names, (c[i].as_py() for c in batch.columns), strict=True)) for i in range(batch.num_rows)):
                (ids, x), (q_ids, q) = untile(row["n"], row["ids"], row["data"]), untile(row["q_n"], row["q_ids"], row["q_data"])
                at, d = nearest(x, q, ids, k, kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, at.shape[1])), pa.array(ids[at].ravel()), pa.array(d.ravel())], ["query_id", "vec_id", "dist"])

    return ranked(base.crossJoin(ask).mapInArrow(meet, "query_id long, vec_id long, dist double"), k, kind)


def pair_products(vectors: DataFrame, queries: DataFrame, digits: int) -> DataFrame:
    """(query_id, vec_id, ip, l2): products and squared distances of all pairs, rounded; null where a vector is.

    Tiles of queries meet tiles of vectors, the vectors broadcast while they are
    small; the tiles that stay are dealt out, so that a small table, too, has
    many tasks.
    """
    base = tiles(vectors, "vec_id", "embedding")
    ask = tiles(queries, "query_id", "embedding", TILE // 8).select(F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    first = queries.select(F.size("embedding").alias("d")).first()
    if is_small(vectors, 8 * max(1, first["d"] if first else 1)):
        base = F.broadcast(base)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (dict(zip(batch.schema.names, (c[i].as_py() for c in batch.columns), strict=True)) for i in range(batch.num_rows)):
                (ids, x), (q_ids, q) = untile(row["n"], row["ids"], row["data"]), untile(row["q_n"], row["q_ids"], row["q_data"])
                found = (rounded(d, digits) for d in (distances(x, q, IP), squares(x, q)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, len(ids))), pa.array(np.tile(ids, len(q_ids))), *(pa.array(d.ravel()) for d in found)], ["query_id", "vec_id", "ip", "l2"])

    out = dealt(ask).crossJoin(base).mapInArrow(meet, "query_id long, vec_id long, ip double, l2 double")
    # Tiles hold rows that have an id and a vector; pairs with another row have ids alone.
    whole = lambda df, name: df.select(F.col(name).cast("long").alias(name), (F.col(name).isNotNull() & F.col("embedding").isNotNull()).alias("whole"), "embedding")
    v, q = whole(vectors, "vec_id"), whole(queries, "query_id").withColumnsRenamed({"whole": "q_whole", "embedding": "q"})
    odd = v.where("not whole").crossJoin(q).unionByName(v.where("whole").crossJoin(q.where("not q_whole")))
    ip, l2 = F.round(V.inner_product("q", "embedding"), digits), F.round(V.squared_distance("q", "embedding"), digits)
    return out.unionByName(odd.select("query_id", "vec_id", (ip + F.lit(0.0)).alias("ip"), (l2 + F.lit(0.0)).alias("l2")))


def truth_errors(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of ``truth`` (query_id, vec_id) that ``found`` lacks."""
    return truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
