"""Centroids: training, assignment, and the lists they make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import IP, L2
from .knn import exact_knn, nearest
from .tiles import SMALL_BYTES, matrix, rows_of

#: Centroids in training: each task and the driver hold them a few times over.
TABLE_BYTES = 4 * SMALL_BYTES


def centroid_table(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a centroid table; a model, bounded by its own size and not the data's."""
    rows = sorted(df.select("cluster_id", "centroid").collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def label_centroids(vectors: DataFrame, label: str = "label", vector_name: str = "embedding") -> DataFrame:
    """(cluster_id, centroid): the mean vector of each label."""
    flat = vectors.select(F.col(label).alias("cluster_id"), F.posexplode(F.col(vector_name).cast("array<double>")).alias("dim", "v"))
    means = flat.groupBy("cluster_id", "dim").agg(F.avg("v").alias("v"))
    return means.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("centroid"))


def single_centroid(vectors: DataFrame, vector_name: str = "embedding") -> DataFrame:
    """(cluster_id, centroid): cluster 0 at the mean of all."""
    return label_centroids(vectors.withColumn("_all", F.lit(0)), "_all", vector_name)


def assign(vectors: DataFrame, centroids: DataFrame, kind: str = L2, id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """(vec_id, cluster_id, dist): the nearest centroid; dist is the root of the squared distance for L2."""
    n, width = centroids.count(), (centroids.select(F.size("centroid")).first() or [0])[0]
    root = (lambda c: c) if kind == IP else F.sqrt
    if n * width * 8 > SMALL_BYTES:
        base = centroids.select(F.col("cluster_id").cast("long").alias("vec_id"), F.col("centroid").alias("embedding"))
        found = exact_knn(base, vectors.select(F.col(id_name).alias("query_id"), F.col(vector_name).alias("embedding")), 1, kind)
        return found.select(F.col("query_id").alias("vec_id"), F.col("vec_id").cast("int").alias("cluster_id"), root(F.col("dist")).alias("dist"))
    ids, table = centroid_table(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, d = nearest(table, matrix(batch.column(1)), ids, 1, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[at[:, 0]], pa.int64()), pa.array(d[:, 0])], ["vec_id", "cluster_id", "dist"])

    v = vectors.select(F.col(id_name).cast("long").alias("vec_id"), F.col(vector_name).cast("array<double>").alias("v")).where("v is not null")
    return v.mapInArrow(place, "vec_id long, cluster_id long, dist double").select("vec_id", F.col("cluster_id").cast("int").alias("cluster_id"), root(F.col("dist")).alias("dist"))


def train(vectors: DataFrame, k: int, rounds: int = 10, seed: int = 0, kind: str = L2, id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """(cluster_id, centroid) by Lloyd's rounds; what comes to the driver is k sums a round, at most TABLE_BYTES.

    For inner products centroids are brought to length 1 after each round.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_name).cast("long").alias("id"), F.col(vector_name).cast("array<double>").alias("v")).where("v is not null")
    width = (v.select(F.size("v")).first() or [0])[0]
    if k * width * 8 > TABLE_BYTES:
        raise ValueError(f"{k} centroids of {width} numbers exceed {TABLE_BYTES} bytes: train on coarser clusters first and split those")
    start = v.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).collect()
    table = np.array([r["v"] for r in start], np.float64)

    def partial(table: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts, order = np.zeros_like(table), np.zeros(len(table), np.int64), np.arange(len(table))
            for batch in batches:
                x = matrix(batch.column(1))
                if not len(x):
                    continue
                at = nearest(table, x, order, 1, kind)[0][:, 0]
                np.add.at(sums, at, x)
                counts += np.bincount(at, minlength=len(table))
            hit = np.flatnonzero(counts)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(counts[hit], pa.int64()), rows_of(sums[hit])], ["cluster", "n", "sum"])

        return run

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for c, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), matrix(batch.column(2)), strict=True):
                old = sums.setdefault(c, [0, 0.0])
                old[0] += n
                old[1] = old[1] + s
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x[0] for x in sums.values()], pa.int64()), rows_of(np.array([x[1] for x in sums.values()]))], ["cluster", "n", "sum"])

    for _ in range(rounds):
        schema = "cluster long, n long, sum array<double>"
        rows = v.mapInArrow(partial(table), schema).repartition("cluster").mapInArrow(add, schema).collect()
        new = table.copy()
        for r in rows:
            new[r["cluster"]] = np.array(r["sum"]) / r["n"]
        if kind == IP:
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-30)
        if np.allclose(new, table, rtol=0, atol=1e-12):
            break
        table = new
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(table)], "cluster_id int, centroid array<double>")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("size"))
