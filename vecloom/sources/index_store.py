"""An index as a folder of Parquet tables; everything needed to search it is in there."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..plans.bits import Segment
from ..plans.config import CodeConfig, QuantizeConfig
from ..plans.model import Model

#: Codes lie by cluster, so that a search reads the row groups of the clusters it probes.
FILES_ROWS = 4_000_000


def save(path: str, model: Model, centroids: DataFrame, codes: DataFrame) -> None:
    spark = codes.sparkSession
    head = {"config": asdict(model.config), "dims": model.dims}
    spark.createDataFrame([(json.dumps(head),)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    segments = [(i, s.offset, s.length, s.bits, None if r is None else [[float(v) for v in row] for row in r]) for i, (s, r) in enumerate(zip(model.segments, model.rotations, strict=True))]
    spark.createDataFrame(segments, "segment int, dim_offset int, dim_len int, bits int, rotation array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.variance)], "dim int, variance double").coalesce(1).write.mode("overwrite").parquet(f"{path}/variance")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    codes.repartitionByRange("cluster_id", "vec_id").sortWithinPartitions("cluster_id", "vec_id").write.option("maxRecordsPerFile", FILES_ROWS).mode("overwrite").parquet(f"{path}/codes")


def load(spark: SparkSession, path: str) -> tuple[Model, DataFrame, DataFrame]:
    head = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    config = QuantizeConfig(**{**head["config"], "code": CodeConfig(**head["config"]["code"])})
    rows = sorted(spark.read.parquet(f"{path}/model").collect(), key=lambda r: r["segment"])
    variance = np.array([r["variance"] for r in sorted(spark.read.parquet(f"{path}/variance").collect(), key=lambda r: r["dim"])])
    segments = [Segment(r["dim_offset"], r["dim_len"], r["bits"]) for r in rows]
    turns = [None if r["rotation"] is None else np.array(r["rotation"]) for r in rows]
    return Model(config, head["dims"], variance, segments, turns), spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/codes")


def save_axes(spark: SparkSession, path: str, mean: np.ndarray, axes: np.ndarray) -> None:
    """Principal axes as a table: row -1 is the mean, row i the i-th row of the matrix."""
    rows = [(i, [float(v) for v in r]) for i, r in enumerate([mean, *axes], -1)]
    spark.createDataFrame(rows, "row int, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_axes(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes); a d by d model."""
    rows = [np.array(r["values"]) for r in spark.read.parquet(path).orderBy("row").collect()]
    return rows[0], np.array(rows[1:])
