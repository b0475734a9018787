"""An inverted file of codes: built, searched, saved and loaded as one thing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import QuantizeConfig, SearchConfig
from ..plans.model import Model
from ..sources import index_store
from . import clustering, quantize, search, transforms


@dataclass
class Index:
    model: Model
    centroids: DataFrame
    codes: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, config: QuantizeConfig, centroids: DataFrame, assigned: DataFrame | None = None, variance=None, path: str | None = None) -> Index:
        """Codes ``vectors`` (vec_id, embedding); without assignments they go to their nearest centroids.

        With ``one_centroid`` in the settings residuals are taken from the mean
        of all vectors while clusters stay as assigned.  With ``path`` the index
        is saved there and searches read it; without one its codes are a plan
        that each search runs again.
        """
        assigned = clustering.assign(vectors, centroids, config.distance) if assigned is None else assigned
        model = Model.fit(transforms.variances(vectors) if variance is None else variance, config)
        if config.one_centroid:
            mean = clustering.single_centroid(vectors).select("centroid")  # one row
            centroids = centroids.select(F.col("cluster_id").cast("int").alias("cluster_id")).crossJoin(F.broadcast(mean))
        index = cls(model, centroids, quantize.encode(vectors, assigned, centroids, model))
        if path is None:
            return index
        index.save(path)
        return cls.load(vectors.sparkSession, path)

    def search(self, queries: DataFrame, k: int, nprobe: int, config: SearchConfig | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """By codes; with the ``vectors`` that the index was built from, the best by codes are ranked by their real distances."""
        return search.search(queries, self.codes, self.centroids, self.model, k, nprobe, config or SearchConfig(self.model.config.distance), vectors)

    def estimate(self, queries: DataFrame, nprobe: int, config: SearchConfig | None = None) -> DataFrame:
        return search.estimate(queries, self.codes, self.centroids, self.model, nprobe, config or SearchConfig(self.model.config.distance))

    def save(self, path: str) -> None:
        index_store.save(path, self.model, self.centroids, self.codes)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*index_store.load(spark, path))
