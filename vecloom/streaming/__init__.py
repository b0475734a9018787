"""Coding a stream of vectors with a fixed model; each vector is coded on its own, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import quantize
from ..plans.model import Model


def encode_stream(vectors: DataFrame, model: Model) -> DataFrame:
    """Codes of a streaming (vec_id, embedding), without centroids."""
    return quantize.encode(vectors, None, None, model)


def append_to_index(vectors: DataFrame, model: Model, path: str, checkpoint: str) -> StreamingQuery:
    """Codes what has arrived and appends it to the codes of an index; exactly once by the stream's checkpoint."""
    return encode_stream(vectors, model).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
