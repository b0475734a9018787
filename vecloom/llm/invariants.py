"""What SQL can say of operators whose whole result is beyond it: counts, targets, bounds and recall as queries of their own.

Each query applies its operator to its whole table and keeps what SQL knows; an
empty table gives what the SQL gives for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.knn import exact_knn
from ..plans.config import IP
from . import ann, mixing, packing, pii
from .common import Scratch, read

#: Of the exact five nearest, nine in ten at least.
LEAST_RECALL = 0.9


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of each base kind a text has."""
    return pii.query(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE))


PII_COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards FROM d)
SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
  CAST(len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(concat('0', ltrim(p, '0')) AS INTEGER), 256) > 255)) = 0)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(cards, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(x, length(x) - i + 1, 1) AS INTEGER)
    ELSE 2 * CAST(substr(x, length(x) - i + 1, 1) AS INTEGER) - CASE WHEN CAST(substr(x, length(x) - i + 1, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
FROM m
"""


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asked, enough): queries, and whether the answers hold the share LEAST_RECALL of the exact ones; near ties by score count as hits."""
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    wanted = F.col("vec_id") % 50 == 0
    scratch = Scratch(spark, "recall")
    found = scratch.put(ann.nearest(vectors, wanted), "found")
    rows = ann.usable(vectors)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.select("vec_id", F.transform("vector", lambda x: x / norm).alias("embedding"))
    asked = unit.where(wanted).withColumnRenamed("vec_id", "query_id")
    # The stated query set against all rows, in tiles; a query is its own nearest, so one more is asked for.
    exact = exact_knn(unit, asked, ann.K + 1, IP).where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dist"), "vec_id"))
    bar = exact.withColumn("place", place).where(F.col("place") <= ann.K).groupBy("query_id").agg(F.min("dist").alias("bar"), F.count("*").alias("of"))
    hits = found.join(bar, "query_id").where(F.col("score") >= F.col("bar") - 1e-9).agg(F.count("*").alias("hits"))
    return bar.agg(F.count("*").alias("asked"), F.sum("of").alias("of")).crossJoin(hits).select("asked", (F.coalesce(F.col("hits") / F.col("of"), F.lit(1.0)) >= LEAST_RECALL).alias("enough"))  # one row each


ANN_RECALL = "SELECT count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 50 = 0"


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, source_size, target, near): whether the words taken of a source are within a document or three thousandths of its target."""
    plan = mixing.query(spark, sf_dir).groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("largest"))
    near = F.abs(F.col("taken") - F.col("target")) <= F.greatest(0.003 * F.col("target"), F.col("largest"))
    return plan.select("source", "source_size", F.round("target", 3).alias("target"), near.alias("near"))


#: Sources in the order in which they are full as the level rises: the level is the first at which the next one is not.
MIXING_TARGETS = r"""
WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS size FROM documents GROUP BY source),
w AS (SELECT source, CAST(size AS BIGINT) AS size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, 2.0 * size / weight AS full_at, row_number() OVER (ORDER BY 2.0 * size / weight, source NULLS LAST) AS n FROM w),
c AS (SELECT *, coalesce(sum(2.0 * size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
l AS (SELECT arg_min((1.5 * (SELECT sum(size) FROM w) - before) / open, n) AS level FROM c WHERE (1.5 * (SELECT sum(size) FROM w) - before) / open <= full_at)
SELECT source, size AS source_size, round(least(2.0 * size, weight * level), 3) AS target, true AS near FROM w, l
"""


def packing_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, whole): whether a document's pieces cover its ids without gap or overlap, and lie so in sequences of the length."""
    scratch = Scratch(spark, "whole")
    pieces = scratch.put(packing.query(spark, sf_dir), "pieces")
    within = Window.partitionBy("sequence_id").orderBy("offset")  # a sequence holds its length in pieces at most
    along = Window.partitionBy("doc_id").orderBy("start")
    laid = pieces.withColumn("laid", (F.col("offset") == F.coalesce(F.lag(F.col("offset") + F.col("length")).over(within), F.lit(0))) & (F.col("offset") + F.col("length") <= packing.LENGTH))
    laid = laid.withColumn("cut", (F.col("start") == F.coalesce(F.lag(F.col("start") + F.col("length")).over(along), F.lit(0))) & (F.col("length") > 0))
    return laid.groupBy("doc_id").agg((F.min(F.col("laid") & F.col("cut")) & (F.sum("length") == F.max("doc_tokens"))).alias("whole"))


PACKING_WHOLE = "SELECT doc_id, true AS whole FROM documents"

QUERIES = {"pii_counts": pii_counts, "ann_recall": ann_recall, "mixing_targets": mixing_targets, "packing_whole": packing_whole}
SQL = {"pii_counts": PII_COUNTS, "ann_recall": ANN_RECALL, "mixing_targets": MIXING_TARGETS, "packing_whole": PACKING_WHOLE}
