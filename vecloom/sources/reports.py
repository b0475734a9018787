"""Figures of an index or a search as CSV files with a header, and many such files as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The headers that readers of these files know.
INDEX_COLUMNS = ("index_time_s", "ip_err_avg", "ip_err_max")
ERROR_COLUMNS = ("nprobe", "avg_tm_ms", "search_tm_ms", "err_tot_avg", "err_tot_max", "err_q_avg_avg", "err_q_mx_avg")
QPS_COLUMNS = ("nprobe", "num_threads", "QPS", "avg_tm_ms", "recall", "ratio", "bw_mbps", "compute_kopps")
IVF_COLUMNS = ("nprobe", "num_threads", "QPS", "avg_tm_ms", "recall", "ratio", "bw_mbps", "err_tot_avg", "err_tot_max", "err_q_avg_avg", "err_q_mx_avg")


def write(spark: SparkSession, path: str, columns: tuple[str, ...], rows: list[dict]) -> None:
    """A folder with one CSV file of a few rows; a figure that was not taken is empty."""
    data = [tuple(None if r.get(c) is None else float(r[c]) for c in columns) for r in rows]
    spark.createDataFrame(data, ", ".join(f"`{c}` double" for c in columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def gather(spark: SparkSession, pattern: str, words: list[str] | None = None, without: list[str] | None = None, dims: int = 0) -> DataFrame:
    """All CSV files that match ``pattern`` as one table with ``file``, ``bits`` and ``real_bits``.

    Files whose path has one of ``words`` and none of ``without``.  ``bits`` is
    the number after ``_b`` or ``/b`` in the path, null where there is none;
    ``real_bits`` adds the factors' share of ``dims`` dimensions.
    """
    found = spark.read.option("header", True).option("inferSchema", True).csv(pattern).withColumn("file", F.input_file_name())
    if words:
        found = found.where(F.array_contains(F.array(*(F.col("file").contains(w) for w in words)), True))
    for w in without or []:
        found = found.where(~F.col("file").contains(w))
    bits = F.nullif(F.regexp_extract("file", r"[_/]b([0-9]+(?:\.[0-9]+)?)(?=[_./])", 1), F.lit("")).cast("double")
    return found.withColumn("bits", bits).withColumn("real_bits", (F.col("bits") * dims + 64) / dims if dims else F.lit(None).cast("double"))
