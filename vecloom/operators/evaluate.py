"""How good a search or an estimate is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: hits, of, recall - the share of each query's first ``k`` true ids that were found."""
    first = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    hits = found.where(F.col("rank") <= k).select("query_id", "vec_id").join(first, ["query_id", "vec_id"]).agg(F.count("*").alias("hits"))
    of = truth.agg((F.countDistinct("query_id") * k).alias("of"))
    return hits.crossJoin(of).select("hits", "of", (F.col("hits") / F.col("of")).alias("recall"))


def distance_ratio(found: DataFrame, truth: DataFrame, k: int, least: float = 1e-5) -> DataFrame:
    """(query_id, ratio): the mean root of found over true distance by rank, where the true one exceeds ``least``; 1 where none does."""
    order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    side = lambda df, name: df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "place", F.col("dist").alias(name))
    both = side(found, "ours").join(side(truth, "theirs"), ["query_id", "place"])
    good = F.col("theirs") > least
    return both.groupBy("query_id").agg(F.coalesce(F.avg(F.when(good, F.sqrt(F.col("ours") / F.col("theirs")))), F.lit(1.0)).alias("ratio"))


def relative_error(estimates: DataFrame, estimate: str = "accurate", real: str = "real") -> DataFrame:
    """``estimates`` with ``error``: |estimate - real| / real; rows whose real distance is not positive go."""
    return estimates.where(F.col(real) > 0).withColumn("error", F.abs(F.col(estimate) - F.col(real)) / F.col(real))


def signed_error(estimates: DataFrame, estimate: str, real: str = "real") -> DataFrame:
    """``estimates`` with ``error``: (real - estimate) / |real|, positive where the estimate is below; rows at 0 go."""
    return estimates.where(F.col(real) != 0).withColumn("error", (F.col(real) - F.col(estimate)) / F.abs(F.col(real)))


def summary(values: DataFrame, column: str) -> DataFrame:
    """One row: n, total, mean, largest."""
    return values.agg(F.count(column).alias("n"), F.sum(column).alias("total"), F.avg(column).alias("mean"), F.max(column).alias("largest"))


def grouped_summary(values: DataFrame, column: str, by: str = "query_id") -> DataFrame:
    """One row: over all values (n, mean, largest), and over groups (mean of means, mean of largest)."""
    groups = values.groupBy(by).agg(F.count(column).alias("n"), F.sum(column).alias("s"), F.avg(column).alias("m"), F.max(column).alias("x"))
    return groups.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.max("x").alias("largest"), F.avg("m").alias("mean_of_means"), F.avg("x").alias("mean_of_largest"))


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): values clamped to [low, high] in ``bins`` equal bins; empty bins are left out."""
    at = F.floor((F.greatest(F.lit(low), F.least(F.lit(high), F.col(column))) - low) / (high - low) * bins)
    return values.groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def prune_rate(metrics: DataFrame, dims: int, bits: float) -> DataFrame:
    """One row: the share of all code bits that a search did not read, on average over queries."""
    read = (F.col("fast_bits") + F.col("accurate_bits")) / F.col("compared")
    return metrics.agg((1 - F.avg(read) / (dims * bits)).alias("prune_rate"))


def cosine_summary(codes: DataFrame, segments: int) -> DataFrame:
    """(segment, mean, largest): how near the coded directions are to the vectors'."""
    at = [F.struct(F.lit(i).alias("segment"), F.get("factors", F.lit(4 * i + 3)).alias("cosine")) for i in range(segments)]
    flat = codes.select(F.explode(F.array(*at)).alias("x")).select("x.segment", "x.cosine")
    return flat.groupBy("segment").agg(F.avg("cosine").alias("mean"), F.max("cosine").alias("largest"))


def throughput(seconds_per_query: list[float], threads: int, bits_read: float) -> dict[str, float]:
    """Queries a second, milliseconds a query and MB of codes a second."""
    total = sum(seconds_per_query)
    n = len(seconds_per_query)
    return {"qps": n / total * threads, "avg_ms": total / n * 1e3, "mb_per_s": bits_read / 8 / 2**20 / total * threads}


def unstable(runs: list[dict[str, float]]) -> list[str]:
    """What differs too much between equal runs: recall at all, times by a tenth."""
    out = []
    for key, slack in (("recall", 1e-6), ("qps", 0.1), ("avg_ms", 0.1)):
        values = [r[key] for r in runs if key in r]
        if values and max(values) - min(values) > (slack if key == "recall" else slack * max(values)):
            out.append(f"{key}: {min(values):g} to {max(values):g}")
    return out
