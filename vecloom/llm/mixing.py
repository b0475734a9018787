"""Mixing sources to target weights by entropy balancing.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating,
and share ``budget`` times all words; no target passes ``cap`` times its
source's words, and what is above is shared again by weight.

Rates: of all document rates between 0 and ``cap``, take those nearest to 1 in
relative entropy that meet each source's words.  The solution is an
exponential tilt, ``min(cap, exp(dual * words / scale))`` with one dual
variable a source; the duals are the roots of a monotone system that Newton's
method solves.  Documents of one source and length share a rate, so the
iterations run on (source, length, count) cells, and each is one aggregation
that combines before it shuffles.

Copies: a rate's whole part is taken, its fraction is rounded by a hash of
doc_id against a threshold set per source from a histogram of the rounding
keys, so that a source's words end within a bin or a document of its target.

Defined results: null text has no words and is taken 0 times; null source is a
source of its own, the last.  A source without words has target 0.  Rows that
repeat a doc_id are mixed row by row and decide alike; a null doc_id draws as one
number.  A very long text is one size, taken whole or not.  An empty table gives
no rows.  ``mix`` passes all other columns on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, boxed, join_known, parallelism, read, unit_hash

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET, CAP = 1.5, 2
BINS = 4096
ROUNDS, TOLERANCE = 60, 1e-9


def source_weights(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` with ``weight`` by place in code-point order, null last; no task holds all sources."""
    spark, order = sources.sparkSession, F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(parallelism(spark), order).withColumn("slot", F.spark_partition_id())
    ranged = scratch.put(ranged, "ranged")
    offsets, before = [], 0
    for slot, n in sorted(map(tuple, ranged.groupBy("slot").count().collect())):  # a row for each partition
        offsets.append((slot, before))
        before += n
    offsets = spark.createDataFrame(offsets or [(0, 0)], "slot int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("slot").orderBy(order)) - 1
    pick = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return ranged.join(F.broadcast(offsets), "slot").withColumn("weight", pick).drop("slot", "before")


def fill(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """``target`` for each source: least(cap * size, weight * level), at the level where targets add up."""
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = budget * (total or 0)
    level, capped_before = goal / weight if weight else 0.0, -1
    while True:
        is_full = F.col("source_size") * cap <= F.col("weight") * F.lit(level)
        full, free, capped = sources.agg(
            F.sum(F.when(is_full, F.col("source_size") * cap)), F.sum(F.when(~is_full, F.col("weight"))), F.count(F.when(is_full, 1))
        ).first()
        if not free or capped == capped_before:
            break
        level, capped_before = (goal - (full or 0)) / free, capped
    return sources.withColumn("target", F.least(F.col("source_size") * float(cap), F.col("weight") * F.lit(float(level))))


def solve_duals(cells: DataFrame, sources: DataFrame, n_sources: int, scratch: Scratch, cap: float) -> DataFrame:
    """(key, dual, scale): Newton's iterations for every source at once, kept inside a bracket."""
    far = 1e6
    duals = scratch.put(
        sources.select("key", "target", "source_size", F.when(F.col("source_size") > 0, F.col("source_size") / F.col("docs")).otherwise(1.0).alias("scale"), F.lit(0.0).alias("dual"), F.lit(-far).alias("low"), F.lit(far).alias("high")),
        "duals_0",
    )
    for i in range(1, ROUNDS + 1):
        x = F.col("size") / F.col("scale")
        tilt = F.col("dual") * x
        rate = F.when(tilt < F.log(F.lit(float(cap))), F.exp(tilt)).otherwise(F.lit(float(cap)))
        slope = F.when(tilt < F.log(F.lit(float(cap))), rate * x * x).otherwise(0.0)
        sums = join_known(cells, duals.select("key", "dual", "scale"), "key", n_sources).groupBy("key").agg(
            F.sum(F.col("n") * x * rate).alias("words"), F.sum(F.col("n") * slope).alias("slope")
        )
        step = duals.join(sums, "key", "left")
        gap = F.coalesce("words", F.lit(0.0)) - F.col("target") / F.col("scale")
        low, high = F.when(gap < 0, F.col("dual")).otherwise(F.col("low")), F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - F.try_divide(gap, F.col("slope"))
        # Outside the bracket the step halves it on a logarithmic scale.
        half = F.sinh((F.asinh(low) + F.asinh(high)) / 2)
        done = (F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size")) | (F.abs(gap) * F.col("scale") <= TOLERANCE * F.col("target"))
        moved = F.when(done, F.col("dual")).when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(half)
        duals = scratch.put(step.select("key", "target", "source_size", "scale", moved.alias("dual"), low.alias("low"), high.alias("high"), (~done).alias("open")), f"duals_{i}")
        scratch.drop(f"duals_{i - 1}")
        if not duals.where("open").limit(1).count():
            break
        duals = duals.drop("open")
    full = F.col("target") >= cap * F.col("source_size")
    return duals.select("key", F.when(full, F.lit(far)).otherwise(F.col("dual")).alias("dual"), "scale", full.alias("full"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, seed: int = 17) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies, source."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.put(
        docs.select(
            "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"),
            F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), unit_hash("doc_id", seed).alias("draw"),
        ),
        "sized",
    )
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = scratch.put(fill(scratch.put(source_weights(sources, scratch, weights), "weighted"), budget, cap), "sources")
    cells = scratch.put(sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), "cells")
    n_sources = sources.count()
    duals = solve_duals(cells, sources, n_sources, scratch, float(cap))
    known = scratch.put(sources.drop("source").join(duals, "key"), "known")
    tilt = F.col("dual") * F.col("size") / F.col("scale")
    rate = F.when(F.col("full") | (tilt >= F.log(F.lit(float(cap)))), F.lit(float(cap))).otherwise(F.exp(tilt))
    rated = join_known(sized, known, "key", n_sources).withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn(
        "bin", F.when((F.col("whole") < cap) & (F.col("size") > 0), F.floor((F.col("draw") - (F.col("rate") - F.col("whole")) + 1) * (BINS / 2)))
    )
    # The threshold of a source: the bin up to which another copy brings its words nearest to the target.
    bins = rated.groupBy("key", "bin").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("size")).otherwise(0)).alias("more"), F.sum(F.col("whole") * F.col("size")).alias("base"), F.max("target").alias("target"))
    by_bin = Window.partitionBy("key").orderBy(F.col("bin").asc_nulls_first())
    bins = bins.withColumn("base", F.sum("base").over(Window.partitionBy("key"))).withColumn("got", F.col("base") + F.sum("more").over(by_bin))
    cuts = bins.groupBy("key").agg(F.min_by(F.coalesce("bin", F.lit(-1)), F.struct(F.abs(F.col("got") - F.col("target")), "bin")).alias("cut"))
    cuts = scratch.put(known.join(cuts, "key"), "cuts")
    final = join_known(sized, cuts, "key", n_sources).withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0)).withColumn("whole", F.floor("rate"))
    extra = (F.col("whole") < cap) & (F.col("size") > 0) & (F.floor((F.col("draw") - (F.col("rate") - F.col("whole")) + 1) * (BINS / 2)) <= F.col("cut"))
    final = final.withColumn("copies", F.col("whole") + extra.cast("long"))
    return final.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "rate")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows without words go. Columns unchanged."""
    copies = plan(docs, **settings).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")).distinct()
    own = boxed(docs).withColumn("words", F.coalesce(F.regexp_count("row.text", F.lit(WORDS)), F.lit(0)).cast("long"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & F.col("row.source").eqNullSafe(F.col("_source")) & (F.col("words") == F.col("_size"))
    return own.join(copies.hint("merge"), same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
