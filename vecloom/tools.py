"""Programs over vector files and saved indexes: ``python -m vecloom.tools NAME --help``.

``axes``    principal axes of a file of vectors, kept, and files turned by them
``truth``   the exact nearest neighbours of queries, or what a given truth lacks
``build``   an index, with its time and the cosines of its codes
``errors``  relative errors of an index's estimates
``search``  recall, distance ratio and speed of an index over numbers of probes
``partial`` the same of raw vectors whose last components are the centroids'
``gather``  the figures of many runs as one CSV
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import clustering, evaluate, knn, search, transforms
from .operators.index import Index
from .plans.config import IP, L2, QuantizeConfig, SearchConfig
from .sources import index_store, reports, vecfiles


def table(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) of a vector file, a ``.npy`` matrix or a Parquet table."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("vec_id", "embedding")
    return vecfiles.read_npy(spark, path) if path.endswith(".npy") else vecfiles.read(spark, path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path).withColumnRenamed("vec_id", "query_id")


def centroids_of(spark: SparkSession, args: argparse.Namespace, base: DataFrame) -> DataFrame:
    if args.centroids:
        return table(spark, args.centroids).select(F.col("vec_id").cast("int").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("centroid"))
    return clustering.train(base, args.clusters, seed=args.seed, kind=args.distance)


def truth_of(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, vec_id) from rows of ids, nearest first."""
    rows = vecfiles.read(spark, path, "ids")
    return rows.select(F.col("vec_id").alias("query_id"), F.posexplode("ids").alias("at", "id")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("id").cast("long").alias("vec_id"))


def timed(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def axes(spark: SparkSession, args: argparse.Namespace) -> None:
    base = table(spark, args.base)
    mean, turn = transforms.principal_axes(base)
    index_store.save_axes(spark, args.out, mean, turn)
    for source, target in zip(args.turn[::2], args.turn[1::2], strict=True):
        # Inner products are kept by the rotation alone.
        turned = transforms.rotate(table(spark, source), turn, None if args.distance == IP else mean)
        vecfiles.write_parts(turned, target) if args.parts else vecfiles.write(turned, target)


def truth(spark: SparkSession, args: argparse.Namespace) -> None:
    found = knn.exact_knn(table(spark, args.base), questions(spark, args.queries), args.k, args.distance)
    if args.check:
        given = truth_of(spark, args.check).where(F.col("rank") <= args.k)
        print(f"{knn.truth_errors(found, given).count()} of {given.count()} given ids are not among the true ones")
    if args.out:
        ids = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("int")).alias("embedding"))
        vecfiles.write(ids.withColumnRenamed("query_id", "vec_id"), args.out)


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    base = table(spark, args.base)
    config = QuantizeConfig(avg_bits=args.bits, segmentation=not args.one_segment, dim_block=args.block, distance=args.distance, one_centroid=args.one_centroid, seed=args.seed)
    centroids = centroids_of(spark, args, base)
    began = time.perf_counter()
    index = Index.build(base, config, centroids, path=args.out)
    took = time.perf_counter() - began
    cosines = evaluate.cosine_summary(index.codes, len(index.model.segments)).agg(F.avg("mean").alias("mean"), F.max("largest").alias("largest")).first()
    reports.write(spark, args.report or f"{args.out}/report", reports.INDEX_COLUMNS, [{"index_time_s": took, "ip_err_avg": cosines["mean"], "ip_err_max": cosines["largest"]}])


def with_real(found: DataFrame, base: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """``found`` with the real distances of its pairs."""
    both = found.join(base, "vec_id").join(asked.select("query_id", F.col("embedding").alias("q")), "query_id")
    return both.withColumn("real", V.squared_distance("q", "embedding") if kind == L2 else V.inner_product("q", "embedding")).drop("embedding", "q")


def error_figures(found: DataFrame, base: DataFrame, asked: DataFrame, kind: str, estimate: str) -> dict[str, float]:
    """Errors of ``estimate`` beside the real distances, by the headers of reports."""
    s = evaluate.grouped_summary(evaluate.relative_error(with_real(found, base, asked, kind), estimate), "error").first()
    return {"err_tot_avg": s["mean"], "err_tot_max": s["largest"], "err_q_avg_avg": s["mean_of_means"], "err_q_mx_avg": s["mean_of_largest"]}


def errors(spark: SparkSession, args: argparse.Namespace) -> None:
    index, base, asked = Index.load(spark, args.index), table(spark, args.base), questions(spark, args.queries)
    kind, n, rows = index.model.config.distance, asked.count(), []
    for nprobe in args.nprobe:
        found = index.estimate(asked, nprobe)
        row = {"nprobe": nprobe, "avg_tm_ms": timed(found) / n * 1e3, "search_tm_ms": timed(index.search(asked, args.k, nprobe)) / n * 1e3}
        rows.append(row | error_figures(found, base, asked, kind, args.estimate))
    reports.write(spark, args.out, reports.ERROR_COLUMNS, rows)


def quality(found: DataFrame, truth: DataFrame, best: DataFrame, base: DataFrame, asked: DataFrame, k: int, kind: str) -> dict[str, float | None]:
    """Recall against ``truth``, and how far the found ids' real distances are from those of ``best``; a ratio of inner products would tell nothing."""
    ratio = None
    if kind == L2:
        real = with_real(found, base, asked, kind).select("query_id", "vec_id", F.col("real").alias("dist"))
        ratio = evaluate.distance_ratio(real, best, k).agg(F.avg("ratio").alias("r")).first()["r"]
    return {"recall": evaluate.recall(found, truth, k).first()["recall"], "ratio": ratio}


def figures(seconds: list[float], n: int, bits: float, compared: float) -> dict[str, float]:
    """Mean figures of the rounds of a search over ``n`` queries; Spark runs queries together, so threads are 1."""
    mean = sum(seconds) / len(seconds)
    t = evaluate.throughput([mean / n] * n, 1, bits)
    return {"num_threads": 1, "QPS": t["qps"], "avg_tm_ms": t["avg_ms"], "bw_mbps": t["mb_per_s"], "compute_kopps": compared / 1000 / mean}


def searches(spark: SparkSession, args: argparse.Namespace) -> None:
    index, base, asked = Index.load(spark, args.index), table(spark, args.base), questions(spark, args.queries)
    kind, n, rows = index.model.config.distance, asked.count(), []
    best = knn.exact_knn(base, asked, args.k, kind)
    truth = truth_of(spark, args.truth) if args.truth else best
    config = SearchConfig(kind, prune=args.prune)
    for nprobe in args.nprobe:
        found = index.search(asked, args.k, nprobe, config)
        seconds = [timed(found) for _ in range(args.rounds)]
        read = search.search_metrics(asked, index.codes, index.centroids, index.model, args.k, nprobe, config)
        cost = read.agg(F.sum(F.col("fast_bits") + F.col("accurate_bits")).alias("bits"), F.sum("compared").alias("compared")).first()
        rows.append({"nprobe": nprobe} | figures(seconds, n, cost["bits"] or 0, cost["compared"] or 0) | quality(found, truth, best, base, asked, args.k, kind))
    reports.write(spark, args.out, reports.QPS_COLUMNS, rows)


def partial(spark: SparkSession, args: argparse.Namespace) -> None:
    base, asked = table(spark, args.base), questions(spark, args.queries)
    centroids, n, rows = centroids_of(spark, args, base), asked.count(), []
    members = clustering.assign(base, centroids, args.distance)
    best = knn.exact_knn(base, asked, args.k, args.distance)
    for nprobe in args.nprobe:
        found = search.partial_search(asked, base, members, centroids, args.k, nprobe, args.exact_dims, args.distance)
        row = {"nprobe": nprobe} | figures([timed(found) for _ in range(args.rounds)], n, 0, 0) | quality(found, best, best, base, asked, args.k, args.distance)
        rows.append(row | error_figures(found, base, asked, args.distance, "dist") | {"bw_mbps": None})
    reports.write(spark, args.out, reports.IVF_COLUMNS, rows)


def gathered(spark: SparkSession, args: argparse.Namespace) -> None:
    found = reports.gather(spark, args.files, args.words, args.without, args.dims)
    found.coalesce(1).write.mode("overwrite").option("header", True).csv(args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vecloom.tools", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="program", required=True)

    def add(name: str, run, *files: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for f in files:
            p.add_argument(f"--{f}", required=True)
        return p

    p = add("axes", axes, "base", "out")
    p.add_argument("--turn", nargs="*", default=[], help="pairs of a file and the file its turned vectors go to")
    p.add_argument("--parts", action="store_true", help="write a folder of parts, in parallel")
    p.add_argument("--distance", choices=(L2, IP), default=L2)
    p = add("truth", truth, "base", "queries")
    p.add_argument("--out")
    p.add_argument("--check", help="a truth file to hold against the exact answer")
    p.add_argument("--k", type=int, default=1000)
    p.add_argument("--distance", choices=(L2, IP), default=L2)
    p = add("build", build, "base", "out")
    p.add_argument("--bits", type=float, default=4)
    p.add_argument("--block", type=int, default=64)
    p.add_argument("--one-segment", action="store_true")
    p.add_argument("--one-centroid", action="store_true")
    p.add_argument("--report")
    q = add("partial", partial, "base", "queries", "out")
    q.add_argument("--exact-dims", type=int, default=64)
    for one in (p, q):
        one.add_argument("--centroids", help="a file of centroids; without one they are trained")
        one.add_argument("--clusters", type=int, default=4096)
        one.add_argument("--seed", type=int, default=0)
        one.add_argument("--distance", choices=(L2, IP), default=L2)
    p = add("errors", errors, "index", "base", "queries", "out")
    p.add_argument("--estimate", choices=("accurate", "fast"), default="accurate")
    s = add("search", searches, "index", "base", "queries", "out")
    s.add_argument("--truth", help="a file of true ids; without one they are computed")
    s.add_argument("--prune", action="store_true")
    for one in (p, s, q):
        one.add_argument("--k", type=int, default=100)
        one.add_argument("--nprobe", type=int, nargs="+", default=[200])
        one.add_argument("--rounds", type=int, default=3)
    p = add("gather", gathered, "files", "out")
    p.add_argument("--words", nargs="*")
    p.add_argument("--without", nargs="*")
    p.add_argument("--dims", type=int, default=0)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName(f"vecloom {args.program}").getOrCreate(), args)


if __name__ == "__main__":
    main()
