"""Operators on small DataFrames: sizes around tiles, empty clusters, files, saved indexes, streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import tools
from vecloom.operators import clustering, evaluate, knn, quantize, search, transforms
from vecloom.operators.index import Index
from vecloom.plans.config import IP, QuantizeConfig, SearchConfig
from vecloom.plans.model import Model
from vecloom.sources import index_store, reports, vecfiles
from vecloom.streaming import append_to_index

RNG = np.random.default_rng(9)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def queries(spark, x):
    return frame(spark, x).withColumnRenamed("vec_id", "query_id")


@pytest.mark.parametrize("kind", ["l2sqr", IP])
def test_exact_knn_by_brute_force(spark, kind):
    x, q = RNG.standard_normal((130, 10)).astype("f4"), RNG.standard_normal((4, 10)).astype("f4")
    got = knn.exact_knn(frame(spark, x).repartition(3), queries(spark, q), 7, kind).collect()
    d = knn.distances(x.astype(float), q.astype(float), kind)
    for i in range(4):
        want = np.argsort(-d[i] if kind == IP else d[i])[:7].tolist()
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want


@pytest.mark.parametrize("step", [1e-5, 1e-3])
def test_near_copies_far_from_the_origin(spark, step):
    """Rounding of a matrix product about the origin would lose every digit of these distances."""
    x = np.stack([1e4 + step * np.arange(300), np.full(300, 1e4)], axis=1)
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in knn.exact_knn(v, v.withColumnRenamed("vec_id", "query_id"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i in range(300):
        d = ((x - x[i]) ** 2).sum(axis=1)
        assert got[i] == np.lexsort((np.arange(300), d))[:4].tolist()
    c = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x[::50])], "cluster_id int, centroid array<double>")
    at = {r["vec_id"]: r["cluster_id"] for r in clustering.assign(v, c).collect()}
    assert all(at[i] == ((x[::50] - x[i]) ** 2).sum(axis=1).argmin() for i in range(300))


def test_knn_edges(spark):
    x = frame(spark, RNG.standard_normal((3, 4)))
    with_null = x.unionByName(spark.createDataFrame([(9, None)], x.schema))
    assert knn.exact_knn(with_null, queries(spark, np.ones((1, 4))), 10).count() == 3
    assert knn.exact_knn(x.where("vec_id < 0"), queries(spark, np.ones((1, 4))), 10).count() == 0
    with pytest.raises(ValueError):
        knn.exact_knn(x, queries(spark, np.ones((1, 4))), 10, "cosine")


@pytest.mark.parametrize("sizes", [[0, 1, 31, 32, 33, 64]])
def test_every_member_of_every_cluster_is_compared(spark, sizes):
    ids = np.repeat(np.arange(len(sizes)), sizes)
    x = RNG.standard_normal((len(ids), 16))
    v = frame(spark, x)
    members = spark.createDataFrame([(i, int(c)) for i, c in enumerate(ids)], "vec_id long, cluster_id int")
    c = spark.createDataFrame([(i, [float(i)] * 16) for i in range(len(sizes))], "cluster_id int, centroid array<double>")
    index = Index.build(v, QuantizeConfig(avg_bits=8, dim_block=16), c, members)
    q = queries(spark, x[:3])
    got = index.search(q, len(ids), 100).groupBy("query_id").count().collect()
    assert [r["count"] for r in got] == [len(ids)] * 3
    metrics = search.search_metrics(q, index.codes, c, index.model, 5, 2).collect()
    assert all(r["compared"] <= 97 for r in metrics)
    first = {r["query_id"]: r["vec_id"] for r in index.search(q, 1, 100).collect()}
    assert first == {0: 0, 1: 1, 2: 2}


def test_pruned_search_agrees(spark):
    x = RNG.standard_normal((400, 32))
    v, q = frame(spark, x), queries(spark, RNG.standard_normal((6, 32)))
    c = clustering.train(v, 4, seed=1)
    index = Index.build(v, QuantizeConfig(avg_bits=6, dim_block=16), c)
    plain = index.search(q, 10, 4)
    pruned = index.search(q, 10, 4, SearchConfig(prune=True))
    assert evaluate.recall(pruned, plain, 10).first()["recall"] >= 0.9
    both = evaluate.recall(plain, knn.exact_knn(v, q, 10), 10).first()
    assert both["recall"] >= 0.9 and both["of"] == 60
    read = search.search_metrics(q, index.codes, c, index.model, 10, 4, SearchConfig(prune=True))
    assert 0 <= evaluate.prune_rate(read, 32, 6).first()[0] <= 1


@pytest.mark.parametrize("kind", ["l2sqr", IP])
def test_pruning_reads_less_and_keeps_the_best(kind):
    """On uneven variances: with a wide bound nothing is lost, and most bits stay unread."""
    scale = np.repeat([4.0, 1.0, 0.25, 0.1], 16)
    x, q = RNG.standard_normal((900, 64)) * scale, RNG.standard_normal((7, 64)) * scale
    model = Model.fit(x.var(axis=0), QuantizeConfig(avg_bits=4, dim_block=16, distance=kind))
    code, factors = quantize.encode_matrix(x, model)
    packed, estimator = quantize.Layout(model.segments).pack(code), search.Estimator(model, SearchConfig(kind, prune=True))
    assert (quantize.Layout(model.segments).unpack(packed) == code).all() and packed.shape[1] * 8 <= 4 * 64 + 64
    whole = estimator.packed(q, np.zeros(64), packed, factors)[2]
    value, top, rest = estimator.pruned(q, np.zeros(64), packed, factors, 5)
    seen = np.isfinite(value)
    most = 900 * sum(s.length * max(0, s.bits - 1) for s in model.segments)
    assert np.allclose(value[seen], whole[seen]) and (rest.sum(axis=1) <= most).all() and rest.sum() < 7 * most
    sign = -1 if kind == IP else 1
    a, b = (np.argsort(sign * v, axis=1)[:, :5] for v in (whole, value))
    assert np.mean([len(set(i) & set(j)) for i, j in zip(a, b, strict=True)]) >= 4.5


def test_hot_cluster_is_salted(spark, monkeypatch):
    """Beyond the size for a broadcast, queries go to every task of a hot cluster; nothing is lost."""
    x = RNG.standard_normal((500, 16))
    v, q = frame(spark, x), queries(spark, x[:9])
    members = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(500)], "vec_id long, cluster_id int")
    c = spark.createDataFrame([(i, [float(i)] * 16) for i in range(2)], "cluster_id int, centroid array<double>")
    index = Index.build(v, QuantizeConfig(avg_bits=8, dim_block=16), c, members)
    plain = sorted(map(tuple, index.search(q, 20, 2).collect()))
    raw = sorted(map(tuple, search.partial_search(q, v, members, c, 20, 2, 16).collect()))
    monkeypatch.setattr(search, "SMALL_BYTES", 1)
    monkeypatch.setattr(search, "TILE", 1)
    assert sorted(map(tuple, index.search(q, 20, 2).collect())) == plain
    assert sorted(map(tuple, search.partial_search(q, v, members, c, 20, 2, 16).collect())) == raw


def test_kmeans_lowers_the_error(spark):
    x = np.concatenate([RNG.standard_normal((60, 5)) + 8 * i for i in range(3)])
    v = frame(spark, x).repartition(4)
    error = lambda c: clustering.assign(v, c).agg(F.sum(F.col("dist") ** 2)).first()[0]
    trained = clustering.train(v, 3, rounds=10)
    assert error(trained) < error(clustering.train(v, 3, rounds=0))
    assert clustering.train(v, 3, rounds=2, kind=IP).select(F.aggregate("centroid", F.lit(0.0), lambda s, y: s + y * y).alias("n")).where("abs(n - 1) > 1e-9").count() == 0


def test_principal_axes(spark):
    x = RNG.standard_normal((300, 6)) * [5, 4, 3, 2, 1, 0.5] + 7
    mean, axes = transforms.principal_axes(frame(spark, x).repartition(5))
    assert np.allclose(mean, x.mean(axis=0), atol=1e-4)
    turned = (x - mean) @ axes
    assert (np.diff(turned.var(axis=0)) <= 1e-6).all()
    assert np.allclose(np.cov(turned.T) - np.diag(np.diag(np.cov(turned.T))), 0, atol=1e-3)


def test_holdout_and_merge(spark):
    v = frame(spark, RNG.standard_normal((40, 3)))
    q, rest = transforms.holdout(v, 7, seed=3)
    assert q.count() == 7 and rest.count() == 33 and q.join(rest, "vec_id").count() == 0


def test_distance_ratio_of_zero_distances(spark):
    rows = spark.createDataFrame([(0, 1, 5, 0.0), (0, 2, 6, 0.0)], "query_id long, rank int, vec_id long, dist double")
    assert evaluate.distance_ratio(rows, rows, 2).first()["ratio"] == 1.0


def test_throughput_and_stability():
    t = evaluate.throughput([0.01, 0.03], 4, 8 * 2**20)
    assert t["qps"] == pytest.approx(200) and t["avg_ms"] == pytest.approx(20)
    assert evaluate.unstable([{"recall": 0.9, "qps": 100}, {"recall": 0.9, "qps": 95}]) == []
    assert len(evaluate.unstable([{"recall": 0.9, "qps": 100}, {"recall": 0.91, "qps": 50}])) == 2


@pytest.mark.parametrize("suffix", [".fvecs", ".ivecs", ".fbin", ".bin", ".ibin"])
def test_files_byte_for_byte(spark, tmp_path, suffix):
    x = RNG.integers(-9, 9, (10, 3))
    kind, carried = vecfiles.kind_of(suffix if suffix.startswith("x") else "a" + suffix)
    body = b"".join((struct.pack("<i", 3) if carried else b"") + r.astype(kind).tobytes() for r in x)
    path = tmp_path / f"a{suffix}"
    path.write_bytes(body if carried else struct.pack("<II", 10, 3) + body)
    df = vecfiles.read(spark, str(path))
    assert [list(r["embedding"]) for r in df.orderBy("vec_id").collect()] == x.tolist()
    assert vecfiles.write(df.repartition(3), str(tmp_path / f"b{suffix}")) == 10
    assert (tmp_path / f"b{suffix}").read_bytes() == path.read_bytes()


def test_files_of_other_kinds(spark, tmp_path):
    with pytest.raises(ValueError):
        vecfiles.read(spark, "a.txt")
    (tmp_path / "bad.fvecs").write_bytes(struct.pack("<i", 3) + b"\0" * 9)
    with pytest.raises(ValueError):
        vecfiles.read(spark, str(tmp_path / "bad.fvecs"))
    (tmp_path / "none.fvecs").write_bytes(b"")
    assert vecfiles.read(spark, str(tmp_path / "none.fvecs")).count() == 0
    x = RNG.standard_normal((9, 2)).astype("f4")
    for i in range(2):
        np.save(tmp_path / f"{i}.npy", x[i * 5 : i * 5 + 5])
    merged = vecfiles.merge_npy(spark, [str(tmp_path / "0.npy"), str(tmp_path / "1.npy")], 7).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in merged] == list(range(7))
    assert np.allclose([r["embedding"] for r in merged], x[:7])
    assert vecfiles.read_npy(spark, str(tmp_path / "0.npy"), 2).count() == 2
    assert vecfiles.write(vecfiles.read_npy(spark, str(tmp_path / "0.npy")), str(tmp_path / "c.fbin")) == 5
    assert vecfiles.convert(spark, str(tmp_path / "c.fbin"), str(tmp_path / "c.fvecs")) == 5
    assert np.allclose([r["embedding"] for r in vecfiles.read(spark, str(tmp_path / "c.fvecs")).orderBy("vec_id").collect()], x[:5])


@pytest.mark.parametrize("suffix", [".fvecs", ".fbin"])
def test_files_in_parts_and_ranges(spark, tmp_path, suffix, monkeypatch):
    x = RNG.standard_normal((103, 7)).astype("f4")
    monkeypatch.setattr(vecfiles, "RANGE_BYTES", 300)
    path = str(tmp_path / f"parts{suffix}")
    assert vecfiles.write_parts(frame(spark, x).repartition(5), path) == 103
    assert vecfiles.write(frame(spark, x), str(tmp_path / f"one{suffix}")) == 103
    for p in (path, "file://" + str(tmp_path / f"one{suffix}")):
        got = vecfiles.read(spark, p).orderBy("vec_id").collect()
        assert [r["vec_id"] for r in got] == list(range(103)) and np.allclose([r["embedding"] for r in got], x)
    assert vecfiles.exists(path) and not vecfiles.exists(path + "x")
    assert vecfiles.size(str(tmp_path / f"one{suffix}")) == 103 * 28 + (103 * 4 if suffix == ".fvecs" else 8)
    with pytest.raises(FileNotFoundError):
        vecfiles.size(path + "x")
    empty = frame(spark, x).where("vec_id < 0")
    assert vecfiles.write_parts(empty, str(tmp_path / f"none{suffix}")) == 0
    assert vecfiles.read(spark, str(tmp_path / f"none{suffix}")).count() == 0


def test_programs(spark, tmp_path):
    """From files to figures, as from a command line."""
    x = (RNG.standard_normal((400, 32)) * np.repeat([2.0, 0.5], 16)).astype("f4")
    at = lambda name: str(tmp_path / name)
    vecfiles.write(frame(spark, x), at("base.fvecs"))
    vecfiles.write(frame(spark, x[:8] + 0.01), at("query.fbin"))
    run = lambda *a: tools.main([str(v) for v in a], spark)
    run("axes", "--base", at("base.fvecs"), "--out", at("axes"), "--turn", at("base.fvecs"), at("b.fvecs"), at("query.fbin"), at("q.fvecs"))
    mean, axes = index_store.load_axes(spark, at("axes"))
    turned = np.array([r["embedding"] for r in vecfiles.read(spark, at("b.fvecs")).orderBy("vec_id").collect()])
    assert np.allclose(turned, (x - mean) @ axes, atol=1e-4)
    run("truth", "--base", at("b.fvecs"), "--queries", at("q.fvecs"), "--out", at("truth.ivecs"), "--k", 10)
    run("truth", "--base", at("b.fvecs"), "--queries", at("q.fvecs"), "--check", at("truth.ivecs"), "--k", 10)
    run("build", "--base", at("b.fvecs"), "--out", at("runs_b4.index"), "--clusters", 4, "--block", 16, "--report", at("r_b4.build"))
    one = spark.read.option("header", True).csv(at("r_b4.build")).collect()
    assert one[0].asDict().keys() == set(reports.INDEX_COLUMNS) and 0.9 < float(one[0]["ip_err_avg"]) <= 1
    common = ["--index", at("runs_b4.index"), "--base", at("b.fvecs"), "--queries", at("q.fvecs"), "--k", 10, "--nprobe", 2, 4]
    run("search", *common, "--truth", at("truth.ivecs"), "--rounds", 1, "--out", at("r_b4.search"))
    rows = spark.read.option("header", True).option("inferSchema", True).csv(at("r_b4.search")).orderBy("nprobe").collect()
    assert [r["nprobe"] for r in rows] == [2, 4] and rows[1]["recall"] >= 0.8 and rows[1]["ratio"] >= 1 - 1e-3
    run("errors", *common, "--out", at("r_b4.errors"))
    assert spark.read.option("header", True).csv(at("r_b4.errors")).count() == 2
    run("partial", "--base", at("b.fvecs"), "--queries", at("q.fvecs"), "--clusters", 4, "--exact-dims", 16, "--k", 10, "--nprobe", 4, "--rounds", 1, "--out", at("r_b0.partial"))
    run("gather", "--files", at("r_b4.search"), "--words", "_b4", "--dims", 32, "--out", at("all"))
    got = spark.read.option("header", True).option("inferSchema", True).csv(at("all")).collect()
    assert {r["bits"] for r in got} == {4.0} and {r["real_bits"] for r in got} == {6.0}


def test_index_round_trip_and_stream(spark, tmp_path):
    x = RNG.standard_normal((50, 32))
    v = frame(spark, x)
    c = clustering.train(v, 3, rounds=2)
    index = Index.build(v, QuantizeConfig(avg_bits=4, dim_block=16), c)
    index.save(str(tmp_path / "index"))
    loaded = Index.load(spark, str(tmp_path / "index"))
    q = queries(spark, x[:4])
    key = lambda i: [(r["query_id"], r["rank"], r["vec_id"]) for r in i.search(q, 5, 3).orderBy("query_id", "rank").collect()]
    assert key(loaded) == key(index)
    assert loaded.model.config == index.model.config
    model = Model.fit(x.var(axis=0), QuantizeConfig(avg_bits=4, dim_block=16))
    v.write.parquet(str(tmp_path / "arrivals"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "arrivals"))
    append_to_index(stream, model, str(tmp_path / "codes"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "codes")).count() == 50
    # A second run finds nothing new.
    append_to_index(stream, model, str(tmp_path / "codes"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "codes")).count() == 50
