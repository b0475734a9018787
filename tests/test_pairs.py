"""Pairs at size: estimates and real distances in one pass, tiles dealt evenly, raw vectors where codes leave a place open."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import queries
from vecloom.operators import evaluate, knn, quantize, search, tiles
from vecloom.plans.config import IP, L2, QuantizeConfig, SearchConfig
from vecloom.plans.model import Model

RNG = np.random.default_rng(8)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def pair_joins(df):
    return [line for line in plan_of(df).split("\n") if "Join" in line and "query_id" in line and "vec_id" in line]


def is_lean(df):
    """Pairs are joined once, and rounded where they are made."""
    return not pair_joins(df) and "round(" not in plan_of(df)


def frames(spark, n, dims=8, clusters=3):
    x, label = RNG.standard_normal((n, dims)), RNG.integers(0, clusters, n)
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    members = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "vec_id long, cluster_id int")
    c = spark.createDataFrame([(j, [float(a) for a in x[label == j].mean(axis=0)]) for j in range(clusters)], "cluster_id int, centroid array<double>")
    return x, v, members, c


@pytest.mark.parametrize("small", [1 << 26, 5000, 0])
@pytest.mark.parametrize("kind", [L2, IP])
def test_estimates_by_every_way_to_meet(spark, monkeypatch, small, kind):
    """Tiles of vectors broadcast (the lesser), tiles of queries broadcast, both dealt."""
    x, v, members, c = frames(spark, 90)
    monkeypatch.setattr(search, "SMALL_BYTES", small)
    model = Model.fit(x.var(axis=0), QuantizeConfig(avg_bits=4, segmentation=False, distance=kind))
    q = v.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    codes = quantize.encode(v, members, c, model)
    every = search.estimate(q, codes, c, model, 3, SearchConfig(kind), v, (*search.ESTIMATES, "real"))
    found = {(r["query_id"], r["vec_id"]): r for r in every.collect()}
    assert len(found) == 20 * 90
    for (a, b), r in found.items():
        assert r["real"] == pytest.approx(x[a] @ x[b] if kind == IP else ((x[a] - x[b]) ** 2).sum(), abs=1e-9)
    one = search.estimate(q, codes, c, model, 3, SearchConfig(kind), columns=("fast",), digits=3)
    assert one.columns == ["query_id", "vec_id", "fast"]
    for r in one.collect():
        assert r["fast"] == pytest.approx(found[r["query_id"], r["vec_id"]]["fast"], abs=5.1e-4)


def test_bounds_ip_is_lean(spark, sf_dir):
    assert is_lean(queries.QUERIES["bounds_ip"](spark, sf_dir))


def test_code_error_by_bits_joins_pairs_once(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(evaluate, "summary", lambda df, column, f=evaluate.summary: (seen.append(pair_joins(df)), f(df, column))[1])
    assert all(r["smaller"] for r in queries.QUERIES["code_error_by_bits"](spark, sf_dir).collect())
    assert seen == [[]] * 4


def test_pair_products_of_odd_rows(spark):
    """Null vectors, far vectors that nearly agree, and components that are no numbers; rows as many as pairs."""
    rows = [(0, [1e6, 1.0]), (1, [1e6, 1.001]), (2, None), (3, [0.5, -2.0]), (4, [float("inf"), 0.0]), (5, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r[0], r[1]): (r[2], r[3]) for r in knn.pair_products(v, v.withColumnRenamed("vec_id", "query_id"), 6).collect()}
    assert len(found) == 36
    assert found[0, 1] == (1e12 + 1.001, 1e-6) and found[3, 3] == (4.25, 0.0)
    assert all(found[a, b] == (None, None) for a, b in found if 2 in (a, b))
    assert found[3, 4][1] == float("inf") and np.isnan(found[3, 5]).all() and not np.isnan(found[3, 0]).any()


def test_pair_products_by_tiles(spark, sf_dir):
    assert "MapInArrow" in plan_of(queries.QUERIES["pair_products"](spark, sf_dir))


def test_uneven_codes_reads_no_pair_again(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries.V, "squared_distance", None)  # row by row, over all pairs
    assert queries.QUERIES["uneven_codes"](spark, sf_dir).collect() == [(True, True, True)]


def test_fast_bound_is_lean(spark, sf_dir):
    assert is_lean(queries.QUERIES["fast_bound"](spark, sf_dir))


@pytest.mark.parametrize("small", [1 << 26, 0])
def test_members_come_in_lists(spark, monkeypatch, small):
    """A hot cluster is many lists; a null label is in no cluster, a null id is a member."""
    monkeypatch.setattr(search, "SMALL_BYTES", small)
    monkeypatch.setattr(search, "is_small", lambda df, width: small > 0)
    rows = [(i, 0) for i in range(50)] + [(100, 1), (101, None), (None, 1)]
    members = spark.createDataFrame(rows, "vec_id long, cluster_id int")
    probes = spark.createDataFrame([(7, 0), (7, 1), (8, 1), (9, 2)], "query_id long, cluster_id int")
    found = search.probe_members(probes, members, size=8).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((q, v, c) for q, c in ((7, 0), (7, 1), (8, 1)) for v, m in rows if m == c), key=repr)


def test_relative_error_histogram_joins_pairs_once(spark, sf_dir):
    assert not pair_joins(queries.QUERIES["relative_error_histogram"](spark, sf_dir))


def test_relative_error_stats_joins_pairs_once(spark, sf_dir):
    assert not pair_joins(queries.QUERIES["relative_error_stats"](spark, sf_dir))


def test_signed_error_joins_pairs_once(spark, sf_dir):
    assert not pair_joins(queries.QUERIES["signed_error"](spark, sf_dir))


def test_sq_estimate_is_lean(spark, sf_dir):
    assert is_lean(queries.QUERIES["sq_estimate"](spark, sf_dir))


def test_variance_bound_is_lean(spark, sf_dir):
    assert is_lean(queries.QUERIES["variance_bound"](spark, sf_dir))


def test_sq_estimate_ip_is_lean(spark, sf_dir):
    assert is_lean(queries.QUERIES["sq_estimate_ip"](spark, sf_dir))


def test_segmented_estimate_is_lean(spark, sf_dir):
    assert is_lean(queries.QUERIES["segmented_estimate"](spark, sf_dir))


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """600 vectors in tight groups of 60: many lie about as near as the best, so codes of four bits alone cannot tell them apart."""
    centres = RNG.standard_normal((10, 64))
    x = np.repeat(centres, 60, axis=0) + 0.01 * RNG.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    path = str(tmp_path_factory.mktemp("crowded"))
    spark.createDataFrame([(i, [float(a) for a in r], i % 10) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_one_centroid_recall_where_many_lie_as_near(spark, crowded):
    assert queries.QUERIES["one_centroid_recall"](spark, crowded).collect() == [(6000, True)]


def test_pca_recall_where_many_lie_as_near(spark, crowded):
    assert queries.QUERIES["pca_recall"](spark, crowded).collect() == [(6000, True)]


def test_planned_recall_where_many_lie_as_near(spark, crowded):
    assert queries.QUERIES["planned_recall"](spark, crowded).collect() == [(6000, True)]


def test_planned_recall_ip_where_many_lie_as_near(spark, crowded):
    assert queries.QUERIES["planned_recall_ip"](spark, crowded).collect() == [(6000, True)]


def test_vectors_of_queries_move_once_with_their_probes(spark, sf_dir):
    plan = queries.QUERIES["relative_error_stats"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan


@pytest.mark.parametrize(("kind", "moved"), [("float", "array<float>"), ("double", "array<double>"), ("int", "array<double>")])
def test_vectors_move_as_they_are_stored(spark, kind, moved):
    """Floats are widened after the shuffle, with equal results."""
    rows = [(i, [i % 7 - 3.0, i % 5 + 0.0, 2.0 - i % 3]) for i in range(40)]
    v = spark.createDataFrame([*rows, (40, None)], "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    assert dict(v.select(tiles.compact(v, "embedding").alias("x")).dtypes)["x"] == moved
    members = spark.createDataFrame([(i, i % 2) for i in range(41)], "vec_id long, cluster_id int")
    c = spark.createDataFrame([(0, [0.25, 0.5, 0.125]), (1, [1.0, 2.0, 0.5])], "cluster_id int, centroid array<double>")
    model = Model.fit(np.ones(3), QuantizeConfig(avg_bits=4, segmentation=False))
    asked = v.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    found = search.estimate(asked, quantize.encode(v, members, c, model), c, model, 2, SearchConfig(L2), v, ("real",)).collect()
    at = {i: np.array(x) for i, x in rows}
    assert len(found) == 9 * 40 and all(r["real"] == pytest.approx(((at[r["query_id"]] - at[r["vec_id"]]) ** 2).sum(), abs=1e-9) for r in found)
