"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

A document's set holds the hashes of its runs of five words (words: runs of
anything but ASCII white space).  Equal sets are one node from the start, named
by 128 bits.

Forest: each of ``trees`` tries orders the nodes by a label of MinHash values,
its own ``deepest`` ones first, then those of the trees after it.  Nodes are
dealt by the first values of their labels that all must share (``floor``) and
sorted by the whole label; the common prefixes of neighbours in that order are
the branches of the trie.  Matching starts at the longest common prefixes and
shortens them branch by branch: at each, only nodes that longer prefixes left
apart are compared, so a crowd of near copies is settled far down.  A document
stops where the tries have found a partner with probability ``recall``: the
least similarity at or above the threshold that any other set can have with one
of its size gives that length, so a set of six runs stops earlier than one of
five, and sets of up to three runs, which can have no partner but an equal one,
never enter.  MinHash estimates (192 values, far below the threshold: ``slack``)
say which matches become edges of a spanning forest.

Crowded prefixes and components are worked in blocks of bounded size; a large
one is split into pairs of blocks, so no task holds it whole and no row stands
for a pair.  In a component all pairs are compared on their whole sets in
integers, and only link counts and a spanning forest of true links leave the
task.

Result: one row a document with its class (documents joined by links, named by
the smallest doc_id) and how many documents it is linked to at ``threshold`` or
more; equal sets count as links and are never expanded into pairs.

Defined results: fewer than five words form one run of all words.  Null, empty
and white-space texts have no set: each is a class of its own without links.
Rows with equal texts and ids count each on their own; a null doc_id is a class
name only where no other is in the class.  An empty table gives no rows.  A very
long text is one set, compared whole.  Only doc_id and text are read;
``deduplicate`` passes all other columns on, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, bound_batches, boxed, join_sized, mix64, parallelism, read, utf8, whole_groups
from .components import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 32, 6, 0.99999
SLACK = 0.15
BLOCK_NODES, BLOCK_RUNS = 512, 1_000_000
#: What a member of a component takes in a broadcast, with its hash table; about 180 measured.
MEMBER_BYTES = 200
U = np.uint64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240607)
_FACTORS = (_RNG.integers(1 << 62, size=64, dtype=np.uint64) << U(1)) | U(1)
_A = (_RNG.integers(1 << 31, size=512, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(1 << 32, size=512, dtype=np.uint32)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            step = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(_BASE, step, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(_INVERSE, step, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def runs(data: bytes, words: int = WORDS) -> np.ndarray:
    """The set of a text: sorted hashes of its runs of ``words`` words."""
    b = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], SPACE[b], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + U(1)) * up[:-1], dtype=np.uint64)])
    # The length keeps words apart that are parts of each other.
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xD1B54A32D192ED03))
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out += h[j : j + len(out)] * _FACTORS[j]
    return np.unique(mix64(out + U(k)))


def node_of(found: np.ndarray) -> bytes:
    """A name of 128 bits for a set: equal sets have equal names."""
    if not len(found):
        return b""
    other = mix64(found + _FACTORS[60])
    return b"".join(
        int((mix64(np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(h), len(h)], np.uint64)) * _FACTORS[k : k + 3]).sum(dtype=np.uint64)).to_bytes(8, "little") for h, k in ((found, 40), (other, 50))
    )


def minhash(found: np.ndarray, size: int) -> np.ndarray:
    x = (found >> U(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        out = np.minimum(out, ((x[at : at + 1024, None] ^ _B[:size]) * _A[:size]).min(axis=0))
    return out


def depth_for(trees: int, deepest: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is found with probability ``recall``."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


@lru_cache
def least_similarity(size: int, threshold: float) -> float:
    """The least Jaccard similarity from ``threshold`` up that a different set can have with one of ``size``; 1 where there is none.

    A partner that shares ``i`` runs and differs in ``d`` has i / (i + d), with
    i from ``size - d`` to ``size``.
    """
    exact, best = Fraction(threshold).limit_denominator(10**6), Fraction(1)
    for d in range(1, int(size * (1 - exact) / exact) + 1):
        i = max(size - d, math.ceil(exact * d / (1 - exact)))
        if 0 < i <= size:
            best = min(best, Fraction(i, i + d))
    return float(best)


#: Sets above this size can be as little as a thousandth above the threshold: they stop where the threshold does.
SMALL_SET = 256


@lru_cache
def stops(trees: int, deepest: int, threshold: float, recall: float) -> np.ndarray:
    """By size of set, up to SMALL_SET, the length of prefix at which matching stops; above ``deepest`` where no partner can exist."""
    least = [1.0] + [least_similarity(n, threshold) for n in range(1, SMALL_SET)] + [threshold]
    return np.array([deepest + 1 if s == 1 else depth_for(trees, deepest, s, recall) for s in least])


def prefixes(signature: np.ndarray, trees: int, deepest: int, depth: int) -> np.ndarray:
    """The first ``depth`` values of each tree's label as one number, with the tree in it."""
    rows = signature.reshape(trees, deepest)[:, :depth].astype(np.uint64)
    key = np.arange(1, trees + 1, dtype=np.uint64)
    for d in range(depth):
        key = mix64(key * U(_BASE) + rows[:, d])
    return key


def _sign(words: int, trees: int, deepest: int, depth: int, stop: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, n, keys, sketch = [], [], [], []
            for body in utf8(batch.column(1)):
                found = runs(body, words)
                name.append(node_of(found))
                n.append(len(found))
                if stop[min(len(found), SMALL_SET)] > deepest:
                    keys.append(np.zeros(0, np.int64))
                    sketch.append(b"")
                    continue
                signature = minhash(found, trees * deepest)
                keys.append(prefixes(signature, trees, deepest, depth).view(np.int64))
                sketch.append((signature >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "name": pa.array(name, pa.binary()), "n_runs": pa.array(n, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.binary())})

    return run


def spanning(linked) -> Iterator[tuple[int, int]]:
    """The edges of a spanning forest, from a function that gives a row's neighbours among all rows."""
    n, neighbours = linked
    free = np.ones(n, bool)
    for root in range(n):
        if not free[root]:
            continue
        free[root], front = False, [root]
        while front:
            i = front.pop()
            for j in np.flatnonzero(neighbours(i) & free).tolist():
                free[j] = False
                front.append(j)
                yield i, j


def climb(label: np.ndarray, stop: np.ndarray, floor: int, similar) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the nodes of a subtrie.

    ``label`` holds the nodes' labels, equal in the first ``floor`` values.
    Prefixes shorten from the longest that two neighbours share; at each branch
    the nodes that have not stopped are compared with those not joined to them
    yet.  ``similar(i, others)`` says which of ``others`` match node ``i``.
    """
    n = len(label)
    order = np.lexsort(label.T[::-1])
    sorted_label = label[order]
    same = sorted_label[1:] == sorted_label[:-1]
    common = np.where(same.all(axis=1), label.shape[1], same.argmin(axis=1))
    part, edges = np.arange(n), []
    for depth in np.unique(np.maximum(common, floor))[::-1].tolist():
        cut = np.flatnonzero(np.concatenate([[True], common < depth, [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            # Children of this branch: what longer prefixes hold together has been compared.
            child = np.concatenate([[0], np.cumsum(common[a : b - 1] <= depth)])
            if not child[-1]:
                continue
            inside = order[a:b]
            open_ = stop[inside] <= depth
            inside, child = inside[open_], child[open_]
            for k, i in enumerate(inside.tolist()):
                after = int(np.searchsorted(child, child[k], "right"))
                others = inside[after:][part[inside[after:]] != part[i]]
                for j in others[similar(i, others)].tolist() if len(others) else ():
                    if part[j] != part[i]:
                        edges.append((i, j))
                        part[part == part[j]] = part[i]
    return edges


def _forest_edges(least: float, deepest: int, floor: int, stop: np.ndarray):
    """Edges between nodes of a subtrie, or between the two blocks of a pair, whose estimates pass."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(rows, "task"):
            nodes, tree, side, crosses = (table.column(c).to_numpy() for c in ("node", "tree", "side", "crosses"))
            ends = stop[np.minimum(table.column("n_runs").to_numpy(), SMALL_SET)]
            raw = table.column("sketch").combine_chunks()
            sketches = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(nodes), -1)
            need = math.ceil(least * sketches.shape[1])
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            two = two[~crosses[two] | (side[two] != side[two + 1])]
            # The tree's own values beyond the floor, as far as both need them.
            own = tree[two, None] * deepest + np.arange(floor, deepest)
            ok = (sketches[two] == sketches[two + 1]).sum(axis=1) >= need
            late = np.maximum(ends[two], ends[two + 1])
            alike = sketches[two[:, None], own] == sketches[two[:, None] + 1, own]
            ok &= (alike | (np.arange(floor, deepest) >= late[:, None])).all(axis=1)
            a, b = [nodes[two[ok]]], [nodes[two[ok] + 1]]
            for start, size in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                s, half, crossing = sketches[start : start + size], side[start : start + size], bool(crosses[start])
                # A label: the tree's own values, then those of the trees after it.
                label = np.roll(s, -int(tree[start]) * deepest, axis=1)

                def similar(i: int, others: np.ndarray, s=s, half=half, crossing=crossing) -> np.ndarray:
                    ok = (s[others] == s[i]).sum(axis=1) >= need
                    return ok & (half[others] != half[i]) if crossing else ok

                edges = climb(label, ends[start : start + size], floor, similar)
                if edges:
                    e = np.array(edges) + start
                    a.append(nodes[e[:, 0]])
                    b.append(nodes[e[:, 1]])
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return run


def block_pairs(rows: DataFrame, group: str, ways: str, member: str) -> DataFrame:
    """Rows dealt to tasks: a group of ``ways`` blocks has a task for each pair of blocks, itself included.

    ``crosses`` tells whether a task is of two blocks, of which one may be empty;
    ``side`` is 1 in the second block of a pair, else 0.
    """
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(F.lit(5), member), F.col(ways)))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col(ways) - 1)))
    low, high = F.least("_own", "_with"), F.greatest("_own", "_with")
    task = F.xxhash64(group, low, high)
    rows = rows.withColumn("task", task).withColumn("side", ((F.col("_own") > F.col("_with"))).cast("int"))
    return rows.withColumn("crosses", F.col("_own") != F.col("_with")).drop("_own", "_with")


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of ``threshold`` or more, counted exactly."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(first) - 1
    counts = np.bincount(column)
    shared = counts[column] > 1
    owner, column = owner[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    inter = np.zeros((n, n), np.int64)
    width = max(256, min(8192, (8 << 20) // max(1, n)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        inter += (m @ m.T).astype(np.int64)  # at most ``width``, exact in single precision
    union = sizes[:, None] + sizes[None, :] - inter
    exact = Fraction(threshold).limit_denominator(10**6)
    out = inter * exact.denominator >= union * exact.numerator
    np.fill_diagonal(out, False)
    return out


def _verify(words: int, threshold: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(rows, "task"):
            nodes, side, crosses, size, ways = (table.column(c).to_numpy() for c in ("node", "side", "crosses", "size", "ways"))
            bodies = utf8(table.column("text").combine_chunks())
            out = {"node": [], "links": [], "near": [], "apart": []}
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets = [runs(x, words) for x in bodies[a:b]]
                ok = linked(sets, threshold)
                half, own = side[a:b], nodes[a:b]
                if crosses[a]:
                    ok &= half[:, None] != half[None, :]
                near = own.copy()
                for i, j in spanning((b - a, lambda i, ok=ok: ok[i])):
                    near[j] = near[i]
                out["node"].append(own)
                out["links"].append((ok * size[a:b][None, :]).sum(axis=1).astype(np.int64))
                out["near"].append(near)
                out["apart"].append(ways[a:b] > 1)
            yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v), pa.bool_() if k == "apart" else pa.int64()) for k, v in out.items()})

    return run


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL,
    block_nodes: int = BLOCK_NODES, block_runs: int = BLOCK_RUNS,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_runs."""
    spark = docs.sparkSession
    bound_batches(spark, "8m")
    scratch, parts, floor = Scratch(spark, "near"), parallelism(spark), depth_for(trees, deepest, threshold, recall)
    stop = stops(trees, deepest, threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.put(docs.mapInArrow(_sign(words, trees, deepest, floor, stop), "doc_id long, name binary, n_runs long, keys array<long>, sketch binary"), "signed")
    nodes = signed.where("n_runs > 0").groupBy("name").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n_runs").alias("n_runs"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = scratch.put(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Prefixes that two nodes or more share: subtries, in blocks.
    held = nodes.select("node", F.posexplode("keys").alias("tree", "key"))
    shared = scratch.put(held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    held = join_sized(held, shared, ["key"], "n").select("key", "tree", "node", F.ceil(F.col("n") / block_nodes).alias("ways"))
    held = scratch.put(held, "held")
    scratch.settle()
    dealt = block_pairs(held.join(nodes.select("node", "n_runs", "sketch").hint("merge"), "node"), "key", "ways", "node")
    dealt = dealt.select("task", "node", "tree", "n_runs", "side", "crosses", "sketch").repartition(parts, "task").sortWithinPartitions("task")
    edges = scratch.put(dealt.mapInArrow(_forest_edges(threshold - SLACK, deepest, floor, stop), "a long, b long").distinct(), "edges")
    scratch.settle()
    members = scratch.put(components(edges, scratch, "near"), "members")
    few = members.count() <= min(BROADCAST_ROWS, BROADCAST_BYTES // MEMBER_BYTES)  # then what has a row a member at most meets the rest by broadcast
    met = lambda df: F.broadcast(df) if few else df.hint("merge")
    sizes = nodes.select(F.col("node").alias("id"), "name", "rep", "size", "n_runs").join(met(members), "id")
    sizes = scratch.put(sizes.select("id", "root", "name", "rep", "size", "n_runs"), "sizes")
    ways = sizes.groupBy("root").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n_runs") / block_runs)).alias("ways"))
    ways = scratch.put(ways, "ways")
    placed = sizes.join(met(ways), "root") if few else join_sized(sizes, ways, ["root"], "n")
    sizes = scratch.put(placed.drop("n"), "placed")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [node_of(runs(x, words)) for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_pydict({"rep": batch.column(0), "name": pa.array(found, pa.binary()), "text": batch.column(1)})

    # Of each node in a component one text: that of its smallest doc_id. Texts of other ids are not looked at again.
    wanted = sizes.withColumn("rep", F.coalesce("rep", F.lit(-1 << 63))).withColumnRenamed("id", "node").drop("n_runs")
    reps = scratch.put(wanted.select("rep").distinct(), "reps")
    own = docs.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("rep"), "text").join(met(reps), "rep", "left_semi")
    own = own.mapInArrow(name, "rep long, name binary, text string").dropDuplicates(["name", "rep"]).join(met(wanted), ["name", "rep"])
    dealt = block_pairs(own, "root", "ways", "node").select("task", "node", "side", "crosses", "size", "ways", "text").repartition(parts, "task").sortWithinPartitions("task")
    found = scratch.put(dealt.mapInArrow(_verify(words, threshold), "node long, links long, near long, apart boolean"), "found")
    scratch.settle()
    linkage = found.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.when(~F.col("apart"), F.col("near"))).alias("near"))
    apart = found.where("apart and node <> near").select(F.col("node").alias("a"), F.col("near").alias("b"))
    if apart.limit(1).count():
        joined = components(apart, scratch, "apart").select(F.col("id").alias("node"), F.col("root").alias("across"))
        linkage = linkage.join(met(scratch.put(joined, "across")), "node", "left").withColumn("near", F.coalesce("across", "near")).drop("across")
    full = nodes.select("node", "name", "rep", "size").join(met(scratch.put(linkage, "linkage")), "node", "left")
    full = scratch.put(full.select("node", "name", "rep", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("near", "node").alias("near")), "full")
    named = scratch.put(full.groupBy("near").agg(F.min("rep").alias("class_id"), F.count("*").alias("n")), "named")
    full = scratch.put(join_sized(full, named, ["near"], "n").select("name", "size", "n_links", "class_id"), "classes")
    out = join_sized(signed.select("doc_id", "name", "n_runs").where("n_runs > 0"), full, ["name"], "size")
    alone = signed.where("n_runs = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_runs")
    return out.select("doc_id", "class_id", "n_links", "n_runs").unionByName(alone)


def deduplicate(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest doc_id; columns unchanged."""
    kept = classes(docs, **settings).where("doc_id <=> class_id").select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("_id")).distinct()
    own = boxed(docs).withColumn("_id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-1 << 63))).join(kept, "_id", "left_semi")
    return own.withColumn("_text", F.xxhash64("row.text")).dropDuplicates(["_id", "_text"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM d),
s AS (SELECT doc_id, unnest(g) AS run FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (run) WHERE a.doc_id <> b.doc_id GROUP BY x, y),
l AS (SELECT x, y FROM p JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y WHERE k * 5 >= 4 * (len(a.g) + len(b.g) - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM g UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT r.doc_id, min(c) AS class_id, (SELECT count(*) FROM l WHERE x = r.doc_id) AS n_links, any_value(len(g.g)) AS n_runs FROM r JOIN g USING (doc_id) GROUP BY r.doc_id
"""
