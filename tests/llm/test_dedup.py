"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import exact_dedup, near_dup, suffix_dedup
from vecloom.llm.common import Scratch, read
from vecloom.llm.components import components, least_reached

from .helpers import ODD, docs, rows_of, words

# ---- exact ----------------------------------------------------------------


@given(st.binary(max_size=300), st.integers(1, 40), st.data())
@settings(max_examples=80, deadline=None)
def test_fingerprints_combine(data, chunk, draw):
    whole = exact_dedup.Polynomial(chunk=chunk)
    assert whole.fingerprint(data) == exact_dedup.Polynomial(chunk=7).fingerprint(data) == exact_dedup.Polynomial(chunk=4096).fingerprint(data)
    # h(ab) from h(a) and h(b) alone
    at = draw.draw(st.integers(0, len(data)))
    f, p, base = whole.fingerprint, exact_dedup.PRIMES[0], exact_dedup.BASES[0]
    assert f(data) >> 31 == ((f(data[:at]) >> 31) * pow(base, len(data) - at, p) + (f(data[at:]) >> 31)) % p


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("poly", [None, exact_dedup.Polynomial((3, 5), 16)])
def test_exact_against_brute_force(spark, poly):
    """The tiny moduli make most texts collide, so the comparison has to tell them apart."""
    r = random.Random(2)
    rows = ODD + [(100 + i, r.choice(["aa", "ab", "ba", "b" * 40, "b" * 39 + "c", "é" * 30])) for i in range(60)]
    got = rows_of(exact_dedup.decisions(docs(spark, rows, True).repartition(3), poly, 16 if poly else 1 << 16))
    assert sorted(got, key=repr) == sorted(brute_exact(rows), key=repr)


def test_exact_empty_table(spark):
    assert exact_dedup.decisions(docs(spark, ODD).where("doc_id < 0")).count() == 0
    assert exact_dedup.deduplicate(docs(spark, ODD).where("doc_id < 0")).count() == 0


def test_exact_deduplicate_keeps_columns(spark):
    df = docs(spark, ODD, True)
    got = exact_dedup.deduplicate(df)
    assert got.columns == df.columns
    assert got.where("_id = 'clash' and _sha = 'clash' and key = 'clash'").count() == got.count()
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted([2, None, 3, 5, 6, 7, 8], key=repr)


# ---- near -----------------------------------------------------------------


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * 5 >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(d, name[find(i)] if sets[i] else d, links[i], len(sets[i])) for i, (d, _) in enumerate(rows)]


def near_rows(n_groups=8, seed=3):
    r, rows = random.Random(seed), []
    for g in range(n_groups):
        base = words(r.randrange(6, 400), 100 + g)
        for _ in range(r.randrange(1, 14)):
            w = base[:]
            for _ in range(r.randrange(0, max(1, len(w) // 25) + 1)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            rows.append(" ".join(w))
    r.shuffle(rows)
    return [(1000 - i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [(512, 10**6), (4, 10**6), (512, 900)])
def test_near_against_brute_force(spark, block):
    """Small blocks split every bucket and component into pairs of blocks."""
    rows = near_rows() + ODD
    got = rows_of(near_dup.classes(docs(spark, rows, True).repartition(3), block_nodes=block[0], block_runs=block[1]))
    assert sorted(got, key=repr) == sorted(brute_near(rows), key=repr)


def test_near_counts_links_once_among_empty_blocks(spark):
    """Few long texts and many ways: most blocks are empty, and a pair is compared in one task only."""
    rows = []
    for g in range(6):
        base = words(3000, 500 + g)
        rows += [(10 * g + i, " ".join([*base, f"end{i}"])) for i in range(2 + g % 2)]
    for most in (400, 2000):
        got = rows_of(near_dup.classes(docs(spark, rows), block_runs=most))
        assert sorted(got) == sorted(brute_near(rows))


def test_near_keeps_one_of_each_class(spark):
    rows = near_rows(4) + ODD
    df = docs(spark, rows, True)
    got = near_dup.deduplicate(df)
    assert got.columns == df.columns
    assert got.where("_id = 'clash' and _text = 'clash' and node = 'clash'").count() == got.count()
    want = Counter()
    for d, c, _, _ in brute_near(rows):
        if d == c:
            want[d] = 1
    ids = Counter(r["doc_id"] for r in got.collect())
    # two rows without id and different texts are two documents
    assert {k for k in ids} == {k for k in want}
    assert near_dup.classes(df.where("doc_id < 0")).count() == 0


def test_depth_meets_the_recall():
    for trees, recall in ((32, 0.99999), (16, 0.99), (64, 0.9)):
        d = near_dup.depth_for(trees, 8, 0.8, recall)
        assert 1 - (1 - 0.8**d) ** trees >= recall
        assert d == 8 or 1 - (1 - 0.8 ** (d + 1)) ** trees < recall


def test_least_similarity_by_brute_force():
    for n in range(1, 40):
        sims = [i / (n + m - i) for m in range(1, 60) for i in range(min(n, m) + 1) if i < max(n, m) and i * 5 >= 4 * (n + m - i)]
        assert near_dup.least_similarity(n, 0.8) == pytest.approx(min(sims, default=1.0))


def test_documents_stop_at_their_own_prefix(spark):
    """Sets of three runs never enter the forest, sets of six stop at a longer prefix than sets of five."""
    stop = near_dup.stops(near_dup.TREES, near_dup.DEEPEST, 0.8, near_dup.RECALL)
    assert stop[3] > near_dup.DEEPEST and stop[6] == 6 and stop[5] == 5 and stop[near_dup.SMALL_SET] == 5
    label = np.array([[7, 7, 7, 7, 7, a, b] for a, b in ((1, 1), (1, 2), (2, 1), (2, 1))], np.uint8)
    always = lambda i, others: np.ones(len(others), bool)
    joined = lambda ends: {frozenset(e) for e in near_dup.climb(label, np.array(ends), 5, always)}
    # Where all stop at five values the tree is spanned; the last two, which share all, are joined first.
    assert near_dup.climb(label, np.array([5] * 4), 5, always)[0] == (2, 3) and len(joined([5] * 4)) == 3
    # Documents that stop at six are not matched across the fifth value, whatever the others do.
    assert joined([6, 5, 6, 5]) == {frozenset((0, 1)), frozenset((2, 3)), frozenset((1, 3))}
    assert joined([6] * 4) == {frozenset((0, 1)), frozenset((2, 3))}


@given(st.integers(2, 40), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_climbing_spans_what_matches(n, seed):
    """The parts are those of the graph of all matching pairs."""
    r = np.random.default_rng(seed)
    label = np.hstack([np.zeros((n, 2), np.uint8), r.integers(0, 2, (n, 5)).astype(np.uint8)])
    stop = r.integers(2, 5, n)
    match = r.random((n, n)) < 0.15
    match |= match.T
    found = near_dup.climb(label, stop, 2, lambda i, others: match[i, others])
    shared = lambda i, j: int((label[i] == label[j]).argmin()) if (label[i] != label[j]).any() else 7
    want = {(i, j) for i in range(n) for j in range(i) if match[i, j] and shared(i, j) >= max(stop[i], stop[j])}

    def parts(edges):
        part = list(range(n))
        for i, j in edges:
            a, b = part[i], part[j]
            part = [b if x == a else x for x in part]
        return [[part[i] == part[j] for j in range(n)] for i in range(n)]

    assert all((i, j) in want or (j, i) in want for i, j in found) and parts(found) == parts(want)


def test_links_of_very_large_sets_are_counted_exactly():
    base = np.arange(3_000_000, dtype=np.uint64)
    n = len(base)
    shift = n // 9 + 1  # i / (2n - i) just below 0.8
    assert (n - shift) * 5 < 4 * (n + shift) and not near_dup.linked([base, base + np.uint64(shift)], 0.8).any()
    assert near_dup.linked([base, base + np.uint64(shift - 1)], 0.8).sum() == 2


def test_runs_by_words():
    assert len(near_dup.runs(b"a b c d e f")) == 2
    assert len(near_dup.runs(b"a b")) == 1
    assert (near_dup.runs(b"a  b\tc\nd e") == near_dup.runs(b" a b c d e ")).all()
    assert len(near_dup.runs(b" \n")) == 0
    assert near_dup.node_of(near_dup.runs(b"ab c")) != near_dup.node_of(near_dup.runs(b"a bc"))


def test_minhash_estimates():
    r = np.random.default_rng(0)
    x = r.integers(1 << 62, size=2000, dtype=np.uint64)
    a, b = near_dup.minhash(x[:1500], 192), near_dup.minhash(x[500:], 192)
    assert abs((a == b).mean() - 0.5) < 0.15


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, r.randrange(101, 300)) for _ in range(60)] + [(500, 500), (7, 3)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c")))
    assert all(got[i] == 0 for i in range(41))
    assert all(got[b] == 100 for a, b in edges if a == 100) and 500 not in got


class Counted(Scratch):
    """Counts the tables written."""

    def put(self, df, name):
        self.made = [*getattr(self, "made", []), name]
        return super().put(df, name)


def parted(edges):
    """The smallest id that each end reaches, by brute force."""
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    while any(root[a] != root[b] for a, b in edges if a in root and b in root):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    return root


def test_few_edges_take_no_round(spark):
    """Each round of joins has its fixed cost, so few edges take none, whatever their form; stars beyond the bound take none either."""
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(-900, -100), r.randrange(-900, -100)) for _ in range(400)] + [(70, 70), (1 << 62, -(1 << 63)), (3, 1), (1, 3)]
    df, scratch = spark.createDataFrame([*edges, (None, 5), (80, None)], "a long, b long").repartition(3), Counted(spark, "t")
    got = rows_of(components(df, scratch, "c"))
    assert dict(got) == parted(edges) and len(got) == len(dict(got)) and not hasattr(scratch, "made")
    assert components(df.where("a is null"), scratch, "e").count() == 0


def test_rounds_join_what_the_driver_joins(spark, monkeypatch):
    monkeypatch.setattr("vecloom.llm.components.BROADCAST_ROWS", -1)
    r = random.Random(6)
    for form in ([(i, i + 1) for i in range(50)] + [(90, 20), (70, 71), (71, 70), (60, 60)], [(r.randrange(120), r.randrange(120)) for _ in range(90)], [(99, i) for i in range(30)] + [(40, 45), (41, 46)]):
        got = rows_of(components(spark.createDataFrame([*form, (None, 5)], "a long, b long"), Scratch(spark, "t"), "c"))
        assert dict(got) == parted(form) and len(got) == len(dict(got))
    scratch, empty = Counted(spark, "t"), spark.createDataFrame([], "a long, b long")
    stars = [(7, 3), (9, 3), (8, 3), (5, 4), (3, 7)]
    assert dict(rows_of(components(spark.createDataFrame(stars, "a long, b long"), scratch, "c"))) == parted(stars)
    assert scratch.made == ["c_0", "c_1_large"] and components(empty, scratch, "e").count() == 0


@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=40))
@settings(max_examples=80, deadline=None)
def test_least_reached_by_brute_force(edges):
    edges = [e for e in edges if e[0] != e[1]]
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    ids, root = least_reached(a, b)
    assert dict(zip(ids.tolist(), root.tolist(), strict=True)) == parted(edges)


@pytest.mark.parametrize("block", [(512, 10**6), (4, 900)])
def test_near_beyond_broadcasts(spark, monkeypatch, block):
    """Where members are too many to broadcast, joins and rounds give the same classes."""
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr("vecloom.llm.components.BROADCAST_ROWS", -1)
    rows = near_rows(5) + ODD
    got = rows_of(near_dup.classes(docs(spark, rows, True).repartition(3), block_nodes=block[0], block_runs=block[1]))
    assert sorted(got, key=repr) == sorted(brute_near(rows), key=repr)


# ---- passages -------------------------------------------------------------


def brute_passages(rows, length=50):
    by_id = defaultdict(set)
    bodies = [(i if i is not None else float("inf"), (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in bodies:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, float("inf")), i)
    out = []
    for (i, b), (d, _) in zip(bodies, rows, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def passage_rows(seed=5):
    r = random.Random(seed)
    shared = ["".join(r.choice("ab cdé") for _ in range(n)) for n in (49, 50, 51, 60, 120, 400)]
    rows = []
    for i in range(40):
        parts = [r.choice([*shared, "".join(r.choice("abcdef ") for _ in range(r.randrange(80))), "th" * r.randrange(60), "z" * r.randrange(90)]) for _ in range(r.randrange(6))]
        rows.append((r.randrange(30), "".join(parts)))
    return rows + [(40, shared[5][:75]), (41, shared[5][20:130]), (42, None), (43, ""), (None, shared[4] + "x"), (44, "q" * 3000), (45, "q" * 2000)]


@pytest.mark.parametrize("seed", [5, 6, 7])
@pytest.mark.parametrize("batch", [1 << 20, 700])
def test_passages_against_brute_force(spark, seed, batch):
    rows = passage_rows(seed)
    got = rows_of(suffix_dedup.remove_repeats(docs(spark, rows, True).repartition(3), batch_bytes=batch, bucket_bytes=2000))
    assert sorted(got, key=repr) == sorted(brute_passages(rows), key=repr)


@pytest.mark.parametrize("length,qgram", [(20, 8), (33, 17), (64, 40)])
def test_passages_of_other_lengths(spark, length, qgram):
    rows = passage_rows(8)
    got = rows_of(suffix_dedup.remove_repeats(docs(spark, rows), length=length, qgram=qgram, batch_bytes=900, bucket_bytes=3000))
    assert sorted(got, key=repr) == sorted(brute_passages(rows, length), key=repr)


def test_passages_edges(spark):
    assert suffix_dedup.remove_repeats(docs(spark, ODD).where("doc_id < 0")).count() == 0
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(spark, [(1, "k" * 200_000), (2, "k" * 100)]), keep_text=True).collect()}
    assert got[2]["kept"] == b"" and got[1]["n_removed"] == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs(spark, ODD), qgram=60)


def test_slabs_do_not_show(spark, monkeypatch):
    """Documents many slabs long, repeats across a slab's end, matches near every end."""
    monkeypatch.setattr(suffix_dedup, "SLAB_BYTES", 64)
    rows = passage_rows(9) + [(50, "".join(random.Random(7).choice("ab") for _ in range(900))), (51, "".join(random.Random(7).choice("ab") for _ in range(700)))]
    whole = "".join(t or "" for _, t in rows).encode()
    offsets = np.concatenate([[0], np.cumsum([len((t or "").encode()) for _, t in rows])])
    small = suffix_dedup.owners(whole, offsets, 50, 20)
    monkeypatch.setattr(suffix_dedup, "SLAB_BYTES", 1 << 20)
    large = suffix_dedup.owners(whole, offsets, 50, 20)
    assert all((a == b).all() for a, b in zip(small, large, strict=True)) and len(small[0]) > 20
    got = rows_of(suffix_dedup.remove_repeats(docs(spark, rows), batch_bytes=500, bucket_bytes=400))
    assert sorted(got, key=repr) == sorted(brute_passages(rows), key=repr)


@given(st.integers(8, 60), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_refined_buckets_hold_equal_strings(depth, seed):
    """Suffixes share a bucket exactly where their first bytes are equal."""
    r = random.Random(seed)
    data = "".join(r.choice(["a", "b", "ab" * 20, "abba" * 9]) for _ in range(40)).encode() + b"c" * 70
    first = np.array(sorted(r.sample(range(len(data) - depth - 10), 5)))
    last = first + np.array([r.randrange(10) for _ in range(5)])
    refined = suffix_dedup.Refined(suffix_dedup.words_at(data), first, last, depth)
    assert refined.places.tolist() == sorted({p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)})
    strings = [data[p : p + depth] for p in refined.places.tolist()]
    for i, a in enumerate(strings):
        for j, b in enumerate(strings):
            assert (refined.ids[i] == refined.ids[j]) == (a == b)
    assert (refined.of(refined.places) == refined.ids).all()


@pytest.mark.parametrize("most", [10**6, 0])
def test_hot_keys_are_dealt_out(spark, monkeypatch, most):
    """A key beyond the bound goes to several tasks, with or without a broadcast; joins stay what they are, and so do the operators on them."""
    from vecloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(90)], "k long, v long")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 5")
    for how in ("inner", "left"):
        plain = rows.join(groups, "k", how).select("k", "v", "n")
        assert sorted(rows_of(common.join_sized(rows, groups, ["k"], "n", how).select("k", "v", "n")), key=repr) == sorted(rows_of(plain), key=repr)
    near = [(i, t) for i, (_, t) in enumerate(near_rows(3))] + [(100 + i, "the very same words in every one") for i in range(12)]
    assert sorted(rows_of(near_dup.classes(docs(spark, near))), key=repr) == sorted(brute_near(near), key=repr)
    assert sorted(rows_of(exact_dedup.decisions(docs(spark, near))), key=repr) == sorted(brute_exact(near), key=repr)


def test_bucket_names_are_names():
    r = np.random.default_rng(1)
    data = bytes(r.integers(97, 99, 400).tolist())
    word = suffix_dedup.words_at(data)
    full = suffix_dedup.names_of(word, np.arange(len(data) - 49), 50)
    for a, b in [(0, 10), (3, 7)]:
        assert (full[a] == full[b]) == (data[a : a + 50] == data[b : b + 50])
    twice = data + data
    again = suffix_dedup.names_of(suffix_dedup.words_at(twice), np.arange(300) + 400, 50)
    assert (again == full[:300]).all()
    assert len(suffix_dedup.names(word, 20)) == len(data) - 19


def test_driver_tables(spark, sf_dir):
    """Whole small tables, exactly."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    rows = rows_of(d)
    assert sorted(rows_of(exact_dedup.decisions(d)), key=repr) == sorted(brute_exact(rows), key=repr)
    assert sorted(rows_of(near_dup.classes(d)), key=repr) == sorted(brute_near(rows), key=repr)
    assert sorted(rows_of(suffix_dedup.remove_repeats(d)), key=repr) == sorted(brute_passages(rows), key=repr)
    assert d.select(F.count("*")).first()[0] == len(rows)


def test_messages_leave_many_to_a_batch():
    """Messages number as the square of the table; each was a batch of its own."""
    sent = [("n", i, 7, bytes([i % 256]) * 100) for i in range(3000)]
    out = list(suffix_dedup.together(iter(sent)))
    assert [b.num_rows for b in out] == [1024, 1024, 952]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == sent
    large = list(suffix_dedup.together(("a", i, 1, bytes(1 << 20)) for i in range(5)))
    assert [b.num_rows for b in large] == [2, 2, 1] and not list(suffix_dedup.together(iter([])))


def test_owners_are_found_once_and_kept_as_steps():
    rng = random.Random(5)
    data = bytes(rng.choice(b"abcd ") for _ in range(5000)) + b"x" * 3000
    offsets = np.array([0, 10, 2000, 2600, 8000])
    for qgram in (8, 13, 16, 20, 33, 50):
        at, name = suffix_dedup.owners(data, offsets, 50, qgram)
        word = suffix_dedup.words_at(data)
        assert (suffix_dedup.names_at(word, at, qgram) == name).all()
        assert (suffix_dedup.places(suffix_dedup.gaps(at)) == at).all()
    for at in ([], [0], [254], [255], [0, 255, 510, 511, 70_000]):
        assert suffix_dedup.places(suffix_dedup.gaps(np.array(at, np.int64))).tolist() == at


def test_no_bucket_is_refined_twice(spark, monkeypatch):
    """The cut takes what the third round noted; it refined all buckets of the batch anew."""
    rng = random.Random(9)
    common = [bytes(rng.choice(b"abcdefgh") for _ in range(90)) for _ in range(4)]
    bodies = [rng.choice(common)[: rng.randint(50, 90)] + bytes(rng.choice(b"ijklmn") for _ in range(40)) + rng.choice(common) for _ in range(30)]
    lengths, data = np.array(list(map(len, bodies))), b"".join(bodies)
    ids, answers = np.array(rng.sample(range(100), 30)), {k: {} for k in "nmasg"}
    made = []
    monkeypatch.setattr(suffix_dedup, "Refined", lambda *a, f=suffix_dedup.Refined: made.append(1) or f(*a))
    batch = lambda: suffix_dedup.Batch(0, ids, lengths, data, 1, 50, 20, answers)
    for round_ in (1, 2, 3):
        for kind, bucket, _, blob in batch().send(round_):
            answers[kind][bucket] = suffix_dedup.answer(kind, [blob])[0]
    got = [(int(i), *f[:3], hashlib.sha256(f[3]).hexdigest()) for i, f in zip(ids, batch().cut(), strict=True)]
    assert made == [1]
    want = suffix_dedup.remove_repeats(docs(spark, [(int(i), b.decode()) for i, b in zip(ids, bodies, strict=True)]), batch_bytes=300)
    assert sorted(got) == sorted(rows_of(want)) and sum(g[2] for g in got) > 1000
