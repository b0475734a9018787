"""Nearest neighbours, mixing, packing and the pipeline against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from vecloom.llm import ann, mixing, packing
from vecloom.llm.common import read

from .helpers import ODD, docs, rows_of, words

# ---- nearest neighbours ---------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, node string, unit string, own string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], VECTORS)


def brute_nearest(rows, wanted, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    length = Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, v) for i, v in good if len(v) == length]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in sorted({i for i, _ in good if wanted(i)}):
        s = np.round((x @ x[np.flatnonzero(ids == q)[0]]), 12)
        seen = sorted({(-a, b) for a, b in zip(s, ids.tolist(), strict=True) if b != q})[:k]
        out[q] = [b for _, b in seen]
    return out


def test_small_tables_exactly(spark):
    """Few enough vectors for one leaf: the answer is exact. Copies, ties, unusable rows, repeated rows."""
    r = np.random.default_rng(1)
    x = r.standard_normal((150, 8)).astype("f4").tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(200 + i, x[0]) for i in range(9)] + [(300, x[0]), (300, x[0])] + [(i, [c * 2 for c in x[1]]) for i in (350, 351)]
    rows += [(400, None), (450, []), (500, [0.0] * 8), (550, [float("nan")] * 8), (600, [None] + [1.0] * 7), (650, [1.0] * 5), (None, x[3]), (700, [float("inf")] * 8)]
    got = defaultdict(list)
    for q, rank, v, s in sorted(rows_of(ann.nearest(vectors(spark, rows).repartition(3), F.col("vec_id") % 50 == 0))):
        got[q].append(v)
        assert rank == len(got[q]) and -1.0001 <= s <= 1.0001
    assert dict(got) == brute_nearest(rows, lambda i: i % 50 == 0, 5)


def test_few_vectors(spark):
    two = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    assert rows_of(ann.nearest(vectors(spark, two), F.lit(True)).select("query_id", "rank", "vec_id").orderBy("query_id")) == [(0, 1, 1), (1, 1, 0)]
    assert ann.nearest(vectors(spark, two[:1]), F.lit(True)).count() == 0
    assert ann.nearest(vectors(spark, []), F.lit(True)).count() == 0
    copies = [(i, [1.0, 2.0]) for i in range(9)]
    assert [r["vec_id"] for r in ann.nearest(vectors(spark, copies), F.col("vec_id") == 2).orderBy("rank").collect()] == [0, 1, 3, 4, 5]


def test_recall(spark):
    """Small leaves, so that only the joins of neighbours of neighbours can find most."""
    r = np.random.default_rng(2)
    x = r.standard_normal((1500, 12)).astype("f4").tolist()
    rows = list(enumerate(x))
    want = brute_nearest(rows, lambda i: i % 50 == 0, 5)
    got = defaultdict(set)
    for q, _, v, _ in rows_of(ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, leaf=64, trees=2)):
        got[q].add(v)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_recall_in_a_tight_group(spark):
    """A third of all rows are distinct vectors far nearer to one another than half precision tells apart."""
    r = np.random.default_rng(4)
    x = r.standard_normal((1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:400] = x[0] + 3e-4 * r.standard_normal((400, 64))
    rows = list(enumerate(x.astype("f4").tolist()))
    want = brute_nearest(rows, lambda i: i % 20 == 0 and i < 400, 5)
    got = defaultdict(set)
    for q, _, v, _ in rows_of(ann.nearest(vectors(spark, rows), (F.col("vec_id") % 20 == 0) & (F.col("vec_id") < 400))):
        got[q].add(v)
    recall = sum(len(got[q] & set(w)) for q, w in want.items()) / sum(map(len, want.values()))
    print("recall in a tight group", recall)
    assert recall >= 0.95


def test_recall_among_clusters(spark):
    """Forty tight clusters, half of them tighter; every query's neighbours lie in its own."""
    r = np.random.default_rng(5)
    noise = np.repeat([1e-3, 1e-2], 1000)[:, None]
    x = np.repeat(r.standard_normal((40, 64)) / 8, 50, axis=0) + noise * r.standard_normal((2000, 64))
    rows = list(enumerate(x.astype("f4").tolist()))
    want = brute_nearest(rows, lambda i: i % 50 == 0, 5)
    got = defaultdict(set)
    for q, _, v, _ in rows_of(ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0)):
        got[q].add(v)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) / sum(map(len, want.values())) >= 0.95


def test_vectors_of_several_lengths(spark):
    """Each length has its own answers."""
    rows = [(i, [1.0, i + 1.0]) for i in range(4)] + [(50 + i, [1.0, 0.5, i + 1.0]) for i in range(3)] + [(100, [1.0])]
    got = defaultdict(list)
    for q, _, v, _ in sorted(rows_of(ann.nearest(vectors(spark, rows), F.lit(True)))):
        got[q].append(v)
    assert got[0] == [1, 2, 3] and got[50] == [51, 52] and 100 not in got


# ---- mixing ---------------------------------------------------------------


def brute_targets(rows, budget=1.5, cap=2.0):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = budget * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share >= cap * sizes[s]}
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return sizes, target


def mix_rows():
    r, rows = random.Random(3), []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else r.choice(["a", "b", "B", "é", "z", "𝒳", "", None])
        rows.append((i, " ".join(["w"] * r.choice([1, 3, 10, 40, 41, 100, 300])), source))
    return rows + [(5000, None, "a"), (5001, "", "empty"), (5002, None, None), (5003, "x " * 5000, "b"), (3, rows[3][1], rows[3][2]), (None, "no id", "a")]


def test_mixing_meets_targets(spark):
    rows = mix_rows()
    sizes, target = brute_targets(rows)
    df = docs(spark, rows, True).repartition(3)
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.003 * t, 600)
    again = mixing.plan(docs(spark, rows).repartition(5)).collect()
    key = lambda x: sorted(((r["doc_id"], r["size"], r["taken"]) for r in x), key=repr)
    assert key(got) == key(again)


def test_rates_are_an_exponential_tilt(spark):
    """The rates solve the balance: one dual a source gives every rate, and the rates meet the target."""
    got = mixing.plan(docs(spark, mix_rows())).where("size > 0").collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append((r["size"], r["rate"], r["target"]))
    for rows in by.values():
        duals = {round(np.log(rate) / size, 9) for size, rate, _ in rows if rate < 2}
        assert len(duals) <= 1
        assert sum(size * rate for size, rate, _ in rows) == pytest.approx(rows[0][2], rel=1e-6)


def test_mixing_edges(spark):
    df = docs(spark, ODD, True)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.where("_id = 'clash' and copies = 'clash'").count() == mixed.count() > 0
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.plan(df).collect()}
    seen = Counter(r["doc_id"] for r in mixed.collect())
    assert seen[7] == copies[7, 60_000] and seen[2] == 0
    assert mixing.plan(df.where("doc_id < 0")).count() == 0
    assert mixing.plan(docs(spark, [(1, None, "a"), (2, "", None)])).collect()[0]["target"] == 0


# ---- packing --------------------------------------------------------------


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=200, deadline=None)
def test_tournament_tree_is_first_fit(sizes):
    seq, offset = packing.first_fit_decreasing(sizes, 40)
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
        if at == len(room):
            room.append(40)
        want[i] = (at, 40 - room[at])
        room[at] -= sizes[i]
    assert {i: (s, o) for i, (s, o) in enumerate(zip(seq, offset, strict=True))} == want


@given(st.text(alphabet="aB's'Té ñÇ1²½ \n\t\xa0.,-—İΣσß_!é\x85\x1cćǄ<|>", max_size=40))
@settings(max_examples=500, deadline=None)
def test_ids_are_the_tokenizers(text):
    global _WORDS
    if "_WORDS" not in globals():
        _WORDS = packing.WordIds(packing.tokenizer_path())
    for t in (text, text + "<|endoftext|>"):
        assert _WORDS.encode([t])[0].tolist() == _WORDS.tokenizer.encode(t, add_special_tokens=False).ids


def test_ids_of_all_letters_that_leave_the_range():
    """Every letter whose lower case lies elsewhere, alone, in words and before combining marks; then random text over them."""
    own = packing.WordIds(packing.tokenizer_path())
    odd = [c for c in map(chr, range(0x3000)) if any(ord(x) >= own.LIMIT for x in c.lower()) or len(c.lower()) > 1 or len(c.upper()) > 1] + ["İ", "Ⱥ", "Ⱦ"]
    r, low = random.Random(9), [chr(c) for c in range(own.LIMIT)]
    batch = [f"a{c}b {c} {c}\u0331{c}\u0349" for c in odd] + ["aȺ b", "ȾELȺ", "Ⱦ\u0349", "İ\u0331Ɔ", ""]
    batch += ["".join(r.choice(odd if r.random() < 0.2 else low) for _ in range(r.randrange(12))) for _ in range(20_000)]
    for i in range(0, len(batch), 2000):
        want = own.tokenizer.encode_batch(batch[i : i + 2000], add_special_tokens=False)
        assert [x.tolist() for x in own.encode(batch[i : i + 2000])] == [x.ids for x in want]


def test_words_unlike_the_tokenizers_go_through_it(monkeypatch):
    own = packing.WordIds(packing.tokenizer_path())
    monkeypatch.setattr(own, "words", lambda text: [text])
    texts = ["two words", "one, two"]
    assert [x.tolist() for x in own.encode(texts)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    own = packing.WordIds(packing.tokenizer_path())
    for i in range(5):
        t = " ".join(words(100, i))
        assert own.encode([t])[0].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


@given(st.lists(st.text(alphabet="ab'stmdrevl'Té ñ1²½ \n\t\xa0.,\x85\x1cß\u0331", max_size=30), max_size=5))
@settings(max_examples=1000, deadline=None)
def test_split_of_bytes_is_that_of_the_words(texts):
    global _WORDS
    if "_WORDS" not in globals():
        _WORDS = packing.WordIds(packing.tokenizer_path())
    low = [t.lower() for t in texts]
    words, bounds = _WORDS.split(low)
    want = [_WORDS.words(t) for t in low]
    assert words.to_pylist() == [w for x in want for w in x]
    assert bounds.tolist() == list(itertools.accumulate(map(len, want)))


def test_split_unlike_the_tokenizers_goes_through_it(monkeypatch):
    """As above, for what is split from bytes: several of the tokenizer's words taken for one are noticed."""
    own = packing.WordIds(packing.tokenizer_path())
    monkeypatch.setattr(own, "split", lambda texts: (pa.array(["two words", "one", ", two"], pa.large_string()), np.array([1, 3])))
    texts = ["two words", "one, two"]
    assert [x.tolist() for x in own.encode(texts)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_beside_others_get_their_own_ids():
    """Texts of a batch that go through the tokenizer whole, are empty or hold no words keep their places."""
    own = packing.WordIds(packing.tokenizer_path())
    batch = ["", "it's a", "日本 語", "<|endoftext|> x", " \n", "l'été 25²", "", "it'sa 'll'd''s'", "Я"]
    for some in (batch, batch[::-1], ["日本"], ["", " "], []):
        assert [x.tolist() for x in own.encode(some)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_a_word_is_encoded_once_a_worker(monkeypatch):
    """Tasks that one worker runs share what it learned; a word is looked up once a batch, not each time it stands there."""
    learned, looked = [], []
    learn, get = packing.WordIds.learn, packing.Places.__getitem__
    monkeypatch.setattr(packing.WordIds, "learn", lambda self, some: learned.extend(some) or learn(self, some))
    monkeypatch.setattr(packing.Places, "__getitem__", lambda self, w: looked.append(w) or get(self, w), raising=False)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["qua quo qua " * 50, "quo qui"]})
    packing.word_ids.cache_clear()
    cut = [packing._cut(packing.tokenizer_path(), 64, 2, True) for _ in range(2)]
    one, two = [next(c(iter([batch]))).to_pydict() for c in cut]
    packing.word_ids.cache_clear()
    assert one == two and learned == ["qua", "quo", "qui"] and looked == learned * 2


def check_pieces(pieces, rows, length):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[d, len(ids), tuple(ids)] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    for (d, n), ps in by_doc.items():
        texts = [ids for (dd, nn, ids), c in want.items() if (dd, nn) == (d, n) for _ in range(c)]
        assert sum(p["length"] for p in ps) == n * len(texts)
        cover = Counter((p["start"], p["length"], p["ids_crc32"]) for p in ps)
        expect = Counter()
        for ids in texts:
            for s, ln in {(p["start"], p["length"]) for p in ps}:
                expect[s, ln, zlib.crc32(np.array(ids[s : s + ln], "<u4").tobytes())] += 1
        assert cover == expect
    assert sum(want.values()) == sum(len([ids for (dd, nn, ids), c in want.items() if (dd, nn) == k for _ in range(c)]) for k in by_doc)
    fill = defaultdict(list)
    for p in pieces:
        fill[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
    return sum(p["length"] for p in pieces) / (length * len(fill))


def test_packing_places_every_id_once(spark):
    r = random.Random(5)
    rows = [(i, " ".join(words(r.choice([0, 1, 5, 50, 200]), i))) for i in range(400)] + [x for x in ODD if x[0] != 8]
    got = packing.pack(docs(spark, rows, True).repartition(3), length=256, group_size=50).collect()
    assert check_pieces(got, rows, 256) > 0.9
    assert packing.pack(docs(spark, rows).where("doc_id < 0")).count() == 0
    assert packing.pack(docs(spark, [(1, None)])).select("length", "doc_tokens", "offset").collect()[0][:] == (1, 1, 0)


def test_packing_with_ids(spark):
    got = packing.pack(docs(spark, [(1, "hello world"), (2, "x")]), keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)


def test_packing_tables(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    assert check_pieces(packing.query(spark, sf_dir).collect(), rows_of(d), 4096) > 0.95


# ---- pipeline -------------------------------------------------------------


def test_pipeline_by_stages(spark, sf_dir, tmp_path):
    from .test_dedup import brute_near

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frames, before = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, sf_dir).write.parquet(path)
        frames[name], before = (before, spark.read.parquet(path)), spark.read.parquet(path)
    assert list(frames) == ["toxicity", "exact_dedup", "near_dup", "mixing", "packing"]
    for name in list(frames)[:-1]:
        assert frames[name][1].columns == columns
    one, two = frames["exact_dedup"]
    best = {}
    for d, t in rows_of(one.select("doc_id", "text")):
        best[t or ""] = max(d, best.get(t or "", d))
    assert sorted(best.values()) == sorted(r["doc_id"] for r in two.collect())
    three = frames["near_dup"][1]
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(d for d, c, _, _ in brute_near(rows_of(two.select("doc_id", "text"))) if d == c)
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(three).collect() if r["copies"]}
    four = frames["mixing"][1]
    assert Counter(r["doc_id"] for r in four.collect()) == Counter(copies)
    check_pieces(frames["packing"][1].collect(), rows_of(four.select("doc_id", "text")), 4096)
    assert frames["toxicity"][1].count() >= 0.7 * frames["toxicity"][0].count()


def test_pipeline_passes_other_columns_on(spark, sf_dir, tmp_path):
    """Columns whose names the operators use inside come through every stage but the last."""
    df = docs(spark, [*ODD, *((100 + i, " ".join(words(40, i))) for i in range(5))], True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        df = spark.read.parquet(path)
        assert df.where("node = 'clash' and _id = 'clash' and kept = 'clash'").count() == df.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() >= df.count()


def test_pipeline_on_no_rows_and_odd_rows(spark, sf_dir, tmp_path):
    for k, df in enumerate((docs(spark, ODD), docs(spark, ODD).where("doc_id < 0"))):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}{k}")
            stage(spark, df, sf_dir).write.parquet(path)
            df = spark.read.parquet(path)
        assert (df.count() > 0) == (k == 0)
