"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers over word classes are composed into one table: the lexicon
(word to class), negation (an insult or threat soon after a negation is
negated), reported speech (what a speech verb introduces or quotation marks hold
is reported) and target (an insult or threat soon after a person is aimed).  A
clause is run through the composition once; what counts are the events it
emits, never words on their own, and each event carries the weight of its path:
an aimed insult more than a plain one, a reported one a third of it, a negated
one a tenth.  A document's strength is the sum over its clauses; its logarithm
and its share of the words go through a logistic model whose slopes are never
negative, so negating or reporting a clause can only lower a score.

Target, negation, speech and threat words are fixed lists in four languages.
Insults are learned from labelled rows alone: whole words and word beginnings
whose share of the words is many times higher in toxic rows, on evidence enough,
counting near-identical rows once.

Bound: lexicon and weights are fitted on the ``sample`` labelled rows with the
smallest hash of doc_id (default 20,000), whatever the input; scoring covers
every whole text.

Defined results: null text is an empty text; without an event the score is the
model's base rate, so empty texts have a score too, and so has a very long one,
read once from end to end.  Several labels of a doc_id count as the largest, a
null label as none.  A null doc_id is never labelled and counts as not held out.
Repeated rows score alike.  Without labels no word is an insult and all scores
are the prior's; an empty table gives no rows.  Only doc_id and text are read;
``keep_clean`` passes all other columns on, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, read, texts

SAMPLE = 20_000
FOLDS = 5
#: An entry needs so many toxic rows (and this share of them), so high a log ratio of its shares of words, and so much evidence: rows times their log odds.
MIN_SUPPORT, MIN_SHARE, MIN_ODDS, MIN_EVIDENCE = 4, 0.002, 2.0, 15.0
STEMS = (4, 5, 6, 7)
#: Added to shares of words before ratios are taken.
SHARE_SLACK = 1e-4

TARGETS = frozenset("you your yours yourself he she they him her them u du dich dir dein deine ihr euch sie tu toi ton ta te vous votre vos il elle ils tú ti tu vosotros usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor isn aren wasn don doesn didn without nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split())
SPEECH = frozenset("said says say wrote writes called calls quoted quotes claimed claims told reported heard sagt sagte schrieb nannte zitiert dit disait écrit appelé cité dijo dice escribió llamó citó".split())
THREATS = frozenset("kill killing murder hurt destroy stab shoot strangle beat töte töten umbringen schlagen tuer frapper buter matar golpear".split())

WORD = re.compile(r"[^\W\d_]+|[\"“”„«»]|[.!?;\n]+")
SYMBOLS = ("insult", "threat", "target", "negation", "speech", "quote", "break", "other")
EVENTS = ("insult", "insult aimed", "insult negated", "insult reported", "threat", "threat aimed", "threat negated", "threat reported")
#: The weight of each event's path through the grammar: threats weigh by whom they are aimed at.
PATHS = (1.0, 1.25, 0.1, 0.3, 0.1, 1.0, 0.01, 0.05)
#: Prior means and precision of the logistic weights: base rate, logarithm of the strength, strength in a hundred words.
PRIOR, PRECISION = np.array([-4.0, 0.5, 1.0]), 0.05
#: Shorter texts count as this many words; shares above MOST tell no more.
LEAST_WORDS, MOST = 20, 10.0

Step = Callable[[int, str], tuple[int, str]]


def negation(state: int, symbol: str, scope: int = 4) -> tuple[int, str]:
    if symbol == "break":
        return 0, symbol
    if symbol == "negation":
        return scope, symbol
    return max(0, state - 1), symbol + " negated" if state and symbol in ("insult", "threat") else symbol


def reported(state: int, symbol: str) -> tuple[int, str]:
    """States: 0 plain, 1 after a speech verb, 2 inside quotation marks it opened."""
    if symbol == "speech":
        return 1 if state == 0 else state, symbol
    if symbol == "quote":
        return (0 if state == 2 else 2 if state == 1 else 0), symbol
    if symbol == "break":
        return (2 if state == 2 else 0), symbol
    return state, symbol + " reported" if state and symbol.split(" ")[0] in ("insult", "threat") else symbol


def aimed(state: int, symbol: str, scope: int = 4) -> tuple[int, str]:
    if symbol == "break":
        return 0, symbol
    if symbol == "target":
        return scope, symbol
    return max(0, state - 1), symbol + " aimed" if state and symbol in ("insult", "threat") else symbol


def compose(*steps: Step, symbols: Iterable[str] = SYMBOLS) -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]]:
    """One transition table for transducers that run one after the other, over the states that can occur."""
    start = (0,) * len(steps)
    table, open_states, seen = {}, [start], {start}
    while open_states:
        states = open_states.pop()
        for symbol in symbols:
            out, after = symbol, []
            for step, state in zip(steps, states, strict=True):
                state, out = step(state, out)
                after.append(state)
            table[states, symbol] = tuple(after), out
            if table[states, symbol][0] not in seen:
                seen.add(table[states, symbol][0])
                open_states.append(table[states, symbol][0])
    return table


#: Reported and negated insults keep that mark whether or not they are aimed.
GRAMMAR = compose(negation, reported, aimed)
START = (0, 0, 0)
EVENT_OF = {name: i for i, name in enumerate(EVENTS)} | {"insult negated reported": 2, "threat negated reported": 6}


class Lexicon:
    """Insults as whole words (``word$``) and word beginnings; finds the clauses that hold one or a threat."""

    def __init__(self, entries: Iterable[str]):
        entries = sorted(entries)
        self.words = frozenset(e[:-1] for e in entries if e.endswith("$"))
        self.stems = tuple(e for e in entries if not e.endswith("$"))
        alternatives = [re.escape(w) + r"(?![^\W\d_])" for w in sorted(self.words | THREATS)] + [re.escape(s) for s in self.stems]
        self.find = re.compile(r"(?<![^\W\d_])(?:" + "|".join(alternatives) + ")").finditer

    def symbol(self, token: str) -> str:
        if token in self.words or token.startswith(self.stems) and self.stems:
            return "insult"
        if token in THREATS:
            return "threat"
        if token in TARGETS:
            return "target"
        if token in NEGATIONS:
            return "negation"
        if token in SPEECH:
            return "speech"
        if not token[0].isalpha():
            return "quote" if token in "\"“”„«»" else "break"
        return "other"

    def events(self, text: str) -> list[int]:
        """How often each event occurs in the clauses of ``text``."""
        counts, done, text = [0] * len(EVENTS), -1, text.casefold()
        for m in self.find(text):
            if m.start() < done:
                continue
            # From the line's start, so that a quotation opened before the clause is known.
            begin = max(text.rfind("\n", 0, m.start()) + 1, done)
            end = text.find("\n", m.end())
            done = end if end >= 0 else len(text)
            states = START
            for token in WORD.findall(text[begin:done]):
                states, out = GRAMMAR[states, self.symbol(token)]
                if out in EVENT_OF:
                    counts[EVENT_OF[out]] += 1
        return counts


def entries_of(words: list[str]) -> Counter:
    """How many words of a text each entry holds: whole words with ``$``, and word beginnings."""
    out: Counter = Counter()
    for word, n in Counter(words).items():
        out[word + "$"] += n
        for k in STEMS:
            if len(word) > k:
                out[word[:k]] += n
    return out


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled rows a key that near-identical rows share (the least hash of five words)."""
    for batch in batches:
        words = [re.findall(r"[^\W\d_]+", x.casefold()) for x in texts(batch.column(1))]
        family = [min((zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))), default=0) for w in words]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "toxic": batch.column(2), "family": pa.array(family, pa.int64())})


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a batch, by entry: toxic and clean rows that hold it, and the sums of its shares of their words."""
    for batch in batches:
        sums: dict[str, list[float]] = {}
        for body, toxic in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = re.findall(r"[^\W\d_]+", body.casefold())
            at = 0 if toxic else 1
            for entry, n in entries_of(words).items():
                s = sums.setdefault(entry, [0, 0, 0.0, 0.0])
                s[at] += 1
                s[2 + at] += n / len(words)
        columns = list(zip(*sums.values(), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_pydict({"entry": pa.array(list(sums), pa.string())} | {c: pa.array([float(v) for v in x], pa.float64()) for c, x in zip(("hits", "misses", "toxic_share", "clean_share"), columns, strict=True)})


def choose(marks: list[tuple[str, float]]) -> list[str]:
    """Entries by evidence, less those that begin with a stronger beginning or begin a stronger entry; of equals whole words, then longer ones first."""
    chosen: list[str] = []
    for entry, _ in sorted(marks, key=lambda m: (-m[1], not m[0].endswith("$"), -len(m[0]), m[0])):
        word = entry.rstrip("$")
        if not any(not c.endswith("$") and word.startswith(c) or not entry.endswith("$") and c.startswith(word) for c in chosen):
            chosen.append(entry)
    return chosen


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights nearest to the prior, slopes not below 0, by projected Newton steps."""
    w, x = PRIOR.copy(), np.hstack([np.ones((len(x), 1)), x])
    strength = np.diag([1e-3] + [PRECISION] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        new = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + strength, x.T @ (p - y) + strength @ (w - PRIOR))
        new[1:] = np.maximum(new[1:], 0)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def features(counts: Iterable[int], words: int) -> list[float]:
    """Logarithm of the strength of the events, and their strength in a hundred words."""
    total = sum(n * w for n, w in zip(counts, PATHS, strict=True))
    return [math.log1p(total), min(MOST, 100 * total / max(LEAST_WORDS, words))]


class Model:
    def __init__(self, entries: list[str], weights: np.ndarray):
        self.entries, self.weights = entries, [float(w) for w in weights]

    def scorer(self) -> Callable[[str], tuple[float, list[int]]]:
        lexicon, weights = Lexicon(self.entries), self.weights

        def score(text: str) -> tuple[float, list[int]]:
            counts = lexicon.events(text)
            z = weights[0] + (sum(w * v for w, v in zip(weights[1:], features(counts, len(text.split())), strict=True)) if any(counts) else 0.0)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), counts

        return score


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """A model from the labelled rows whose crc32 of doc_id as text is no multiple of ``folds``."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = scratch.put(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    # ``sample`` rows of two numbers: a bounded broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    families = scratch.put(rows.mapInArrow(_training, "doc_id long, toxic int, family long"), "families")
    once = scratch.put(families.groupBy("family", "toxic").agg(F.min("doc_id").alias("doc_id")), "once")
    own = rows.join(F.broadcast(once.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text", "toxic")
    sizes = {t: n for t, n in once.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(MIN_SUPPORT, math.ceil(MIN_SHARE * toxic))
    sums = own.mapInArrow(_shares, "entry string, hits double, misses double, toxic_share double, clean_share double").groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("hits", "misses", "toxic_share", "clean_share")))
    ratio = F.log(F.col("toxic_share") / max(1, toxic) + SHARE_SLACK) - F.log(F.col("clean_share") / max(1, clean) + SHARE_SLACK)
    evidence = F.col("hits") * (F.log((F.col("hits") + 0.5) / (toxic + 1)) - F.log((F.col("misses") + 0.5) / (clean + 1)))
    marks = sums.where(F.col("hits") >= least).where(ratio >= MIN_ODDS).select("entry", evidence.alias("evidence")).where(F.col("evidence") >= MIN_EVIDENCE)
    found = choose([tuple(r) for r in marks.collect()])  # entries that ``sample`` rows support
    lexicon = Lexicon(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, e, len(x.split()) if any(e) else 0) for t, x in zip(batch.column(2).to_pylist(), texts(batch.column(1)), strict=True) for e in [lexicon.events(x)]]
            yield pa.RecordBatch.from_pydict({"toxic": pa.array([r[0] for r in rows], pa.int32()), "counts": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "words": pa.array([r[2] for r in rows], pa.int64())})

    seen = own.mapInArrow(count, "toxic int, counts array<long>, words long").groupBy("toxic", "counts", "words").agg(F.count("*").alias("n")).orderBy("toxic", "counts", "words").collect()  # at most ``sample`` rows
    if not seen:
        return Model(found, PRIOR)
    x = np.repeat(np.array([features(r["counts"], r["words"]) for r in seen]), [r["n"] for r in seen], axis=0)
    return Model(found, fit(x, np.repeat([float(r["toxic"]) for r in seen], [r["n"] for r in seen])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score, predicted, events."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            found = [scorer(x) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "score": pa.array([s for s, _ in found], pa.float64()),
                "predicted": pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), "events": pa.array([c for _, c in found], pa.list_(pa.int64())),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, events array<long>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows predicted toxic; columns unchanged."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer(x)[0] < 0.5 for x in texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "events")
