"""Personal data: base patterns, and contextual patterns bootstrapped from what they find.

The base patterns (email, ip, card, phone) give seed entities, and so do strings
that look like keys (long, mixed, of many different characters), which are no
result on their own.  The words beside a seed induce lexical patterns (two words
to the left, one word on each side, the label in front of a colon or equals
sign).  Patterns and instances form a bipartite graph; Spark scores it by turns:
a pattern by the belief in its instances against those of another kind or shape,
an instance by the noisy-or of its patterns.  Patterns that stay sure over enough
different seeds mark what else stands in them: identifiers that no base pattern
covers, and the keys themselves (kind secret).

The scan goes over each text once and keeps only spans, instances and patterns;
the iterations run on (pattern, instance, kind, count) edges, combined before
each shuffle.  A common pattern meets its score by broadcast or salted.

Defined results: null text is an empty text and has no spans; a very long one is
read once from end to end.  Each row stands for itself, so repeated rows give
repeated results, and an empty table none.  Of overlapping discovered spans the
one with the smaller start, then the longer one, then the kind listed first
stays; none overlaps a base span.  Only doc_id and text are read, so other
columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, bound_batches, join_known, read, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: A pattern counts from this many different seeds on, and with this confidence.
MIN_SEEDS, MIN_CONFIDENCE, ROUNDS = 5, 0.8, 3
#: How much an instance of a kind's shape that nothing else speaks for counts against a pattern, and from which confidence a pattern speaks for its instances.
UNSEEN, SPEAKS = 0.1, 0.4
CONTEXT = 80

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A failing match can't succeed from inside the same run of digits: runs are tried once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: strings around digit groups, and addresses written out.
DIGITS = re.compile(r"[0-9](?:[0-9 ().-]*[0-9])?")
TOKEN = LOCAL | frozenset("/")
WRITTEN = re.compile(r" ?[\[(]at[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)*| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+")
#: What a label gives in quotation marks.
QUOTED = re.compile(r"[:=]\s?[\"']([^\s\"']{6,200})[\"']")
KEY = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_DIGITS = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain.tld: from each @ back over the local part, then on over the domain."""
    before, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > before and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            before = m.end()
        at = text.find("@", max(at + 1, before))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda x: (x[0], BASE.index(x[2])))


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span."""
    left = text[max(0, start - CONTEXT) : start]
    words, after = re.findall(r"[^\W\d_]+", left.casefold())[-2:], re.findall(r"[^\W\d_]+", text[end : end + CONTEXT // 2].casefold())[:1]
    out = []
    if len(words) == 2:
        out.append("2 " + " ".join(words))
    if words and after:
        out.append(f"1 {words[-1]} _ {after[0]}")
    if words and (m := re.search(r"[:=#]\s*[\"']?$", left)):
        out.append(f"l {words[-1]} {m.group()[0]}")
    return out


FOUND = "row long, doc_id long, base array<struct<start:long,stop:long,kind:string>>, items array<struct<kind:string,start:long,stop:long,instance:string,shape:string,patterns:array<string>>>"
SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())])
ITEM = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("instance", pa.string()), ("shape", pa.string()), ("patterns", pa.list_(pa.string()))])


def candidates(text: str) -> list[tuple[int, int]]:
    """Disjoint spans that may hold an identifier, in order: strings around digits, addresses written out, quoted values of labels."""
    out, before = [], 0
    for m in DIGITS.finditer(text):
        start, end = m.span()
        if start < before:
            continue
        while start > before and text[start - 1] in TOKEN:
            start -= 1
        while end < len(text) and text[end] in TOKEN:
            end += 1
        before = end
        if sum(c.isdigit() for c in text[start:end]) >= MIN_DIGITS:
            out.append((start, end))
    n = len(out)
    if "at]" in text or "at)" in text or " dot " in text:
        before = 0
        for m in WRITTEN.finditer(text):
            start = m.start()
            while start > before and text[start - 1] in LOCAL:
                start -= 1
            before = m.end()
            if start < m.start():
                out.append((start, m.end()))
    if '"' in text or "'" in text:
        out += [m.span(1) for m in QUOTED.finditer(text)]
    if len(out) > n:
        out.sort(key=lambda x: (x[0], -x[1]))
        whole: list[tuple[int, int]] = []
        for x in out:
            if not whole or x[0] >= whole[-1][1]:
                whole.append(x)
        out = whole
    return out


def is_key(text: str) -> bool:
    """Whether a string looks like a key: long, of many different characters, letters and digits mixed all through."""
    if not KEY.fullmatch(text) or len(set(text)) < 10:
        return False
    digits = sum(c.isdigit() for c in text)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(text, text[1:], strict=False))
    return digits >= 4 and len(text) - digits >= 4 and changes >= 6


def shape_of(text: str) -> str:
    """The kinds, one letter each, that an instance's form allows."""
    digits = sum(c.isdigit() for c in text)
    letters = sum(c.isalpha() for c in text)
    out = "e" if letters and ("at" in text or "@" in text) else ""
    if not letters:
        out += ("i" if 4 <= digits <= 12 and text.count(".") == 3 else "") + ("c" if 12 <= digits <= 19 else "") + ("p" if 5 <= digits <= 15 else "")
    return out + ("s" if len(text) >= 6 and " " not in text else "")


def scan_text(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and items: base spans as seeds, and candidates apart from them, of which keys are seeds, too."""
    base = base_spans(text)
    found, i, reach = list(base), 0, 0
    for s, e in candidates(text):
        while i < len(base) and base[i][0] < e:
            reach, i = max(reach, base[i][1]), i + 1
        if reach <= s:
            found.append((s, e, "secret" if is_key(text[s:e]) else ""))
    items = [{"kind": k, "start": s, "stop": e, "instance": re.sub(r"\W", "", text[s:e].casefold()), "shape": shape_of(text[s:e]), "patterns": patterns(text, s, e)} for s, e, k in found]
    return [{"start": s, "stop": e, "kind": k} for s, e, k in base], items


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        found = [scan_text(x) for x in texts(batch.column(1))]
        yield pa.RecordBatch.from_pydict({
            "row": pa.array(range(row, row + len(found)), pa.int64()), "doc_id": batch.column(0),
            "base": pa.array([x[0] for x in found], pa.list_(SPAN)), "items": pa.array([x[1] for x in found], pa.list_(ITEM)),
        })
        row += len(found)


def learn(items: DataFrame, scratch: Scratch, min_seeds: int, min_confidence: float, rounds: int) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are sure, from the pattern-instance graph.

    confidence = believed / (believed + of other kinds or shapes + UNSEEN * unseen + 1), in different instances.
    """
    edges = items.select(F.explode("patterns").alias("pattern"), "instance", "kind", "shape").groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"), F.min("shape").alias("shape"))
    edges = scratch.put(edges, "edges")
    seeded = edges.where("kind <> ''").groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("seeds")).where(F.col("seeds") >= min_seeds)
    seeded = scratch.put(seeded.select("pattern", F.col("kind").alias("as"), "seeds"), "seeded")
    n = seeded.count()
    patterns = seeded.select("pattern").distinct()
    edges = scratch.put(join_known(edges, patterns, "pattern", n), "live")
    # Each live edge for every kind its pattern may mark; a seed of the kind is believed from the start.
    pairs = seeded.groupBy("pattern").agg(F.collect_list("as").alias("kinds"))  # at most as many as there are kinds
    pairs = join_known(edges, pairs, "pattern", n).select("pattern", "instance", "kind", "shape", F.explode("kinds").alias("as"))
    first = F.create_map(*(F.lit(x) for k in KINDS for x in (k, k[0])))
    own, fits = F.col("kind") == F.col("as"), F.contains("shape", first[F.col("as")])
    pairs = scratch.put(pairs.withColumn("own", own).withColumn("against", ~own & ((F.col("kind") != "") | ~fits)), "pairs")
    belief, sure = None, None
    for i in range(1, rounds + 1):
        told = pairs.withColumn("score", F.lit(0.0)) if belief is None else pairs.join(belief.hint("merge"), ["instance", "as"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        mass = F.when(F.col("own"), 1.0).when(F.col("against"), 0.0).otherwise(F.col("score"))
        sums = told.groupBy("pattern", "as").agg(F.sum(mass).alias("mass"), F.sum(F.col("against").cast("double")).alias("against"), F.sum((~F.col("own") & ~F.col("against")).cast("double") * (1 - F.col("score"))).alias("unseen"))
        score = scratch.put(sums.withColumn("confidence", F.col("mass") / (F.col("mass") + F.col("against") + UNSEEN * F.col("unseen") + 1)), f"score_{i}")
        sure = score.where(F.col("confidence") >= min_confidence)
        if i < rounds:
            speaks = score.where(F.col("confidence") >= SPEAKS).select("pattern", "as", "confidence")
            heard = pairs.where("not own and not against").join(F.broadcast(speaks) if n <= BROADCAST_ROWS else speaks.hint("merge"), ["pattern", "as"])
            belief = scratch.put(heard.groupBy("instance", "as").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score")), f"belief_{i}")
    return sure.select("pattern", F.col("as").alias("kind"), "confidence")


def extract(docs: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base and spans, arrays of (start, stop, kind) in code points."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "pii")
    found = scratch.put(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, FOUND), "found")
    items = found.select("row", F.inline("items"))
    sure = scratch.put(learn(items, scratch, min_seeds, min_confidence, rounds), "sure")
    n = sure.count()
    if not n:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    best = sure.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", -rank(F.col("kind")))).alias("as"), F.max("confidence").alias("confidence"))
    hits = items.where(~F.col("kind").isin(*BASE)).select("row", "start", "stop", F.explode("patterns").alias("pattern"))
    hits = join_known(hits, best, "pattern", n).withColumnRenamed("as", "kind")
    hits = hits.groupBy("row", "start", "stop").agg(F.max_by("kind", F.struct("confidence", -rank(F.col("kind")))).alias("kind"))
    more = hits.groupBy("row").agg(F.collect_list(F.struct("start", rank(F.col("kind")).alias("rank"), "stop", "kind")).alias("more"))  # the spans of one text
    both = found.drop("items").join(more.hint("merge"), "row", "left")
    ranked = F.transform("base", lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    merged = F.sort_array(F.when(F.col("more").isNull(), ranked).otherwise(F.concat(ranked, "more")))
    return both.select("doc_id", "base", F.transform(merged, lambda s: F.struct(s["start"], s["stop"], s["kind"])).alias("spans"))


def joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts as the contract has them; ``n_found``: spans that contexts add, ``n_secret``: keys among them, ``n_spans``: all."""
    found = extract(read(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    more = [(F.size("spans") - F.size("base")).cast("long").alias("n_found"), F.size(F.expr("filter(spans, s -> s.kind = 'secret')")).cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), *more)
