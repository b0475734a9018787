"""Removal of repeated passages by bucket-pointer refinement of suffixes.

Every byte covered by a string of ``length`` bytes that also starts in a
document with a smaller doc_id goes.

Which suffixes: among the names of depth ``QGRAM`` inside each string of
``length`` bytes the least one (the last of equals) owns the string.  Equal
strings have equal owners, so comparing owners finds every repeated string
while only one suffix in about fifteen is kept.  These names are hashes of 64
bits; two grams of one name cost work, never an answer.

Buckets (``Refined``): inside a batch, suffixes start in buckets by their first
8 bytes, sorted.  A bucket is refined by sorting its suffixes on the bucket
identifiers of the suffixes some bytes on; the refined identifiers are the ones
that the next refinement reads, at 16, 32 ... ``length`` bytes.  Suffixes share a
bucket exactly where their first ``length`` bytes are equal.

Rounds: documents are dealt into batches of about ``batch_bytes``.  A batch
tells each bucket only once, whatever its number of copies inside, so a string
that a third of all documents hold costs one row a batch, never a row a copy.
Between batches a bucket goes by a name of 96 bits.  Tasks sort what the batches
send by these names and answer each batch.

1. owner names: which occur in more than one batch;
2. of those, the names of all text around an owner (the strings it owns, taken
   together): the smallest doc_id of each; and whether an owner has several;
3. where an owner has several, the buckets of its single strings, refined, told
   once for each different surrounding: where a smaller doc_id has them.  What a
   bucket's other suffixes in the batch need is kept, so no bucket is refined twice.

Then each batch marks and cuts its own documents.  A round has a task for each
batch, whatever a setting says, so a task's share stays the
same at any size; messages number at most batches times buckets.

Defined results: null text is empty.  Null doc_id comes after all others.  Rows
with one doc_id are one document to each other: neither removes the other's
bytes.  Texts shorter than ``length`` are kept whole.  A very long text is a
batch of its own; names are made over slabs of it, so only the text and what it
repeats are held.  An empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, mix64, parallelism, read, utf8, whole_groups

LENGTH, QGRAM = 50, 20
BATCH_BYTES = BUCKET_BYTES = 8 << 20
SLAB_BYTES = 1 << 18
#: The other part of a name, of which 32 bits are sent.
OTHER, PART = np.uint64(0xA0761D6478BD642F), np.uint64(0xFFFFFFFF)
NO_ID = (1 << 63) - 1
U = np.uint64


def pair(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The names of buckets refined by the names of buckets further on."""
    return mix64(first * U(0x9E3779B97F4A7C15) + later)


def words_at(data: bytes) -> np.ndarray:
    """The 8 bytes from each position on, as a view that copies nothing."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def names(word: np.ndarray, depth: int) -> np.ndarray:
    """Bucket names of all suffixes at ``depth`` bytes, each refined from names less deep."""
    at, name = 8, mix64(word)
    while at < depth:
        step = min(at, depth - at)  # the name ``step`` bytes on reaches exactly as far as needed
        name, at = pair(name[: len(name) - step], name[step:]), at + step
    return name


def names_at(word: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``names`` of some suffixes only."""
    if depth == 8:
        return mix64(word[starts])
    half = 8
    while half * 2 < depth:
        half *= 2
    return pair(names_at(word, starts, half), names_at(word, starts + (depth - half), half))


def names_of(word: np.ndarray, starts: np.ndarray, depth: int, salt: np.uint64 = U(0)) -> np.ndarray:
    """Names of the first ``depth`` bytes of some suffixes, from the bytes at every eighth offset; another ``salt`` gives another name."""
    name = mix64(word[starts] ^ salt)
    for offset in [*range(8, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        name = pair(name, word[starts + offset])
    return name


def ranked(keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers: the place of each key among the distinct keys in order."""
    order = np.argsort(keys)
    k = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.concatenate([np.zeros(min(1, len(k)), bool), k[1:] != k[:-1]]), dtype=np.uint64)
    return out


def inside(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """The places below ``size`` that lie in some interval, ends included, in order."""
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, first, 1)
    np.add.at(marks, last + 1, -1)
    return np.flatnonzero(np.cumsum(marks[:-1], out=marks[:-1]) > 0)


class Refined:
    """Buckets of the suffixes that start in intervals [first, last], equal in their first ``depth`` bytes; by sorting."""

    def __init__(self, word: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int):
        # Refinement looks ahead: at eight bytes' depth it needs the buckets of suffixes further on, too.
        self.places, at = inside(first, last + depth - 8, len(word)), 8
        self.ids = ranked(word[self.places])
        where = np.zeros(len(word), np.int32)
        while at < depth:
            step = min(at, depth - at)
            where[self.places] = np.arange(len(self.places), dtype=np.int32)
            places = inside(first, last + depth - at - step, len(word))
            own, later = self.ids[where[places]], self.ids[where[places + step]]
            self.places, self.ids, at = places, ranked((own << U(32)) | later), at + step
        self.where = where
        self.where[self.places] = np.arange(len(self.places), dtype=np.int32)

    def of(self, starts: np.ndarray) -> np.ndarray:
        return self.ids[self.where[starts]].astype(np.int64)


def sliding(values: np.ndarray, width: int, least: Callable) -> np.ndarray:
    k = 1
    while k * 2 <= width:
        values = least(values[: len(values) - k], values[k:])
        k *= 2
    return least(values[: len(values) - (width - k)], values[width - k :]) if k < width else values


def owners(data: bytes, offsets: np.ndarray, length: int, qgram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes that own a string, and their names at depth ``qgram``; slab by slab, whatever the documents' lengths."""
    width, found, ends = length - qgram + 1, [], offsets[1:]
    for begin in range(0, len(data) - length + 1, SLAB_BYTES):
        end = min(len(data), begin + SLAB_BYTES + length - 1)
        name = names(words_at(data[begin:end]), qgram)
        # Strings that run over a document's end own nothing.
        ok = np.ones(end - begin - length + 1, bool)
        for e in (ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, end, "left")] - begin).tolist():
            ok[max(0, e - length + 1) : e] = False
        low = np.where(ok, sliding(name, width, np.minimum), U(0))
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), width, np.maximum) == name)
        found.append((at + begin, name[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, name = (np.concatenate(x) for x in zip(*found, strict=True))
    at, once = np.unique(at, return_index=True)  # next to a slab's end both slabs find one
    return at, name[once]


def least_by(keys: np.ndarray, *columns: tuple[Callable, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and of each column its reduction over equal keys."""
    order = np.argsort(keys)
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return (k[at], *(f.reduceat(c[order], at) if len(k) else c for f, c in columns))


def grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of numbers: an order by them, where in it each distinct pair begins, and the place among the distinct ones of each pair."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def least_of(order: np.ndarray, begins: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values[order], begins) if len(order) else values[:0]


def look_up(keys: np.ndarray, sorted_keys: np.ndarray, values: np.ndarray, default) -> np.ndarray:
    if not len(sorted_keys):
        return np.full(len(keys), default, values.dtype)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], default)


# A message: a kind, a bucket, a batch, and arrays of 8-byte numbers one after another, keys first.
MESSAGE = "kind string, bucket long, batch long, blob binary"
MESSAGE_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])


def shares(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted ``keys``, for the buckets that have any."""
    ends = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    at = np.searchsorted(ends, keys, "right")
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(at[i]), i, j


def deal(kind: str, batch: int, buckets: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[str, int, int, bytes]]:
    """Messages of sorted ``keys``, cut where the bucket changes."""
    for b, i, j in shares(keys, buckets):
        yield kind, b, batch, packed(*(c[i:j] for c in (keys, *columns)))


#: Messages and bytes of them that leave Python at a time.
SENT_ROWS, SENT_BYTES = 1024, 2 << 20


def together(messages: Iterator[tuple[str, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Messages many to a batch: they number as the square of the table, and a batch of its own for each would cost more than what it says."""
    held, size = [], 0
    for message in messages:
        held.append(message)
        size += len(message[3])
        if len(held) == SENT_ROWS or size >= SENT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), MESSAGE_SCHEMA, strict=True)], schema=MESSAGE_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), MESSAGE_SCHEMA, strict=True)], schema=MESSAGE_SCHEMA)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, each as its highest bytes, its next ones and so on, compressed: what sorted names and small ids share lies together."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T[::-1].tobytes() for c in columns)
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    """The columns back, the first unsigned."""
    raw = pa.Codec("zstd", 1).decompress(blob[8:], struct.unpack("<q", blob[:8])[0], asbytes=True)
    n = len(raw) // (8 * columns)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p[::-1].T).reshape(-1).view(np.uint64 if i == 0 else np.int64) for i, p in enumerate(planes)]


def answer(kind: str, blobs: list[bytes]) -> list[bytes]:
    """What a bucket answers to each batch: bits for names (n: in several batches, m: several surroundings); of a and s, whose names have two parts, ids, and the places that a smaller document has, too. A batch's own notes (g) go back as they are."""
    if kind == "g":
        return blobs
    parts = [unpack(b, {"n": 1, "m": 3, "a": 3, "s": 4}[kind]) for b in blobs]
    keys = np.concatenate([p[0] for p in parts])
    if kind == "n":
        known, count = least_by(keys, (np.add, np.ones(len(keys), np.int64)))
        return [np.packbits(look_up(p[0], known, count > 1, False)).tobytes() for p in parts]
    if kind == "m":
        low, high = (np.concatenate([p[c] for p in parts]) for c in (1, 2))
        known, low, high = least_by(keys, (np.minimum, low), (np.maximum, high))
        return [np.packbits(look_up(p[0], known, low != high, False)).tobytes() for p in parts]
    order, begins, place = grouped(keys, np.concatenate([p[1] for p in parts]))
    ids = least_of(order, begins, np.concatenate([p[2] for p in parts]))[place]
    cut = np.cumsum([len(p[0]) for p in parts])[:-1]
    if kind == "s":
        return [gaps(np.sort(p[3][x < p[2]])) for p, x in zip(parts, np.split(ids, cut), strict=True)]
    return [packed(x) for x in np.split(ids, cut)]


class Batch:
    """What a batch sends in each round and marks in the end, from its texts and the answers so far."""

    def __init__(self, number: int, docs: np.ndarray, lengths: np.ndarray, data: bytes, buckets: int, length: int, qgram: int, answers: dict[str, dict[int, bytes]], owned: np.ndarray | None = None):
        self.number, self.buckets, self.docs, self.data, self.answers = number, buckets, docs, data, answers
        self.length, self.width = length, length - qgram + 1
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.word = words_at(data)
        self.at, self.name = owners(data, self.offsets, length, qgram) if owned is None else (owned, names_at(self.word, owned, qgram))
        order = np.argsort(self.name)
        k = self.name[order]
        new = np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]])
        self.names = k[new]
        self.group = np.empty(len(k), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.text = np.searchsorted(self.offsets, self.at, "right") - 1
        docs_of = docs[self.text][order] if len(k) else docs[:0]
        starts = np.flatnonzero(new)
        self.shared = np.minimum.reduceat(docs_of, starts) != np.maximum.reduceat(docs_of, starts) if len(k) else np.zeros(0, bool)

    def bits(self, kind: str, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for b, i, j in shares(keys, self.buckets):
            out[i:j] = np.unpackbits(np.frombuffer(self.answers[kind][b], np.uint8), count=j - i).astype(bool)
        return out

    def ids(self, kind: str) -> np.ndarray:
        return np.concatenate([unpack(x, 1)[0].view(np.int64) for _, x in sorted(self.answers.get(kind, {}).items())] or [np.zeros(0, np.int64)])

    def settle_owners(self) -> None:
        """Keeps the owners whose names other documents have, with the strings each owns and all text around it."""
        self.abroad = self.bits("n", self.names)
        chosen = np.flatnonzero((self.abroad | self.shared)[self.group])
        at, name, text = self.at, self.name, self.text
        where, v = at[chosen], name[chosen]
        # A string is owned by its least name, the last of equals: up to a lesser owner before and a lesser or equal one after.
        first, end = np.maximum(where - self.width + 1, self.offsets[text[chosen]]), np.minimum(where, self.offsets[text[chosen] + 1] - self.length)
        for step, bound in ((-1, first), (1, end)):
            k, open_ = chosen + step, np.arange(len(chosen))
            while len(open_):
                inside = (k[open_] >= 0) & (k[open_] < len(at))
                open_ = open_[inside]
                near = at[k[open_]]
                open_ = open_[near > where[open_] - self.width] if step < 0 else open_[near < where[open_] + self.width]
                other = name[k[open_]]
                stop = other < v[open_] if step < 0 else other <= v[open_]
                hit = open_[stop]
                if step < 0:
                    bound[hit] = np.maximum(bound[hit], at[k[hit]] + 1)
                else:
                    bound[hit] = np.minimum(bound[hit], at[k[hit]] - self.width)
                open_ = open_[~stop]
                k[open_] += step
        some = first <= end  # of equal names close together an early one may own nothing
        chosen, where, first, end = chosen[some], where[some], first[some], end[some]
        self.first, self.end, self.doc, self.own_group = first, end, self.docs[text[chosen]], self.group[chosen]
        extent = ((where - first) * 4096 + (end - first)).astype(np.uint64)
        self.around, other = (pair(pair(names_of(self.word, first, self.length, x), names_of(self.word, end, self.length, x)), extent) for x in (U(0), OTHER))
        other &= PART
        # Each surrounding by its name's two parts: its place in order, and the least document here that has it.
        order, begins, self.place = grouped(self.around, other)
        self.least = least_of(order, begins, self.doc)
        self.out = self.abroad[self.own_group]
        known = order[begins]
        self.sent = np.flatnonzero(self.out[known])
        self.parts = self.around[known][self.sent], other[known][self.sent]

    def send(self, round_: int) -> Iterator[tuple[str, int, int, bytes]]:
        if round_ == 1:
            yield from deal("n", self.number, self.buckets, self.names)
            return
        self.settle_owners()
        if round_ == 2:
            around = self.around[self.out]
            signed = around.view(np.int64)
            yield from deal("m", self.number, self.buckets, *least_by(self.names[self.own_group[self.out]], (np.minimum, signed), (np.maximum, signed)))
            yield from deal("a", self.number, self.buckets, *self.parts, self.least[self.sent])
            return
        self.hear()
        yield from deal("s", self.number, self.buckets, *self.told())
        gone = gaps(self.gone)
        yield "g", self.number, self.number, struct.pack("<q", len(gone)) + gone + packed(*self.again)

    def hear(self) -> None:
        """Of each owner: the smallest document with its surrounding, and whether its name has several surroundings."""
        smallest = self.least.copy()
        smallest[self.sent] = np.minimum(smallest[self.sent], self.ids("a"))
        self.smallest = smallest[self.place]
        groups, a, b = least_by(self.own_group, (np.minimum, self.around), (np.maximum, self.around))
        several = np.zeros(len(self.names), bool)
        several[groups] = a != b
        several[self.abroad] |= self.bits("m", self.names[self.abroad])
        self.several = several[self.own_group]

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of single strings, by name: both parts, the smallest document here and a place in it. The document that holds a surrounding first tells for all that hold it."""
        chosen = np.flatnonzero(self.several & (self.smallest == self.doc))
        refined = Refined(self.word, self.first[chosen], self.end[chosen], self.length)
        places, buckets = refined.places, refined.ids.astype(np.int64)
        known, rank = np.unique(self.docs, return_inverse=True)
        doc = rank.reshape(-1)[np.searchsorted(self.offsets, places, "right") - 1]
        order = np.argsort(buckets * len(known) + doc)
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), buckets[order][1:] != buckets[order][:-1]]))
        of, least = places[order[begins]], doc[order[begins]]
        #: Places that go whatever other batches say, and those that go with the place told, which lies in their document.
        self.gone = places[doc > least[buckets]]
        with_it = np.flatnonzero((doc == least[buckets]) & (places != of[buckets]))
        self.again = places[with_it], of[buckets[with_it]]
        one, two = (names_of(self.word, of, self.length, x) for x in (U(0), OTHER))
        two &= PART
        by_name = np.argsort(one)
        return one[by_name], two[by_name], known[least[by_name]], of[by_name]

    def cut(self) -> Iterator[tuple[int, int, int, bytes]]:
        """Of each document: bytes, bytes removed, runs removed, what is kept."""
        self.settle_owners()
        self.hear()
        marks = np.zeros(len(self.data) + 1, np.int32)
        whole = self.smallest < self.doc
        np.add.at(marks, self.first[whole], 1)
        np.add.at(marks, self.end[whole] + self.length, -1)
        # What is not whole was told, by this very document: its buckets have their answers.
        (notes,) = self.answers["g"].values()
        size = 8 + struct.unpack("<q", notes[:8])[0]
        starts, told = (x.view(np.int64) for x in unpack(notes[size:], 2))
        heard = np.concatenate([places(x) for x in self.answers["s"].values()] or [np.zeros(0, np.int64)])
        starts = np.concatenate([places(notes[8:size]), heard, starts[np.isin(told, heard)]])
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + self.length, -1)
        gone = np.cumsum(marks[:-1], out=marks[:-1]) > 0
        for begin, end in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            body, mask = self.data[begin:end], gone[begin:end]
            removed = int(mask.sum())
            spans = int((mask[1:] & ~mask[:-1]).sum()) + int(mask[0]) if removed else 0
            yield len(body), removed, spans, np.frombuffer(body, np.uint8)[~mask].tobytes() if removed else body


BATCHES = "batch long, doc_ids binary, lengths binary, body binary, owned binary"


def gaps(at: np.ndarray) -> bytes:
    """Ascending places as the steps between them, a byte each; 255 for so many and no place. Compressed, they take less than a twentieth of the text."""
    step = np.diff(at, prepend=0)
    out = np.full(int((step // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(step // 255 + 1) - 1] = step % 255
    return struct.pack("<q", len(out)) + pa.Codec("zstd", 1).compress(out.tobytes(), asbytes=True)


def places(blob: bytes) -> np.ndarray:
    """The places back."""
    step = np.frombuffer(pa.Codec("zstd", 1).decompress(blob[8:], struct.unpack("<q", blob[:8])[0], asbytes=True), np.uint8)
    return np.cumsum(step, dtype=np.int64)[step < 255]


def _collect(batch_bytes: int, length: int, qgram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbouring documents as one compressed row of about ``batch_bytes``, with the places of its owners, which every round needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, bodies, size = TaskContext.get().partitionId() << 32, [], [], 0
        codec = pa.Codec("zstd", 1)

        def out() -> pa.RecordBatch:
            body = b"".join(bodies)
            packed = struct.pack("<q", len(body)) + codec.compress(body, asbytes=True)
            lengths = np.array(list(map(len, bodies)), "<i8")
            owned = owners(body, np.concatenate([[0], np.cumsum(lengths)]), length, qgram)[0]
            arrays = [np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes(), lengths.tobytes(), packed, gaps(owned)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in arrays)], ["batch", "doc_ids", "lengths", "body", "owned"])

        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if bodies and size + len(body) > batch_bytes:
                    yield out()
                    number, ids, bodies, size = number + 1, [], [], 0
                ids.append(i)
                bodies.append(body)
                size += len(body)
        if bodies:
            yield out()

    return run


def _batches(rows: Iterator[pa.RecordBatch], buckets: int, length: int, qgram: int) -> Iterator[Batch]:
    """Batches with the answers they got; a batch's own row and its answers lie together."""
    for table, bounds in whole_groups(rows, "batch"):
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            answers: dict[str, dict[int, bytes]] = {"n": {}, "m": {}, "a": {}, "s": {}, "g": {}}
            own = None
            for row in table.slice(a, b - a).to_pylist():
                if row["kind"]:
                    answers[row["kind"]][row["bucket"]] = row["blob"]
                else:
                    own = row
            lengths, packed = np.frombuffer(own["lengths"], "<i8"), own["blob"]
            body = pa.Codec("zstd", 1).decompress(packed[8:], struct.unpack("<q", packed[:8])[0], asbytes=True)
            yield Batch(own["batch"], np.frombuffer(own["doc_ids"], "<i8"), lengths, body, buckets, length, qgram, answers, places(own["owned"]))


def _reduce(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bounds in whole_groups(rows, "place"):
        kinds, buckets, numbers, blobs = (table.column(c).to_pylist() for c in ("kind", "bucket", "batch", "blob"))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            found = answer(kinds[a], blobs[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kinds[a:b], buckets[a:b], numbers[a:b])] + [pa.array(found, pa.binary())], schema=MESSAGE_SCHEMA)


def remove_repeats(docs: DataFrame, length: int = LENGTH, qgram: int = QGRAM, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256; ``keep_text`` adds the kept bytes."""
    if not 8 <= qgram <= length:
        raise ValueError("8 <= qgram <= length")
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    batches = scratch.put(docs.mapInArrow(_collect(batch_bytes, length, qgram), BATCHES), "batches")
    count = batches.count()
    buckets = max(1, -(-count * batch_bytes // bucket_bytes))
    n = max(parallelism(spark), count)  # tasks of a batch or a few, at any size
    own = batches.select(F.lit("").alias("kind"), F.lit(-1).cast("long").alias("bucket"), "batch", F.col("body").alias("blob"), "doc_ids", "lengths", "owned")
    heard: DataFrame = own

    def with_answers() -> DataFrame:
        return heard.repartition(n, "batch").sortWithinPartitions("batch")

    def send(round_: int):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _batches(rows, buckets, length, qgram):
                yield from together(batch.send(round_))

        return run

    for round_ in (1, 2, 3):
        sent = (own if round_ == 1 else with_answers()).mapInArrow(send(round_), MESSAGE)
        placed = sent.withColumn("place", F.concat("kind", F.col("bucket").cast("string")))
        answers = placed.repartition(n, "place").sortWithinPartitions("place").mapInArrow(_reduce, MESSAGE)
        answers = scratch.put(answers, f"answers_{round_}")
        scratch.settle()
        nothing = F.lit(None).cast("binary")
        heard = heard.unionByName(answers.withColumn("doc_ids", nothing).withColumn("lengths", nothing).withColumn("owned", nothing))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(rows, buckets, length, qgram):
            found = list(batch.cut())
            columns = {"doc_id": pa.array([None if i == NO_ID else i for i in batch.docs.tolist()], pa.int64())}
            columns |= {k: pa.array([f[i] for f in found], pa.int64()) for i, k in enumerate(("n_bytes", "n_removed", "n_spans"))}
            columns["kept_sha256"] = pa.array([hashlib.sha256(f[3]).hexdigest() for f in found], pa.string())
            if keep_text:
                columns["kept"] = pa.array([f[3] for f in found], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return with_answers().mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS s, h FROM h WHERE length(h) >= 100),
v AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS x FROM w),
m AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) AS first FROM v) WHERE first < doc_id),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (
  SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS new FROM m)),
r AS (SELECT doc_id, run, min(s) AS a, max(s) + 50 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS begins, a AS ends, b FROM r),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM r GROUP BY doc_id),
o AS (SELECT k.doc_id, string_agg(substr(h, CAST(2 * begins + 1 AS BIGINT), CAST(2 * (ends - begins) AS BIGINT)), '' ORDER BY begins) AS x FROM k JOIN h USING (doc_id) GROUP BY k.doc_id)
SELECT h.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE o.x || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id) LEFT JOIN o USING (doc_id)
"""
