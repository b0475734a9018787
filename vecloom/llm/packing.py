"""Packing documents into sequences: first-fit decreasing over a tournament tree.

A document is its token ids and a closing id.  Whole sequences are cut off its
front; what remains, shorter than a sequence, is packed with the remains of
other documents of a randomised group: longest first, each into the first
sequence with room.  A tournament tree over the free room (each node holds the
larger of its two children) finds that sequence in logarithmic time.  Groups
come from a hash and hold about ``group_size`` documents whatever the input, so
they run in parallel and none grows with the data.

Ids come from the tokenizer itself.  For Latin text the tokenizer's own
pre-tokenisation is repeated here, on the bytes of many texts at once, and each
distinct word is encoded once and remembered by the worker for its later tasks;
any text outside that range, itself or in lower case, not in normal form or with
a special token's string goes through the tokenizer whole, and so do all texts
of a batch whose words turn out not to be the tokenizer's.

Defined results: null text is an empty text, whose only id is the closing id.
Repeated rows are packed each on their own, ties in length in the order of rows.
An empty table gives no pieces.  A very long text is encoded whole by one task,
in memory of a small multiple of its size, and cut into sequences.  Only doc_id
and text are read, so other columns may have any names.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, read, texts

LENGTH, CLOSING, GROUP = 4096, 2, 1024
#: Words remembered by a worker, about 100 bytes each.
REMEMBERED = 300_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Places(dict):
    """The place of each word in the order seen; ``new`` holds those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = at = len(self)
        return at


class WordIds:
    """Token ids of texts, equal to ``tokenizer.encode(text, add_special_tokens=False).ids``."""

    LIMIT = 0x370

    def __init__(self, path: str):
        # A task is one thread; threads of the tokenizer's own would each hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        kinds = {"L": [], "N": []}
        for c in range(self.LIMIT):
            if (k := unicodedata.category(chr(c))[0]) in kinds:
                kinds[k].append(c)
        letters, numbers = ("".join(f"\\u{c:04x}" for c in kinds[k]) for k in "LN")
        space = "\\t-\\r \\x85\\xa0"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        # Kinds of characters: 0 white space, 1 letters, 2 numbers, 3 others.
        self.kinds = np.full(self.LIMIT, 3, np.uint8)
        for kind, within in enumerate((f"[{space}]", f"[{letters}]", f"[{numbers}]")):
            self.kinds[[c for c in range(self.LIMIT) if re.match(within, chr(c))]] = kind
        self.beyond = re.compile(f"[\\u{self.LIMIT:04x}-\U0010ffff]").search
        self.forget()

    def forget(self) -> None:
        self.at = Places()
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[str]) -> bool:
        """Encodes words in lines of many; each is one word again when split, and its last id, and no other, is one that ends a word. False where that does not hold."""
        some = [words[i : i + 1024] for i in range(0, len(words), 1024)]
        lines = [" ".join(x) for x in some]
        if any(self.words(line) != x for line, x in zip(lines, some, strict=True)):
            return False
        ids = np.concatenate([np.array(x.ids, np.uint32) for i in range(0, len(lines), 8) for x in self.tokenizer.encode_batch_fast(lines[i : i + 8], add_special_tokens=False)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        lengths = np.diff(ends, prepend=0)
        if len(lengths) != len(words) or ends[-1] != len(ids):
            return False
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])
        return True

    def lowered(self, text: str) -> str | None:
        """The text as the tokenizer lower-cases it, where this class can split it: a small letter may lie outside the range or normal form that its capital is in."""
        low = text.lower()
        plain = text.isascii() or not self.beyond(text) and not self.beyond(low) and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
        return low if plain and not any(x in text for x in self.special) else None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of lower-cased texts, one after another, as ``words`` finds them in each, and how many there are up to the end of each text."""
        parts = [x.encode() for x in texts]
        data = np.frombuffer(b"\n".join([*parts, b"\n\n"]), np.uint8)  # white space beyond the end, for the looks ahead
        kind = self.kinds[data]
        wide = np.flatnonzero(data >= 0xC0)  # within LIMIT, the first of two bytes
        kind[wide] = kind[wide + 1] = self.kinds[(data[wide] & 31).astype(np.int64) << 6 | data[wide + 1] & 63]
        first = kind == 2
        first[wide + 1] = False
        first[0] = True
        first[1:] |= kind[1:] != kind[:-1]
        # A quotation mark that a word would begin with takes 's 't 'm 'd 're 've 'll along and leaves the rest of the letters.
        quote = np.flatnonzero(data == ord("'"))
        quote = quote[first[quote]]
        a, b = data[quote + 1], data[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        first[quote[one | two] + 1] = False
        first[quote[one] + 2] = True
        first[quote[two] + 3] = True
        inside = kind != 0
        at = np.flatnonzero(first & inside)
        starts, held = np.flatnonzero(first[inside]), data[inside]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(held))), pa.py_buffer(held))
        return words, np.searchsorted(at, np.cumsum([len(x) + 1 for x in parts], dtype=np.int64))

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        if len(self.at) > REMEMBERED:
            self.forget()
        low = [self.lowered(x) for x in batch]
        words, bounds = self.split([x for x in low if x is not None])
        words = words.dictionary_encode()
        place = list(map(self.at.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        if self.at.new:
            known = self.learn(self.at.new)
            self.at.new = []
            if not known:  # the split is not the tokenizer's: it encodes the texts itself
                self.forget()
                return [self.whole(x) for x in batch]
        k = np.array(place, np.int64)[words.indices.to_numpy()]
        lengths = self.lengths[k]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[k] - ends + lengths, lengths) + np.arange(lengths.sum())]
        split = iter(np.split(ids, np.append(0, ends)[bounds]))
        return [self.whole(text) if x is None else next(split) for text, x in zip(batch, low, strict=True)]


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker: words that one task met need not be encoded again by the next."""
    return WordIds(path)


def slices(batch: list[str], size: int = 1 << 21) -> Iterator[list[str]]:
    """Neighbouring texts of about ``size`` characters in all: words in hand are many times the text, and a word is looked up once in all of them."""
    some, held = [], 0
    for text in batch:
        some.append(text)
        held += len(text)
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


class Room:
    """A tournament tree over the free room of sequences; ``first`` finds the leftmost with enough."""

    def __init__(self, sequences: int, length: int):
        self.leaves = 1 << max(0, (sequences - 1).bit_length())
        self.tree = [length] * (2 * self.leaves)

    def first(self, need: int) -> int:
        i, tree = 1, self.tree
        while i < self.leaves:
            i *= 2
            if tree[i] < need:
                i += 1
        return i - self.leaves

    def take(self, at: int, need: int) -> int:
        i, tree = at + self.leaves, self.tree
        tree[i] = left = tree[i] - need
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return left


def first_fit_decreasing(sizes: list[int], length: int) -> tuple[list[int], list[int]]:
    """The sequence and the offset of each size, in the order given."""
    room, seq, offset = Room(len(sizes), length), [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        seq[i] = room.first(sizes[i])
        offset[i] = length - room.take(seq[i], sizes[i]) - sizes[i]
    return seq, offset


PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, length: int, closing: int, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = word_ids(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens") + (("ids",) if keep_ids else ())}
            for doc, ids in zip(batch.column(0).to_pylist(), (ids for some in slices(texts(batch.column(1))) for ids in words.encode(some)), strict=True):
                ids = np.append(ids, np.uint32(closing)).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    for k, v in zip(rows, (doc, row, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece), strict=False):
                        rows[k].append(v)
                row += 1
            kinds = {k: pa.list_(pa.int32()) if k == "ids" else pa.int64() for k in rows}
            yield pa.RecordBatch.from_pydict({k: pa.array([x.astype(np.int32) for x in v] if k == "ids" else v, kinds[k]) for k, v in rows.items()})

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, closing: int = CLOSING, group_size: int = GROUP, keep_ids: bool = False, seed: int = 23) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``keep_ids`` adds the ids of each piece.
    """
    spark = docs.sparkSession
    bound_batches(spark, "2m")
    scratch, schema = Scratch(spark, "packing"), PIECES + (", ids array<int>" if keep_ids else "")
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(path or tokenizer_path(), length, closing, keep_ids), schema)
    pieces = scratch.put(pieces, "pieces")
    groups = max(1, -(-pieces.where("length < %d" % length).count() // group_size))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "start"], kind="stable").reset_index(drop=True)
        partial = (frame["length"] < length).to_numpy()
        seq, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        s, o = first_fit_decreasing(frame["length"][partial].tolist(), length)
        seq[partial], offset[partial] = s, o
        seq[~partial] = np.arange((~partial).sum()) + max(s, default=-1) + 1
        return frame.assign(sequence_id=seq + (frame["group"].to_numpy() << 32), offset=offset)[[c for c in out_columns]]

    # Sizes and places only go through the groups; ids follow by a join on the piece.
    out_columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["row"] if keep_ids else [])
    out_schema = ", ".join(f"{c} long" for c in out_columns)
    placed = pieces.drop("ids").groupBy("group").applyInPandas(place, out_schema)
    return placed.join(pieces.select("row", "start", "ids"), ["row", "start"]).drop("row") if keep_ids else placed


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"))
