"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of ``chunk`` bytes.  The polynomial hash of each
chunk is one row of a matrix product, so the chunks of a huge text hash side by
side; neighbouring hashes combine as ``h(ab) = h(a) * base**len(b) + h(b)``
(two 31-bit prime moduli, 62 bits in all).  Equal fingerprints of equal length
are candidates only: every candidate is compared with the row that stays, chunk
by chunk, as a join on (fingerprint, chunk number), so no task ever holds a
group.  Groups in which a chunk differs are regrouped by their whole texts.

Defined results: null text counts as empty, and empty texts are equal to one
another.  A null ``doc_id`` loses to any other id; a group of null ids keeps
null.  Rows that repeat both ``doc_id`` and text are the same document: they
count in ``group_size``, all carry the same decision, and ``deduplicate``
leaves one of them.  Extra columns pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, boxed, join_sized, read, utf8

#: Two primes under 2**31 and a base for each; sums of 2**20 products of a byte and a residue fit in 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 69069069)
CHUNK = 4096
COMPARE_BYTES = 1 << 16


def powers(length: int, base: int, prime: int) -> np.ndarray:
    out = np.empty(length, np.int64)
    x = 1
    for i in range(length - 1, -1, -1):
        out[i] = x
        x = x * base % prime
    return out


class Polynomial:
    """Fingerprints of byte strings for given moduli; small moduli serve to test collisions."""

    def __init__(self, primes: tuple[int, int] = PRIMES, chunk: int = CHUNK):
        self.primes, self.chunk = primes, chunk
        self.tables = [powers(chunk, b, p) for b, p in zip(BASES, primes, strict=True)]
        self.shift = [pow(b, chunk, p) for b, p in zip(BASES, primes, strict=True)]

    def chunk_hashes(self, data: bytes) -> list[tuple[np.ndarray, int, int]]:
        """For each modulus: the hashes of the whole chunks, that of the rest, and the rest's length."""
        a = np.frombuffer(data, np.uint8)
        whole = len(a) // self.chunk
        body, rest = a[: whole * self.chunk].reshape(whole, self.chunk), a[whole * self.chunk :].astype(np.int64)
        out = []
        for table, p in zip(self.tables, self.primes, strict=True):
            hashes = np.array([int(row.astype(np.int64) @ table) % p for row in body], np.int64)
            out.append((hashes, int(rest @ table[self.chunk - len(rest) :]) % p, len(rest)))
        return out

    def combine(self, hashes: np.ndarray, rest: int, rest_length: int, which: int) -> int:
        p, acc = self.primes[which], 0
        for h in hashes.tolist():
            acc = (acc * self.shift[which] + h) % p
        return (acc * pow(BASES[which], rest_length, p) + rest) % p

    def fingerprint(self, data: bytes) -> int:
        a, b = (self.combine(*x, i) for i, x in enumerate(self.chunk_hashes(data)))
        return a << 31 | b


def _print_rows(poly: Polynomial, keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = utf8(batch.column(1))
            columns = {
                "doc_id": batch.column(0),
                "fp": pa.array([poly.fingerprint(x) for x in data], pa.int64()),
                "n_bytes": pa.array([len(x) for x in data], pa.int64()),
            }
            columns["body" if keep_text else "text_sha256"] = pa.array(data, pa.binary()) if keep_text else pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _chunk_rows(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams a text as rows of (group, chunk number, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = range(0, len(body), size)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    yield pa.RecordBatch.from_pydict({
                        "fp": pa.array([fp] * len(some), pa.int64()), "n_bytes": pa.array([n] * len(some), pa.int64()),
                        "part": pa.array([s // size for s in some], pa.int64()), "piece": pa.array([body[s : s + size] for s in some], pa.binary()),
                    })

    return run


def decisions(docs: DataFrame, poly: Polynomial | None = None, compare_bytes: int = COMPARE_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    spark, poly = docs.sparkSession, poly or Polynomial()
    bound_batches(spark)
    scratch, docs = Scratch(spark, "exact"), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = scratch.put(docs.mapInArrow(_print_rows(poly, False), "doc_id long, fp long, n_bytes long, text_sha256 string"), "prints")
    groups = scratch.put(prints.groupBy("fp", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    # Only texts that share a fingerprint with another row are moved again, and only once.
    suspects = groups.where("group_size > 1 and n_bytes > 0")
    bodies = docs.mapInArrow(_print_rows(poly, True), "doc_id long, fp long, n_bytes long, body binary")
    members = scratch.put(join_sized(bodies, suspects, ["fp", "n_bytes"], "group_size"), "members")
    chunks = "fp long, n_bytes long, part long, piece binary"
    theirs = members.select("fp", "n_bytes", "body").mapInArrow(_chunk_rows(compare_bytes), chunks)
    stays = members.where("doc_id <=> keep_id").groupBy("fp", "n_bytes").agg(F.min("body").alias("body"))
    stays = stays.mapInArrow(_chunk_rows(compare_bytes), chunks).withColumnRenamed("piece", "kept_piece")
    stays = scratch.put(join_sized(stays, suspects.select("fp", "n_bytes", "group_size"), ["fp", "n_bytes"], "group_size"), "stays")
    differ = scratch.put(join_sized(theirs, stays, ["fp", "n_bytes", "part"], "group_size").where("piece <> kept_piece").groupBy("fp", "n_bytes").agg(F.count("*").alias("n_differ")), "differ")
    out = join_sized(prints, groups, ["fp", "n_bytes"], "group_size")
    if differ.limit(1).count():  # a collision: these groups are told apart by their whole texts
        own = members.drop("keep_id", "group_size").join(differ.select("fp", "n_bytes"), ["fp", "n_bytes"])
        own = own.withColumn("text_sha256", F.sha2("body", 256))
        right = scratch.put(own.groupBy("fp", "n_bytes", "body", "text_sha256").agg(F.max("doc_id").alias("right_id"), F.count("*").alias("right_size")).drop("body"), "right")
        out = out.join(right.hint("merge"), ["fp", "n_bytes", "text_sha256"], "left")
        out = out.withColumn("keep_id", F.when(F.col("right_size").isNull(), F.col("keep_id")).otherwise(F.col("right_id")))
        out = out.withColumn("group_size", F.coalesce("right_size", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, poly: Polynomial | None = None) -> DataFrame:
    """``docs`` without the rows that fall to a larger doc_id of equal text; columns unchanged."""
    kept = decisions(docs, poly).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    full = boxed(docs).withColumn("sha", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256)).withColumn("id", F.col("row.doc_id").cast("long"))
    full = full.join(kept.hint("merge"), (full["sha"] == kept["_sha"]) & full["id"].eqNullSafe(kept["_id"]), "left_semi")
    return full.dropDuplicates(["id", "sha"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(read(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
