"""Scalar codes whose direction is adjusted to the vector, and the factors that go with them.

A segment of a residual is coded on a grid of ``2**bits`` levels over
[-max, max].  Adjustment then moves single codes up or down while that brings
the coded vector's direction nearer to the vector's.  Rows are independent, so
numpy works on all rows of a batch at once, dimension by dimension.

Decided results: bits 0 stores the norm only; a zero residual has code 0 and
factors 0; the coded value of code c is ``(c + 0.5) * 2 / 2**bits - 1`` times
the largest component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bits import Segment
from ..plans.config import MAX_BITS, CodeConfig
from ..plans.model import Model
from .clustering import centroid_table
from .tiles import SMALL_BYTES, compact, matrix

#: Fixed value: the spread of the error bound.
ERROR_WIDTH = 1.9
FACTORS = ("norm", "rescale", "error", "cosine")


def grid(o: np.ndarray, bits: int) -> np.ndarray:
    """Codes of the levels below each component."""
    top = np.abs(o).max(axis=1, keepdims=True, initial=0.0)
    step = 2 * top / 2**bits
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.floor((o + top) / step)
    return np.where(step > 0, np.minimum(c, 2**bits - 1), 0).astype(np.int64)


def levels(code: np.ndarray, bits: int) -> np.ndarray:
    """The values of codes on [-1, 1]."""
    return (code + 0.5) * (2 / 2**bits) - 1


def adjust(o: np.ndarray, code: np.ndarray, bits: int, rounds: int | None, epsilon: float) -> np.ndarray:
    """Codes moved, one step of one dimension at a time, while the squared cosine grows."""
    code, step, top = code.copy(), 2 / 2**bits, 2**bits - 1
    live = np.flatnonzero(np.abs(o).max(axis=1, initial=0.0) > 0)
    slack = epsilon * (levels(code, bits) ** 2).sum(axis=1)
    done = 0
    while len(live) and (rounds is None or done < rounds):
        a = levels(code[live], bits)
        ip, n2, x, eps = (o[live] * a).sum(axis=1), (a * a).sum(axis=1), o[live], slack[live]
        changed = np.zeros(len(live), bool)
        for i in range(o.shape[1]):
            for way in (1, -1):
                open_ = np.arange(len(live))
                while len(open_):
                    c = code[live[open_], i]
                    ok = c < top if way > 0 else c > 0
                    d = way * step
                    ip_new = ip[open_] + d * x[open_, i]
                    n2_new = n2[open_] + d * (2 * levels(c, bits) + d)
                    ok &= (ip[open_] ** 2 + eps[open_]) * n2_new < ip_new**2 * n2[open_]
                    open_, ip_new, n2_new = open_[ok], ip_new[ok], n2_new[ok]
                    code[live[open_], i] += way
                    ip[open_], n2[open_], changed[open_] = ip_new, n2_new, True
        live, done = live[changed], done + 1
    return code


def encode_part(o: np.ndarray, bits: int, config: CodeConfig) -> tuple[np.ndarray, np.ndarray]:
    """(codes, factors by FACTORS) of one segment of residuals, already rotated."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits from 0 to {MAX_BITS}")
    norm2 = (o * o).sum(axis=1)
    factors = np.zeros((len(o), 4))
    factors[:, 0] = np.sqrt(norm2)
    if bits == 0:
        return np.zeros(o.shape, np.int64), factors
    first = max(bits, config.source_bits)
    code = grid(o, first)
    if config.adjust and config.max_rounds != 0:
        code = adjust(o, code, first, config.max_rounds, config.epsilon)
    code >>= first - bits
    a = levels(code, bits)
    ip, n2 = (o * a).sum(axis=1), (a * a).sum(axis=1)
    ok = (ip != 0) & (norm2 > 0)
    i, n, m = ip[ok], norm2[ok], n2[ok]
    factors[ok, 1] = n / i
    factors[ok, 2] = n * ERROR_WIDTH * np.sqrt(np.maximum(n * m / i**2 - 1, 0) / max(1, o.shape[1] - 1))
    factors[ok, 3] = i / np.sqrt(n * m)
    return code, factors


# ---- bit packing ----------------------------------------------------------


def pack_codes(code: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """(top bits, the rest) of one vector's codes, most significant first."""
    if bits == 0:
        return b"", b""
    planes = (code[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(planes[:, 0].astype(np.uint8)).tobytes(), np.packbits(planes[:, 1:].astype(np.uint8).ravel()).tobytes()


def unpack_codes(top: bytes, rest: bytes, bits: int, length: int) -> np.ndarray:
    if bits == 0:
        return np.zeros(length, np.int64)
    planes = np.zeros((length, bits), np.int64)
    planes[:, 0] = np.unpackbits(np.frombuffer(top, np.uint8), count=length)
    if bits > 1:
        planes[:, 1:] = np.unpackbits(np.frombuffer(rest, np.uint8), count=length * (bits - 1)).reshape(length, bits - 1)
    return (planes << np.arange(bits - 1, -1, -1)).sum(axis=1)


class Layout:
    """Where the bits of a vector's code lie: the top bits of each segment, then the other bits of each, every part from a whole byte on."""

    def __init__(self, segments: list[Segment]):
        at, self.tops, self.rests = 0, [], []
        for out, width in ((self.tops, lambda s: s.length * min(s.bits, 1)), (self.rests, lambda s: s.length * max(s.bits - 1, 0))):
            for s in segments:
                out.append(slice(at, at + -(-width(s) // 8)))
                at = out[-1].stop
        self.segments, self.size = segments, at

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Rows of bytes from rows of codes of all padded dimensions."""
        out = np.zeros((len(codes), self.size), np.uint8)
        for s, top, rest in zip(self.segments, self.tops, self.rests, strict=True):
            code = codes[:, s.offset : s.offset + s.length]
            if s.bits:
                out[:, top] = np.packbits((code >> (s.bits - 1)).astype(np.uint8) & 1, axis=1)
            if s.bits > 1:
                planes = (code[:, :, None] >> np.arange(s.bits - 2, -1, -1)) & 1
                out[:, rest] = np.packbits(planes.astype(np.uint8).reshape(len(code), -1), axis=1)
        return out

    def top(self, packed: np.ndarray, i: int) -> np.ndarray:
        """The top bits of segment ``i``, 0 or 1."""
        return np.unpackbits(packed[:, self.tops[i]], axis=1, count=self.segments[i].length)

    def rest(self, packed: np.ndarray, i: int) -> np.ndarray:
        """The codes of segment ``i`` without their top bits."""
        s = self.segments[i]
        planes = np.unpackbits(packed[:, self.rests[i]], axis=1, count=s.length * (s.bits - 1)).reshape(len(packed), s.length, s.bits - 1)
        out = np.zeros(planes.shape[:2], np.uint16)
        for b in range(s.bits - 1):
            out = (out << 1) | planes[:, :, b]
        return out

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        out = np.zeros((len(packed), sum(s.length for s in self.segments)), np.int64)
        for i, s in enumerate(self.segments):
            if s.bits:
                out[:, s.offset : s.offset + s.length] = self.top(packed, i).astype(np.int64) << (s.bits - 1)
            if s.bits > 1:
                out[:, s.offset : s.offset + s.length] |= self.rest(packed, i)
        return out


# ---- encoding tables ------------------------------------------------------

CODES = "cluster_id int, vec_id long, code binary, factors array<double>"


def encode_matrix(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all padded dimensions, factors of all segments) of residuals."""
    parts = model.parts(model.pad(x))
    found = [encode_part(o, s.bits, model.config.code) for o, s in zip(parts, model.segments, strict=True)]
    return np.hstack([c for c, _ in found]), np.hstack([f for _, f in found])


def encode(vectors: DataFrame, assigned: DataFrame | None, centroids: DataFrame | None, model: Model, id_name: str = "vec_id", vector_name: str = "embedding") -> DataFrame:
    """CODES of ``vectors``: residuals to their centroids, or vectors as they are where ``assigned`` is None.

    A code has the bits that its segments give it and no more (``Layout``); four factors a segment.
    Encoding needs no shuffle: ``assigned`` is joined by id, centroids ship with
    the model while they are small and are joined beyond that.
    """
    v = vectors.select(F.col(id_name).cast("long").alias("vec_id"), compact(vectors, vector_name).alias("v")).where("v is not null")
    table, layout = None, Layout(model.segments)
    if assigned is None:
        v = v.select(F.lit(0).alias("cluster_id"), "vec_id", "v")
    else:
        v = v.join(assigned.select("vec_id", F.col("cluster_id").cast("int").alias("cluster_id")), "vec_id").select("cluster_id", "vec_id", "v")
        if centroids.count() * model.dims * 8 <= SMALL_BYTES:
            table = centroid_table(centroids)
        else:
            minus = F.zip_with("v", F.col("centroid").cast("array<double>"), lambda a, b: a - b)
            v = v.join(centroids, "cluster_id").select("cluster_id", "vec_id", minus.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2))
            if not len(x):
                continue
            if table is not None:
                ids, rows = table
                x = x - rows[np.searchsorted(ids, batch.column(0).to_numpy())]
            codes, factors = encode_matrix(x, model)
            blobs = [c.tobytes() for c in layout.pack(codes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), pa.array(list(factors), pa.list_(pa.float64()))], ["cluster_id", "vec_id", "code", "factors"])

    return v.mapInArrow(run, CODES)


def code_tables(codes: DataFrame, model: Model) -> DataFrame:
    """(cluster_id, vec_id, segment, bits, top, rest): codes as packed bits, a row for each segment."""
    layout = Layout(model.segments)
    segments = [(i, s.bits, top, rest) for i, (s, top, rest) in enumerate(zip(model.segments, layout.tops, layout.rests, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cluster, vec, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(cluster, vec, i, bits, blob[top], blob[rest]) for i, bits, top, rest in segments]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], ["cluster_id", "vec_id", "segment", "bits", "top", "rest"])

    return codes.select("cluster_id", "vec_id", "code").mapInArrow(run, "cluster_id int, vec_id long, segment int, bits int, top binary, rest binary")
