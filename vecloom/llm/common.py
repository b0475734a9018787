"""What the training-data operators share: scratch tables, Arrow helpers, table reads.

Scratch tables and checkpoints go to the folder that the session names in
``spark.checkpoint.dir``: every executor and the driver see it, so a lost
executor costs a re-read and never a wrong answer.  Only where that setting is
missing (tests on one machine) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import contextlib
import copy
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vecloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Folders of scratch tables; results read them lazily, so they go when the driver ends.
_MADE: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear() -> None:
    for spark, base in _MADE:
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, base)


def made() -> int:
    """How many folders of scratch tables there are so far."""
    return len(_MADE)


def release(since: int) -> None:
    """Deletes the scratch tables made after the first ``since``, once what was computed from them is written."""
    for spark, base in _MADE[since:]:
        _delete(spark, base)
    del _MADE[since:]


#: Files in local folders without files of checksums beside them: an executor starts a process for each mode that it sets, some a file, and each may count its memory again.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Scratch:
    """Tables written to the shared folder; ``drop`` removes the ones no later step reads. ``plain``: for many small tables."""

    def __init__(self, spark: SparkSession, tag: str, compression: str = "zstd", plain: bool = False):
        if not _MADE:
            atexit.register(_clear)
        self.spark, self.base, self.compression, self.options = spark, f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}", compression, PLAIN if plain else {}
        _MADE.append((spark, self.base))

    def within(self, name: str) -> Scratch:
        """The same folder's subfolder ``name``."""
        out = copy.copy(self)
        out.base = f"{self.base}/{name}"
        return out

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table of its own; the shuffle files that made it go at once, for nothing reads them again."""
        path, conf = f"{self.base}/{name}", self.spark.conf
        before = conf.get(SHUFFLE_CLEANUP, "false")
        conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.select("*").write.options(**self.options).option("compression", self.compression).parquet(path)
        finally:
            conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Lets Spark delete the shuffle files of finished steps, which it does when the driver's garbage goes."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.base}/{name}")


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def boxed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name of theirs meets one used on the way; ``select("row.*")`` gives them back."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"))


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions as the session plans them; grows with the cluster, not with a constant here."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def bound_batches(spark: SparkSession, size: str = "16m") -> None:
    """Arrow batches by bytes, not rows: a text may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``key``: tables that hold whole groups only, with the groups' bounds.

    A group that the end of a batch cuts is carried into the next table.
    """
    held: list[pa.RecordBatch] = []
    last = None

    def out(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        values = table.column(key).combine_chunks()
        if isinstance(values, pa.ChunkedArray):
            values = pa.concat_arrays(values.chunks)
        k = values.to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        return table, np.concatenate([[0], cut, [len(k)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if last is not None and k[0] == last and k[-1] == last:
            held.append(batch)
            continue
        at = int(np.searchsorted(k, k[-1], "left"))
        if at or held and k[0] != last:
            parts = held + ([batch.slice(0, at)] if at else [])
            yield out(pa.Table.from_batches(parts))
            held = []
        held.append(batch.slice(at))
        last = k[-1]
    if held:
        yield out(pa.Table.from_batches(held))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit_hash(column: str, seed: int = 0):
    """A reproducible number in [0, 1) from a column."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 40)) / float(1 << 40)).cast("double")


#: What may be broadcast: rows of a few numbers and a short key, some tens of MB, or rows of a known size.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def join_known(rows: DataFrame, known: DataFrame, key: str, n_known: int, how: str = "inner", n_bytes: int = 0) -> DataFrame:
    """``rows`` joined with one row a key: by broadcast up to BROADCAST_ROWS keys and BROADCAST_BYTES, beyond it salted.

    ``n_bytes``: the size of ``known`` where its rows hold more than a few
    numbers.  A key may hold a third of ``rows``; neither way brings its rows to
    one task.
    """
    if n_known <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(known), key, how)
    salts = parallelism(rows.sparkSession)
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))
    return spread.join(salted.hint("merge"), [key, "_salt"], how).drop("_salt")


#: Rows of one key that may meet in one task.
HOT_ROWS = 65_536


def join_sized(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row a key, whose column ``size`` tells about how many of ``rows`` have it.

    A key of more than HOT_ROWS rows is dealt to as many tasks as it needs, and
    its row in ``groups`` goes to each.  The keys that are so large are few, at
    most a row in HOT_ROWS, and are broadcast up to a checked count; beyond it
    every key is dealt to as many tasks as the largest needs.
    """
    ways = F.greatest(F.ceil(F.col(size) / HOT_ROWS), F.lit(1)).cast("int")
    hot = groups.where(F.col(size) > HOT_ROWS).select(*keys, ways.alias("_ways"))
    n_hot, most = hot.agg(F.count("*"), F.max("_ways")).first()
    if not n_hot:
        return rows.join(groups.hint("merge"), keys, how)
    if n_hot > BROADCAST_ROWS:
        salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        spread = rows.withColumn("_salt", (F.monotonically_increasing_id() % most).cast("int"))
        return spread.join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1)))
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", (F.monotonically_increasing_id() % F.coalesce("_ways", F.lit(1))).cast("int")).drop("_ways")
    return spread.join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt")
