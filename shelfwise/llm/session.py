"""Shared folders, scratch tables and the shipping of this package to executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, deleted when the driver's JVM ends. Where that setting is
    missing, a session on one machine (tests) gets a temporary folder; on a cluster this raises, as executors would not
    share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_shelfwise_dir", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="shelfwise-")
            spark.sparkContext._shelfwise_dir = folder
    mine = f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"
    made = spark.sparkContext.__dict__.setdefault("_shelfwise_made", set())
    if mine not in made:
        p = spark._jvm.org.apache.hadoop.fs.Path(mine)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(p)
        files.deleteOnExit(p)
        made.add(mine)
    return mine


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps of a job of many steps: it acts when the driver's
    JVM finds them unused, and a driver with little to do collects its garbage too rarely for that."""
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors when their PYTHONPATH does not hold it."""
    places = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if str(ROOT) in places or os.path.abspath(os.getcwd()) == str(ROOT):
        return
    sc = spark.sparkContext
    if getattr(sc, "_shelfwise_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="shelfwise-pkg-"), "shelfwise_pkg")
    sc.addPyFile(shutil.make_archive(base, "zip", ROOT, "shelfwise"))
    sc._shelfwise_shipped = True
    if str(ROOT) not in sys.path:
        sys.path.insert(0, str(ROOT))


#: What operators keep in a worker between tasks (models and the units they met), by operator.
_kept: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    return _kept.setdefault(operator, {})


def release_others(operator: str | None) -> None:
    """Drop what other operators keep in this worker. Spark uses a worker again for tasks of any operator, so caches of one
    would stay beside all that later ones hold."""
    if others := [o for o in _kept if o != operator and _kept[o]]:
        for o in others:
            _kept[o].clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not with every C library
            ctypes.CDLL(None).malloc_trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Membership:
    """A bitmap over 64-bit keys (one hash function), used only to shrink what is shuffled: false positives cost traffic,
    never correctness, as an exact join follows every use."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = spread(keys) & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def spread(keys: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over 64-bit keys."""
    z = keys.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


#: A bitmap has eight bits a key, and MOST_BITS (32 MiB) at most.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 28


def membership(df: DataFrame, column: str):
    """Broadcast bitmap of the values of a long column of a written table, sized by its rows, or None where that takes
    more than ``MOST_BITS``: the caller then leaves the exact join to do all of the work."""
    rows = df.count()
    bits = max(LEAST_BITS, 1 << (max(rows, 1) * BITS_A_KEY - 1).bit_length())
    if bits > MOST_BITS:
        return None

    def slots(batches):
        import pyarrow as pa

        words = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            key = batch.column(0)
            if key.null_count:
                key = key.drop_null()
            slot = spread(np.asarray(key).view(np.uint64) if len(key) else np.empty(0, np.uint64)) & np.uint64(bits - 1)
            np.bitwise_or.at(words, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(words)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["word", "mask"])

    found = df.select(F.col(column).cast("long").alias("k")).mapInArrow(slots, "word long, mask long")
    rows = found.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    if rows.num_rows:
        words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(words)


def member(broadcast) -> Membership | None:
    return None if broadcast is None else Membership(broadcast.value)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
