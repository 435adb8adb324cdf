"""Helpers shared by the training-data operators: shared storage, Arrow mapping, fixed-size key filters."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
#: The separators of every word pattern used here: space and the six ASCII controls 0x09 to 0x0D.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewatch-"))
    return str(spark.sparkContext.getCheckpointDir()).rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the session may have ended before; the folder then is its owner's to clear
        pass


def shared_store(path: str):
    """The file system and inner path of a shared folder, as executors see it: a mounted folder, or a store pyarrow reads."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["stashed_at"] = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files that ``stash`` wrote for ``df``, once nothing reads them any more."""
    _remove(df.sparkSession, df.__dict__["stashed_at"])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``fn`` over all batches of ``df``, whatever its columns are called (``mapInArrow`` takes a dot in a name for a path)."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch.rename_columns(names))

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice's strings hold about ``most`` bytes; one longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
                give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on from stage to stage, and what one held would add up."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def crc_mod(doc_id, mod: int):
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def crc_mod_py(ids, mod: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % mod for x in ids], dtype=np.int64)


def worker_files(spark: SparkSession, package: str) -> None:
    """Send the package to executors that can't import it from their own path."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(":") or os.getcwd() == root or getattr(spark, "_tidewatch_sent", False):
        return
    folder = tempfile.mkdtemp()
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package}", "zip", root, package))
    spark._tidewatch_sent = True


# --- fixed-size key filters -------------------------------------------------------------------------------------

FILTER_BITS = 23


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (public splitmix64 finaliser)."""
    x = np.asarray(x).astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def key_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``2**bits`` bits with the slots of all keys set (slot: the low bits of the key, taken as mixed already).

    Its size is fixed by ``bits`` whatever the input, so it may be broadcast; a full bitmap only filters less, and every
    user of it joins exactly afterwards. Each executor sends at most ``2**bits / 64`` words to the driver.
    """
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    words = (
        keys.where(F.col(column).isNotNull())
        .groupBy(F.shiftright(slot, 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("b"))
    )
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    if got.num_rows:
        out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(np.log2(len(bitmap))) + 6
    slot = np.asarray(keys).astype(np.uint64) & np.uint64((1 << bits) - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
