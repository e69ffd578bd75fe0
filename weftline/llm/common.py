"""Helpers shared by the training-data operators: staging tables and text kernels."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow batch of whole texts may hold (documents of a megabyte still fit a worker).
BATCH_ROWS = 1000
#: Bytes of text that a numpy kernel works on at a time.
KERNEL_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset; it gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weftline-")  # one machine is all there is
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    """Removes a staged table when the program ends; a session that has ended already leaves it to the folder's owner."""
    if spark._sc._jsc is None or spark._sc._jsc.sc().isStopped():
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tune(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches that carry whole texts; Spark bounds their bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def lean(over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives back, after its last batch, the memory that it has freed. Workers live on
    between tasks and steps, several to a core where functions follow each other, and would each hold their largest task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from over(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return run


def held(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each row as one struct `row`, beside own columns: nothing in a table can clash with these."""
    return docs.select(F.struct("*").alias("row"), *(v.alias(k) for k, v in keys.items()))


def unused(name: str, columns: Iterable[str]) -> str:
    """name, with as many underscores before it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sliced(texts: list[bytes], most: int = KERNEL_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about most bytes; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


# --- 64-bit mixing on numpy arrays -------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place."""
    t = x >> np.uint64(30)
    x ^= t
    x *= _M1
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= _M2
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, KERNEL_BYTES + (1 << 17))
        step = np.full(size, _INVERSE if inverse else _BASE, dtype=np.uint64)
        step[0] = 1
        have = _powers[key] = np.multiply.accumulate(step)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (data[k] + 1) * base**k over i <= k < j."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed hash of each data[start:end], the same wherever the range stands."""
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start])


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, and for each text the index of its first word (one more at the end)."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return range_hash(prefix_hash(data), starts, ends), np.searchsorted(starts, at)


_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], dtype=np.uint64)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words, also of those that cross texts."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    out = words[: len(words) - k + 1] * _MULT[0]
    for j in range(1, k):
        out += words[j : len(words) - k + 1 + j] * _MULT[j]
    return mix64(out)


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; of fewer words, the whole sequence as one; without words, none."""
    for a, b in sliced(texts):
        words, first = word_hashes(texts[a:b])
        whole = shingle_hashes(words, k)
        for i, j in zip(first[:-1], first[1:], strict=True):
            if j - i >= k:
                yield np.unique(whole[i : j - k + 1])
            elif j > i:
                yield mix64((words[i:j] * _MULT[: j - i]).sum(keepdims=True) + np.uint64(j - i))
            else:
                yield np.zeros(0, dtype=np.uint64)
