"""Shared pieces: tables, cut lineage, and vectorised hashing of UTF-8 text.

The hashing works on the raw value buffer of an Arrow string column, so that a
whole batch of texts is handled by a few numpy passes and no Python loop over
words. Nothing here shortens a text.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes of text handled in one numpy pass; a longer single text is one pass of its own.
PASS_BYTES = 1 << 18


#: Rows and bytes of one Arrow batch, so that a worker's memory doesn't depend on how long texts are.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Python workers give freed blocks of this size back to the system, instead of keeping their peak.
GIVEN_BACK = str(1 << 20)
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": GIVEN_BACK, "MALLOC_TRIM_THRESHOLD_": GIVEN_BACK, "MALLOC_ARENA_MAX": "2", "OPENBLAS_NUM_THREADS": "1"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, also where the caller's path isn't theirs, and bound what they hold."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    for key, value in WORKER.items():
        environment.setdefault(key, value)
    return spark


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object] | None = None) -> object:
    """What a worker keeps from one task to the next, made if it isn't there. Whatever was kept under another key goes."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
        _KEPT[key] = make() if make else None
    return _KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader opens the path."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in a local session that has none, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Spark's own setting: shuffle files of a finished SQL execution are removed at once, not when garbage is collected.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "step", narrow: int = 0, spread: bool = False) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, and a lost executor costs nothing.

    The finished step's shuffle files are removed, as nothing refers to them any more, and so are its
    broadcasts, which Spark drops when the driver has collected its garbage. narrow: for
    tables of short rows, that fraction of the shuffle partitions is enough, with as many fewer files;
    spread: they are dealt out first, so that the step before keeps its own number of tasks.
    """
    spark = df.sparkSession
    if narrow:
        files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // narrow)
        df = df.repartition(files) if spread else df.coalesce(files)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by cut() that nothing reads any more."""
    for table_ in tables:
        for path in {name.rsplit("/", 1)[0] for name in table_.inputFiles()}:
            at = table_.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table_.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: A key with more than this part of all rows is hot; there are fewer such keys than this.
HOT = 1000


def looked_up(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """rows left-joined with found (key, of which each stands once, k: its rows at least, and value) for value.

    Keys of more than a thousandth of all rows, of which there are less than a thousand, are looked
    up in a broadcast table; so no key's rows have to meet in one task.
    """
    hot = found.where(F.col("k") * HOT > total).select(key, F.col("value").alias("hot_value"))
    near = rows.join(F.broadcast(hot), key, "left")
    rest = near.where("hot_value is null").drop("hot_value").join(found.select(key, "value"), key, "left")
    return near.where("hot_value is not null").withColumnRenamed("hot_value", "value").unionByName(rest)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _constants(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, PASS_BYTES + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Random value of each byte after lower-casing A-Z.
_BYTE = _constants(7, 256)[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is no letter or digit.
PUNCT = np.ones(256, bool)
PUNCT[128:] = False
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and int64 offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return values, at


def passes(offsets: np.ndarray, limit: int = PASS_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes and at most so many rows each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1), lo + rows)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, start byte of each word, and per text the number of its first word (one more at the end).

    data holds the texts one after the other, offsets (from 0) where each begins. A word is a
    maximal run of bytes that are not in breaks; none spans two texts.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = breaks[data]
    first = ~gap
    first[1:] &= gap[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = ~gap[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts, np.zeros(len(offsets), np.int64)
    power, inverse = powers(n)
    value = _BYTE[data]
    value *= power
    value[gap] = 0
    h = mix(np.add.reduceat(value, starts) * inverse[starts])
    return h, starts, np.searchsorted(starts, offsets)


_PLACE = _constants(11, 64)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text, and per text the number of its first one.

    A text of one to k-1 words has its whole sequence as one shingle, one of no words has none.
    """
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(int(to[-1]), np.uint64)
    if len(h) >= k:
        rolled = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            rolled += h[j : len(h) - k + 1 + j] * _PLACE[j]
        keep = counts >= k
        lengths = made[keep]
        if len(lengths):
            source = np.repeat(first[:-1][keep] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            target = np.repeat(to[:-1][keep] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            out[target] = mix(rolled[source])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = h[first[i] : first[i + 1]]
        out[to[i]] = mix(mix((own * _PLACE[: len(own)]).sum(keepdims=True)) + _PLACE[32 + len(own)])[0]
    return out, to


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
