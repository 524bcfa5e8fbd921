"""Shared pieces of the training-data operators: tables, scratch tables, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space and U+0009 to U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Rows up to which a two-column side of a join counts as small enough to broadcast.
BROADCAST_ROWS = 200_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20
#: Written tables: session, path, and the mark that was set in their thread.
_scratch_paths: list[tuple[SparkSession, str, object]] = []
_here = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as rows, so that very long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = "file://" + tempfile.mkdtemp(prefix="tesselon-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def drop_scratch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for spark, path, _ in _scratch_paths:
        try:
            drop_scratch(spark, path)
        except Exception:  # a session may have ended already; others may not
            continue


atexit.register(_drop_all)


class Scratch:
    """Written tables in the shared folder: they cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again; a table written earlier by that name goes."""
        old, path = self.paths.get(name), f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        _scratch_paths.append((self.spark, path, getattr(_here, "mark", None)))
        self.paths[name] = path
        if old:
            drop_scratch(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_scratch(self.spark, self.paths.pop(name))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_mark() -> object:
    """A mark for the scratch tables that this thread writes from now on; see drop_since."""
    _here.mark = object()
    return _here.mark


def drop_since(mark: object) -> None:
    """Drops the scratch tables written under a mark but for the newest, which must not need them any more; those of other threads stay."""
    own = [x for x in _scratch_paths if x[2] is mark][:-1]
    for spark, path, _ in own:
        drop_scratch(spark, path)
    gone = {path for _, path, _ in own}
    _scratch_paths[:] = [x for x in _scratch_paths if x[1] not in gone]


def spark_gc(spark: SparkSession) -> None:
    """Lets Spark's cleaner find shuffle files that no plan needs any more; else they stay until the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df marked for broadcast if it has few rows, else as it is. df should be a written table.

    weight: the size of a row that holds an array; then the sum of weights is what must be small."""
    size = df.count() if weight is None else df.agg(F.sum(weight + 1)).first()[0] or 0
    return F.broadcast(df) if size <= rows else df


def tidy(run):
    """run (batches to batches), and at its end what it held goes back to the system: workers live on and would keep it."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return outer


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for."""

    up = down = np.ones(1, _U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _SEGMENT + 1)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, _U(_BASE))]))
                inverse = _U(pow(_BASE, -1, 1 << 64))
                cls.down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, inverse)]))
        return cls.up, cls.down


_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[ord("A") + np.arange(26)] = _VALUE[ord("a") + np.arange(26)]
_VALUE[_SEP] = 0


def word_hashes(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in buf (UTF-8 bytes, A-Z as a-z) and where each word starts.

    cuts: offsets at which a word ends in any case (starts of documents)."""
    sep = _SEP[buf]
    start = ~sep
    start[1:] &= sep[:-1]
    inner = cuts[cuts < len(buf)]
    start[inner] = ~sep[inner]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, _U), starts
    up, down = _Powers.get(len(buf) + 1)
    sums = np.add.reduceat(_VALUE[buf] * up[: len(buf)], starts)
    return mix(sums * down[starts]), starts


def _long_words(buf: np.ndarray) -> np.ndarray:
    """As word_hashes, for one long text: by segments that end at separators."""
    parts, at = [], 0
    while at < len(buf):
        end = min(at + _SEGMENT, len(buf))
        while end < len(buf):
            gaps = np.flatnonzero(_SEP[buf[end : end + _SEGMENT]])
            end = end + int(gaps[0]) if len(gaps) else min(end + _SEGMENT, len(buf))
            if len(gaps):
                break
        parts.append(word_hashes(buf[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; nulls are empty."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = text.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about a segment of bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SEGMENT, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words_by_row(text: pa.Array) -> Iterator[np.ndarray]:
    """For each row the hashes of its words, in order."""
    data, offsets = text_bytes(text)
    for a, b in chunks(offsets):
        buf = data[offsets[a] : offsets[b]]
        if b == a + 1:
            yield _long_words(buf)
            continue
        cuts = offsets[a : b + 1] - offsets[a]
        hashes, starts = word_hashes(buf, cuts)
        at = np.searchsorted(starts, cuts)
        for i in range(b - a):
            yield hashes[at[i] : at[i + 1]]


#: Fixed odd multipliers, one for each place in a shingle.
_PLACES = [_U(pow(0xD1342543DE82EF95, 3 * k + 1, 1 << 64) | 1) for k in range(16)]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words; of the whole sequence if it is shorter; none for no words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, _U)
    size_here = min(size, n)
    total = words[: n - size_here + 1] * _PLACES[0]
    for k in range(1, size_here):
        total = total + words[k : n - size_here + 1 + k] * _PLACES[k]
    return mix(total ^ _U(size_here))
