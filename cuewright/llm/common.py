"""Helpers that several text operators share: durable tables, hashing, tokens."""

from __future__ import annotations

import atexit
import functools
import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class of Java and RE2 regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a numpy pass holds at once; a longer document goes alone.
SLICE_BYTES = 1 << 20
#: Bytes, or numbers, that one step of the hash arithmetic holds at once.
PIECE_BYTES = 1 << 17
#: A longer word is hashed in blocks of so many bytes: polynomials modulo 2**64 have known collisions between texts of 1024 bytes and more.
WORD_BLOCK = 64
#: Rows and bytes of one Arrow batch between Spark and a Python worker.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cuewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: What holds while an intermediate table is written: Spark removes the shuffle files of a query that has ended, Arrow batches are small, and so are
#: the descriptions of plans, of which the driver keeps one for each of a session's last thousand queries.
WRITING = {
    "spark.sql.maxPlanStringLength": "4096",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES),
}
_lock, _writers, _before = threading.Lock(), {}, {}
_scratch = threading.local()
#: Tables that durable() wrote and that are still there.
_written: dict[str, SparkSession] = {}


class _settings:
    """WRITING for a session while any of its threads writes; what held before comes back with the last one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.key = spark, spark._jsparkSession.hashCode()

    def __enter__(self):
        with _lock:
            if not _writers.get(self.key):
                _before[self.key] = {k: self.spark.conf.get(k, None) for k in WRITING}
                for k, v in WRITING.items():
                    self.spark.conf.set(k, v)
            _writers[self.key] = _writers.get(self.key, 0) + 1

    def __exit__(self, *_):
        with _lock:
            _writers[self.key] -= 1
            if not _writers[self.key]:
                for k, v in _before.pop(self.key).items():
                    self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    The shuffle files behind it are of no more use then and are removed at once. The
    table goes with discard() or tidy(), or else when the process ends: a result that
    is not worked out yet may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cuewright/{uuid.uuid4().hex}"
    with _settings(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = spark
    for tables in getattr(_scratch, "open", ())[-1:]:
        tables[path] = spark
    out._cuewright_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _written.pop(path, None)
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that durable() gave and that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._cuewright_path)
        for own in getattr(_scratch, "open", ()):
            own.pop(df._cuewright_path, None)


def tidy(operator):
    """An operator whose result is written, and whose other tables are removed then.

    Tables that durable() wrote for it go when its result is durable; the result
    itself goes with the tables of the operator that called it, if any.
    """

    @functools.wraps(operator)
    def run(*args, **options):
        if not hasattr(_scratch, "open"):
            _scratch.open = []
        _scratch.open.append({})
        try:
            out = operator(*args, **options)
            done = out if hasattr(out, "_cuewright_path") else durable(out)
        finally:
            own = _scratch.open.pop()
        own.pop(done._cuewright_path, None)
        for path, spark in own.items():
            _delete(spark, path)
        for tables in _scratch.open[-1:]:
            tables[done._cuewright_path] = done.sparkSession
        return done

    return run


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold_of(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & _MASK, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Polynomial hashes of byte ranges and of runs of numbers, modulo 2**64. Tables of powers are shared by a process."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, base: int = _BASE):
        self.base = base | 1

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """base**i and base**-i for i below n; tables beyond 2 * PIECE_BYTES aren't kept."""
        got = Hasher.tables.get(self.base)
        if got is None or len(got[0]) < n:
            m = max(n, 2 * PIECE_BYTES)
            got = powers(self.base, m), powers(pow(self.base, -1, 1 << 64), m)
            if m == 2 * PIECE_BYTES:
                Hasher.tables[self.base] = got
        return got

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Running sums from which ranges() takes the hash of any range."""
        out = np.zeros(len(values) + 1, np.uint64)
        np.multiply(values, self._powers(len(values))[0][: len(values)], out=out[1:])
        return np.cumsum(out, out=out)

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        down = self._powers(len(prefix))[1]
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def column_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as its bytes and the n+1 offsets of its rows; null rows are empty."""
    import pyarrow as pa

    array = array.fill_null("") if array.null_count else array
    array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1 + array.offset)[array.offset :]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, text: int):
    """Cut a record batch into runs of rows with at most SLICE_BYTES of text, or one row."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    ends, at = np.cumsum(n), 0
    while at < len(n):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words end at ASCII white space and at a row's end."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACES[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[filled] = inside[filled]
    filled = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[filled] = inside[filled]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher) -> np.ndarray:
    """A 64-bit hash of each word, worked out over pieces of PIECE_BYTES.

    A word of more than WORD_BLOCK bytes is hashed in blocks, and the mixed hashes
    of its blocks are added up by their place.
    """
    blocks = -(-(ends - starts) // WORD_BLOCK)
    if len(starts) and blocks.max() > 1:
        first = np.cumsum(blocks) - blocks
        nth = np.arange(blocks.sum()) - np.repeat(first, blocks)
        lo = np.repeat(starts, blocks) + nth * WORD_BLOCK
        h = word_hashes(buf, lo, np.minimum(lo + WORD_BLOCK, np.repeat(ends, blocks)), hasher)
        long = blocks > 1
        h = np.where(np.repeat(long, blocks), mix(h ^ mix(nth.astype(np.uint64))), h)
        return np.add.reduceat(h, first)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, "right")))
        lo, hi = starts[at], ends[to - 1]
        sums = hasher.prefix(buf[lo:hi].astype(np.uint64) + np.uint64(1))
        out[at:to] = hasher.ranges(sums, starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out


def rows_of(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row each word belongs to."""
    return np.searchsorted(offsets, starts, "right") - 1


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def window_hashes(h: np.ndarray, size: int, hasher: Hasher) -> np.ndarray:
    """Hash of each run of size consecutive numbers, by its start; len(h)-size+1 of them."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = PIECE_BYTES
    for at in range(0, n, step):
        to = min(n, at + step)
        sums = hasher.prefix(h[at : to + size - 1])
        i = np.arange(to - at)
        out[at:to] = hasher.ranges(sums, i, i + size)
    return out
