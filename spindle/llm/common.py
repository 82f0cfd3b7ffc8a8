"""Helpers shared by the corpus operators: reading, writing to the shared folder, vectorised text access.

Defined results common to all operators of this subpackage
----------------------------------------------------------
* Only the columns an operator names are read; any other column of the input is ignored, whatever its name.
* A null text is the empty text unless the operator says otherwise.
* Rows whose key (``doc_id``) is null are no documents: they are left out.
* Rows that repeat a ``doc_id`` are one document, with the greatest text of the repeats (null is least). Both rules hold
  in the stages of a pipeline too: these return one row for each doc_id, with all its columns.
* Empty tables give empty results with the full schema.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of text that a task handles at once in vectorised code (a longer text is handled alone).
SLICE_BYTES = 400_000
#: Bytes of a batch that goes to Python, unless the session has a bound of its own: 10,000 rows of long texts have no bound.
BATCH_BYTES = 12_000_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Set while a table is written: what that write has shuffled goes at its end, not when the driver happens to collect its garbage.
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}
_tables: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local master (as in tests) gets a folder of its own; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-spindle-")
    return _own_dirs[app]


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: cuts lineage and survives lost executors.

    Tables go when `dropped` or when the program ends, the shuffle files behind them at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _tables.add(path)
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_CONF)
        else:
            spark.conf.set(_CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(path: str) -> None:
    from pyspark import SparkContext

    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    conf = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    _tables.discard(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files that `written` made, once nothing reads them any more."""
    files = df.inputFiles()[:1]
    for path in [x for x in _tables if files and x.rpartition("/")[2] == files[0].rpartition("/")[0].rpartition("/")[2]]:
        _delete(path)


@atexit.register
def _drop_all() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        for path in list(_tables):
            _delete(path)


def written_alone(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make() returns, written; the tables that make() wrote on the way go."""
    before = set(_tables)
    df = make()
    made = _tables - before
    out = written(df, tag)
    for path in made:
        _delete(path)
    return out


def documents(df: DataFrame, *cols: str) -> DataFrame:
    """doc_id and the named columns (by default all, in their order), one row for each doc_id that is not null.

    Sets the session's bound of Arrow batches if it has none. Ids alone are counted first (8 bytes a row); the texts are shuffled only if some id does repeat. Of repeats, the row with
    the greatest text stays; of equal texts, that whose other columns (of types with an order) are greatest.
    """
    if df.sparkSession.conf.get(_BATCH_CONF, None) is None:
        df.sparkSession.conf.set(_BATCH_CONF, BATCH_BYTES)
    own = list(cols) or [c for c in df.columns if c.lower() != "doc_id"]
    out = df.select(*(("doc_id", *cols) if cols else df.columns)).where(F.col("doc_id").isNotNull())
    repeats = out.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeats:
        return out
    first = [c for c in own if c.lower() == "text"]
    order = [*first, *(c for c in own if c not in first and "map<" not in df.schema[c].dataType.simpleString() and "variant" not in df.schema[c].dataType.simpleString())]
    best = out.groupBy(F.col("doc_id")).agg(F.max_by(F.struct(*own), F.struct(*order)).alias("_r"))
    return best.select(*["doc_id" if c.lower() == "doc_id" else F.col("_r")[c].alias(c) for c in out.columns])


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most this many rows (counted), else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def arrow_type(ddl: str) -> pa.DataType:
    """The Arrow type of a Spark type's name, as for doc_id of any type."""
    return to_arrow_type(DataType.fromDDL(ddl))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


#: Bound of the ids (8 bytes each) that are broadcast to drop rows; more are joined by shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of docs whose doc_id the first column of make() doesn't hold. What is gone is worked out once, in a written table, which alone stays."""
    name = fresh(docs, "_gone")
    gone = small(written_alone(lambda: make().toDF(name), "gone"), BROADCAST_IDS)
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


#: A hash is drawn from so many values, so that a share of any table is exact enough.
SHARES = 1 << 50


def share_of(wanted: float, rows: int) -> int:
    """How many of SHARES hash values draw about `wanted` of `rows` rows."""
    return max(1, int(SHARES * min(1.0, wanted / max(rows, 1))))


def held_out(col: str = "doc_id"):
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0


_held: dict[str, object] = {}


def held(key: str, make: Callable):
    """What the tasks of one operator share in a worker. Workers serve all operators in turn and hold one such thing at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def _trimmed() -> None:
    """Gives free memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _forget(key: str | None) -> None:
    others = [k for k in _held if k != key]
    for k in others:
        del _held[k]
    if others:
        _trimmed()


def lean(run: Callable, key: str | None = None) -> Callable:
    """A function of batches that leaves no free memory behind in its worker, nor what operators other than `key` hold there."""

    def task(batches):
        _forget(key)
        try:
            yield from run(batches)
        finally:
            _trimmed()

    return task


def lean_group(run: Callable) -> Callable:
    """The same for a function of a group's table."""

    def task(group):
        _forget(None)
        out = run(group)
        del group
        _trimmed()
        return out

    return task


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and n + 1 offsets; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(arr) else data[:0], off - off[0] if len(arr) else np.zeros(1, np.int64)


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, a longer row alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for texts up to a few slices."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 8 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


#: Maps A-Z to a-z and leaves the other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A salt for each byte value.
SALT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray, lower: bool = True):
    """Words of every text: maximal runs of bytes that are in `member`.

    Returns (start, end, text index, 64-bit hash) of each word. The hash is a function of the word's bytes alone.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    inside = member[data]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    with np.errstate(over="ignore"):
        value = (SALT[LOWER] if lower else SALT)[data]
        value *= powers(_BASE, n)
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        h = mix((total[e] - total[s]) * powers(_INV, n)[s] + (e - s).astype(np.uint64))
    return s, e, np.searchsorted(off, s, side="right") - 1, h


def counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)
