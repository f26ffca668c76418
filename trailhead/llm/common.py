"""What the operators of this subpackage share: shared-folder tables, batches, text helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead import ship

#: Arrow batches hold whole texts, so they are bounded by bytes and not by rows alone.
BATCH_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

try:  # large arrays go back to the system when they are freed, so that idle workers hold little
    ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD of the GNU C library
    pa.set_memory_pool(pa.system_memory_pool())  # Arrow's buffers too
except (AttributeError, OSError):
    pass

_own_dirs: dict[str, str] = {}
_stored: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves, but only for a local master: on a
    cluster a machine-local folder would lose rows, so that raises.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="trailhead-")
    return f"file://{_own_dirs[app]}"


def store(df: DataFrame, free: bool = False, by: str | None = None, light: bool = False) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back; `free` calls release() after it.

    With `by`, the table is dealt into buckets by that column, as many as a shuffle has partitions, so
    that a join on it does not move the table. A `light` table holds a few numbers for each text: an
    eighth of the shuffle's partitions write it, and no task leaves a file of some hundred bytes.

    This cuts lineage like checkpoint() but stays columnar and compressed; a lost executor
    costs nothing, because readers go to the shared folder. Deleted when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/trailhead/{uuid.uuid4().hex}"
    schema = df.schema
    if light:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    if by:
        name = f"trailhead_{path.rsplit('/', 1)[1]}"
        df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name)
    else:
        df.write.parquet(path)
    _stored.append((spark, path))
    if free:
        release(spark)
    return spark.table(name) if by else spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's ContextCleaner see what is no longer referred to, so that shuffle files of stages
    whose result is stored go at once and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the tables that `df` (from store()) reads, once nothing needs them."""
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for spark, path in list(_stored):
        if any(r.split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/") for r in roots):
            _delete(spark, path)
            _stored.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _stored:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for this session, and let its workers import the package."""
    ship(spark)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def as_bytes(col: Column) -> Column:
    """A text as UTF-8 bytes; null: empty."""
    return F.coalesce(col.cast("binary"), F.lit(b""))


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[list]:
    for n in names:
        yield batch.column(batch.schema.get_field_index(n)).to_pylist()


def batch_of(schema: pa.Schema, **arrays: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(arrays[f.name], type=f.type) for f in schema], schema=schema)


def crc_mod4(col: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4."""
    return F.crc32(col.cast("string").cast("binary")) % 4


def held_out(col: Column) -> Column:
    """True where the row is kept from training: remainder 2. A null id is held out too."""
    return F.coalesce(crc_mod4(col) == 2, F.lit(True))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise uint64 hashes, vectorised (splitmix64's constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Little-endian arrays in one block: a count of bytes before each."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        out += [len(raw).to_bytes(8, "little"), raw]
    return b"".join(out)


def unpack(block: bytes, *dtypes: str) -> list[np.ndarray]:
    out, at = [], 0
    for d in dtypes:
        n = int.from_bytes(block[at : at + 8], "little")
        out.append(np.frombuffer(block, dtype=d, count=n // np.dtype(d).itemsize, offset=at + 8))
        at += 8 + n
    return out
