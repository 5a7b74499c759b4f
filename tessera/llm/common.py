"""What the operators of this subpackage share: inputs, the shared scratch folder, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of at most about 32 bytes that may be broadcast (some 64 MB as a hash table).
BROADCAST_ROWS = 1_000_000

#: Rows of an Arrow batch.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_scratch: list[str] = []


def bounded_batches(spark: SparkSession) -> None:
    """Hand long texts to Python BATCH_ROWS rows at a time, unless the session sets a number of its own.

    Spark's default of 10,000 rows makes batches of tens of megabytes on either side of the pipe.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only a local session may do without the setting, as in tests: driver and executors then are one process.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def stash(df: DataFrame, codec: str = "lz4", group_bytes: int = 64 << 20) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The copy outlives any executor; ``sweep`` removes the copies of a session.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", codec).option("parquet.block.size", group_bytes).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """How many scratch tables this process has made so far."""
    return len(_scratch)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete this process's scratch tables, those made after a mark only, but not the files that ``keep`` reads.

    Call it when no other result that reads them is needed.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    used = "\n".join(keep.inputFiles()) if keep is not None else ""
    for path in _scratch[since:]:
        if path.rsplit("/", 1)[-1] not in used:
            _scratch.remove(path)
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def lookup(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (stashed, narrow) marked for broadcast if it has at most BROADCAST_ROWS rows.

    Beyond that it is returned as it is, and the join is a shuffled one that AQE can split.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def text_column(texts: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if t is None else t for t in texts.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``text`` holds about ``limit`` bytes, so memory stays bounded."""
    for batch in batches:
        column = batch.column(text)
        at, row = 0, 0
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for i, size in enumerate(sizes):
            if i > row and at + size > limit:
                yield batch.slice(row, i - row)
                row, at = i, 0
            at += int(size)
        if row < batch.num_rows:
            yield batch.slice(row)


def appended(docs: DataFrame, name: str, kind: str) -> tuple[DataFrame, StructType]:
    """``docs`` without a column ``name``, and the schema with that column last: a clashing one is replaced."""
    left = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    return left, StructType([*left.schema.fields, StructType().add(name, kind)[0]])


_owner: list[tuple[str, Callable[[], None] | None]] = []


def give_back() -> None:
    """Return freed memory of this worker to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def takes_worker(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called where a task of an operator begins: a reused worker drops what the operator before it had cached there."""
    if _owner and _owner[0][0] != owner:
        before = _owner[0][1]
        if before is not None:
            before()
        give_back()
    _owner[:] = [(owner, release)]
