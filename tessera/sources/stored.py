"""Derived tables that are kept: built once for a state of their inputs, read from then on.

They live in the folder that driver and executors share (spark.checkpoint.dir), under a name that holds a digest of the
inputs' files and of the builder's version, so that a table whose inputs changed is never read.  Only a local session
may do without the setting; its folder then goes when the process ends.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_schemas: dict[str, StructType] = {}


def shared_base(spark: SparkSession) -> str:
    """The shared folder's path."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def state_of(inputs: Sequence[DataFrame]) -> str:
    """A digest of the files that the inputs read: their names, and sizes and times of their folders."""
    digest = hashlib.sha256()
    for df in inputs:
        spark, files = df.sparkSession, sorted(df.inputFiles())
        roots = sorted({f.rsplit("/", 1)[0] for f in files} | set(files[:1]))
        digest.update("\n".join(files).encode())
        for root in roots:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            digest.update(f"{status.getLen()} {status.getModificationTime()}".encode())
    return digest.hexdigest()[:32]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored(spark: SparkSession, name: str, inputs: Sequence[DataFrame], build: Callable[[], DataFrame], partition_by: Sequence[str] = (), **options: str) -> DataFrame:
    """The table ``name`` of these inputs: read if it is there, else built, written and read.

    ``name`` should tell the builder's parameters.  A half-written table has no _SUCCESS and is written anew.
    """
    path = f"{shared_base(spark)}/tessera-stored/{name}-{state_of(inputs)}"
    if not exists(spark, path):
        writer = build().write.mode("overwrite").options(**options)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        _schemas.pop(path, None)
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """A copy in the shared folder, which cuts the lineage of a loop; it outlives any executor."""
    path = f"{shared_base(df.sparkSession)}/tessera-rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
