"""Reading inputs and cutting lineage through tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries. Its texts are long, so Arrow batches of the session hold ``_BATCH_ROWS`` rows, unless it asks for fewer."""
    rows = int(spark.conf.get(_BATCH))
    if rows <= 0 or rows > _BATCH_ROWS:
        spark.conf.set(_BATCH, _BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; where the setting is missing on one
    machine (tests) a temporary folder is set, and removed when the driver ends.
    """
    base = spark.conf.get(_SETTING, None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="gaugefleet-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set(_SETTING, base)
    return f"{base.rstrip('/')}/gaugefleet-{uuid.uuid4().hex}"


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table cuts the lineage and survives lost executors. Its size is known to the planner, so a
    later join broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = 500_000, weight: str = "1") -> DataFrame:
    """A staged table, marked for broadcast only if its ``weight`` (rows, or what they hold) sums to at most ``rows``."""
    total = df.agg(F.sum(F.expr(weight))).first()[0] or 0
    return F.broadcast(df) if total <= rows else df


def slices(batch: pa.RecordBatch | pa.Array, rows: int = 256) -> Iterator[pa.RecordBatch | pa.Array]:
    """Views of a few rows, so that few texts are Python objects at a time."""
    for i in range(0, len(batch), rows):
        yield batch.slice(i, rows)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)
