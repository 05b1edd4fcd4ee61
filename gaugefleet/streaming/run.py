"""Running a stream over what is there now, into tables that a repeated batch doesn't double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Parts = dict[str, DataFrame]


def run_batches(df: DataFrame, path: str, parts: Callable[[DataFrame], Parts], mode: str = "append") -> None:
    """Run a streaming frame to the end of its input; each batch is written as the tables that ``parts`` makes of it.

    Every table has a folder for each batch, which a repeated batch rewrites, so a restart doubles no row.
    """

    def put(batch: DataFrame, number: int) -> None:
        made = parts(batch)
        if len(made) > 1:
            batch.persist()
        for name, table in made.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def written_batches(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """All batches of a table that ``run_batches`` wrote; an empty table before the first one."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}/batch=*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over what is there now into a table under ``path``."""
    run_batches(df, path, lambda batch: {"out": batch}, mode)
    return written_batches(df.sparkSession, path, "out", df.schema).select(*df.columns)
