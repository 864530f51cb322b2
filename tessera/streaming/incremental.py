"""Resume-and-append evaluation.

Batch form: skip keys already in the output (C1), evaluate the rest, append
once. Streaming form: a file stream over the incoming folder with
``trigger(availableNow=True)``. The stream checkpoint sees to it that each
input file is processed once; a key that comes again in a later file is left
out by an anti join with what the other batches have written, and one that
comes twice in a batch is evaluated once. Each micro-batch is written under its
own ``batch_id=<n>`` folder with overwrite, so a retried batch, which does not
look at its own folder, replaces its output instead of appending it twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.resume import skip_done
from tessera.session import path_exists


def resume_and_append(todo: DataFrame, output_path: str, evaluate: Callable[[DataFrame], DataFrame],
                      key: str = "csno", output_schema: str | None = None, part_col: str | None = None) -> DataFrame:
    """Batch form: keys that the output at ``output_path`` already has are left
    out, ``evaluate`` sees only the others, and its rows are appended once (in
    folders of ``part_col``, if given). Returns the rows it appended (lazily
    re-readable)."""
    spark, remaining = todo.sparkSession, todo
    if path_exists(spark, output_path):
        reader = spark.read.schema(output_schema) if output_schema else spark.read
        done = reader.parquet(output_path).select(F.col(key).cast(todo.schema[key].dataType).alias(key))
        remaining = skip_done(todo, done, key)
    out = evaluate(remaining)
    out.write.mode("append").partitionBy(*([part_col] if part_col else [])).parquet(output_path)
    return out


def run_available(spark: SparkSession, incoming: str, schema: str, output_path: str, checkpoint: str,
                  evaluate: Callable[[DataFrame], DataFrame], output_schema: str, key: str = "csno") -> None:
    """Streaming form: process every file that arrived since the last run,
    then stop. ``output_schema`` is that of ``evaluate``'s rows, which hold
    ``key``; rows of ``incoming`` with a null key are evaluated, as in C1."""
    stream = spark.readStream.schema(schema).parquet(incoming)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        todo = batch.dropDuplicates([key])
        if path_exists(spark, output_path):
            done = read_output(spark, output_path, output_schema).where(F.col("batch_id") != batch_id)
            todo = skip_done(todo, done.select(F.col(key).cast(batch.schema[key].dataType).alias(key)), key)
        evaluate(todo).write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    exc = q.exception()
    if exc is not None:
        raise RuntimeError(str(exc))


def read_output(spark: SparkSession, output_path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch_id long").parquet(output_path)
