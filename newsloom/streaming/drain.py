"""The drain loop: parse payloads as they arrive until none is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import schemas
from newsloom.operators.state import transitions
from newsloom.plans.parsing import (
    article_rows,
    date_errors,
    dead_letters,
    parse_payload,
    parse_transitions,
)
from newsloom.session import remove_path
from newsloom.streaming.runs import batch_path, run_name


def stream_payload(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a payload table, as a stream."""
    reader = spark.readStream.schema(schemas.PAYLOAD)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(
    payload: DataFrame,
    out: str,
    checkpoint: str,
    parse: Callable[[DataFrame], DataFrame] = parse_payload,
    event_time: Column | None = None,
) -> StreamingQuery:
    """Parse everything that is there, batch by batch, then stop.

    Writes ``articles``, ``dead_letters``, ``date_errors`` and ``status_log`` below ``out``, each
    in one folder per run and batch.  One bad document ends up in ``dead_letters`` and holds up
    no one.  A second run goes on where the first one ended.
    """
    run = run_name(payload.sparkSession, checkpoint)
    moment = F.current_timestamp() if event_time is None else event_time

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # Parsed once and stored: the outputs are short plans over it, and no lost executor
        # makes the pages be parsed again.
        spark = batch.sparkSession
        stored = batch_path(f"{out}/_parsed", run, batch_id)
        table = parse(batch)
        table.write.mode("overwrite").parquet(stored)
        parsed = spark.read.schema(table.schema).parquet(stored)
        states = parse_transitions(parsed)
        outputs = {
            "articles": article_rows(parsed),
            "dead_letters": dead_letters(parsed),
            "date_errors": date_errors(parsed),
            "status_log": transitions(states, F.col("state"), moment, F.lit(batch_id)),
        }
        for name, rows in outputs.items():
            target = batch_path(f"{out}/{name}", run, batch_id)
            rows.write.mode("overwrite").parquet(target)
        remove_path(spark, stored)

    return (
        payload.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
