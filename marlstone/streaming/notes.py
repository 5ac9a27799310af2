"""Notes as a stream, an extension: every micro-batch runs the batch plan and is written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotate import annotate


def annotate_stream(notes: DataFrame, key: str = "note_id", text: str = "text") -> DataFrame:
    """Concepts of a stream of notes; stateless, so late notes need no watermark."""
    return annotate(notes, key, text)


def run_available(notes: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch plan over what is there and stop; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
