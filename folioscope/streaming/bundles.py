"""Incremental reports: new artefact rows stream in, each micro-batch holds whole documents and is reported as a batch.

A document's scores depend on all its pages, so a document must arrive whole; the batch engine runs inside foreachBatch
and the checkpoint makes a restarted stream continue where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.report import Engine
from ..sources import parsing


def report_stream(artifacts: DataFrame, engine: Engine, out_path: str, checkpoint: str) -> StreamingQuery:
    """Append document reports of a stream of artefact rows (doc_id, kind, content) to a Parquet table."""

    def each(batch: DataFrame, batch_id: int) -> None:
        engine.report(parsing.parse(batch)).documents.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return artifacts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
