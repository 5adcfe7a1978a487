"""Streaming ingest: a micro-batch is a commit.

Mutations come as files; each micro-batch is validated, resolved by seq and published with its number in the
manifest, so a replayed batch changes nothing. ``foreachBatch`` runs one batch at a time, which is the
single writer's order. A bad mutation fails the stream before its batch is published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.residual import Model
from ..sources.store import MUTATIONS, Index


def source(spark: SparkSession, path: str, files_per_batch: int = 1, schema: str = MUTATIONS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, index: Index, checkpoint: str, name: str = "ingest", model: Model | None = None, available_now: bool = True):
    """Starts the query; ``index`` moves on with every batch. Returns (query, list of responses)."""
    replies: list[dict] = []

    def one(batch: DataFrame, number: int) -> None:
        replies.append(index.apply(batch, model, (name, number)))

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(), replies
