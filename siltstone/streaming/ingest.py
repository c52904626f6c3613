"""File streams into collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.catalog import Collection


def ingest_lines(spark: SparkSession, folder: str, collection: Collection, checkpoint: str) -> StreamingQuery:
    """Adds a document for each line of JSON in the new text files of a folder, one commit for each batch of files.

    Lines that are no JSON object are refused. Takes all files that are there and ends; started again with the same
    ``checkpoint``, it goes on with later ones. The number of a batch is part of its commit, so a batch that is repeated
    after a failure is added once.
    """

    def add(batch: DataFrame, number: int) -> None:
        collection.ingest(batch, "value", checkpoint, number)

    return spark.readStream.text(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
