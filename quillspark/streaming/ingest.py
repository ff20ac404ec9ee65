"""Shards that arrive one after the other: each micro-batch becomes a part of the catalogue, with its codes and an index segment of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..operators import catalogue
from ..operators.ingest import flattened, records_and_codes
from ..sources import shards


def start(spark: SparkSession, source: str, target: str, checkpoint: str, strict: bool = True, max_files: int | None = None):
    """A query that adds the records of new shards of source to the catalogue of target, each shard once, by the checkpoint; a batch that runs again is
    known by its number and changes nothing. Within a batch shards are in order of their numbers; rids go on where the catalogue ends.
    Readers see whole batches. ``catalogue.compact`` makes one segment of many."""
    text = spark.readStream.schema("value string").option("pathGlobFilter", "aarecords__*.json.gz")
    if max_files is not None:
        text = text.option("maxFilesPerTrigger", max_files)

    def append(batch: DataFrame, number: int) -> None:
        paths = sorted((r.path for r in batch.select("path").distinct().collect()), key=lambda p: shards.shard_key(p.rsplit("/", 1)[-1]))  # the batch's files
        if not paths:
            return
        flat = flattened(shards.parsed(shards.placed(batch, paths)).drop("value"), strict)
        aside = f"{shared.shared_dir(spark)}/{uuid.uuid4().hex}"

        def tables(last: int) -> tuple[DataFrame, DataFrame]:
            try:
                flat.write.mode("overwrite").parquet(aside)
            except Exception as error:
                raise shards.explained(spark, paths, error) from error
            return records_and_codes(shards.numbered(spark.read.schema(flat.schema).parquet(aside)).withColumn("rid", F.col("rid") + last))

        catalogue.append(spark, target, tables, checkpoint, number)
        shared.remove(spark, aside)

    return shards.lines_of(text.text(source)).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
