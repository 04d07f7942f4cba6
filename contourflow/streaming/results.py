"""Job results as a stream: output texts that arrive in a folder become registry updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.outputs import known_value, words


def watch_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ``job, content``, one row per file that arrives below ``folder``; the job is the file's folder."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    path = F.col("_metadata.file_path")
    return raw.select(F.element_at(F.split(path, "/"), -2).alias("job"), F.col("value").alias("content"))


def last_energies(stream: DataFrame) -> DataFrame:
    """``job, energy, label_status`` of each text: its last converged energy, or a failure."""
    every = F.transform(F.split("content", "\n"), lambda line: known_value(words(line), "converged_energy"))
    found = F.filter(every, lambda e: e.isNotNull())
    energy = F.try_element_at(found, F.lit(-1)).try_cast("double")
    return stream.select("job", energy.alias("energy"), F.when(energy.isNull(), "failed").otherwise("completed").alias("label_status"))


def collect(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the query; ``sink`` gets each batch once, to upsert it."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


