"""Point tables saved as Parquet with a manifest, and per-map results that can be resumed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], settings: Mapping | None = None) -> None:
    """Writes the tables, then a line of the manifest that makes them the current version.

    Tables with a column ``map_index`` are laid out by it. A reader sees the former version until the line is
    there, and a failed save changes nothing; versions are numbered, and old ones stay.
    """
    number = max((v["version"] for v in _versions(spark, folder)), default=0) + 1
    place = f"data-{number}-{uuid.uuid4().hex[:8]}"
    entry = {"version": number, "place": place, "tables": {}, "settings": dict(settings or {})}
    for name, df in tables.items():
        if "map_index" in df.columns and len(df.columns) > 1:
            # one map's rows side by side; the adaptive plan splits a map that is too large for a task
            df.hint("rebalance", F.col("map_index")).write.partitionBy("map_index").parquet(f"{folder}/{place}/{name}")
        else:
            df.write.parquet(f"{folder}/{place}/{name}")
        entry["tables"][name] = df.schema.jsonValue()
    spark.range(1).select(F.lit(json.dumps(entry)).alias("value")).write.mode("append").text(f"{folder}/manifest")


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of the newest version, with their columns and types as saved, and the settings."""
    from pyspark.sql.types import StructType

    found = _versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"no saved tables in {folder}")
    entry = max(found, key=lambda v: (v["version"], v["place"]))
    tables = {}
    for name, fields in entry["tables"].items():
        schema = StructType.fromJson(fields)
        tables[name] = spark.read.schema(schema).parquet(f"{folder}/{entry['place']}/{name}").select(*schema.names)
    return tables, entry["settings"]


def _versions(spark: SparkSession, folder: str) -> list[dict]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return []
    return [json.loads(row[0]) for row in spark.read.text(f"{folder}/manifest").collect()]


def pending(wanted: DataFrame, done: DataFrame | None) -> DataFrame:
    """``map_index`` of the maps of ``wanted`` without a row in ``done``."""
    maps = wanted.select("map_index").distinct()
    return maps if done is None else maps.join(done.select("map_index").distinct(), "map_index", "left_anti")
