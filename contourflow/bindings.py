"""How the driver's tables stand in for points, atoms and features; the SQL twins are used by the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge lengths of the periodic box and the grid's spacing.
BOX = (10.0, 10.0, 12.5)
STEP = 0.5
NX, NY = 20, 20
ELEMENTS = ("Co", "H", "Mo", "O", "S")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per event, each in a grid cell of its own."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.expr("int(user_id % 4)").alias("map_index"),
        F.col("event_id").alias("point_index"),
        F.expr("int(event_id % 20)").alias("ix"),
        F.expr("int((event_id div 20) % 20)").alias("iy"),
        F.expr("int(event_id div 400)").alias("iz"),
        F.expr("double(event_id % 20) * 0.5D").alias("x"),
        F.expr("double((event_id div 20) % 20) * 0.5D").alias("y"),
        F.expr("double(event_id div 400) * 0.5D").alias("z"),
        F.expr("double(user_id % 10 + 1) / 10D").alias("probability"),
        F.col("value").alias("energy"),
        F.expr("int(event_id % 3)").alias("layer"),
        F.expr("int(event_id % 2)").alias("region"),
    )


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One atom per nation; the element is its region's."""
    symbols = F.array(*[F.lit(s) for s in ELEMENTS])
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("atom_index"),
        F.element_at(symbols, F.col("n_regionkey").cast("int") + 1).alias("symbol"),
        F.expr("double((n_nationkey * 7) % 20) * 0.5D + 0.25D").alias("ax"),
        F.expr("double((n_nationkey * 11) % 20) * 0.5D + 0.25D").alias("ay"),
        F.expr("double((n_nationkey * 3) % 25) * 0.5D + 0.25D").alias("az"),
    )


POINTS_SQL = """points AS (
  SELECT CAST(user_id % 4 AS INTEGER) AS map_index, event_id AS point_index,
         CAST(event_id % 20 AS INTEGER) AS ix, CAST((event_id // 20) % 20 AS INTEGER) AS iy,
         CAST(event_id // 400 AS INTEGER) AS iz,
         CAST(event_id % 20 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS x,
         CAST((event_id // 20) % 20 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS y,
         CAST(event_id // 400 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS z,
         CAST(user_id % 10 + 1 AS DOUBLE) / CAST(10 AS DOUBLE) AS probability, value AS energy,
         CAST(event_id % 3 AS INTEGER) AS layer, CAST(event_id % 2 AS INTEGER) AS region
  FROM events
)"""

ATOMS_SQL = """atoms AS (
  SELECT CAST(n_nationkey AS INTEGER) AS atom_index,
         ['Co', 'H', 'Mo', 'O', 'S'][CAST(n_regionkey AS INTEGER) + 1] AS symbol,
         CAST((n_nationkey * 7) % 20 AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS ax,
         CAST((n_nationkey * 11) % 20 AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS ay,
         CAST((n_nationkey * 3) % 25 AS DOUBLE) * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS az
  FROM nation
)"""


def wrap_sql(d: str, length: float) -> str:
    return f"({d} - CAST({length} AS DOUBLE) * floor(({d}) / CAST({length} AS DOUBLE) + CAST(0.5 AS DOUBLE)))"


PAIRS_SQL = f"""{POINTS_SQL}, {ATOMS_SQL}, moved AS (
  SELECT p.*, a.atom_index, a.symbol, {wrap_sql("p.x - a.ax", BOX[0])} AS dx,
         {wrap_sql("p.y - a.ay", BOX[1])} AS dy, {wrap_sql("p.z - a.az", BOX[2])} AS dz
  FROM points p CROSS JOIN atoms a
), pairs AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM moved)"""
