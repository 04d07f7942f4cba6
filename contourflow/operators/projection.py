"""Projections of point tables on a plane, grids and their smoothing, scattering back to a volume."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def _normal(plane: tuple[str, str]) -> str:
    return next(a for a in AXES if a not in plane)


def select_points(points: DataFrame, region: int | None = None, layer: int | Sequence[int] | None = None, maps: Sequence[int] | None = None) -> DataFrame:
    """Filter by region (equality), layer (one or several) and map; ``None`` filters nothing."""
    if region is not None:
        points = points.where(F.col("region") == region)
    if layer is not None:
        points = points.where(F.col("layer").isin([layer] if isinstance(layer, int) else list(layer)))
    return points if maps is None else points.where(F.col("map_index").isin(list(maps)))


def min_projection(
    points: DataFrame, minimize: str, plane: tuple[str, str] = ("x", "y"), decimals: int | None = None, groups: Sequence[str] = ("map_index",)
) -> DataFrame:
    """Per column of points along the plane's normal the row with the least ``minimize``.

    Ties go to the higher probability, then the lower normal coordinate, then the lower point index. Keys may be
    rounded half-even. Rows with a null coordinate are dropped. Adds ``multiplicity``,
    ``projection_normal_axis`` and ``minimized_column``.
    """
    normal = _normal(plane)
    keys = [F.bround(a, decimals) if decimals is not None else F.col(a) for a in plane]
    rows = points.dropna(subset=list(plane)).withColumn("_a", keys[0]).withColumn("_b", keys[1])
    cell = Window.partitionBy(*groups, "_a", "_b")
    best = cell.orderBy(F.asc(minimize), F.desc("probability"), F.asc(normal), F.asc("point_index"))
    ranked = rows.withColumn("_n", F.row_number().over(best)).withColumn("multiplicity", F.count("*").over(cell))
    return (
        ranked.where("_n = 1").drop("_n", "_a", "_b")
        .withColumn("projection_normal_axis", F.lit(normal)).withColumn("minimized_column", F.lit(minimize))
    )


def core_projection(points: DataFrame, selector: str, distance: str = "core_distance", plane: tuple[str, str] = ("x", "y"), groups: Sequence[str] = ("map_index",)) -> DataFrame:
    """Per column the point nearest to the core, or the top or the bottom one; adds ``multiplicity``."""
    normal = _normal(plane)
    orders = {
        "core": [F.asc(distance), F.desc("probability"), F.desc(normal)],
        "top": [F.desc(normal), F.asc(distance), F.desc("probability")],
        "bottom": [F.asc(normal), F.asc(distance), F.desc("probability")],
    }
    kind = "core" if selector in ("center", "distance") else selector
    cell = Window.partitionBy(*groups, *plane)
    rows = points.dropna(subset=list(plane))
    ranked = rows.withColumn("_n", F.row_number().over(cell.orderBy(*orders[kind], F.asc("point_index"))))
    return ranked.withColumn("multiplicity", F.count("*").over(cell)).where("_n = 1").drop("_n")


def weighted_projection(points: DataFrame, features: Sequence[str], distance: str = "core_distance", plane: tuple[str, str] = ("x", "y"), groups: Sequence[str] = ("map_index",)) -> DataFrame:
    """Per column the probability-weighted mean of the features; weights that sum to about zero count as ones."""
    w = F.col("probability")
    zero = F.abs(F.sum(w)) <= 1e-12
    means = [F.when(zero, F.avg(f)).otherwise(F.sum(w * F.col(f)) / F.sum(w)).alias(f) for f in features]
    return points.groupBy(*groups, *plane).agg(
        *means, F.max("probability").alias("probability"), F.min(distance).alias(distance), F.count("*").alias("multiplicity")
    )


def projection_grid(projected: DataFrame, feature: str, plane: tuple[str, str] = ("x", "y"), values: Sequence[float] | None = None) -> DataFrame:
    """Rows by the second axis, a column for each value of the first; a repeated cell is an error."""
    if values is None:
        values = [r[0] for r in projected.select(plane[0]).distinct().orderBy(plane[0]).limit(100_000).collect()]
    cells = projected.groupBy(*reversed(plane)).agg(F.count("*").alias("_n"), F.first(feature).alias("_v"))
    one = F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated cell")).cast("double")).otherwise(F.col("_v"))
    return cells.withColumn("_v", one).groupBy(plane[1]).pivot(plane[0], list(values)).agg(F.first("_v")).orderBy(plane[1])


def gaussian_smooth(grid: DataFrame, value: str, sigma: float, ix: str = "ix", iy: str = "iy", nx: int = 0, ny: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """Gaussian filter of a regular 2-D grid that ignores missing values; indices beyond an edge are clamped.

    Two passes, one along each axis, truncated at four sigma; each value spreads to the places it reaches.
    """
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weight = [r / sum(raw) for r in raw]
    out = grid.select(*groups, ix, iy, F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias("_v"),
                      F.when(F.col(value).isNull() | F.isnan(value), 0.0).otherwise(1.0).alias("_m"))
    for axis, n in ((ix, nx), (iy, ny)):
        other = iy if axis == ix else ix
        # place t takes from clamp(t + k): a cell inside gives to t = c - k, an edge cell also to all beyond it
        targets = F.filter(F.sequence(F.greatest(F.col(axis) - reach, F.lit(0)), F.least(F.col(axis) + reach, F.lit(n - 1))), lambda t: t >= 0)
        spread = out.withColumn("_t", F.explode(targets))
        k = F.col(axis) - F.col("_t")
        table = F.array(*[F.lit(w) for w in weight])
        tail = [sum(weight[j:]) for j in range(2 * reach + 1)]
        head = [sum(weight[: j + 1]) for j in range(2 * reach + 1)]
        at = (k + reach + 1).cast("int")
        w = (
            F.when((F.col(axis) == 0) & (F.col(axis) == n - 1), F.lit(1.0))
            .when(F.col(axis) == 0, F.element_at(F.array(*[F.lit(h) for h in head]), at))
            .when(F.col(axis) == n - 1, F.element_at(F.array(*[F.lit(t) for t in tail]), at))
            .otherwise(F.element_at(table, at))
        )
        out = spread.groupBy(*groups, F.col("_t").alias(axis), other).agg(F.sum(w * F.col("_v")).alias("_v"), F.sum(w * F.col("_m")).alias("_m"))
    return out.select(*groups, ix, iy, F.when(F.col("_m") > 0, F.col("_v") / F.col("_m")).alias(value))


def to_volume(cells: DataFrame, points: DataFrame, feature: str, reference: float = 0.0, keys: Sequence[str] = ("ix", "iy", "iz")) -> DataFrame:
    """A feature on the full grid, ``reference`` where there is no point."""
    filled = cells.join(points.select(*keys, F.col(feature).alias("value")), list(keys), "left")
    return filled.withColumn("value", F.coalesce("value", F.lit(float(reference))))
