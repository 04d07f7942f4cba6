"""The relational core: registries of special points, joins to references, unions, normalisation, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("unlabeled", "completed", "failed")


# --- registry ---------------------------------------------------------------
def upsert(registry: DataFrame, rows: DataFrame, keys: Sequence[str], replace_kind: str | None = None) -> DataFrame:
    """``rows`` added to ``registry``; of equal keys the last stays. ``replace_kind`` first deletes that kind.

    Both sides may have columns that the other lacks.
    """
    if replace_kind is not None:
        registry = registry.where(~F.col("kind").eqNullSafe(F.lit(replace_kind)))
    both = registry.withColumn("_seq", F.lit(0)).unionByName(rows.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_seq"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_seq")


def remove(registry: DataFrame, kind: str | None = None, ids: DataFrame | None = None, on: str = "point_index") -> DataFrame:
    """Deletes rows of a kind, with the given ids, or both where both are given; with neither all rows go."""
    if ids is None:
        return registry.where(~F.col("kind").eqNullSafe(F.lit(kind))) if kind is not None else registry.limit(0)
    if kind is None:
        return registry.join(ids.select(on).distinct(), on, "left_anti")
    gone = ids.select(on).distinct().withColumn("kind", F.lit(kind))
    return registry.join(gone, [on, "kind"], "left_anti")


def update(registry: DataFrame, values: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``registry`` with the columns of ``values`` where its keys match."""
    new = [c for c in values.columns if c not in on]
    marked = values.select(*on, *[F.col(c).alias(f"_new_{c}") for c in new], F.lit(True).alias("_hit"))
    joined = registry.join(marked, list(on), "left")
    for c in new:
        old = F.col(c) if c in registry.columns else F.lit(None)
        joined = joined.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(old))
    return joined.drop("_hit", *[f"_new_{c}" for c in new])


def registry_frame(registry: DataFrame, kind: str | Sequence[str] | None = None, status: str | Sequence[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Rows by kind, status and ids; an unknown status is an error."""
    many = lambda v: [v] if isinstance(v, str) else list(v)
    if kind is not None:
        registry = registry.where(F.col("kind").isin(many(kind)))
    if status is not None:
        if wrong := set(many(status)) - set(STATUSES):
            raise ValueError(f"unknown status: {sorted(wrong)}")
        registry = registry.where(F.col("label_status").isin(many(status)))
    return registry if ids is None else registry.join(ids, ids.columns, "left_semi")


def special_points(registry: DataFrame, data: DataFrame, keys: Sequence[str] = ("point_index",)) -> DataFrame:
    """Registry rows with the points' columns; the registry wins where names clash."""
    extra = [c for c in data.columns if c in keys or c not in registry.columns]
    return registry.join(data.select(*extra), list(keys), "left")


# --- references -------------------------------------------------------------
def _distance(a: Sequence[str], b: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (F.col(x) - F.col(y)) * (F.col(x) - F.col(y))
    return F.sqrt(total)


def nearest_reference(points: DataFrame, references: DataFrame, key: str, reference_key: str, columns: Sequence[str], most_broadcast: int = 50_000) -> DataFrame:
    """``key, reference, distance``: the nearest reference of each point, the lowest of equally near ones.

    References are broadcast up to ``most_broadcast`` (checked); more are met block by block, and only each
    block's best goes on.
    """
    names = [f"_r_{c}" for c in columns]
    refs = references.select(F.col(reference_key).alias("reference"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    p = points.select(key, *columns)
    n = refs.limit(most_broadcast + 1).count()
    if n == 0:
        raise ValueError("there are no references")
    if n <= most_broadcast:
        met = p.crossJoin(F.broadcast(refs))
    else:
        blocks = -(-refs.count() // most_broadcast)
        refs = refs.withColumn("_b", F.pmod(F.xxhash64("reference"), F.lit(blocks)))
        met = p.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("long")).join(refs, "_b")
    best = met.groupBy(key).agg(F.min(F.struct(_distance(columns, names).alias("d"), "reference")).alias("m"))
    return best.select(key, F.col("m.reference").alias("reference"), F.col("m.d").alias("distance"))


def min_distance(points: DataFrame, references: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, distance`` to the nearest reference; zero where there are none."""
    if references.limit(1).count() == 0:
        return points.select(key, F.lit(0.0).alias("distance"))
    numbered = references.select(*columns).withColumn("_id", F.monotonically_increasing_id())
    return nearest_reference(points, numbered, key, "_id", columns).select(key, "distance")


def knn(points: DataFrame, key: str, vector: str, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """``groups, src, dst, distance, rank``: the ``k`` nearest others of each point within its group.

    Vectors are dealt into blocks that meet pairwise in a task each, as one matrix product; only each
    point's ``k`` best of a block leave it. Ties go to the lower key.
    """
    import math

    import numpy as np
    import pyarrow as pa

    n = points.count()
    blocks = max(2, math.ceil(n / 4096))
    rows = points.select(*groups, F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = left.select(*groups, F.col("b").alias("bi"), F.col("o").alias("bj"), F.lit(0).alias("side"), "id", "v")
    gives = left.select(*groups, F.col("o").alias("bi"), F.col("b").alias("bj"), F.lit(1).alias("side"), "id", "v")
    kinds = dict(points.dtypes)
    schema = "".join(f"`{g}` {kinds[g]}, " for g in groups) + "src long, dst long, distance double"

    def run(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        v = np.array(table.column("v").to_pylist(), float)
        q, x = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x = x[np.argsort(ids[x], kind="stable")]
        src, dst, dist = [], [], []
        for s in range(0, len(q) if len(x) else 0, 512):
            part = q[s : s + 512]
            d = np.sqrt(np.maximum(0, ((v[part, None, :] - v[None, x, :]) ** 2).sum(axis=2)) if len(x) * v.shape[1] < 20_000
                        else np.maximum(0, (v[part] ** 2).sum(1)[:, None] + (v[x] ** 2).sum(1)[None] - 2 * v[part] @ v[x].T))
            d[ids[part][:, None] == ids[x][None]] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            r = np.repeat(np.arange(len(part)), near.shape[1])
            c = near.ravel()
            exact = np.sqrt(((v[part[r]] - v[x[c]]) ** 2).sum(axis=1))
            ok = np.isfinite(d[r, c])
            src.append(ids[part[r]][ok])
            dst.append(ids[x[c]][ok])
            dist.append(exact[ok])
        cat = lambda a, t: np.concatenate(a) if a else np.empty(0, t)
        m = sum(map(len, src))
        first = {g: pa.chunked_array([table.column(g).slice(0, 1)]) for g in groups}
        cols = {g: pa.array([first[g][0].as_py()] * m, table.schema.field(g).type) for g in groups}
        return pa.table(cols | {"src": cat(src, np.int64), "dst": cat(dst, np.int64), "distance": cat(dist, float)})

    met = asks.union(gives).groupBy(*groups, "bi", "bj").applyInArrow(run, schema)
    best = Window.partitionBy(*groups, "src").orderBy("distance", "dst")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# --- unions and normalisation ------------------------------------------------
def union_maps(frames: Sequence[DataFrame], names: Sequence[str], features: Sequence[Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """All maps' rows with ``system, map_index`` and a dense ``point_index``; feature sets must be equal."""
    if any(set(f) != set(features[0]) for f in features):
        raise ValueError("the maps have different features")
    parts = [f.withColumn("system", F.lit(n)).withColumn("map_index", F.lit(i)) for i, (f, n) in enumerate(zip(frames, names, strict=True))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, list(features[0])


def global_index(points: DataFrame) -> DataFrame:
    """Adds ``global_point_index``: the offset of the point's map plus its own index."""
    sizes = points.groupBy("map_index").agg((F.max("point_index") + 1).alias("_n"))
    before = Window.orderBy("map_index").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("map_index", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return points.join(offsets, "map_index").withColumn("global_point_index", F.col("_o") + F.col("point_index")).drop("_o")


def normalize(df: DataFrame, column: str, alias: str, groups: Sequence[str] = (), constant: float = 0.0) -> DataFrame:
    """Min-max scaling by one aggregate joined back; a constant column becomes ``constant``."""
    keys = list(groups) or [F.lit(1).alias("_one")]
    ends = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    joined = df.join(ends, list(groups)) if groups else df.crossJoin(F.broadcast(ends.drop("_one")))
    flat = (F.col("_hi") - F.col("_lo")) <= F.lit(1e-8) + 1e-5 * F.abs("_lo")
    return joined.withColumn(alias, F.when(flat, F.lit(constant)).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


# --- metrics -----------------------------------------------------------------
def parity_metrics(df: DataFrame, reference: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """n, r2, mae, rmse, median and maximal absolute and mean error over the finite pairs, in one aggregation."""
    r, p = F.col(reference).cast("double"), F.col(predicted).cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    e = p - r
    rows = df.where(finite(r) & finite(p)).select(*groups, r.alias("_r"), e.alias("_e"))
    total = F.var_pop("_r") * F.count("*")
    square = F.sum(F.col("_e") * F.col("_e"))
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.when(total > 0, 1.0 - square / total).alias("r2"),
        F.avg(F.abs("_e")).alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.percentile(F.abs("_e"), 0.5).alias("median_abs_error"),
        F.max(F.abs("_e")).alias("max_abs_error"),
        F.avg("_e").alias("mean_error"),
    )


def error_table(df: DataFrame, reference: str, predicted: str, index: str, top_n: int | None = None) -> DataFrame:
    """Residuals by falling size with ``error_rank``; the rank is found by a sort and a top-n, not in one task, where ``top_n`` is given."""
    e = df.select("*", (F.col(predicted) - F.col(reference)).alias("residual")).withColumn("abs_residual", F.abs("residual"))
    e = e.where(F.col("residual").isNotNull() & ~F.isnan("residual"))
    order = [F.desc("abs_residual"), F.asc(index)]
    if top_n is not None:
        e = e.orderBy(*order).limit(top_n)
    return e.withColumn("error_rank", F.row_number().over(Window.orderBy(*order)))
