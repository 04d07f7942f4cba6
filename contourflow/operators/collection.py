"""Columns and registries of a collection of maps: annotations, boundary columns, metadata, global special points."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import assign, propagation_scores, reweight
from .selection import energy_component, greedy_select
from .tables import upsert

#: The columns of the contact space, which no annotation may replace.
RESERVED = (
    "x", "y", "z", "nn", "region", "probability", "signed_distance", "core_distance", "patch", "layer", "patch_size",
    "layer_size", "patch_mean_distance", "layer_mean_distance",
)


def annotate(points: DataFrame, values: DataFrame, name: str, features: Sequence[str] = (), as_feature: bool = True, keys: Sequence[str] = ("point_index",)) -> tuple[DataFrame, list[str]]:
    """``points`` with the column ``name`` of ``values(keys, name)`` as a double, and the list of feature columns.

    Each point needs one value, else an error says how many there are; a reserved name is an error. An earlier
    annotation of that name is replaced. ``as_feature`` puts the name into the list or takes it out.
    """
    if name in RESERVED:
        raise ValueError(f"{name} is a column of the contact space")
    new = values.select(*keys, F.col(name).cast("double").alias(name))
    have, want = new.count(), points.count()
    both = points.select(*keys).join(new.select(*keys), list(keys)).count()
    if not have == want == both:
        raise ValueError(f"{name} has {have} values, {both} of them for one of the {want} points")
    listed = [f for f in features if f != name or as_feature]
    if as_feature and name not in listed:
        listed.append(name)
    return points.drop(name).join(new, list(keys)), listed


def boundary_columns(points: DataFrame, scalars: Mapping[str, str], vectors: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds ``boundary_<name>`` of each scalar column and ``boundary_<name>_x``, ``_y``, ``_z`` of each three."""
    found = {f"boundary_{n}": c for n, c in scalars.items()}
    found |= {f"boundary_{n}_{axis}": c for n, three in vectors.items() for axis, c in zip("xyz", three, strict=True)}
    return points.withColumns({n: F.col(c).cast("double") for n, c in found.items()})


def attach_metadata(points: DataFrame, metadata: DataFrame, key: str = "map_index") -> DataFrame:
    """The columns of ``metadata``, one row a map, on every point of that map.

    They replace columns of the same name, but not where a map has no metadata. Spark chooses the join.
    """
    new = [c for c in metadata.columns if c != key]
    renamed = metadata.select(key, F.lit(True).alias("_has"), *[F.col(c).alias(f"_new_{c}") for c in new])
    joined = points.join(renamed, key, "left")
    old = {c: F.col(c) if c in points.columns else F.lit(None) for c in new}
    return joined.withColumns({c: F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(old[c]) for c in new}).drop("_has", *[f"_new_{c}" for c in new])


def contact_column(contact: DataFrame, data: DataFrame, column: str, keys: Sequence[str] = ("map_index", "point_index")) -> DataFrame:
    """``keys, column`` as a double: the contact space's column where it has one, else that of the data."""
    for source in (contact, data):
        if column in source.columns:
            return source.select(*keys, F.col(column).cast("double").alias(column))
    raise ValueError(f"{column} is a column of neither table")


def register_global(
    registry: DataFrame, points: DataFrame, chosen: DataFrame, kind: str, iteration: int | None = None, label_status: str = "unlabeled",
    replace_kind: bool = False,
) -> DataFrame:
    """``registry`` with the points of ``chosen(global_point_index, metadata...)`` as special points of ``kind``.

    ``points(global_point_index, map_index, point_index)`` gives each its place in its map, so the children's
    registries are this one by ``map_index``. Equal (map, point, kind) are replaced; ``replace_kind`` first
    deletes the kind. Ids that are no points are an error.
    """
    placed = chosen.join(points.select("global_point_index", "map_index", "point_index"), "global_point_index", "left")
    if strange := placed.where("map_index is null").select("global_point_index").first():
        raise ValueError(f"no point {strange[0]}")
    rows = placed.withColumns({"kind": F.lit(kind), "iteration": F.lit(iteration).cast("int"), "label_status": F.lit(label_status)})
    return upsert(registry, rows, ["map_index", "point_index", "kind"], kind if replace_kind else None)


def global_ids(registry: DataFrame, points: DataFrame) -> DataFrame:
    """``global_point_index``: every point with a special row, once."""
    special = registry.select("map_index", "point_index")
    return points.join(special, ["map_index", "point_index"], "left_semi").select("global_point_index").distinct()


def select_special_points(
    registry: DataFrame, points: DataFrame, n: int, kind: str = "adaptive", iteration: int | None = None, label_status: str = "unlabeled",
    replace_kind: bool = False, features: Sequence[str] = (), space: Sequence[str] = ("x", "y", "z"), real_weight: float = 0.0,
    feature_weight: float = 1.0, energy: str | None = None, energy_weight: float = 0.0, uncertainty: str | None = None,
    uncertainty_weight: float = 0.0, scale: bool = True, region: int | None = None, layer: int | None = None, **energy_settings,
) -> DataFrame:
    """``registry`` with ``n`` more points, chosen greedily, with ``selection_rank`` (from 0) and ``selection_score``.

    The registered points are the seeds, which are not chosen again; ``region`` and ``layer`` restrict the
    candidates and seeds. A weight of an energy or uncertainty needs its column. The new rows replace equal
    (point, kind); ``replace_kind`` first deletes the kind.
    """
    for column, value in (("region", region), ("layer", layer)):
        if value is not None:
            points = points.where(F.col(column) == value)
    extra = []
    if energy_weight:
        if energy is None:
            raise ValueError("a weight of the energy needs its column")
        points = energy_component(points, energy, **energy_settings)
        extra.append(("energy_component", energy_weight))
    if uncertainty_weight:
        if uncertainty is None:
            raise ValueError("a weight of the uncertainty needs its column")
        extra.append((uncertainty, uncertainty_weight))
    seeds = registry.select("point_index").distinct()
    chosen = greedy_select(points, n, features, space, "point_index", seeds, real_weight, feature_weight, extra, scale)
    rows = registry.sparkSession.createDataFrame(
        [(int(i), kind, iteration, label_status, rank, float(score)) for rank, (i, score) in enumerate(chosen)],
        "point_index long, kind string, iteration int, label_status string, selection_rank long, selection_score double",
    )
    return upsert(registry, rows, ["point_index", "kind"], kind if replace_kind else None)


def propagate_archetypes(
    edges: DataFrame, nodes: DataFrame, selected: Sequence[int], mode: str = "diffusion", alpha: float = 0.9, most: int = 500,
    tolerance: float = 1e-8, confidence: float = 0.5, margin: float = 0.0, realspace_scale: float = 1.0, feature_scale: float = 1.0,
    use_nodes: bool = False,
) -> DataFrame:
    """The rows of ``nodes`` with the archetype that reaches each along the reweighted edges.

    ``selected`` lists the archetypes' points. Adds ``assigned_archetype_rank`` (place in that list) and
    ``assigned_archetype_index`` (its point), both -1 where ``is_ambiguous``; ``archetype_confidence``,
    ``archetype_margin`` and one ``archetype_score_<rank>`` each, 0 where an archetype does not reach.
    """
    if not 0 < alpha < 1 or most <= 0 or tolerance <= 0:
        raise ValueError("alpha must lie between 0 and 1, the rounds and the tolerance be positive")
    if not selected or len(set(selected)) != len(selected):
        raise ValueError("archetypes must be given, each once")
    seeds = nodes.sparkSession.createDataFrame([(int(i), rank) for rank, i in enumerate(selected)], "node long, label long")
    if lost := seeds.join(nodes, seeds.node == nodes.point_index, "left_anti").first():
        raise ValueError(f"archetype {lost[0]} is no node")
    scores = propagation_scores(reweight(edges, realspace_scale, feature_scale, use_nodes), seeds, mode, alpha, most, tolerance)
    best = assign(nodes.select(F.col("point_index").alias("node")), scores, confidence, margin)
    ranks = list(range(len(selected)))
    wide = scores.groupBy("node").pivot("label", ranks).agg(F.first("score"))
    wide = wide.select(F.col("node").alias("_node"), *[F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"archetype_score_{k}") for k in ranks])
    index = F.element_at(F.array(*[F.lit(int(i)).cast("long") for i in selected]), F.col("label").cast("int") + 1)
    best = best.select(
        F.col("node").alias("point_index"), F.col("label").alias("assigned_archetype_rank"),
        F.when(F.col("label") < 0, F.lit(-1).cast("long")).otherwise(index).alias("assigned_archetype_index"),
        F.col("confidence").alias("archetype_confidence"), F.col("margin").alias("archetype_margin"), "is_ambiguous",
    )
    out = nodes.join(best, "point_index").join(wide, F.col("point_index") == F.col("_node"), "left").drop("_node")
    return out.na.fill(0.0, [f"archetype_score_{k}" for k in ranks])


def radii_of(table: DataFrame, mode: str) -> DataFrame:
    """``symbol, radius`` of one mode of ``table(symbol, pauling, bondi, uff, muff)``; uff and muff are diameters."""
    factors = {"pauling": 1.0, "bondi": 1.0, "uff": 0.5, "muff": 0.5}
    if mode not in factors:
        raise ValueError(f"unknown radius mode: {mode}")
    return table.select("symbol", (F.col(mode).cast("double") * factors[mode]).alias("radius"))
