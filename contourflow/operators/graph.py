"""Point graphs: edges in real and feature space, weights, label propagation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import components, settle
from .tables import knn


def realspace_edges(neighbours: DataFrame, weight: float = 1.0) -> DataFrame:
    """``source, target, realspace_component`` from ``(point_index, neighbour)``: one weight per directed entry upwards."""
    e = neighbours.where((F.col("neighbour") >= 0) & (F.col("point_index") < F.col("neighbour")))
    return e.groupBy(F.col("point_index").alias("source"), F.col("neighbour").alias("target")).agg(
        (F.count("*") * F.lit(float(weight))).alias("realspace_component")
    )


def feature_edges(points: DataFrame, vector: str, k: int = 8, weight: float = 1.0, sigma: float | None = None, groups: Sequence[str] = (), tree: bool = False) -> DataFrame:
    """``source, target, feature_component``: similarities exp(-(d / sigma)^2) of k nearest neighbours.

    Mutual neighbours count twice. ``sigma`` is the median of the positive distances by default (1 if there
    is none). ``tree`` adds a minimum spanning tree over the k-NN graph and its components' nearest pairs.
    """
    near = settle(knn(points, "point_index", vector, k, groups))
    if sigma is None:
        sigma = near.where("distance > 0").agg(F.percentile("distance", 0.5)).first()[0] or 1.0
    s = F.greatest(F.exp(-(F.col("distance") / sigma) * (F.col("distance") / sigma)), F.lit(1e-12 if tree else 0.0))
    pairs = near.select(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target"), "distance", s.alias("s"))
    if tree:
        mst = spanning_tree(points, vector)
        pairs = pairs.unionByName(mst.select("source", "target", "distance", F.greatest(F.exp(-(F.col("distance") / sigma) ** 2), F.lit(1e-12)).alias("s")))
    return pairs.groupBy("source", "target").agg((F.sum("s") * F.lit(float(weight))).alias("feature_component"))


def _prim(v: np.ndarray, ids: np.ndarray) -> list[tuple[float, int, int]]:
    """The minimum spanning tree of points, sorted by id: (distance, source, target), equal distances ordered by the pair."""
    n = len(ids)
    gap, near = np.full(n, np.inf), np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    tree, now = [], 0
    for _ in range(n - 1):
        inside[now] = True
        d = np.zeros(n)
        for k in range(v.shape[1]):
            d += (v[:, k] - v[now, k]) ** 2
        lo, hi = np.minimum(ids, ids[near]), np.maximum(ids, ids[near])
        new_lo, new_hi = np.minimum(ids, ids[now]), np.maximum(ids, ids[now])
        better = (d < gap) | ((d == gap) & ((new_lo < lo) | ((new_lo == lo) & (new_hi < hi))))
        gap, near = np.where(better, d, gap), np.where(better, now, near)
        least = np.where(inside, np.inf, gap)
        tied = np.flatnonzero(least == least.min())
        lo, hi = np.minimum(ids[tied], ids[near[tied]]), np.maximum(ids[tied], ids[near[tied]])
        pick = np.lexsort((hi, lo))[0]
        now = int(tied[pick])
        tree.append((math.sqrt(gap[now]), int(lo[pick]), int(hi[pick])))
    return tree


def spanning_tree(points: DataFrame, vector: str, most_rounds: int = 40, block_rows: int = 2048) -> DataFrame:
    """``source, target, distance``: a minimum spanning tree of all points, equal distances ordered by the pair.

    Every edge of it is in the tree of any set of points that holds its ends. Each pair of blocks therefore
    returns the tree of its points alone; with several blocks Boruvka rounds choose among these edges.
    """
    rows = settle(points.select(F.col("point_index").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")))
    blocks = max(1, math.ceil(rows.count() / block_rows))
    placed = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # pairs of different blocks; where there are two blocks or more these hold every pair of points
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: (o != F.col("b")) | F.lit(blocks == 1))
    each = placed.withColumn("o", F.explode(others)).select(F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "id", "v")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        tree = _prim(table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1), ids) if len(ids) > 1 else []
        kinds = {"distance": pa.float64(), "source": pa.int64(), "target": pa.int64()}
        return pa.table({c: pa.array([t[k] for t in tree], kind) for k, (c, kind) in enumerate(kinds.items())})

    edges = settle(each.groupBy("bi", "bj").applyInArrow(run, "distance double, source long, target long").distinct())
    columns = ["source", "target", "distance"]
    if blocks < 3:
        return edges.select(*columns)
    nodes = rows.select(F.col("id").alias("node"))
    labels, tree = settle(nodes.withColumn("root", F.col("node"))), None
    for _ in range(most_rounds):
        a, b = (labels.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in ("source", "target"))
        edges = settle(edges.select("distance", "source", "target").join(a, "source").join(b, "target").where("source_root <> target_root"))
        if edges.isEmpty():
            return tree.select(*columns)
        ends = F.explode(F.array("source_root", "target_root")).alias("root")
        least = edges.select(ends, F.struct("distance", "source", "target").alias("m")).groupBy("root").agg(F.min("m").alias("m"))
        least = least.select("m.*").distinct()
        tree = settle(least if tree is None else tree.union(least))
        labels = components(nodes, tree.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    raise RuntimeError(f"the tree is not whole after {most_rounds} rounds")


def node_weights(nodes: DataFrame, column: str = "probability") -> DataFrame:
    """Adds ``node_weight``: the column over its maximum; all ones where none is positive."""
    top = nodes.agg(F.max(column).alias("_top"))
    return nodes.crossJoin(F.broadcast(top)).withColumn(
        "node_weight", F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(1.0)
    ).drop("_top")


def weigh_edges(edges: DataFrame, nodes: DataFrame, use_nodes: bool = True, directions: Sequence[str] | None = None, directional_weight: float = 0.0, power: float = 1.0) -> DataFrame:
    """The edge table: alignment, directional and node factors, and ``weight``.

    ``edges`` has ``realspace_component`` and ``feature_component``; ``nodes`` has ``point_index, x, y, z,
    node_weight`` and the direction columns. Alignment is that of the edge with the mean unit direction.
    """
    cols = ["x", "y", "z", "node_weight", *(directions or [])]
    a = nodes.select(F.col("point_index").alias("source"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = nodes.select(F.col("point_index").alias("target"), *[F.col(c).alias(f"b_{c}") for c in cols])
    e = edges.join(a, "source").join(b, "target")
    align = F.lit(0.0)
    if directions:
        unit = lambda side: [F.col(f"{side}_{c}") / F.greatest(F.sqrt(sum((F.col(f"{side}_{d}") ** 2 for d in directions), F.lit(0.0))), F.lit(1e-300)) for c in directions]
        mean = [(p + q) / 2 for p, q in zip(unit("a"), unit("b"), strict=True)]
        step = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"]
        size = lambda v: F.sqrt(sum((c * c for c in v), F.lit(0.0)))
        dot = sum((s * m for s, m in zip(step, mean, strict=True)), F.lit(0.0))
        norm = size(step) * size(mean)
        align = F.when(norm > 0, F.abs(dot) / norm).otherwise(0.0)
    e = e.withColumn("directional_alignment", align).withColumn("directional_factor", 1.0 + directional_weight * F.pow(F.col("directional_alignment"), F.lit(float(power))))
    e = e.withColumn("node_factor", F.sqrt(F.col("a_node_weight") * F.col("b_node_weight")) if use_nodes else F.lit(1.0))
    weight = (F.col("realspace_component") * F.col("directional_factor") + F.col("feature_component")) * F.col("node_factor")
    return e.select("source", "target", "realspace_component", "feature_component", "directional_alignment", "directional_factor", "node_factor", weight.alias("weight"))


def build_graph(nodes: DataFrame, neighbours: DataFrame | None, mode: str = "hybrid", vector: str | None = None, k: int = 8, realspace_weight: float = 1.0, feature_weight: float = 1.0, groups: Sequence[str] = (), connectivity: str = "knn", column: str = "probability", **weights) -> DataFrame:
    """The edge table of a graph in ``realspace``, ``feature`` or ``hybrid`` mode."""
    if mode not in ("realspace", "feature", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    parts = []
    if mode != "feature":
        parts.append(realspace_edges(neighbours, realspace_weight).withColumn("feature_component", F.lit(0.0)))
    if mode != "realspace":
        e = feature_edges(nodes, vector, k, feature_weight, groups=groups, tree=connectivity == "knn_mst")
        parts.append(e.select("source", "target", F.lit(0.0).alias("realspace_component"), "feature_component"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    merged = both.groupBy("source", "target").agg(F.sum("realspace_component").alias("realspace_component"), F.sum("feature_component").alias("feature_component"))
    return weigh_edges(merged, node_weights(nodes, column), **weights)


def reweight(edges: DataFrame, realspace_scale: float = 1.0, feature_scale: float = 1.0, use_nodes: bool = False) -> DataFrame:
    """Edges with rescaled components; those that are not positive drop out."""
    if "realspace_component" not in edges.columns:
        return edges.where("weight > 0")
    w = F.col("realspace_component") * realspace_scale * F.col("directional_factor") + F.col("feature_component") * feature_scale
    if use_nodes:
        w = w * F.col("node_factor")
    return edges.withColumn("weight", w).where("weight > 0")


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges among ``nodes(point_index)`` with dense ids from zero in the order of the points."""
    ids = nodes.select("point_index").distinct()
    dense = ids.withColumn("_n", F.row_number().over(Window.orderBy("point_index")) - 1)
    a = dense.select(F.col("point_index").alias("source"), F.col("_n").alias("s"))
    b = dense.select(F.col("point_index").alias("target"), F.col("_n").alias("t"))
    return edges.join(a, "source").join(b, "target").drop("source", "target").withColumnsRenamed({"s": "source", "t": "target"})


def _both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("weight").alias("w"))
    return e.union(e.select("dst", "src", "w"))


def diffusion_step(links: DataFrame, scores: DataFrame, seeds: DataFrame, alpha: float = 0.9) -> DataFrame:
    """One round: alpha times the weighted mean of the neighbours' scores plus (1 - alpha) times the target; seeds stay.

    ``links(src, dst, w)`` both ways, ``scores(node, label, score)``, ``seeds(node, label)``.
    """
    degree = links.groupBy("src").agg(F.sum("w").alias("d"))
    spread = links.join(scores, links.dst == scores.node).groupBy("src", "label").agg(F.sum(F.col("w") * F.col("score")).alias("s"))
    moved = spread.join(degree, "src").select(F.col("src").alias("node"), "label", (alpha * F.col("s") / F.col("d")).alias("score"))
    moved = moved.join(seeds.select("node"), "node", "left_anti")
    return moved.union(seeds.select("node", "label", F.lit(1.0).alias("score")))


def diffuse(edges: DataFrame, seeds: DataFrame, alpha: float = 0.9, most: int = 500, tolerance: float = 1e-8, every: int = 5) -> DataFrame:
    """Scores by diffusion until no score changes by ``tolerance``; checkpointed every few rounds."""
    links = settle(_both_ways(edges))
    now = settle(seeds.select("node", "label", F.lit(1.0).alias("score")))
    for r in range(1, most + 1):
        new = diffusion_step(links, now, seeds, alpha)
        if r % every == 0:
            new = settle(new)
            old = now.select("node", "label", F.col("score").alias("old"))
            change = new.join(old, ["node", "label"], "full").agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            now = new
            if change is None or change < tolerance:
                break
        else:
            now = new
    total = now.groupBy("node").agg(F.sum("score").alias("t"))
    return now.join(total, "node").select("node", "label", (F.col("score") / F.col("t")).alias("score"))


def _relax(edges: DataFrame, start: DataFrame, combine, better, most: int) -> DataFrame:
    """Label-wise relaxation of ``start(node, label, value)`` along the edges until nothing improves; raises if that takes over ``most`` rounds."""
    links = settle(_both_ways(edges))
    now, sign = settle(start), None
    for _ in range(most):
        moved = links.join(now, links.dst == now.node).select(F.col("src").alias("node"), "label", combine(F.col("value"), F.col("w")).alias("value"))
        now = settle(now.union(moved).groupBy("node", "label").agg(better("value").alias("value")))
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("node", "label", "value").cast("decimal(38,0)"))).first())
        if new == sign:
            return now
        sign = new
    raise RuntimeError(f"paths did not settle in {most} rounds")


def shortest_paths(edges: DataFrame, seeds: DataFrame, most: int = 1000) -> DataFrame:
    """``node, label, distance`` with cost 1 / max(weight, 1e-12): the least over a label's seeds."""
    start = seeds.select("node", "label", F.lit(0.0).alias("value"))
    cost = lambda v, w: v + 1.0 / F.greatest(w, F.lit(1e-12))
    return _relax(edges, start, cost, F.min, most).withColumnRenamed("value", "distance")


def widest_paths(edges: DataFrame, seeds: DataFrame, most: int = 1000) -> DataFrame:
    """``node, label, capacity``: the largest least weight on a path to a seed; a seed's is infinite."""
    start = seeds.select("node", "label", F.lit(float("inf")).alias("value"))
    return _relax(edges, start, lambda v, w: F.least(v, w), F.max, most).withColumnRenamed("value", "capacity")


def hop_counts(edges: DataFrame, seeds: DataFrame, most: int = 1000) -> DataFrame:
    """``node, label, hops`` by breadth-first levels."""
    start = seeds.select("node", "label", F.lit(0.0).alias("value"))
    return _relax(edges, start, lambda v, w: v + 1.0, F.min, most).withColumnRenamed("value", "hops")


def propagation_scores(edges: DataFrame, seeds: DataFrame, mode: str = "diffusion", alpha: float = 0.9, most: int = 500, tolerance: float = 1e-8) -> DataFrame:
    """``node, label, score``, rows normalised, seeds one-hot, for any of the four propagation modes."""
    if mode == "diffusion":
        return diffuse(edges, seeds, alpha, most, tolerance)
    if mode not in ("shortest_path", "watershed", "region_grow"):
        raise ValueError(f"unknown mode: {mode}")
    near = shortest_paths(edges, seeds, most).withColumn("close", 1.0 / (1.0 + F.col("distance")))
    if mode == "shortest_path":
        raw = near.select("node", "label", F.col("close").alias("score"))
    elif mode == "watershed":
        wide = widest_paths(edges, seeds, most)
        top = wide.where(F.col("capacity") < float("inf")).agg(F.greatest(F.max("capacity"), F.lit(1.0)).alias("top"))
        wide = wide.crossJoin(F.broadcast(top)).withColumn("capacity", F.when(F.col("capacity") == float("inf"), F.coalesce("top", F.lit(1.0))).otherwise(F.col("capacity")))
        raw = wide.join(near, ["node", "label"]).select("node", "label", (F.col("capacity") + 1e-6 * F.col("close")).alias("score"))
    else:
        hops = hop_counts(edges, seeds, most)
        least = hops.groupBy("node").agg(F.min("hops").alias("m"))
        first = hops.join(least, "node").where("hops = m").select("node", "label")
        raw = first.join(near, ["node", "label"]).select("node", "label", F.col("close").alias("score"))
    raw = raw.join(seeds.select("node"), "node", "left_anti").union(seeds.select("node", "label", F.lit(1.0).alias("score")))
    total = raw.groupBy("node").agg(F.sum("score").alias("t"))
    return raw.join(total, "node").select("node", "label", F.when(F.col("t") > 0, F.col("score") / F.col("t")).otherwise(0.0).alias("score"))


def assign(nodes: DataFrame, scores: DataFrame, confidence: float = 0.0, margin: float = 0.0) -> DataFrame:
    """``node, label, confidence, margin, is_ambiguous``: the best label, -1 where it is missing or too weak."""
    best = Window.partitionBy("node").orderBy(F.desc("score"), F.asc("label"))
    two = scores.withColumn("r", F.row_number().over(best)).where("r <= 2").groupBy("node").agg(
        F.max(F.when(F.col("r") == 1, F.col("label"))).alias("label"),
        F.max(F.when(F.col("r") == 1, F.col("score"))).alias("confidence"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
    )
    out = nodes.select("node").join(two, "node", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    out = out.withColumn("margin", F.col("confidence") - F.coalesce("second", F.lit(0.0)))
    weak = (F.col("confidence") <= 0) | (F.col("confidence") < confidence) | (F.col("margin") < margin)
    return out.select("node", F.when(weak, -1).otherwise(F.col("label")).cast("long").alias("label"), "confidence", "margin", weak.alias("is_ambiguous"))


def endpoint_scores(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], weights: tuple[float, float, float] = (1.0, 1.0, 0.5)) -> DataFrame:
    """``point_index, branching, endpointness, geodesic, score`` of each node of an induced graph.

    Branching falls with the weighted degree, endpointness is the length of the weighted mean unit direction
    to the neighbours, geodesic the distance from the component's node of highest degree over its maximum
    (1 for a lone node).
    """
    from .tables import normalize

    links = settle(_both_ways(edges))
    feats = nodes.select("point_index", *columns)
    a = feats.select(F.col("point_index").alias("src"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = feats.select(F.col("point_index").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in columns])
    step = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in columns]
    size = F.greatest(F.sqrt(sum((s * s for s in step), F.lit(0.0))), F.lit(1e-300))
    sums = links.join(a, "src").join(b, "dst").groupBy("src").agg(F.sum("w").alias("degree"), *[F.sum(F.col("w") * s / size).alias(f"u{i}") for i, s in enumerate(step)])
    length = F.sqrt(sum((F.col(f"u{i}") ** 2 for i in range(len(columns))), F.lit(0.0)))
    local = nodes.select("point_index").join(sums.select(F.col("src").alias("point_index"), "degree", (length / F.col("degree")).alias("endpointness")), "point_index", "left").na.fill(0.0)
    root = components(nodes.select(F.col("point_index").alias("node")), edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    local = local.join(root, local.point_index == root.node).drop("node")
    hub = local.groupBy("root").agg(F.max_by("point_index", F.struct("degree", -F.col("point_index"))).alias("node"), F.count("*").alias("n"))
    far = shortest_paths(edges, hub.select("node", F.lit(0).alias("label"))).select(F.col("node").alias("point_index"), "distance")
    local = local.join(far, "point_index", "left").join(hub.select("root", "n"), "root")
    top = local.groupBy("root").agg(F.max("distance").alias("top"))
    local = local.join(top, "root").withColumn("geodesic", F.when(F.col("n") == 1, 1.0).when(F.col("top") > 0, F.col("distance") / F.col("top")).otherwise(0.0))
    local = normalize(local, "degree", "_d", constant=1.0).withColumn("branching", 1.0 - F.col("_d"))
    e, g, br = weights
    raw = local.withColumn("raw", e * F.col("endpointness") + g * F.col("geodesic") + br * F.col("branching"))
    return normalize(raw, "raw", "score", constant=1.0).select("point_index", "branching", "endpointness", "geodesic", "score")
