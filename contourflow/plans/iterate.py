"""Iterative graph algorithms as DataFrame rounds with checkpoints on shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges that a task contracts at once.
MOST_EDGES = 1_000_000


def shared_path(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, which every executor can reach; removed when the driver ends.

    Only a local session without ``spark.checkpoint.dir`` gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="contourflow-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/round-{uuid.uuid4().hex}"

    def remove() -> None:
        if sc._jsc is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Materialises ``df`` below the checkpoint folder and cuts its lineage.

    It is written and read back rather than checkpointed: a checkpointed frame carries its size estimate along,
    and where a round joins a frame with itself that estimate's digits double in every round.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """``df`` for an equi-join in which both sides grow with the input: it is merged, never broadcast.

    The estimate of a settled frame is the size of its compressed files, so millions of rows would pass for a few
    megabytes and be gathered on the driver.
    """
    return df.hint("merge")


def until_stable(start: DataFrame, step: Callable[[DataFrame], DataFrame], signature: Callable[[DataFrame], tuple], most: int) -> DataFrame:
    """Repeats ``step`` until the signature stays; an error if that takes over ``most`` rounds."""
    now = settle(start)
    sign = signature(now)
    for _ in range(most):
        now = settle(step(now))
        new = signature(now)
        if new == sign:
            return now
        sign = new
    raise RuntimeError(f"no stable state in {most} rounds")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) that connect what the pairs ``a[i], b[i]`` connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all() and (label[x] == label[y]).all():
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as stars, a bounded number at a time."""
    held: list[pa.RecordBatch] = []

    def close() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        src, dst = forest(table["src"].to_numpy(), table["dst"].to_numpy())
        held.clear()
        return pa.RecordBatch.from_pydict({"src": src, "dst": dst})

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > MOST_EDGES:
            yield close()
    if held:
        yield close()


def components(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """``node, root``: the smallest node of each node's component, singletons included.

    ``nodes(node)``; ``edges(src, dst)`` in either direction or both, all longs. Tasks first turn their edges into
    stars. Then each round hangs every node's larger neighbours on its smallest one (large star) and a node's
    smaller neighbours on the smallest of them (small star) until only stars are left; a round is two partially
    aggregated minima and two equi-joins, so a hub is split by the skew join.
    """
    plain = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    stars = plain.mapInArrow(_contracted, "src long, dst long")

    def downwards(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def step(e: DataFrame) -> DataFrame:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(grown(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        hop = large.join(grown(large.groupBy("a").agg(F.min("b").alias("m"))), "a")
        return downwards(hop.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hop.select("a", F.col("m").alias("b"))))

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    done = until_stable(downwards(stars.toDF("a", "b")), step, signature, most)
    return nodes.select("node").join(grown(done), F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"))


def least_ancestors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node from which edges ``(src, dst)`` lead to each node, itself included.

    Nodes joined by edges in both directions are first taken together by :func:`components`. Only edges without
    their reverse take rounds, each an equi-join and a partially aggregated minimum: as many as the longest way
    that a root goes over such edges. Without any of them the components are the result.
    """
    plain = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct()
    way = F.count_if(F.col("src") < F.col("dst")) > 0, F.count_if(F.col("src") > F.col("dst")) > 0
    pairs = plain.groupBy(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).agg(way[0].alias("up"), way[1].alias("down"))
    pairs = settle(pairs)
    both = pairs.where("up and down").select(F.col("low").alias("src"), F.col("high").alias("dst"))
    joined = settle(components(nodes, both))
    single = pairs.where("not (up and down)").select(
        F.when(F.col("up"), F.col("low")).otherwise(F.col("high")).alias("src"), F.when(F.col("up"), F.col("high")).otherwise(F.col("low")).alias("dst")
    )
    at = [joined.select(F.col("node").alias(c), F.col("root").alias(r)) for c, r in (("src", "a"), ("dst", "b"))]
    ways = settle(single.join(grown(at[0]), "src").join(grown(at[1]), "dst").select("a", "b").where("a <> b").distinct())
    if ways.isEmpty():
        return joined

    def step(now: DataFrame) -> DataFrame:
        met = ways.join(grown(now), F.col("a") == F.col("node")).select(F.col("b").alias("node"), "root")
        return now.union(met).groupBy("node").agg(F.min("root").alias("root"))

    def signature(now: DataFrame) -> tuple:
        return tuple(now.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first())

    ends = ways.select(F.col("a").alias("node")).union(ways.select("b")).distinct()
    # roots only fall, so an equal sum is the same state; no way is longer than there are nodes at ends
    least = until_stable(ends.withColumn("root", F.col("node")), step, signature, ends.count() + 1)
    least = least.select(F.col("node").alias("end"), F.col("root").alias("least"))
    return joined.join(grown(least), F.col("root") == F.col("end"), "left").select("node", F.coalesce("least", "root").alias("root"))


def dense_numbers(labels: DataFrame) -> DataFrame:
    """``node, component``: components numbered from zero by their smallest node."""
    roots = labels.select("root").distinct()
    numbered = roots.withColumn("component", F.row_number().over(Window.orderBy("root")) - 1)
    return labels.join(grown(numbered), "root").select("node", F.col("component").cast("long").alias("component"))
