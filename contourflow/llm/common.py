"""What several corpus operators share: shared-storage checkpoints and connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker gives its free memory back: workers outlive their tasks, and
    what they keep adds up over the stages of a pipeline."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return trimmed


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only where that setting is absent and all work is done on one machine (tests) a temporary folder of our own
    is chosen; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="contourflow-"))
    return configured or sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        if spark.sparkContext._jsc is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage and cut its lineage; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: compressed, and later reads take only
    the columns they need. As with a checkpoint the lineage ends, and the loss of any executor is survived."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected long-to-long ``edges(a, b)`` as ``(node, root)``.

    ``root`` is the smallest node of the component. Alternating large-star and small-star rounds; every
    round is two partially aggregated minima and two equi-joins, so a hub is split by the skew join and no
    task gathers a component. Each round is checkpointed. Nodes without an edge do not appear; self-loops
    and repeated edges are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = checkpoint(e)
    sign = _signature(e)
    for _ in range(max_rounds):
        if sign[0] == 0:
            break
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hop = large.join(low, "a")
        small = hop.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hop.select("a", F.col("m").alias("b")))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        e = checkpoint(small)
        new = _signature(e)
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


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


def compressed(keyed: DataFrame) -> DataFrame:
    """``keyed`` with its text as ``z``, compressed, for a shuffle."""
    rest = [c for c in keyed.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(z, pa.binary())], [*rest, "z"])

    schema = ", ".join(f"`{c}` {t}" for c, t in keyed.select(*rest).dtypes)
    return keyed.select(*rest, "text").mapInArrow(lean(run), f"{schema}, z binary")


def keyed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``k1, k2``: 96 bits that tell texts and ids apart; rows repeated as a whole share them."""
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn(
        "k2", F.hash("text", "doc_id").cast("long").bitwiseAND(F.lit(2**31 - 1))
    )
