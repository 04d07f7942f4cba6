"""Embedding near-duplicates: int8 tile products with rigorous error bounds, recomputed where they cannot decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, forest

#: Vectors in a tile, at most about.
TILE_ROWS = 4096
#: Rows of a tile that are multiplied at once.
BLOCK_ROWS = 512
#: Tiles in each direction at least, so that a small table still spreads over many tasks.
LEAST_TILES = 8


def packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` with ``vec`` the components as little-endian doubles; null where the vector takes no part.

    That is: null vectors, empty or zero ones, and ones holding null or non-finite components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for scalar in batch.column(1):
                x = None if not scalar.is_valid else scalar.values
                if x is None or x.null_count or not len(x):
                    out.append(None)
                    continue
                v = x.to_numpy(zero_copy_only=False).astype("<f8")
                out.append((v + 0.0).tobytes() if np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col)).mapInArrow(run, "id long, vec binary")


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one without overflow or underflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales and error lengths: row ``i`` is ``scale[i] * code[i]`` plus a vector no longer than ``err[i]``."""
    scale = np.abs(u).max(axis=1) / 127
    code = np.rint(u / scale[:, None]).astype(np.int8)
    e = u - code * scale[:, None]
    return code, scale, np.sqrt(np.einsum("ij,ij->i", e, e)) * (1 + 1e-12) + 1e-15


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``x`` and ``y`` (``None``: pairs i < j within ``x``) with cosine >= threshold.

    For unit vectors ``u = s q + e`` and ``v = t r + f`` the exact product differs from ``s t (q . r)`` by
    at most ``(1 + |e|) |f| + |e|``. Codes are multiplied as floats, which is exact while
    ``dim * 127**2 < 2**24`` (else as doubles); pairs whose upper bound reaches the threshold are
    recomputed in double precision.
    """
    u = unit(x)
    v = u if y is None else unit(y)
    qx, sx, ex = quantise(u)
    qy, sy, ey = (qx, sx, ex) if y is None else quantise(v)
    kind = np.float32 if x.shape[1] * 127**2 < 2**24 else np.float64
    right = qy.astype(kind).T
    cut = (threshold - 2e-6 - ey * (1 + ex.max())).astype(np.float32)  # 2e-6: rounding of the float scaling
    found = []
    for i in range(0, len(u), BLOCK_ROWS):
        j0 = i if y is None else 0
        upper = (qx[i : i + BLOCK_ROWS].astype(kind) @ right[:, j0:]).astype(np.float32)
        upper *= sx[i : i + BLOCK_ROWS, None].astype(np.float32)
        upper *= sy[j0:].astype(np.float32)
        upper += ex[i : i + BLOCK_ROWS, None].astype(np.float32)
        a, b = np.nonzero(upper >= cut[j0:])
        a, b = a + i, b + j0
        if y is None:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 65536):
            p, q = a[k : k + 65536], b[k : k + 65536]
            good = np.einsum("ij,ij->i", u[p], v[q]) >= threshold
            found.append((p[good], q[good]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows link when the cosine of their vectors, in double precision, is at least ``threshold``
    (above 0). ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    reachable and ``kept`` marks the row that has it. Null, empty and zero vectors and ones with null or
    non-finite components link with nothing, nor do vectors of different lengths; such rows are their own
    component. Equal vectors are collapsed first and counted by multiplicity. Rows may repeat and ids may
    be null or shared (null ids sort last); other columns are ignored; an empty table gives no rows.

    Classes are dealt into tiles of bounded size; a task gets two tiles and returns per vector a partial
    link count and a spanning forest of its links, never the pairs of a dense group.
    """
    rows = checkpoint(packed(vectors, id_col, vec_col))
    valid = rows.where("vec is not null")
    classes = valid.groupBy("vec").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    classes = checkpoint(classes.withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    tiles = max(LEAST_TILES, math.ceil(n / TILE_ROWS))
    placed = classes.select(
        "cid", "copies", "vec", F.pmod(F.xxhash64("cid"), F.lit(tiles)).cast("int").alias("t"), F.length("vec").alias("dim")
    )
    cells = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        "dim", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "cid", "copies", "vec"
    )

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        t, cid = table.column("t").to_numpy(), table.column("cid").to_numpy()
        copies = table.column("copies").to_numpy()
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), "<f8").reshape(len(cid), -1)
        left, right = np.flatnonzero(t == i), np.flatnonzero(t == j)
        if not len(left) or not len(right):
            p = q = np.empty(0, np.int64)
        else:
            p, q = tile_links(x[left], None if i == j else x[right], threshold)
        p, q = left[p], right[q]
        degree = np.bincount(p, copies[q], len(cid)) + np.bincount(q, copies[p], len(cid))
        a, b = forest(cid[p], cid[q]) if len(p) else (cid[:0], cid[:0])
        some = np.flatnonzero(degree)
        return pa.table(
            {
                "a": np.concatenate([cid[some], a]),
                "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())]),
                "links": np.concatenate([degree[some].astype(np.int64), np.zeros(len(a), np.int64)]),
            }
        )

    found = checkpoint(cells.groupBy("dim", "i", "j").applyInArrow(run, "a long, b long, links long"))
    degrees = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    linked = components(found.where("b is not null").select("a", "b"))
    labelled = classes.join(linked, classes.cid == linked.node, "left").select(
        "cid", "vec", "copies", "low", F.coalesce("root", "cid").alias("root")
    )
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    labelled = labelled.join(lowest, "root").join(degrees, "cid", "left")
    labelled = labelled.select(
        F.col("vec").alias("v"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = valid.join(labelled, F.col("vec") == F.col("v")).select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(
        F.col("id").alias("vec_id"),
        "n_links",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
