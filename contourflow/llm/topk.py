"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Vectors in a block and queries in a query block, at most about.
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
#: Norm boundaries that are kept; beyond so many blocks a norm range is shared by several.
MOST_RANGES = 512
#: Rotated coordinates that are summed before the residual bound decides.
HEAD = 12


def integers(vectors: DataFrame, id_col: str, vec_col: str, factor: float) -> DataFrame:
    """``(id, vec, norm, dim)`` of the rows that take part; ``vec`` holds floor(factor * x) as doubles, which is exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs, norms, dims = [], [], [], []
            for key, scalar in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not scalar.is_valid or scalar.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scalar.values.to_numpy(zero_copy_only=False).astype("<f8") * factor)
                if not np.isfinite(v).all():
                    continue
                top = np.abs(v).max(initial=0)
                ids.append(key)
                vecs.append((v + 0.0).tobytes())
                norms.append(float(top * np.sqrt(np.square(v / top).sum())) if top else 0.0)
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(norms, pa.float64()), pa.array(dims, pa.int32())],
                ["id", "vec", "norm", "dim"],
            )

    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col))
    return picked.mapInArrow(run, "id long, vec binary, norm double, dim int")


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the right singular vectors of its rows, by descending singular value.

    The Gram matrices are summed per partition and combined by key, so dim**2 rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            vecs = batch.column(0).to_pylist()
            for d in np.unique(dims):
                x = np.frombuffer(b"".join(vecs[i] for i in np.flatnonzero(dims == d)), "<f8").reshape(-1, d)
                x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=1), 1)
                sums[int(d)] = sums.get(int(d), 0) + x.T @ x
        for d, g in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(i), d, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "g": g[i, j]})

    parts = rows.select("vec", "dim").mapInArrow(run, "dim int, i int, j int, g double")
    table = parts.groupBy("dim", "i", "j").agg(F.sum("g").alias("g")).toArrow().to_pandas()
    found = {}
    for d, part in table.groupby("dim"):
        g = np.zeros((d, d))
        g[part.i, part.j] = part.g
        g[part.j, part.i] = part.g
        found[int(d)] = np.linalg.eigh(g)[1][:, ::-1]
    return found


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of integer-valued rows as longs; values beyond a long stop at its ends."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    a = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape)
    b = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    ends = np.iinfo(np.int64)
    return np.clip(a @ b.T, ends.min, ends.max).astype(np.int64)


def block_top(q: np.ndarray, qkey: np.ndarray, least: np.ndarray, x: np.ndarray, xkey: np.ndarray, order: np.ndarray, k: int, v: np.ndarray) -> list:
    """Per query of a block the ``k`` best rows of ``x`` as (query index, row index, score).

    Rows are taken by descending length in slices. A query leaves once its length times the slice's longest
    stays below its k-th best score (or the given lower bound ``least``); of the rest only rows are scored
    exactly whose head sum plus residual lengths can reach it. ``order`` ranks rows of equal score.
    """
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    qn = np.sqrt(np.einsum("ij,ij->i", q, q))
    by_norm = np.argsort(-norms, kind="stable")
    head = min(HEAD, x.shape[1])
    rx, rq = x @ v, q @ v
    tx = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", rx[:, head:], rx[:, head:])))
    tq = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", rq[:, head:], rq[:, head:])))
    floor = least.astype(np.float64)
    best: list[list[tuple[int, int, int]]] = [[] for _ in q]
    for s in range(0, len(x), 512):
        part = by_norm[s : s + 512]
        live = np.flatnonzero(qn * norms[part[0]] * (1 + 1e-9) + 1e-6 >= floor)
        if not len(live):
            break
        bound = rq[live, :head] @ rx[part, :head].T + tq[live, None] * tx[None, part]
        slack = 1e-9 * qn[live, None] * norms[None, part] + 1e-6
        may = bound + slack >= floor[live, None]
        rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(rows):
            continue
        scores = _exact(q[live[rows]], x[part[cols]])
        for r, row in zip(rows.tolist(), scores, strict=True):
            i = live[r]
            own = qkey[i] != xkey[part[cols]]
            ok = np.flatnonzero(own & may[r, cols] & (row >= floor[i]))
            if not len(ok):
                continue
            if len(ok) > k:
                cut = np.partition(row[ok], len(ok) - k)[len(ok) - k]
                ok = ok[row[ok] >= cut]
            best[i] += [(-int(row[c]), int(order[part[cols[c]]]), int(part[cols[c]])) for c in ok]
            best[i] = sorted(best[i])[:k]
            if len(best[i]) == k:
                floor[i] = max(floor[i], -best[i][-1][0])
    return [(i, c, -s) for i, found in enumerate(best) for s, _, c in found]


def top_inner_products(
    vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = 1024.0
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the highest integer inner product for each query.

    Components become ``floor(factor * x)`` in double precision. Queries are the rows for which ``query``,
    a condition on the column ``id``, holds; candidates are all rows but the query's own row. Ties go to the
    smaller id (null last). Rows whose vector is null or holds null or non-finite components take no part;
    vectors of different lengths are not compared; with fewer than ``k`` candidates all are returned.
    Scores beyond a long stop at its ends. Repeated rows are rows of their own, as query and as candidate.
    An empty table gives no rows.

    Blocks follow descending length. The longest block gives each query a first lower bound; all other
    blocks then meet every query block and prune by it, so nothing but bounds and ``k`` rows a block leaves
    a task.
    """
    rows = checkpoint(integers(vectors, id_col, vec_col, factor).withColumn("key", F.monotonically_increasing_id()))
    n = rows.count()
    queries = rows.where(query).toDF(*rows.columns)  # attributes of its own, to meet its own table
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    ranges = min(MOST_RANGES, blocks)
    cuts = rows.approxQuantile("norm", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if n and ranges > 1 else []
    share = math.ceil(blocks / ranges)
    above = F.lit(0)
    if cuts:
        above = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(cuts)]), lambda c: c > F.col("norm")))
    data = rows.withColumn("block", above * F.lit(share) + F.pmod(F.xxhash64("key"), F.lit(share)).cast("int"))
    nq = queries.count()
    parts = max(1, math.ceil(nq / QUERY_ROWS))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    turn = rotations(rows) if n else {}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qkey", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        d = left.column("dim")[0].as_py()
        q = np.frombuffer(b"".join(left.column("vec").to_pylist()), "<f8").reshape(left.num_rows, d)
        x = np.frombuffer(b"".join(right.column("vec").to_pylist()), "<f8").reshape(right.num_rows, d)
        ids = right.column("id").to_pylist()
        order = np.argsort(np.argsort([2**63 if i is None else i for i in ids], kind="stable"), kind="stable")
        qkey = left.column("key").to_numpy()
        found = block_top(q, qkey, left.column("least").to_numpy(), x, right.column("key").to_numpy(), order, k, turn.get(d, np.eye(d)))
        qids = left.column("id").to_pylist()
        return pa.table(
            {
                "qkey": pa.array([int(qkey[i]) for i, _, _ in found], pa.int64()),
                "query_id": pa.array([qids[i] for i, _, _ in found], pa.int64()),
                "vec_id": pa.array([ids[c] for _, c, _ in found], pa.int64()),
                "score": pa.array([s for _, _, s in found], pa.int64()),
            }
        )

    def meet(asks: DataFrame, have: DataFrame, numbers: list[int]) -> DataFrame:
        spread_q = asks.withColumn("block", F.explode(F.array(*[F.lit(b) for b in numbers])))
        spread_x = have.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ["dim", "part", "block"]
        return spread_q.groupBy(*keys).cogroup(spread_x.groupBy(*keys)).applyInArrow(
            run, "qkey long, query_id long, vec_id long, score long"
        )

    far = -(2.0**63)
    first = checkpoint(meet(asked.withColumn("least", F.lit(far)), data.where("block = 0"), [0]))
    rest = list(range(1, ranges * share))
    found = first
    if rest:
        bound = first.groupBy("qkey").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
        bound = bound.withColumnRenamed("qkey", "key")
        known = asked.join(bound, "key", "left").withColumn("least", F.coalesce("least", F.lit(far)))
        found = first.union(meet(known, data.where("block > 0"), rest))
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
