"""Reduction and clustering of feature tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.iterate import forest

#: Points up to which methods that need a dense matrix of a graph are allowed.
MOST_DENSE = 5_000
#: Points up to which the affinity of features is one matrix; beyond, tasks make its blocks of so many entries.
MOST_AFFINE = 2_000
BLOCK_ENTRIES = 1 << 25
METHODS = ("spectral", "gaussian_mixture", "kmeans", "agglomerative")


def _vector(columns: Sequence[str]) -> F.Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


# --- principal components -----------------------------------------------------
def covariance(df: DataFrame, columns: Sequence[str], scale: bool = False) -> DataFrame:
    """``i, j, c``: population covariances (correlations with ``scale``), one aggregation of the upper triangle."""
    f = F.corr if scale else F.covar_pop
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.agg(*[f(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("c")) for i, j in pairs])
    return one.select(F.inline(rows))


class PCA:
    """Full principal component analysis by the covariance matrix; the largest loading of each component is positive."""

    def __init__(self, df: DataFrame, columns: Sequence[str], scale: bool = False):
        self.columns, self.scale = list(columns), scale
        n = len(columns)
        stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        self.mean = np.array([stats[f"m{i}"] for i in range(n)])
        std = np.array([stats[f"s{i}"] for i in range(n)])
        self.std = np.where(std > 0, std, 1.0) if scale else np.ones(n)
        matrix = np.zeros((n, n))
        for r in covariance(df, columns).collect():
            matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["c"] / (self.std[r["i"]] * self.std[r["j"]])
        values, vectors = np.linalg.eigh(matrix)
        order = np.argsort(-values)
        self.components = vectors[:, order].T
        self.components *= np.sign(self.components[np.arange(n), np.abs(self.components).argmax(axis=1)])[:, None]
        variance = np.maximum(values[order], 0)
        self.explained_variance_ratio = variance / variance.sum() if variance.sum() > 0 else variance
        self.cumulative = np.cumsum(self.explained_variance_ratio)

    def project(self, df: DataFrame, npca: int) -> DataFrame:
        """All rows with ``pca0 ...``."""
        if not 1 <= npca <= len(self.columns):
            raise ValueError(f"npca must lie in 1..{len(self.columns)}")
        parts = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.std, strict=True)]
        scores = [sum((p * float(w) for p, w in zip(parts, row, strict=True)), F.lit(0.0)) for row in self.components[:npca]]
        return df.withColumns({f"pca{k}": s for k, s in enumerate(scores)})


# --- tables of a clustering ------------------------------------------------------
def centers(df: DataFrame, columns: Sequence[str], label: str = "Cluster") -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])


def sizes(df: DataFrame, label: str = "Cluster") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("size"))


def relabel(df: DataFrame, columns: Sequence[str], label: str = "Cluster") -> DataFrame:
    """Clusters renumbered by the lexicographic order of their centres; equal centres keep their order."""
    rank = F.row_number().over(Window.orderBy(*columns, label)) - 1
    new = centers(df, columns, label).withColumn("_new", rank).select(label, "_new")
    return df.join(F.broadcast(new), label).drop(label).withColumnRenamed("_new", label)


def cluster_graph(labels: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``ci, cj, edges``: both directions of every neighbour entry counted and halved; the diagonal has twice its edges."""
    a = labels.select(F.col("point_index"), F.col("Cluster").alias("ci"))
    b = labels.select(F.col("point_index").alias("neighbour"), F.col("Cluster").alias("cj"))
    e = neighbours.join(a, "point_index").join(b, "neighbour").where("ci >= 0 and cj >= 0")
    both = e.select("ci", "cj").union(e.select("cj", "ci"))
    return both.groupBy("ci", "cj").agg(F.expr("count(*) div 2").alias("edges"))


def silhouette_by_blocks(df: DataFrame, columns: Sequence[str], label: str = "Cluster", key: str = "point_index") -> DataFrame:
    """``key, silhouette`` with Euclidean distances: mean distances to every cluster by block products, no pair leaves a task."""
    import math

    n = df.count()
    blocks = max(2, math.ceil(n / 4096))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("c"), _vector(columns).alias("v"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    each = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = each.select(F.col("b").alias("bi"), F.col("o").alias("bj"), F.lit(0).alias("side"), "id", "c", "v")
    gives = each.select(F.col("o").alias("bi"), F.col("b").alias("bj"), F.lit(1).alias("side"), "id", "c", "v")

    def run(table: pa.Table) -> pa.Table:
        side, ids, c = (table.column(k).to_numpy() for k in ("side", "id", "c"))
        v = np.array(table.column("v").to_pylist(), float)
        q, x = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        kinds, at = np.unique(c[x], return_inverse=True)
        hot = np.eye(len(kinds))[at] if len(x) else np.zeros((0, 0))
        out = []
        for s in range(0, len(q) if len(x) else 0, 256):
            part = q[s : s + 256]
            d = np.sqrt(((v[part, None, :] - v[None, x, :]) ** 2).sum(axis=2))
            out.append((np.repeat(ids[part], len(kinds)), np.repeat(c[part], len(kinds)), np.tile(kinds, len(part)), (d @ hot).ravel()))
        cat = lambda k, t: np.concatenate([o[k] for o in out]) if out else np.empty(0, t)
        return pa.table({"id": cat(0, np.int64), "own": cat(1, np.int64), "other": cat(2, np.int64), "total": cat(3, float)})

    sums = asks.union(gives).groupBy("bi", "bj").applyInArrow(run, "id long, own long, other long, total double")
    counts = rows.groupBy(F.col("c").alias("other")).agg(F.count("*").alias("m"))
    sums = sums.groupBy("id", "own", "other").agg(F.sum("total").alias("total")).join(F.broadcast(counts), "other")
    a = F.max(F.when((F.col("own") == F.col("other")) & (F.col("m") > 1), F.col("total") / (F.col("m") - 1)))
    b = F.min(F.when(F.col("own") != F.col("other"), F.col("total") / F.col("m")))
    both = sums.groupBy(F.col("id").alias(key)).agg(a.alias("a"), b.alias("b"))
    return both.select(key, F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def davies_bouldin(df: DataFrame, columns: Sequence[str], label: str = "Cluster") -> DataFrame:
    """``davies_bouldin``: the mean over clusters of the worst (spread + spread) / distance of centres."""
    c = centers(df, columns, label).select(F.col(label).alias("_l"), *[F.col(x).alias(f"c_{x}") for x in columns])
    square = sum(((F.col(x) - F.col(f"c_{x}")) ** 2 for x in columns), F.lit(0.0))
    spread = df.join(F.broadcast(c), F.col(label) == F.col("_l")).groupBy("_l").agg(F.avg(F.sqrt(square)).alias("s"))
    table = c.join(spread, "_l")
    a = table.select(F.col("_l").alias("la"), F.col("s").alias("sa"), *[F.col(f"c_{x}").alias(f"a_{x}") for x in columns])
    b = table.select(F.col("_l").alias("lb"), F.col("s").alias("sb"), *[F.col(f"c_{x}").alias(f"b_{x}") for x in columns])
    apart = F.sqrt(sum(((F.col(f"a_{x}") - F.col(f"b_{x}")) ** 2 for x in columns), F.lit(0.0)))
    worst = a.join(F.broadcast(b), F.col("la") != F.col("lb")).groupBy("la").agg(F.max(F.when(apart > 0, (F.col("sa") + F.col("sb")) / apart).otherwise(0.0)).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"))


# --- methods -----------------------------------------------------------------------
def ward_chain(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of Ward's agglomeration down to ``k`` clusters in linear memory, by chains of nearest neighbours.

    Clusters that are each other's nearest merge at once; Ward's distance never falls by a merge, so the merges
    in order of their heights are those of the greedy method.
    """
    if not np.isfinite(x).all():
        raise ValueError("features must be finite")
    n = len(x)
    center, size, ids = x - x.mean(axis=0) if n else x.astype(float), np.ones(n), np.arange(n)
    # each step looks at all clusters in single precision; what may be nearest within its error is looked at again
    wide = (center**2).sum(axis=1)
    error = 4 * (16 + 4 * x.shape[1]) * np.finfo(np.float32).eps * wide.max(initial=0.0)
    columns, norm, count = center.T.astype(np.float32, order="C"), wide.astype(np.float32), size.astype(np.float32)
    heights, pairs, chain, left = [], [], [], n
    while left > 1:
        if 10 * left < 9 * len(ids):
            alive = np.isfinite(norm)
            place = np.cumsum(alive) - 1
            center, size, ids, chain = center[alive], size[alive], ids[alive], place[chain].tolist()
            columns, norm, count = np.ascontiguousarray(columns[:, alive]), norm[alive], count[alive]
        if not chain:
            chain.append(int(np.isfinite(norm).argmax()))
        tip = chain[-1]
        rough = columns[:, tip] @ columns
        rough *= -2
        rough += norm
        rough += norm[tip]
        rough *= count / (count + count[tip])
        rough[tip] = np.inf
        some = np.flatnonzero(rough <= rough.min() + error)
        step = center[some] - center[tip]
        # the same from either side, else ties could go in circles
        d = np.einsum("ij,ij->i", step, step) * (size[some] * size[tip] / (size[some] + size[tip]))
        near, height = int(some[d.argmin()]), d.min()
        if len(chain) < 2 or not (some[d == height] == chain[-2]).any():
            chain.append(near)
            continue
        i, j = sorted((tip, chain[-2]))
        heights.append(height)
        pairs.append((ids[i], ids[j]))
        center[i] = (size[i] * center[i] + size[j] * center[j]) / (size[i] + size[j])
        size[i] += size[j]
        columns[:, i], norm[i], count[i] = center[i], (center[i] ** 2).sum(), size[i]
        norm[j] = np.inf  # and so are the distances to a cluster that is gone
        del chain[-2:]
        left -= 1
    first = np.argsort(heights, kind="stable")[: max(n - k, 0)]
    label = np.arange(n)
    if len(first):
        node, root = forest(*np.array(pairs, np.int64)[first].T)
        label[node] = root
    return np.unique(label, return_inverse=True)[1]


def ward(x: np.ndarray, k: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """Labels of Ward's agglomeration down to ``k`` clusters; ``allowed`` restricts merges to linked clusters."""
    if allowed is None:
        return ward_chain(x, k)
    n = len(x)
    size, alive = np.ones(n), np.ones(n, bool)
    center = x.astype(float).copy()
    label = np.arange(n)
    d = ((center[:, None] - center[None]) ** 2).sum(axis=2) / 2
    np.fill_diagonal(d, np.inf)
    link = allowed | allowed.T
    left = n
    while left > k:
        masked = d if link is None else np.where(link, d, np.inf)
        at = int(masked.argmin())
        i, j = sorted(divmod(at, n))
        if not np.isfinite(masked[i, j]):
            link = None
            continue
        center[i] = (size[i] * center[i] + size[j] * center[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
        d[j, :] = d[:, j] = np.inf
        new = size[i] * size / (size[i] + size) * ((center - center[i]) ** 2).sum(axis=1)
        new[~alive] = np.inf
        new[i] = np.inf
        d[i, :] = d[:, i] = new
        if link is not None:
            link[i] |= link[j]
            link[:, i] |= link[:, j]
            link[i, i] = False
        left -= 1
    return np.unique(label, return_inverse=True)[1]


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, tries: int = 10) -> np.ndarray:
    best, labels = np.inf, np.zeros(len(x), int)
    for _ in range(tries):
        c = [x[rng.integers(len(x))]]
        for _ in range(k - 1):
            d = np.min([((x - m) ** 2).sum(axis=1) for m in c], axis=0)
            c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(c)
        for _ in range(100):
            lab = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[lab == j].mean(axis=0) if (lab == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[lab]) ** 2).sum()
        if cost < best:
            best, labels = cost, lab
    return labels


def spectral(affinity: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Labels from the leading eigenvectors of the normalised affinity."""
    degree = np.maximum(affinity.sum(axis=1), 1e-12)
    root = 1 / np.sqrt(degree)
    _, vectors = np.linalg.eigh(root[:, None] * affinity * root[None])
    embedding = vectors[:, -k:] * root[:, None]
    return _lloyd(embedding, k, np.random.default_rng(seed))


def gaussian_products(spark: SparkSession, x: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The product of exp(-|x_i - x_j|^2) with the columns of a matrix; tasks make blocks of rows and keep none."""
    n = len(x)
    x = x - x.mean(axis=0)
    square = (x**2).sum(axis=1)
    # the exponent is one product of matrices
    left, right = np.column_stack([2 * x, -square, -np.ones(n)]), np.vstack([x.T, np.ones(n), square])
    sent = spark.sparkContext.broadcast((left, right))
    blocks = min(n, max(spark.sparkContext.defaultParallelism, -(-n * n // BLOCK_ENTRIES)))
    bounds = [n * b // blocks for b in range(blocks + 1)]

    def product(v: np.ndarray) -> np.ndarray:
        matrix = spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (left, right), v = sent.value, matrix.value
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    rows = left[bounds[b] : bounds[b + 1]]
                    made = np.zeros((len(rows), v.shape[1]))
                    for r in range(0, len(rows), 256):
                        for c in range(0, n, 1024):
                            d = rows[r : r + 256] @ right[:, c : c + 1024]
                            made[r : r + 256] += np.exp(d, out=d) @ v[c : c + 1024]
                    yield pa.RecordBatch.from_pydict({"at": pa.array([bounds[b]]), "made": pa.array([made.tobytes()], pa.binary())})

        out = np.empty(v.shape)
        for r in spark.range(0, blocks, 1, blocks).mapInArrow(run, "at long, made binary").collect():
            made = np.frombuffer(r["made"], float).reshape(-1, v.shape[1])
            out[r["at"] : r["at"] + len(made)] = made
        matrix.destroy()
        return out

    return product


def leading_vectors(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, seed: int = 0, tolerance: float = 1e-10, most: int = 200) -> np.ndarray:
    """The ``k`` leading eigenvectors, least first, of a symmetric matrix given by its products with blocks of columns.

    A basis grows by the residuals of its Ritz vectors (block Davidson, restarted) until those of the wanted
    ones are below ``tolerance``; an error if that takes over ``most`` products.
    """
    width = min(n, 2 * k + 8)
    basis = image = np.empty((n, 0))
    fresh = np.random.default_rng(seed).normal(size=(n, width))
    for _ in range(most):
        for _ in range(2):
            fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]
        basis, image = np.hstack([basis, fresh]), np.hstack([image, product(fresh)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1]
        ritz = basis @ turn[:, :width]
        fresh = image @ turn[:, :width] - ritz * values
        if np.linalg.norm(fresh[:, :k], axis=0).max() <= tolerance * abs(values[0]):
            return ritz[:, :k][:, ::-1]
        if basis.shape[1] + width > min(n, 6 * width):
            basis, image = ritz, image @ turn[:, :width]
        fresh = fresh[:, : n - basis.shape[1]]
    raise RuntimeError(f"no eigenvectors in {most} products")


def spectral_by_blocks(spark: SparkSession, x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The labels of :func:`spectral` for the affinity exp(-|x_i - x_j|^2), of which no task holds more than some rows."""
    affine = gaussian_products(spark, x)
    root = 1 / np.sqrt(np.maximum(affine(np.ones((len(x), 1))), 1e-12))
    vectors = leading_vectors(lambda v: root * affine(root * v), len(x), k)
    return _lloyd(vectors * root, k, np.random.default_rng(seed))


def fit_predict(df: DataFrame, columns: Sequence[str], method: str, k: int, seed: int = 0, edges: DataFrame | None = None, key: str = "point_index") -> DataFrame:
    """``df`` with ``Cluster``.

    K-means (ten seeds, the least cost) and Gaussian mixtures run distributed. Spectral clustering of features
    makes its affinity by blocks in tasks, Ward's method follows chains of neighbours on the driver; both take any
    number of points, with work that grows as its square. Spectral clustering of a graph given as edges runs by
    power iteration when there are over ``MOST_DENSE`` points; Ward's method refuses a graph of more. Graphs are
    refused by k-means and mixtures.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if edges is not None and method in ("kmeans", "gaussian_mixture"):
        raise ValueError(f"{method} takes no graph")
    if method in ("kmeans", "gaussian_mixture"):
        data = df.withColumn("_v", array_to_vector(_vector(columns))).cache()
        if method == "kmeans":
            fits = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="Cluster").fit(data) for i in range(10)]
            model = min(fits, key=lambda m: m.summary.trainingCost)
        else:
            model = GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol="Cluster", probabilityCol="_p").fit(data)
        return model.transform(data).drop("_v", "_p")
    if edges is not None and df.limit(MOST_DENSE + 1).count() > MOST_DENSE:
        if method == "spectral":
            found = PowerIterationClustering(k=k, weightCol="weight", srcCol="source", dstCol="target").assignClusters(edges)
            return df.join(found.select(F.col("id").alias(key), F.col("cluster").alias("Cluster")), key)
        raise ValueError(f"{method} of a graph takes at most {MOST_DENSE} points")
    pdf = df.select(key, *columns).orderBy(key).toPandas()
    x = pdf[list(columns)].to_numpy(float)
    matrix = None
    if edges is not None:
        at = {p: i for i, p in enumerate(pdf[key])}
        matrix = np.zeros((len(pdf), len(pdf)))
        for r in edges.select("source", "target", "weight").toLocalIterator():
            i, j = at[r["source"]], at[r["target"]]
            matrix[i, j] = matrix[j, i] = r["weight"]
    if method == "agglomerative":
        labels = ward(x, k, None if matrix is None else matrix > 0)
    elif matrix is None and len(x) > MOST_AFFINE:
        labels = spectral_by_blocks(df.sparkSession, x, k, seed)
    else:
        affinity = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2)) if matrix is None else matrix
        labels = spectral(affinity, k, seed)
    pdf["Cluster"] = labels.astype(np.int32)
    return df.join(df.sparkSession.createDataFrame(pdf[[key, "Cluster"]]), key)


def screen(df: DataFrame, columns: Sequence[str], method: str, most: int, tries: int = 1, seed: int = 0, key: str = "point_index") -> list[dict]:
    """For k from 2 below ``most`` and each seed: silhouette and Davies-Bouldin index."""
    out = []
    for k in range(2, most):
        for t in range(tries):
            got = fit_predict(df, columns, method, k, seed + t, key=key).cache()
            out.append({
                "nclusters": got.select("Cluster").distinct().count(), "random_state": seed + t,
                "silhouette": silhouette_by_blocks(got, columns, key=key).agg(F.avg("silhouette")).first()[0],
                "davies_bouldin": davies_bouldin(got, columns).first()[0],
            })
            got.unpersist()
    return out


def sites(points: DataFrame, columns: Sequence[str], graph: DataFrame, label: str = "Cluster", key: str = "point_index") -> DataFrame:
    """``label, key``: one site per cluster.

    With adjacent clusters the point with the least sum of size / squared distance over their centres, else
    the one nearest to its own centre; the lowest key of equals.
    """
    c = centers(points, columns, label).join(sizes(points, label), label).select(F.col(label).alias("other"), F.col("size"), *[F.col(x).alias(f"c_{x}") for x in columns])
    near = graph.where("ci <> cj and edges > 0").select(F.col("ci").alias(label), F.col("cj").alias("other"))
    lone = c.select(F.col("other").alias(label)).join(near.select(label).distinct(), label, "left_anti").withColumn("other", F.col(label)).withColumn("own", F.lit(True))
    pairs = near.withColumn("own", F.lit(False)).union(lone).join(c, "other")
    square = sum(((F.col(x) - F.col(f"c_{x}")) ** 2 for x in columns), F.lit(0.0))
    met = points.select(label, key, *columns).join(F.broadcast(pairs), label)
    score = F.sum(F.when(F.col("own"), square).otherwise(F.when(square > 0, F.col("size") / square).otherwise(float("inf"))))
    scored = met.groupBy(label, key).agg(score.alias("score"))
    return scored.groupBy(label).agg(F.min(F.struct("score", key)).alias("m")).select(label, F.col(f"m.{key}").alias(key))
