"""Lattice geometry: grid sizes, cell coordinates, minimum-image displacements."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOHR = 0.52917720859


def is_smooth(n: int) -> bool:
    """Whether ``n`` has no prime factors but 2, 3 and 5."""
    for p in (2, 3, 5):
        while n > 1 and n % p == 0:
            n //= p
    return n == 1


def next_smooth(n: int) -> int:
    n = max(1, int(n))
    while not is_smooth(n):
        n += 1
    return n


def grid_scalars(cell: np.ndarray, cutoff: float) -> tuple[int, int, int]:
    """Points along each lattice vector for an energy cutoff: the next 2-3-5-smooth number."""
    lengths = np.linalg.norm(np.asarray(cell, float), axis=1)
    return tuple(next_smooth(int(math.sqrt(cutoff) / BOHR * a / math.pi)) for a in lengths)


def smooth_at_least(n: Column, limit: int = 4096) -> Column:
    """The least 2-3-5-smooth number >= ``n`` (null above ``limit``), from a sorted literal array."""
    known = [i for i in range(1, limit + 1) if is_smooth(i)]
    return F.array_min(F.filter(F.array(*[F.lit(i) for i in known]), lambda k: k >= n))


def volume(cell: np.ndarray) -> float:
    return float(np.linalg.det(np.asarray(cell, float)))


def reciprocal(cell: np.ndarray) -> np.ndarray:
    """Rows: cross products of the cell's columns over its signed volume."""
    a, b, c = np.asarray(cell, float).T
    return np.array([np.cross(b, c), np.cross(c, a), np.cross(a, b)]) / volume(cell)


def grid_cells(spark: SparkSession, scalars: tuple[int, int, int], basis: np.ndarray, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """``cell_id, ix, iy, iz, x, y, z`` of a regular grid in C order; nothing is materialised on the driver."""
    nx, ny, nz = scalars
    basis = np.asarray(basis, float)
    cells = spark.range(nx * ny * nz).withColumnRenamed("id", "cell_id")
    cells = cells.select(
        "cell_id",
        F.expr(f"int(cell_id div {ny * nz})").alias("ix"),
        F.expr(f"int((cell_id div {nz}) % {ny})").alias("iy"),
        F.expr(f"int(cell_id % {nz})").alias("iz"),
    )
    at = [
        F.lit(float(origin[k])) + F.col("ix") * float(basis[0, k]) + F.col("iy") * float(basis[1, k]) + F.col("iz") * float(basis[2, k])
        for k in range(3)
    ]
    return cells.select("*", *[c.alias(n) for c, n in zip(at, "xyz", strict=True)])


def wrap(d: Column, length: float) -> Column:
    """Minimum image of a displacement along an orthogonal axis."""
    return d - F.lit(length) * F.floor(d / F.lit(length) + 0.5)


def orthogonal_displacement(at: list[Column], to: list[Column], lengths: tuple[float, float, float]) -> list[Column]:
    return [wrap(a - b, float(length)) for a, b, length in zip(at, to, lengths, strict=True)]


def minimum_image(displacement: list[Column], cell: np.ndarray, dim: int = 0, axis: int = 0) -> Column:
    """Struct ``(x, y, z, r)``: the shortest periodic image of a displacement in a general cell.

    The displacement is folded into the cell and the eight corners are tried in order; the first of equal
    lengths stays. ``dim`` 0 measures from a point, 1 from the line along ``axis``, 2 from the plane
    normal to it.
    """
    cell = np.asarray(cell, float)
    inverse = np.linalg.inv(cell)
    part = [sum((displacement[k] * float(inverse[k, j]) for k in range(3)), F.lit(0.0)) for j in range(3)]
    part = [s - F.floor(s) for s in part]
    base = [sum((part[j] * float(cell[j, k]) for j in range(3)), F.lit(0.0)) for k in range(3)]
    keep = [k for k in range(3) if dim == 0 or (dim == 1 and k != axis) or (dim == 2 and k == axis)]
    images = []
    for n, corner in enumerate(np.ndindex(2, 2, 2)):
        shift = np.array(corner, float) @ cell
        v = [base[k] - float(shift[k]) if k in keep else F.lit(0.0) for k in range(3)]
        r = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        images.append(F.struct(r.alias("r"), F.lit(n).alias("n"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z")))
    return F.array_min(F.array(*images))
