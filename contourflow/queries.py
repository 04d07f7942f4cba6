"""The library's operators as queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B
from .functions import geometry, radial
from .operators import clustering, collection, contact, descriptors, fields, graph, learning, panels, projection, selection, stationary, tables
from .plans import iterate
from .sources import outputs, structures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RADIUS = 3.0
FEATURES = 6


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zeros removed, counts as longs."""
    def fix(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            return (F.round(c.cast("double"), digits) + 0.0).alias(name)
        return c.cast("long").alias(name) if kind in ("int", "bigint", "smallint") else c.alias(name)

    return df.select(*[fix(n, k) for n, k in df.dtypes])


def r(e: str, name: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6) + 0 AS \"{name}\""


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def L(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n.split('.')[-1]}" for n in names)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return descriptors.neighbour_pairs(B.points(spark, sf), B.atoms(spark, sf), B.BOX, RADIUS)


FC = f"({d(0.5)} * (cos({d(np.pi)} * r / {d(RADIUS)}) + 1))"
NEAR = f"WITH {B.PAIRS_SQL}, near AS (SELECT *, {FC} AS fc FROM pairs WHERE r <= {d(RADIUS)})"
KEYS = L("map_index", "point_index")


def _descriptor_sql(terms: dict[str, str], source: str = "near", head: str = NEAR) -> str:
    return f"{head} SELECT {KEYS}, " + ", ".join(r(f"sum({t})", n) for n, t in terms.items()) + f" FROM {source} GROUP BY map_index, point_index"


def _each(value: str, name: Callable[[str], str]) -> dict[str, str]:
    return {name(e): f"CASE WHEN symbol = '{e}' THEN {value} ELSE 0 END" for e in sorted(B.ELEMENTS)}


# --- geometry and descriptors ---------------------------------------------------
@query(f"{NEAR} SELECT {KEYS}, {L('atom_index')}, {r('r', 'r')} FROM near")
def min_image(spark, sf):
    return rounded(_pairs(spark, sf).select("map_index", "point_index", "atom_index", "r"))


@query(_descriptor_sql(_each("fc", lambda e: f"BP-G1_{e}_r{RADIUS}")))
def g1(spark, sf):
    return rounded(descriptors.g1(_pairs(spark, sf), B.ELEMENTS, RADIUS))


@query(_descriptor_sql({k: v for eta, rs in ((0.5, 0.0), (1.0, 1.5)) for k, v in _each(f"exp(-{d(eta)} * (r - {d(rs)}) * (r - {d(rs)})) * fc", lambda e, eta=eta, rs=rs: f"BP-G2_{e}_r{RADIUS}_eta{eta:.2f}_rs{rs:.2f}").items()}))
def g2(spark, sf):
    return rounded(descriptors.g2(_pairs(spark, sf), B.ELEMENTS, RADIUS, (0.5, 1.0), (0.0, 1.5)))


@query(_descriptor_sql({k: v for kappa in (1.0, 2.0) for k, v in _each(f"cos({d(kappa)} * r) * fc", lambda e, kappa=kappa: f"BP-G3_{e}_r{RADIUS}_kappa{kappa}").items()}))
def g3(spark, sf):
    return rounded(descriptors.g3(_pairs(spark, sf), B.ELEMENTS, RADIUS, (1.0, 2.0)))


def _two(same: bool) -> str:
    return f"""{NEAR}, two AS (
  SELECT j.map_index, j.point_index, j.symbol AS sj, k.symbol AS sk, j.r AS rij, k.r AS rik, j.fc AS fj, k.fc AS fk,
         sqrt((j.dx-k.dx)*(j.dx-k.dx) + (j.dy-k.dy)*(j.dy-k.dy) + (j.dz-k.dz)*(j.dz-k.dz)) AS rjk,
         greatest({d(-1.0)}, least({d(1.0)}, (j.dx*k.dx + j.dy*k.dy + j.dz*k.dz) / (j.r*k.r))) AS cosine
  FROM near j JOIN near k ON j.point_index = k.point_index AND j.map_index = k.map_index AND j.atom_index {'<=' if same else '<'} k.atom_index
)"""


def _angular(jk: bool) -> str:
    fcjk = f" * CASE WHEN rjk <= {d(RADIUS)} THEN {d(0.5)} * (cos({d(np.pi)} * rjk / {d(RADIUS)}) + 1) ELSE 0 END" if jk else ""
    square = "rij*rij + rik*rik" + (" + rjk*rjk" if jk else "")
    terms = {}
    names = sorted(B.ELEMENTS)
    for lam in (-1.0, 1.0):
        value = f"{d(2.0 ** (1 - 2))} * pow(1 + {d(lam)} * cosine, 2) * exp(-{d(0.1)} * ({square})) * fj * fk{fcjk}"
        for i, a in enumerate(names):
            for b in names[i:]:
                terms[f"BP-{'G4' if jk else 'G5'}_{a}_{b}_r{RADIUS}_l{lam}_z2_eta0.10"] = f"CASE WHEN least(sj, sk) = '{a}' AND greatest(sj, sk) = '{b}' THEN {value} ELSE 0 END"
    return _descriptor_sql(terms, "two", _two(True))


@query(_angular(True))
def g4(spark, sf):
    return rounded(descriptors.angular(_pairs(spark, sf), B.ELEMENTS, RADIUS, (2,), (0.1,), (-1.0, 1.0), True))


@query(_angular(False))
def g5(spark, sf):
    return rounded(descriptors.angular(_pairs(spark, sf), B.ELEMENTS, RADIUS, (2,), (0.1,), (-1.0, 1.0), False))


def _radial(n: int) -> str:
    q = f"(r / {d(RADIUS)})"
    k = 2.0 if n == 0 else 1.0
    return f"CASE WHEN fc > {d(1e-6)} THEN {d(k / (2 * np.pi))} / sqrt({q} - {q}*{q}) / 4 * {d(RADIUS)} * cos({n} * acos(greatest({d(-1.0)}, least({d(1.0)}, 2*{q} - 1)))) * fc ELSE 0 END"


@query(_descriptor_sql({f"ACSF_RS_r{RADIUS}_{n:03d}": _radial(n) for n in range(8)}))
def acsf_radial(spark, sf):
    return rounded(descriptors.chebyshev_radial(_pairs(spark, sf), range(8), RADIUS))


_W = "CASE symbol WHEN 'Co' THEN -2 WHEN 'H' THEN -1 WHEN 'Mo' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"


@query(_descriptor_sql({f"ACSF_RC_r{RADIUS}_{n:03d}": f"({_radial(n)}) * {_W}" for n in range(4)}))
def acsf_compositional(spark, sf):
    return rounded(descriptors.chebyshev_radial(_pairs(spark, sf), range(4), RADIUS, weights=descriptors.element_weights(B.ELEMENTS)))


@query(_descriptor_sql({f"ACSF_AS_r{RADIUS}_{n:03d}": f"cos({n} * acos(greatest({d(-1.0)}, least({d(1.0)}, 2*acos(cosine)/{d(np.pi)} - 1)))) * fj * fk" for n in range(4)},
                       f"(SELECT * FROM two WHERE fj > {d(1e-6)} AND fk > {d(1e-6)})", _two(False)))
def acsf_angular(spark, sf):
    return rounded(descriptors.chebyshev_angular(_pairs(spark, sf), range(4), RADIUS))


@query()
def acsf_arrays(spark, sf):
    return descriptors.descriptor_arrays(B.points(spark, sf), B.atoms(spark, sf), B.BOX, RADIUS, 40, 4)


@query(f"WITH {B.PAIRS_SQL} SELECT {KEYS}, {r('min(r - ' + d(1.1) + ' * CASE symbol WHEN ' + chr(39) + 'H' + chr(39) + ' THEN ' + d(1.2) + ' ELSE ' + d(1.8) + ' END)', 'ionic_distance')} FROM pairs GROUP BY map_index, point_index")
def ionic_distance(spark, sf):
    radii = B.atoms(spark, sf).select("symbol").distinct().withColumn("radius", F.when(F.col("symbol") == "H", 1.2).otherwise(1.8))
    return rounded(contact.ionic_distance(B.points(spark, sf), B.atoms(spark, sf), radii, 1.1, B.BOX, ("map_index", "point_index")))


@query("""SELECT CAST(g AS BIGINT) AS g, CAST(min(n) AS BIGINT) AS smooth FROM (SELECT DISTINCT p_size * 7 AS g FROM part) a
JOIN (SELECT a.n * b.n * c.n AS n FROM (SELECT CAST(pow(2, range) AS BIGINT) AS n FROM range(13)) a, (SELECT CAST(pow(3, range) AS BIGINT) AS n FROM range(8)) b,
(SELECT CAST(pow(5, range) AS BIGINT) AS n FROM range(6)) c) s ON s.n >= g GROUP BY g""")
def smooth_235(spark, sf):
    sizes = B.table(spark, sf, "part").select((F.col("p_size") * 7).cast("long").alias("g")).distinct()
    return rounded(sizes.select("g", geometry.smooth_at_least(F.col("g")).alias("smooth")))


# --- fields -------------------------------------------------------------------------
@query(f"WITH {B.POINTS_SQL} SELECT {L('map_index')}, {r('sum(energy) * 1562.5 / count(*)', 'integral')} FROM points GROUP BY map_index")
def integral(spark, sf):
    return rounded(fields.integral(B.points(spark, sf), "energy", 1562.5, ("map_index",)))


@query(f"WITH {B.POINTS_SQL} SELECT {L('iz')}, {r('avg(energy)', 'energy')} FROM points GROUP BY iz")
def planar_average(spark, sf):
    return rounded(fields.planar_average(B.points(spark, sf), "energy", "iz"))


@query(f"WITH {B.POINTS_SQL} SELECT {L('ix', 'iy')}, {r('energy', 'energy')} FROM points WHERE iz = 3")
def plane_cut(spark, sf):
    return rounded(fields.plane_cut(B.points(spark, sf), "energy", 2, (0, 0, 1.5), (0.5, 0.5, 0.5), (20, 20, 25)))


@query(f"WITH {B.POINTS_SQL} SELECT {L('iz')}, {r('energy', 'energy')} FROM points WHERE ix = 4 AND iy = 2")
def line_cut(spark, sf):
    return rounded(fields.line_cut(B.points(spark, sf), "energy", 2, (2.0, 1.0, 0), (0.5, 0.5, 0.5), (20, 20, 25)))


@query(f"WITH {B.POINTS_SQL} SELECT {L('point_index')}, {r('sqrt(x*x + y*y + z*z)', 'modulus')} FROM points")
def modulus(spark, sf):
    return rounded(B.points(spark, sf).select("point_index", fields.modulus("x", "y", "z").alias("modulus")))


def _erfc_sql(a: str) -> str:
    t = f"(1 / (1 + {d(0.3275911)} * abs({a})))"
    poly = f"({t} * ({d(0.254829592)} + {t} * ({d(-0.284496736)} + {t} * ({d(1.421413741)} + {t} * ({d(-1.453152027)} + {t} * {d(1.061405429)})))))"
    return f"(CASE WHEN {a} >= 0 THEN {poly} * exp(-(abs({a}) * abs({a}))) ELSE 2 - {poly} * exp(-(abs({a}) * abs({a}))) END)"


_DZ = B.wrap_sql("z - " + d(5.0), B.BOX[2])
_A = f"((abs({_DZ}) - {d(2.0)}) / {d(0.5)})"


@query(f"""WITH {B.POINTS_SQL} SELECT {L('point_index')}, {r(d(0.5) + ' * ' + _erfc_sql(_A), 'switch')}, {r('CAST(0 AS DOUBLE)', 'gx')}, {r('CAST(0 AS DOUBLE)', 'gy')},
{r(f'CASE WHEN abs({_DZ}) <= {d(1e-10)} THEN 0 ELSE -exp(-({_A} * {_A})) * {_DZ} / (abs({_DZ}) * {d(fields.ROOT_PI)} * {d(0.5)}) END', 'gz')} FROM points""")
def system_boundary(spark, sf):
    zero = F.lit(0.0)
    dz = geometry.wrap(F.col("z") - 5.0, B.BOX[2])
    return rounded(fields.system_boundary(B.points(spark, sf), [zero, zero, dz], 2.0, 0.5).select("point_index", "switch", "gx", "gy", "gz"))


@query()
def ionic_boundary(spark, sf):
    atoms = B.atoms(spark, sf).withColumn("radius", F.lit(1.5))
    return fields.ionic_boundary(B.points(spark, sf), atoms, B.BOX, 1.0, 0.5, ("point_index",))


# --- contact space --------------------------------------------------------------------
_CELLS = f"""{B.POINTS_SQL}, cells AS (SELECT *, energy / (1 + abs(energy)) AS switch, {d(0.3)} AS gx, probability AS gy, {d(0.1)} AS gz FROM points),
near AS (SELECT *, sqrt(gx*gx + gy*gy + gz*gz) AS m FROM cells), dist AS (SELECT *, (switch - {d(0.5)}) / greatest(m, {d(1e-12)}) AS sd FROM near)"""


def _cells(spark, sf):
    e = F.col("energy")
    return B.points(spark, sf).withColumns({"switch": e / (1.0 + F.abs(e)), "gx": F.lit(0.3), "gy": F.col("probability"), "gz": F.lit(0.1)})


@query(f"WITH {_CELLS} SELECT {L('point_index')}, {r('sd', 'signed_distance')}, {r('abs(sd)', 'core_distance')} FROM dist")
def signed_distance(spark, sf):
    return rounded(contact.signed_distance(_cells(spark, sf)).select("point_index", "signed_distance", "core_distance"))


@query(f"WITH {_CELLS} SELECT {L('point_index')}, {r('sd', 'signed_distance')} FROM dist WHERE abs(sd) <= {d(0.6)}")
def contact_mask(spark, sf):
    return rounded(contact.contact_points(_cells(spark, sf), 0.6).select("point_index", "signed_distance"))


_MASK = f"{B.POINTS_SQL}, cut AS (SELECT quantile_cont(energy, {d(0.3)}) AS q FROM points), kept AS (SELECT points.* FROM points, cut WHERE energy <= q)"
_NEIGH = f"""{_MASK}, o(direction, a, b, c) AS (VALUES (0,1,0,0),(1,-1,0,0),(2,0,1,0),(3,0,-1,0),(4,0,0,1),(5,0,0,-1)),
neigh AS (SELECT k.point_index, o.direction, coalesce(n.point_index, -1) AS neighbour FROM kept k CROSS JOIN o
LEFT JOIN kept n ON n.ix = (k.ix + o.a + 20) % 20 AND n.iy = (k.iy + o.b + 20) % 20 AND n.iz = (k.iz + o.c + 250) % 250)"""
SHAPE = (20, 20, 250)


def _kept(spark, sf):
    p = B.points(spark, sf)
    q = p.agg(F.percentile("energy", 0.3)).first()[0]
    return p.where(F.col("energy") <= q)


@query(f"WITH {_NEIGH} SELECT {L('point_index', 'direction', 'neighbour')} FROM neigh")
def neighbors(spark, sf):
    return rounded(contact.neighbour_edges(_kept(spark, sf), SHAPE))


@query(f"WITH {_MASK} SELECT {L('point_index')}, CAST(row_number() OVER (ORDER BY ix, iy, iz) - 1 AS BIGINT) AS dense FROM kept")
def point_rank(spark, sf):
    kept = _kept(spark, sf).withColumnRenamed("point_index", "id")
    return rounded(contact.point_index(kept, SHAPE).select(F.col("id").alias("point_index"), F.col("point_index").alias("dense")))


@query(f"""WITH RECURSIVE {_NEIGH}, e AS (SELECT point_index AS a, neighbour AS b FROM neigh WHERE neighbour >= 0),
walk(point_index, root) AS (SELECT point_index, point_index FROM kept UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.point_index WHERE walk.root < e.b),
low AS (SELECT point_index, min(root) AS root FROM walk GROUP BY point_index)
SELECT {L('point_index')}, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS region FROM low""")
def regions(spark, sf):
    kept = iterate.settle(_kept(spark, sf))
    return rounded(contact.regions(kept, contact.neighbour_edges(kept, SHAPE)))


@query()
def layers(spark, sf):
    kept = contact.signed_distance(_cells(spark, sf)).where(F.abs("signed_distance") < 1)
    kept = iterate.settle(kept.withColumn("region", F.lit(0)))
    edges = contact.patch_edges(kept, contact.neighbour_edges(kept, SHAPE), (0.5, 0.5, 0.5), cosine_min=0.5, tangent=1.0)
    return contact.layers(kept, edges).select("point_index", "patch", "patch_size", "layer", "layer_size")


# --- projections -----------------------------------------------------------------------
@query(f"""WITH {B.POINTS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY map_index, x, y ORDER BY energy, probability DESC, z, point_index) AS n,
count(*) OVER (PARTITION BY map_index, x, y) AS multiplicity FROM points)
SELECT {L('map_index', 'point_index', 'multiplicity')}, {r('energy', 'energy')}, 'z' AS projection_normal_axis, 'energy' AS minimized_column FROM t WHERE n = 1""")
def min_projection(spark, sf):
    p = projection.min_projection(B.points(spark, sf), "energy")
    return rounded(p.select("map_index", "point_index", "multiplicity", "energy", "projection_normal_axis", "minimized_column"))


_ORDER = {"core": "abs(energy), probability DESC, z DESC", "top": "z DESC, abs(energy), probability DESC", "bottom": "z, abs(energy), probability DESC"}


def _core(selector: str):
    def run(spark, sf):
        p = B.points(spark, sf).withColumn("core_distance", F.abs("energy"))
        return rounded(projection.core_projection(p, selector).select("map_index", "point_index", "multiplicity"))

    run.__name__ = f"core_projection_{selector}"
    query(f"""WITH {B.POINTS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY map_index, x, y ORDER BY {_ORDER[selector]}, point_index) AS n,
count(*) OVER (PARTITION BY map_index, x, y) AS multiplicity FROM points) SELECT {L('map_index', 'point_index', 'multiplicity')} FROM t WHERE n = 1""")(run)


for _s in _ORDER:
    _core(_s)


@query(f"""WITH {B.POINTS_SQL} SELECT {L('map_index')}, x, y, {r('sum(probability * energy) / sum(probability)', 'energy')}, {r('max(probability)', 'probability')},
{r('min(abs(energy))', 'core_distance')}, count(*) AS multiplicity FROM points GROUP BY map_index, x, y""")
def core_projection_weighted(spark, sf):
    p = B.points(spark, sf).withColumn("core_distance", F.abs("energy"))
    return rounded(projection.weighted_projection(p, ["energy"]))


def _plane(spark, sf):
    return B.points(spark, sf).groupBy("ix", "iy").agg(F.avg("energy").alias("e"))


_PLANE = f"{B.POINTS_SQL}, plane AS (SELECT ix, iy, avg(energy) AS e FROM points GROUP BY ix, iy)"


@query(f"WITH {_PLANE} SELECT {L('iy')}, " + ", ".join(r(f"max(CASE WHEN ix = {i} THEN e END)", str(i)) for i in range(20)) + " FROM plane GROUP BY iy")
def projection_grid(spark, sf):
    return rounded(projection.projection_grid(_plane(spark, sf), "e", ("ix", "iy"), list(range(20))))


def _smooth_sql() -> str:
    w = [float(np.exp(-0.5 * k * k)) for k in range(-4, 5)]
    w = [x / sum(w) for x in w]
    table = "[" + ", ".join(d(x) for x in w) + "]"
    return f"""WITH {_PLANE}, t AS (SELECT CAST(range AS INTEGER) AS v FROM range(20)), k AS (SELECT CAST(range AS INTEGER) AS k, ({table})[CAST(range AS INTEGER) + 1] AS w FROM range(9)),
a AS (SELECT t.v AS ix, p.iy, sum(k.w * p.e) AS e FROM t, k, plane p WHERE p.ix = least(greatest(t.v + k.k - 4, 0), 19) GROUP BY t.v, p.iy),
b AS (SELECT a.ix, t.v AS iy, sum(k.w * a.e) AS e FROM t, k, a WHERE a.iy = least(greatest(t.v + k.k - 4, 0), 19) GROUP BY a.ix, t.v)
SELECT {L('ix', 'iy')}, {r('e', 'e')} FROM b"""


@query(_smooth_sql())
def gaussian_smooth(spark, sf):
    return rounded(projection.gaussian_smooth(_plane(spark, sf), "e", 1.0, nx=20, ny=20))


@query(f"WITH {_MASK} SELECT {L('points.point_index')}, {r('coalesce(kept.energy, -1)', 'value')} FROM points LEFT JOIN kept ON kept.point_index = points.point_index")
def volumetric_fill(spark, sf):
    return rounded(projection.to_volume(B.points(spark, sf), _kept(spark, sf), "energy", -1.0).select("point_index", "value"))


# --- tables ---------------------------------------------------------------------------------
_REG = """reg AS (SELECT o_orderkey AS point_index, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'unlabeled' ELSE 'failed' END AS label_status,
CASE WHEN o_custkey % 2 = 0 THEN 'centroid' ELSE 'adaptive' END AS kind, o_totalprice AS observed FROM orders)"""


def _registry(spark, sf):
    o = B.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "unlabeled").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("point_index"), status.alias("label_status"), F.when(F.col("o_custkey") % 2 == 0, "centroid").otherwise("adaptive").alias("kind"), F.col("o_totalprice").alias("observed"))


@query(f"WITH {_REG}, {B.POINTS_SQL} SELECT {L('reg.point_index')}, kind, label_status, {r('observed', 'observed')}, {r('energy', 'energy')} FROM reg LEFT JOIN points ON reg.point_index = points.point_index")
def special_points_join(spark, sf):
    p = B.points(spark, sf).select("point_index", "energy")
    return rounded(tables.special_points(_registry(spark, sf), p).select("point_index", "kind", "label_status", "observed", "energy"))


@query(f"""WITH {_REG}, new AS (SELECT point_index, 'completed' AS label_status, kind, observed * 2 AS observed FROM reg WHERE point_index % 5 = 0)
SELECT {L('point_index')}, label_status, kind, {r('observed', 'observed')} FROM new UNION ALL
SELECT {L('point_index')}, label_status, kind, {r('observed', 'observed')} FROM reg WHERE point_index % 5 <> 0""")
def special_points_upsert(spark, sf):
    reg = _registry(spark, sf)
    new = reg.where("point_index % 5 = 0").select("point_index", F.lit("completed").alias("label_status"), "kind", (F.col("observed") * 2).alias("observed"))
    return rounded(tables.upsert(reg, new, ["point_index", "kind"]))


@query(f"WITH {_REG} SELECT {L('point_index')}, kind FROM reg WHERE NOT (kind = 'centroid' AND point_index % 3 = 0)")
def special_points_remove(spark, sf):
    reg = _registry(spark, sf)
    return rounded(tables.remove(reg, "centroid", reg.where("point_index % 3 = 0").select("point_index")).select("point_index", "kind"))


@query(f"WITH {_REG} SELECT {L('point_index')}, {r('CASE WHEN point_index % 7 = 0 THEN 0 ELSE observed END', 'observed')} FROM reg")
def special_points_update(spark, sf):
    reg = _registry(spark, sf)
    new = reg.where("point_index % 7 = 0").select("point_index", F.lit(0.0).alias("observed"))
    return rounded(tables.update(reg, new, ["point_index"]).select("point_index", "observed"))


@query(f"WITH {_REG} SELECT DISTINCT {L('point_index')} FROM reg WHERE kind = 'centroid' AND label_status IN ('completed', 'failed')")
def special_points_filter(spark, sf):
    return rounded(tables.registry_frame(_registry(spark, sf), "centroid", ["completed", "failed"]).select("point_index").distinct())


_EMB = "emb AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(FEATURES)) + " FROM embeddings)"
FEATS = [f"f{i}" for i in range(FEATURES)]


def _emb(spark, sf):
    e = B.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("point_index"), F.col("label").cast("long").alias("Cluster"), *[F.element_at("embedding", i + 1).cast("double").alias(f) for i, f in enumerate(FEATS)])


def _dist(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{f}-{b}.{f})*({a}.{f}-{b}.{f})" for f in FEATS) + ")"


_NEAREST = f"""WITH {_EMB}, refs AS (SELECT * FROM emb WHERE vec_id % 50 = 0), t AS (SELECT p.vec_id, q.vec_id AS reference, {_dist('p', 'q')} AS dist,
row_number() OVER (PARTITION BY p.vec_id ORDER BY {_dist('p', 'q')}, q.vec_id) AS n FROM emb p CROSS JOIN refs q)"""


@query(f"{_NEAREST} SELECT CAST(vec_id AS BIGINT) AS point_index, {L('reference')}, {r('dist', 'distance')} FROM t WHERE n = 1")
def nearest_reference(spark, sf):
    e = _emb(spark, sf)
    return rounded(tables.nearest_reference(e, e.where("point_index % 50 = 0"), "point_index", "point_index", FEATS))


@query(f"{_NEAREST} SELECT CAST(vec_id AS BIGINT) AS point_index, {r('dist', 'distance')} FROM t WHERE n = 1")
def min_distance(spark, sf):
    e = _emb(spark, sf)
    return rounded(tables.min_distance(e, e.where("point_index % 50 = 0"), "point_index", FEATS))


_KNN = f"""{_EMB}, knn AS (SELECT p.vec_id AS src, q.vec_id AS dst, {_dist('p', 'q')} AS distance,
row_number() OVER (PARTITION BY p.vec_id ORDER BY {_dist('p', 'q')}, q.vec_id) AS rank FROM emb p JOIN emb q ON p.vec_id <> q.vec_id),
near AS (SELECT * FROM knn WHERE rank <= 4), s AS (SELECT quantile_cont(distance, {d(0.5)}) AS sigma FROM near WHERE distance > 0),
fe AS (SELECT least(src, dst) AS source, greatest(src, dst) AS target, sum(exp(-(distance / sigma) * (distance / sigma))) AS fc FROM near, s GROUP BY 1, 2)"""


@query(f"WITH {_KNN} SELECT {L('src', 'dst', 'rank')}, {r('distance', 'distance')} FROM near")
def knn_edges(spark, sf):
    e = _emb(spark, sf).withColumn("v", F.array(*FEATS))
    return rounded(tables.knn(e, "point_index", "v", 4))


@query(f"WITH {_KNN} SELECT {L('source', 'target')}, {r('fc', 'feature_component')} FROM fe")
def feature_edges(spark, sf):
    e = _emb(spark, sf).withColumn("v", F.array(*FEATS))
    return rounded(graph.feature_edges(e, "v", 4))


@query(f"WITH {_NEIGH} SELECT CAST(point_index AS BIGINT) AS source, CAST(neighbour AS BIGINT) AS target, {r('count(*) * ' + d(2.0), 'realspace_component')} FROM neigh WHERE neighbour >= 0 AND point_index < neighbour GROUP BY 1, 2")
def realspace_edges(spark, sf):
    return rounded(graph.realspace_edges(contact.neighbour_edges(_kept(spark, sf), SHAPE), 2.0))


_EDGES = f"""{_KNN}, re AS (SELECT vec_id AS source, vec_id + 1 AS target, {d(1.0)} AS rc FROM emb WHERE vec_id + 1 IN (SELECT vec_id FROM emb)),
both_ AS (SELECT source, target, sum(rc) AS rc, sum(fc) AS fc FROM (SELECT source, target, rc, {d(0.0)} AS fc FROM re UNION ALL SELECT source, target, 0, fc FROM fe) GROUP BY 1, 2),
top AS (SELECT max(abs(f5)) AS m FROM emb), nw AS (SELECT vec_id, f0 AS x, f1 AS y, f2 AS z, f3, f4, f5, abs(f5) / m AS w FROM emb, top)"""


def _nodes(spark, sf):
    e = _emb(spark, sf).withColumn("v", F.array(*FEATS)).withColumn("probability", F.abs("f5"))
    return e.withColumns({"x": F.col("f0"), "y": F.col("f1"), "z": F.col("f2")})


def _chain(nodes):
    n = nodes.select("point_index")
    a = n.withColumn("neighbour", F.col("point_index") + 1)
    return a.join(n.select(F.col("point_index").alias("neighbour")), "neighbour", "left_semi").select("point_index", "neighbour")


_UNIT = {s: f"greatest(sqrt({s}.f3*{s}.f3 + {s}.f4*{s}.f4 + {s}.f5*{s}.f5), {d(1e-300)})" for s in "ab"}
_MEAN = [f"(a.{f} / {_UNIT['a']} + b.{f} / {_UNIT['b']}) / 2" for f in ("f3", "f4", "f5")]
_STEP = [f"(b.{c} - a.{c})" for c in "xyz"]
_DOT = " + ".join(f"{s} * ({m})" for s, m in zip(_STEP, _MEAN, strict=True))
_NORM = f"sqrt({' + '.join(f'{s}*{s}' for s in _STEP)}) * sqrt({' + '.join(f'({m})*({m})' for m in _MEAN)})"
_WEIGHTED = f"""{_EDGES}, al AS (SELECT e.*, sqrt(a.w * b.w) AS nf, CASE WHEN {_NORM} > 0 THEN abs({_DOT}) / ({_NORM}) ELSE 0 END AS align
FROM both_ e JOIN nw a ON a.vec_id = source JOIN nw b ON b.vec_id = target), we AS (SELECT *, (rc * (1 + {d(0.5)} * align) + fc) * nf AS weight FROM al)"""


def _graph(spark, sf):
    nodes = _nodes(spark, sf)
    return graph.build_graph(nodes, _chain(nodes), "hybrid", "v", 4, directions=["f3", "f4", "f5"], directional_weight=0.5)


@query(f"WITH {_WEIGHTED} SELECT {L('source', 'target')}, {r('rc', 'realspace_component')}, {r('fc', 'feature_component')}, {r('align', 'directional_alignment')}, {r('1 + ' + d(0.5) + ' * align', 'directional_factor')}, {r('nf', 'node_factor')}, {r('weight', 'weight')} FROM we")
def hybrid_edges(spark, sf):
    return rounded(_graph(spark, sf))


@query(f"WITH {_WEIGHTED} SELECT {L('source', 'target')}, {r('rc * 2 * (1 + ' + d(0.5) + ' * align) + fc * ' + d(0.5), 'weight')} FROM we WHERE rc * 2 * (1 + {d(0.5)} * align) + fc * {d(0.5)} > 0")
def reweight(spark, sf):
    return rounded(graph.reweight(_graph(spark, sf), 2.0, 0.5).select("source", "target", "weight"))


@query(f"""WITH {_WEIGHTED}, links AS (SELECT source AS src, target AS dst, weight AS w FROM we UNION ALL SELECT target, source, weight FROM we),
seeds AS (SELECT vec_id AS node, label FROM emb WHERE vec_id % 20 = 0), deg AS (SELECT src, sum(w) AS dg FROM links GROUP BY src),
sp AS (SELECT links.src AS node, seeds.label, {d(0.9)} * sum(w) / any_value(dg) AS score FROM links JOIN seeds ON dst = node JOIN deg ON deg.src = links.src GROUP BY links.src, seeds.label)
SELECT {L('node', 'label')}, {r('score', 'score')} FROM sp WHERE node NOT IN (SELECT node FROM seeds) UNION ALL SELECT {L('node', 'label')}, {r(d(1.0), 'score')} FROM seeds""")
def diffusion_step(spark, sf):
    e = _graph(spark, sf).select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("weight").alias("w"))
    links = iterate.settle(e.union(e.select("dst", "src", "w")))
    seeds = _emb(spark, sf).where("point_index % 20 = 0").select(F.col("point_index").alias("node"), F.col("Cluster").alias("label"))
    return rounded(graph.diffusion_step(links, seeds.withColumn("score", F.lit(1.0)), seeds))


def _propagate(mode: str):
    def run(spark, sf):
        e = iterate.settle(_graph(spark, sf))
        nodes = _emb(spark, sf).select(F.col("point_index").alias("node"), F.col("Cluster").alias("label"))
        scores = graph.propagation_scores(e, nodes.where("node % 25 = 0"), mode)
        return graph.assign(nodes, scores)

    run.__name__ = f"propagate_{mode}"
    query()(run)


for _m in ("diffusion", "shortest_path", "watershed", "region_grow"):
    _propagate(_m)


@query()
def spanning_tree(spark, sf):
    return graph.spanning_tree(_nodes(spark, sf), "v")


@query()
def endpoint_scores(spark, sf):
    e = iterate.settle(_graph(spark, sf))
    return graph.endpoint_scores(e, _nodes(spark, sf), FEATS)


@query(f"""WITH {B.POINTS_SQL}, n AS (SELECT map_index, max(point_index) + 1 AS n FROM points GROUP BY map_index),
o AS (SELECT map_index, coalesce(sum(n) OVER (ORDER BY map_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM n)
SELECT {L('points.map_index', 'point_index')}, CAST(o + point_index AS BIGINT) AS global_point_index FROM points JOIN o ON o.map_index = points.map_index""")
def union_offsets(spark, sf):
    return rounded(tables.global_index(B.points(spark, sf)).select("map_index", "point_index", "global_point_index"))


@query(f"""WITH {B.POINTS_SQL}, e AS (SELECT map_index, min(energy) AS lo, max(energy) AS hi FROM points GROUP BY map_index)
SELECT {L('point_index')}, {r('CASE WHEN hi - lo <= 1e-8 + 1e-5 * abs(lo) THEN 0 ELSE (energy - lo) / (hi - lo) END', 'n')} FROM points JOIN e ON e.map_index = points.map_index""")
def normalize_component(spark, sf):
    return rounded(tables.normalize(B.points(spark, sf), "energy", "n", ["map_index"]).select("point_index", "n"))


@query(f"""SELECT count(*) AS n, {r('1 - sum((p - t) * (p - t)) / (var_pop(t) * count(*))', 'r2')}, {r('avg(abs(p - t))', 'mae')}, {r('sqrt(avg((p - t) * (p - t)))', 'rmse')},
{r('quantile_cont(abs(p - t), ' + d(0.5) + ')', 'median_abs_error')}, {r('max(abs(p - t))', 'max_abs_error')}, {r('avg(p - t)', 'mean_error')}
FROM (SELECT l_extendedprice AS t, l_quantity * {d(1500.0)} AS p FROM lineitem)""")
def parity_metrics(spark, sf):
    li = B.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500.0).alias("p"))
    return rounded(tables.parity_metrics(li, "t", "p"))


@query(f"""SELECT {L('o_orderkey')}, {r('res', 'residual')}, CAST(row_number() OVER (ORDER BY abs(res) DESC, o_orderkey) AS BIGINT) AS error_rank
FROM (SELECT o_orderkey, o_totalprice - {d(150000.0)} AS res FROM orders) ORDER BY abs(res) DESC, o_orderkey LIMIT 25""")
def error_rank(spark, sf):
    o = B.table(spark, sf, "orders").withColumn("reference", F.lit(150000.0))
    return rounded(tables.error_table(o, "reference", "o_totalprice", "o_orderkey", 25).select("o_orderkey", "residual", "error_rank"))


# --- reduction and clustering -----------------------------------------------------------------
@query(f"WITH {_EMB} SELECT CAST(label AS BIGINT) AS \"Cluster\", " + ", ".join(r(f"avg({f})", f) for f in FEATS) + " FROM emb GROUP BY label")
def cluster_centers(spark, sf):
    return rounded(clustering.centers(_emb(spark, sf), FEATS))


@query("SELECT CAST(label AS BIGINT) AS \"Cluster\", count(*) AS size FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf):
    return rounded(clustering.sizes(_emb(spark, sf)))


@query(f"""WITH {_EMB}, c AS (SELECT label, row_number() OVER (ORDER BY {', '.join(f'avg({f})' for f in FEATS)}, label) - 1 AS n FROM emb GROUP BY label)
SELECT CAST(vec_id AS BIGINT) AS point_index, CAST(n AS BIGINT) AS "Cluster" FROM emb JOIN c ON c.label = emb.label""")
def cluster_relabel(spark, sf):
    return rounded(clustering.relabel(_emb(spark, sf), FEATS).select("point_index", "Cluster"))


_CG = f"""{_KNN}, cg AS (SELECT a.label AS ci, b.label AS cj FROM near JOIN emb a ON a.vec_id = src JOIN emb b ON b.vec_id = dst),
graph_ AS (SELECT ci, cj, count(*) // 2 AS edges FROM (SELECT ci, cj FROM cg UNION ALL SELECT cj, ci FROM cg) GROUP BY ci, cj)"""


def _cluster_graph(spark, sf):
    e = _emb(spark, sf)
    near = tables.knn(e.withColumn("v", F.array(*FEATS)), "point_index", "v", 4)
    return clustering.cluster_graph(e, near.select(F.col("src").alias("point_index"), F.col("dst").alias("neighbour")))


@query(f"WITH {_CG} SELECT {L('ci', 'cj', 'edges')} FROM graph_")
def cluster_graph(spark, sf):
    return rounded(_cluster_graph(spark, sf))


_SQ = " + ".join(f"(e.{f}-c.{f})*(e.{f}-c.{f})" for f in FEATS)


@query(f"""WITH {_CG}, c AS (SELECT label, count(*) AS size, {', '.join(f'avg({f}) AS {f}' for f in FEATS)} FROM emb GROUP BY label),
pairs AS (SELECT ci AS label, cj AS other, false AS own FROM graph_ WHERE ci <> cj AND edges > 0 UNION ALL
SELECT label, label, true FROM c WHERE label NOT IN (SELECT ci FROM graph_ WHERE ci <> cj AND edges > 0)),
sc AS (SELECT e.label, e.vec_id, sum(CASE WHEN own THEN {_SQ} ELSE size / ({_SQ}) END) AS score FROM emb e JOIN pairs p ON p.label = e.label JOIN c ON c.label = p.other GROUP BY 1, 2),
b AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS n FROM sc)
SELECT CAST(label AS BIGINT) AS "Cluster", CAST(vec_id AS BIGINT) AS point_index FROM b WHERE n = 1""")
def sites(spark, sf):
    return rounded(clustering.sites(_emb(spark, sf), FEATS, iterate.settle(_cluster_graph(spark, sf))))


@query(f"""WITH {_EMB}, n AS (SELECT label, count(*) AS n FROM emb GROUP BY label), m AS (SELECT p.vec_id, p.label, q.label AS other, sum({_dist('p', 'q')}) AS total FROM emb p CROSS JOIN emb q GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, max(CASE WHEN m.label = other AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN m.label <> other THEN total / n END) AS b FROM m JOIN n ON n.label = other GROUP BY vec_id)
SELECT CAST(vec_id AS BIGINT) AS point_index, {r('CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END', 'silhouette')} FROM ab""")
def silhouette(spark, sf):
    return rounded(clustering.silhouette_by_blocks(_emb(spark, sf), FEATS))


@query(f"""WITH {_EMB}, c AS (SELECT label, {', '.join(f'avg({f}) AS {f}' for f in FEATS)} FROM emb GROUP BY label),
s AS (SELECT e.label, avg(sqrt({_SQ})) AS s FROM emb e JOIN c ON c.label = e.label GROUP BY e.label),
w AS (SELECT p.label, max((a.s + b.s) / {_dist('p', 'q')}) AS w FROM c p JOIN c q ON p.label <> q.label JOIN s a ON a.label = p.label JOIN s b ON b.label = q.label GROUP BY p.label)
SELECT {r('avg(w)', 'davies_bouldin')} FROM w""")
def davies_bouldin(spark, sf):
    return rounded(clustering.davies_bouldin(_emb(spark, sf), FEATS))


@query(f"WITH {_EMB} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, {r(f'covar_pop(f{i}, f{j})', 'c')} FROM emb" for i in range(FEATURES) for j in range(i, FEATURES)))
def pca_covariance(spark, sf):
    return rounded(clustering.covariance(_emb(spark, sf), FEATS))


@query()
def pca(spark, sf):
    e = _emb(spark, sf)
    return clustering.PCA(e, FEATS).project(e, 3).select("point_index", "pca0", "pca1", "pca2")


def _method(method: str):
    def run(spark, sf):
        got = clustering.fit_predict(_emb(spark, sf).drop("Cluster"), FEATS, method, 4)
        return clustering.relabel(got, FEATS).select("point_index", "Cluster")

    run.__name__ = {"kmeans": "kmeans", "gaussian_mixture": "gmm"}.get(method, method)
    query()(run)


for _k in ("kmeans", "gaussian_mixture", "spectral", "agglomerative"):
    _method(_k)


# --- selection -----------------------------------------------------------------------------------
@query(f"""WITH {B.POINTS_SQL}, t AS (SELECT *, CASE WHEN abs(x - 5) <= 2 AND abs(y - 5) > {d(1e-8)} AND (CASE WHEN y - 5 < -{d(1e-8)} THEN 1 ELSE 0 END) = 0 THEN -energy END AS e FROM points),
m AS (SELECT min(e) AS lo, max(e) AS hi FROM t)
SELECT {L('point_index')}, {r('CASE WHEN e IS NULL THEN 0 ELSE 0.5 + 0.5 * (e - lo) / (hi - lo) END', 'energy_component')} FROM t, m""")
def stationary_energy(spark, sf):
    p = B.points(spark, sf).withColumn("k", F.col("y") - 5)
    return rounded(selection.energy_component(p, "energy", "stationary", F.abs(F.col("x") - 5), ["k"], gradient_tolerance=2.0).select("point_index", "energy_component"))


@query(f"""WITH {B.POINTS_SQL}, m AS (SELECT min(energy) AS a, max(energy) AS b, min(probability) AS c, max(probability) AS e FROM points),
s AS (SELECT point_index, (energy - a) / (b - a) + {d(0.5)} * (probability - c) / (e - c) AS score FROM points, m)
SELECT {L('point_index')}, {r('score', 'score')} FROM s ORDER BY score DESC, point_index LIMIT 1""")
def select_round1(spark, sf):
    got = selection.greedy_select(B.points(spark, sf), 1, extra=[("energy", 1.0), ("probability", 0.5)], feature_weight=0.0)
    return rounded(spark.createDataFrame(got, "point_index long, score double"))


@query()
def greedy_selection(spark, sf):
    e = _emb(spark, sf)
    return spark.createDataFrame(selection.greedy_select(e, 6, FEATS, space=(), seeds=e.where("point_index = 0")), "point_index long, score double")


@query(f"""WITH {_EMB}, q AS (SELECT quantile_cont(abs(f5), {d(0.75)}) AS q FROM emb), k AS (SELECT emb.* FROM emb, q WHERE abs(f5) >= q),
m AS (SELECT {', '.join(f'avg({f}) AS m{i}, stddev_pop({f}) AS s{i}' for i, f in enumerate(FEATS))} FROM k),
x AS (SELECT vec_id, sqrt({' + '.join(f'(({f} - m{i}) / s{i}) * (({f} - m{i}) / s{i})' for i, f in enumerate(FEATS))}) AS ext FROM k, m), e AS (SELECT min(ext) AS lo, max(ext) AS hi FROM x)
SELECT CAST(vec_id AS BIGINT) AS point_index, {r('ext', 'extremeness')}, {r('(ext - lo) / (hi - lo)', 'e')} FROM x, e""")
def archetype_scores(spark, sf):
    e = _emb(spark, sf).withColumn("probability", F.abs("f5"))
    return rounded(selection.archetype_candidates(e, FEATS).select("point_index", "extremeness", "e"))


@query()
def archetypes(spark, sf):
    c = selection.archetype_candidates(_emb(spark, sf).withColumn("probability", F.abs("f5")), FEATS)
    return spark.createDataFrame(selection.select_archetypes(c, 4, FEATS), "point_index long, score double")


def _pivoted(name: str):
    def run(spark, sf):
        got = selection.pivoted_rows(_emb(spark, sf), "point_index", FEATS, 8, name)
        return spark.createDataFrame([(i, s, n) for n, (i, s) in enumerate(got)], "point_index long, score double, selection_rank int")

    run.__name__ = name
    query()(run)


_pivoted("pivoted_qr")
_pivoted("pivoted_cholesky")


# --- stationary points --------------------------------------------------------------------------------
def _z(i: int, j: int) -> str:
    return f"max(CASE WHEN o.i = {i} AND o.j = {j} THEN p.e END) AS z{i + 1}{j + 1}"


_ST = f"""{_PLANE}, o(i, j) AS (VALUES {', '.join(f'({i},{j})' for i in (-1, 0, 1) for j in (-1, 0, 1))}),
patch AS (SELECT (p.ix - o.i + 20) % 20 AS ix, (p.iy - o.j + 20) % 20 AS iy, {', '.join(_z(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))} FROM plane p CROSS JOIN o GROUP BY 1, 2),
der AS (SELECT *, z21 - z01 AS gx, z12 - z10 AS gy, (z21 - 2*z11 + z01) * 4 AS hxx, (z12 - 2*z11 + z10) * 4 AS hyy, z22 - z20 - z02 + z00 AS hxy FROM patch),
gr AS (SELECT *, sqrt(gx*gx + gy*gy) AS gnorm FROM der)"""


def _der(spark, sf):
    return stationary.derivatives(stationary.stencil(_plane(spark, sf), "e", 20, 20), 0.5, 0.5)


@query(f"WITH {_ST} SELECT {L('ix', 'iy')}, " + ", ".join(r(c, c) for c in ("gx", "gy", "gnorm", "hxx", "hyy", "hxy")) + " FROM gr")
def stencil_gradient(spark, sf):
    return rounded(_der(spark, sf).select("ix", "iy", "gx", "gy", "gnorm", "hxx", "hyy", "hxy"))


@query(f"""WITH {_ST}, tol AS (SELECT quantile_cont(gnorm, {d(0.1)}) AS t FROM gr), lo AS (SELECT (p.ix - o.i + 20) % 20 AS ix, (p.iy - o.j + 20) % 20 AS iy, min(p.gnorm) AS lo FROM gr p CROSS JOIN o GROUP BY 1, 2)
SELECT {L('gr.ix', 'gr.iy')}, {r('gnorm', 'gnorm')} FROM gr JOIN lo ON lo.ix = gr.ix AND lo.iy = gr.iy, tol WHERE (gnorm <= lo AND gnorm <= t)
OR z11 <= least(z00,z01,z02,z10,z11,z12,z20,z21,z22) OR z11 >= greatest(z00,z01,z02,z10,z11,z12,z20,z21,z22)""")
def stencil_candidates(spark, sf):
    return rounded(stationary.candidates(iterate.settle(_der(spark, sf)), 20, 20).select("ix", "iy", "gnorm"))


@query(f"""WITH {_ST} SELECT {L('ix', 'iy')}, {r('(z20+z21+z22-z00-z01-z02) / 3', 'c1')}, {r('(z02+z12+z22-z00-z10-z20) / 3', 'c2')},
{r(f'((z00+z01+z02+z20+z21+z22) * ({d(1 / 3)}) - (z10+z11+z12) * ({d(2 / 3)})) / {d(0.5)}', 'c3')}, {r('z22 - z20 - z02 + z00', 'c4')},
{r(f'((z00+z10+z20+z02+z12+z22) * ({d(1 / 3)}) - (z01+z11+z21) * ({d(2 / 3)})) / {d(0.5)}', 'c5')} FROM gr""")
def quadratic_patch(spark, sf):
    return rounded(stationary.quadratic(_der(spark, sf), 0.5, 0.5).select("ix", "iy", "c1", "c2", "c3", "c4", "c5"))


@query()
def stationary_points(spark, sf):
    return stationary.stationary_points(_plane(spark, sf), "e", 20, 20, 0.5, 0.5)


@query()
def stationary_comparison(spark, sf):
    a = stationary.stationary_points(_plane(spark, sf), "e", 20, 20, 0.5, 0.5)
    b = a.withColumn("x", F.col("x") + 0.1)
    table, _ = stationary.compare(a, b, periods=(10.0, 10.0), energy_scale=1.0, weight_scale=10.0)
    return spark.createDataFrame(table.astype({"type": str, "status": str}))


# --- texts, histories, workflow ---------------------------------------------------------------------------
@query(f"""WITH g AS (SELECT user_id, list(value ORDER BY ts, event_id) AS e FROM events GROUP BY user_id)
SELECT {L('user_id')}, CAST(unnest(range(len(e))) AS BIGINT) AS bfgs_step, {"round(unnest(e), 6) + 0 AS energy"}, {"round(unnest(list_transform(e, lambda x: x * 2)), 6) + 0 AS distance"} FROM g""")
def relax_explode(spark, sf):
    e = B.table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("h"))
    h = e.select("user_id", F.transform("h", lambda x: x["value"]).alias("energy"), F.transform("h", lambda x: x["value"] * 2).alias("c"))
    return rounded(learning.relax_steps(h, "energy", "c", "distance", ("user_id",)))


@query(f"""SELECT {L('event_id')}, {r('last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'carried')} FROM events""")
def carry_forward_geometry(spark, sf):
    from pyspark.sql import Window

    e = B.table(spark, sf, "events")
    first = e.agg(F.min("event_type").alias("m"))
    run = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.last(F.when(F.col("event_type") == F.col("m"), F.col("value")), ignorenulls=True).over(run)
    return rounded(e.crossJoin(F.broadcast(first)).select("event_id", kept.alias("carried")))


@query(f"""WITH x AS (SELECT o_orderkey, o_custkey % 4 AS map_index, o_totalprice AS e FROM orders), s AS (SELECT c_custkey % 4 AS map_index, sum(c_acctbal) AS v FROM customer GROUP BY 1), g AS (SELECT sum(s_acctbal) AS v FROM supplier)
SELECT {L('o_orderkey')}, {r('e - s.v - ' + d(0.5) + ' * g.v', 'E_ads_Ry')} FROM x JOIN s ON s.map_index = x.map_index, g""")
def adsorption_energy(spark, sf):
    res = B.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("map_index"), F.col("o_totalprice").alias("E_bfgs_final_Ry"))
    slab = B.table(spark, sf, "customer").groupBy((F.col("c_custkey") % 4).alias("map_index")).agg(F.sum("c_acctbal").alias("value")).select(F.lit("clean_slab").alias("name"), "map_index", "value")
    gas = B.table(spark, sf, "supplier").agg(F.sum("s_acctbal").alias("value")).select(F.lit("H2").alias("name"), F.lit(None).cast("long").alias("map_index"), "value")
    return rounded(outputs.adsorption_energy(res, slab.union(gas)).select("o_orderkey", "E_ads_Ry"))


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS BIGINT) AS line_no, CAST(len(line) AS BIGINT) AS size,
nullif(regexp_extract(line, '(\\d+)', 1), '') AS number FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)""")
def output_regex(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("job"), F.col("text").alias("content"))
    rows = outputs.lines(docs)
    found = F.regexp_extract("line", r"(\d+)", 1)
    return rounded(rows.select(F.col("job").alias("doc_id"), "line_no", F.length("line").alias("size"), F.when(found != "", found).alias("number")))


@query(f"""SELECT {L('page_id')}, {r("list_extract(regexp_extract_all(url, '\\d+(?:\\.\\d+)?'), -1)", 'number')} FROM pages""")
def folder_number(spark, sf):
    return rounded(B.table(spark, sf, "pages").select("page_id", structures.folder_number(F.col("url")).alias("number")))


@query(f"""WITH {B.POINTS_SQL}, v AS (SELECT CAST(range AS DOUBLE) / 4 AS v FROM range(9)), t AS (SELECT point_index, v, (v - probability) * (v - probability) AS e,
row_number() OVER (PARTITION BY point_index ORDER BY (v - probability) * (v - probability), v) AS n FROM points, v) SELECT {L('point_index')}, v, {r('e', 'e')} FROM t WHERE n = 1""")
def coordinate_min_scan(spark, sf):
    grid = B.points(spark, sf).select("point_index", "probability", F.explode(F.array(*[F.lit(i / 4) for i in range(9)])).alias("v"))
    e = (F.col("v") - F.col("probability")) * (F.col("v") - F.col("probability"))
    best = grid.groupBy("point_index").agg(F.min(F.struct(e.alias("e"), "v")).alias("m"))
    return rounded(best.select("point_index", "m.v", "m.e"))


@query()
def gp_surrogate(spark, sf):
    e = _emb(spark, sf).select("point_index", *FEATS[:2], (F.col("f0") * F.col("f0") + F.col("f1")).alias("y"))
    model = learning.GaussianProcess(FEATS[:2], "y", starts=learning.warm_starts(FEATS[:2], random=1)).fit(e.where("point_index < 40"))
    return model.predict(e).select("point_index", "predicted", "predicted_std")


@query(f"""{NEAR}, g AS (SELECT map_index, point_index, sum(fc) AS g1 FROM near WHERE symbol = 'H' GROUP BY 1, 2), j AS (SELECT p.*, round(coalesce(g1, 0), 9) AS g1 FROM points p LEFT JOIN g ON g.point_index = p.point_index AND g.map_index = p.map_index),
t AS (SELECT *, row_number() OVER (PARTITION BY map_index, x, y ORDER BY g1, probability DESC, z, point_index) AS n, count(*) OVER (PARTITION BY map_index, x, y) AS multiplicity FROM j)
SELECT {L('map_index', 'point_index', 'multiplicity')}, {r('g1', 'g1')} FROM t WHERE n = 1""")
def descriptor_projection(spark, sf):
    """Flagship: points, atoms within the cutoff, descriptor, metadata, projection."""
    name = f"BP-G1_H_r{RADIUS}"
    got = descriptors.g1(_pairs(spark, sf), ["H"], RADIUS).withColumnRenamed(name, "g1")
    joined = B.points(spark, sf).join(got, ["map_index", "point_index"], "left").withColumn("g1", F.coalesce("g1", F.lit(0.0)))
    # equal sums in another order may differ in the last bits; ties are decided on rounded values
    best = projection.min_projection(joined.withColumn("g1", F.round("g1", 9)), "g1")
    return rounded(best.select("map_index", "point_index", "multiplicity", "g1"))


# --- collections of maps ----------------------------------------------------------
@query(f"""WITH {B.POINTS_SQL} SELECT {L('map_index', 'point_index')}, {r('energy * 2', 'strength')}, {r('probability', 'boundary_switch')},
{r('x', 'boundary_gradient_x')}, {r('y', 'boundary_gradient_y')}, {r('z', 'boundary_gradient_z')} FROM points""")
def annotated_points(spark, sf):
    p = B.points(spark, sf)
    keys = ["map_index", "point_index"]
    p, _ = collection.annotate(p, p.select(*keys, (F.col("energy") * 2).alias("strength")), "strength", keys=keys)
    p = collection.boundary_columns(p, {"switch": "probability"}, {"gradient": ("x", "y", "z")})
    return rounded(p.select(*keys, "strength", "boundary_switch", *[f"boundary_gradient_{c}" for c in "xyz"]))


@query(f"""WITH {B.POINTS_SQL} SELECT {L('map_index', 'point_index')}, r_name AS folder FROM points
LEFT JOIN region ON map_index = r_regionkey AND r_regionkey > 0""")
def map_metadata(spark, sf):
    regions = B.table(spark, sf, "region").where("r_regionkey > 0").select(F.col("r_regionkey").cast("int").alias("map_index"), F.col("r_name").alias("folder"))
    return rounded(collection.attach_metadata(B.points(spark, sf).select("map_index", "point_index"), regions))


@query(f"""WITH {B.POINTS_SQL}, old AS (SELECT map_index, point_index, CASE WHEN point_index % 2 = 0 THEN 'archetype' ELSE 'centroid' END AS kind,
  1 AS iteration, 'completed' AS label_status FROM points WHERE layer = 0),
new AS (SELECT map_index, point_index, 'centroid' AS kind, 2 AS iteration, 'unlabeled' AS label_status FROM points WHERE region = 1)
SELECT {L('map_index', 'point_index')}, kind, {L('iteration')}, label_status FROM new UNION ALL
SELECT {L('map_index', 'point_index')}, kind, {L('iteration')}, label_status FROM old
WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.map_index = old.map_index AND new.point_index = old.point_index AND new.kind = old.kind)""")
def global_special_points(spark, sf):
    p = B.points(spark, sf).withColumn("global_point_index", F.col("point_index") * 4 + F.col("map_index"))
    kind = F.when(F.col("point_index") % 2 == 0, "archetype").otherwise("centroid")
    old = p.where("layer = 0").select("map_index", "point_index", kind.alias("kind"), F.lit(1).alias("iteration"), F.lit("completed").alias("label_status"))
    got = collection.register_global(old, p, p.where("region = 1").select("global_point_index"), "centroid", 2)
    return rounded(got.select("map_index", "point_index", "kind", "iteration", "label_status"))


# --- data behind figures ------------------------------------------------------------------------
@query(f"""WITH ends AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, CAST(i AS BIGINT) AS level_index, {r(f'lo + (hi - lo) / {d(9.0)} * i', 'level')} FROM ends, range(10) AS steps(i)""")
def contour_levels(spark, sf):
    return rounded(panels.contour_levels(B.table(spark, sf, "lineitem"), ["l_extendedprice"], 10, ["l_returnflag"]))


@query(f"""SELECT {L('o_orderkey')}, {r('o_totalprice - 150000', 'residual')},
CASE WHEN row_number() OVER (ORDER BY abs(o_totalprice - 150000) DESC, o_orderkey) <= 3
THEN CAST(row_number() OVER (ORDER BY abs(o_totalprice - 150000) DESC, o_orderkey) AS BIGINT) ELSE 0 END AS error_rank FROM orders""")
def parity_points(spark, sf):
    o = B.table(spark, sf, "orders").withColumn("reference", F.lit(150000.0))
    marked = panels.parity_points(o, "reference", "o_totalprice", "o_orderkey").fillna(0, ["error_rank"])
    return rounded(marked.select("o_orderkey", "residual", "error_rank"))


@query(f"""WITH {B.POINTS_SQL} SELECT {r('z', 'panel')}, {r('x', 'x1')}, {r('y', 'x2')}, {r('x * y', 'value')} FROM points WHERE region = 0""")
def figure_panels(spark, sf):
    return rounded(panels.panels(B.points(spark, sf).withColumn("product", F.col("x") * F.col("y")), "product"))
