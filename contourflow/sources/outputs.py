"""Calculation output texts as tables: lines, blocks and the values in them, in SQL throughout."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOHR = 0.529177210903
RYDBERG_EV = 13.605693122994

# The words that begin an output line, the place of its value among the words, and the unit after it.
VALUES = {
    "iteration": ("iteration", 2, ""),
    "energy": ("total energy", 3, "ry"),
    "accuracy": ("estimated scf accuracy", 4, "ry"),
    "converged_energy": ("! total energy", 4, "ry"),
    "total_force": ("total force", 3, ""),
    "alat": ("lattice parameter alat", 4, "a.u."),
    "celldm": ("celldm 1", 3, ""),
}
POSITIONS, CELL, FORCES = "atomic_positions", "cell_parameters", "forces acting on atoms"
DONE = ("bfgs converged", "end of bfgs geometry optimization", "optimization achieved convergence")
#: What separates words besides white space.
MARKS = "=<(){}#:,"


def words(line: Column | str = "line") -> Column:
    """The words of a line in lower case, marks between them left out."""
    line = F.col(line) if isinstance(line, str) else line
    return F.split(F.trim(F.translate(F.translate(F.lower(line), MARKS, " " * len(MARKS)), "\t", " ")), " +")


def begins(parts: Column, phrase: str) -> Column:
    want = phrase.split()
    return F.slice(parts, 1, len(want)) == F.array(*[F.lit(w) for w in want])


def numeric(parts: Column, place: int) -> Column:
    """The word at a place, from one, as a number; null if it is none."""
    return F.get(parts, F.lit(place - 1)).try_cast("double")


def known_value(parts: Column, name: str) -> Column:
    """The value called ``name`` (see ``VALUES``) if the line holds it."""
    phrase, place, unit = VALUES[name]
    here = begins(parts, phrase)
    if unit:
        here = here & (F.get(parts, F.lit(place)) == unit)
    return F.when(here, numeric(parts, place))


def is_atom(parts: Column) -> Column:
    """A symbol of letters and three numbers."""
    whole = numeric(parts, 2).isNotNull() & numeric(parts, 3).isNotNull() & numeric(parts, 4).isNotNull()
    return F.get(parts, F.lit(0)).rlike("^[a-z]+$") & whole


def lines(files: DataFrame, text: str = "content", key: str = "job") -> DataFrame:
    """``job, line_no, line``; a null text has no lines."""
    return files.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def marked(rows: DataFrame, key: str = "job") -> DataFrame:
    """Lines with ``w``, their words, every known value, and ``block``: how many iteration headers stand up to the line."""
    out = rows.withColumn("w", words())
    out = out.withColumns({name: known_value(F.col("w"), name) for name in VALUES})
    run = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("block", F.count("iteration").over(run))


def scf_at(rows: DataFrame, iteration: int, key: str = "job") -> DataFrame:
    """Energy and accuracy in the first block of that iteration number."""
    block = rows.groupBy(key, "block").agg(
        F.max("iteration").alias("iteration"), F.min_by("energy", F.when(F.col("energy").isNotNull(), F.col("line_no"))).alias("scf_energy"),
        F.min_by("accuracy", F.when(F.col("accuracy").isNotNull(), F.col("line_no"))).alias("scf_accuracy"),
    )
    first = block.where(F.col("iteration") == iteration).groupBy(key).agg(F.min_by(F.struct("scf_energy", "scf_accuracy"), "block").alias("m"))
    return first.select(key, "m.*")


def scf_below(rows: DataFrame, threshold: float, key: str = "job") -> DataFrame:
    """The first iteration whose accuracy is below the threshold."""
    block = rows.groupBy(key, "block").agg(F.max("iteration").alias("iteration"), F.max("energy").alias("scf_energy"), F.min("accuracy").alias("scf_accuracy"))
    first = block.where(F.col("scf_accuracy") < threshold).groupBy(key).agg(F.min_by(F.struct("iteration", "scf_energy", "scf_accuracy"), "block").alias("m"))
    return first.select(key, "m.*")


def summaries(rows: DataFrame, key: str = "job") -> DataFrame:
    """Per job: iterations, first, last and all converged energies, first and last total force, ionic steps, convergence."""
    when = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    history = F.array_sort(F.collect_list(F.when(F.col("converged_energy").isNotNull(), F.struct("line_no", "converged_energy"))))
    return rows.groupBy(key).agg(
        F.count("iteration").alias("scf_iterations"),
        F.min_by("converged_energy", when("converged_energy")).alias("first_energy"),
        F.max_by("converged_energy", when("converged_energy")).alias("last_energy"),
        F.transform(history, lambda x: x["converged_energy"]).alias("energy_history"),
        F.min_by("total_force", when("total_force")).alias("first_force"),
        F.max_by("total_force", when("total_force")).alias("last_force"),
        F.count_if(begins(F.col("w"), POSITIONS)).alias("ionic_steps"),
        F.coalesce(F.bool_or(functools.reduce(lambda a, b: a | b, [F.lower("line").contains(d) for d in DONE])), F.lit(False)).alias("relax_converged"),
        F.max_by("alat", when("alat")).alias("alat_bohr"),
    )


def position_blocks(rows: DataFrame, key: str = "job") -> DataFrame:
    """``job, block, unit, atoms``: the atom lines that follow each positions header without a gap, in order.

    A running count of headers carries the block; the first line of a block that is no atom ends it.
    """
    head = begins(F.col("w"), POSITIONS)
    run = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = rows.select(key, "line_no", "line", "w", F.count_if(head).over(run).alias("b"), head.alias("head"))
    inside = Window.partitionBy(key, "b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = part.where("b > 0").withColumn("broken", F.count_if(~F.col("head") & ~F.coalesce(is_atom(F.col("w")), F.lit(False))).over(inside))
    symbol = F.get(F.split(F.trim("line"), "\\s+"), F.lit(0)).alias("symbol")
    atom = F.struct("line_no", symbol, *[numeric(F.col("w"), k + 2).alias(c) for k, c in enumerate("xyz")])
    unit = F.max(F.when(F.col("head"), F.get(F.col("w"), F.lit(1))))
    return part.where("broken = 0").groupBy(key, F.col("b").alias("block")).agg(
        F.coalesce(unit, F.lit("alat")).alias("unit"), F.min("line_no").alias("line_no"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), atom))).alias("atoms"),
    )


def cells(rows: DataFrame, key: str = "job") -> DataFrame:
    """``job, cell``: the three vectors below the job's last cell header, in angstrom; other units give nulls."""
    head = begins(F.col("w"), CELL)
    run = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = rows.select(key, "line_no", "w", "alat", F.max(F.when(head, F.col("line_no"))).over(run).alias("at"))
    part = part.where((F.col("line_no") - F.col("at")).between(0, 3))
    vector = F.when(F.col("line_no") > F.col("at"), F.struct("line_no", F.array(*[numeric(F.col("w"), k) for k in (1, 2, 3)]).alias("v")))
    unit = F.max(F.when(F.col("line_no") == F.col("at"), F.coalesce(F.get(F.col("w"), F.lit(1)), F.lit("alat"))))
    each = part.groupBy(key, "at").agg(unit.alias("unit"), F.array_sort(F.collect_list(vector)).alias("vs"))
    last = each.groupBy(key).agg(F.max_by(F.struct("unit", "vs"), "at").alias("m"))
    alat = rows.groupBy(key).agg((F.coalesce(F.max("alat"), F.max("celldm")) * BOHR).alias("alat"))
    scaled = lambda v: F.transform(v["v"], lambda c: in_angstrom(c, F.col("m.unit"), F.col("alat")))
    return last.join(alat, key).select(key, F.transform("m.vs", scaled).alias("cell"))


def in_angstrom(value: Column, unit: Column, alat: Column) -> Column:
    """A Cartesian coordinate in angstrom; null for other units."""
    return F.when(unit == "angstrom", value).when(unit == "bohr", value * BOHR).when(unit == "alat", value * alat)


def last_atom_history(rows: DataFrame, key: str = "job", label: str | None = None) -> DataFrame:
    """``job, block, x, y, z`` of one atom of each positions block, in angstrom: the last, or the last called ``label``.

    Crystal coordinates are multiplied by the job's cell; without a cell they give nulls. Blocks without such an
    atom are left out. Input decks go through the same lines.
    """
    alat = rows.groupBy(key).agg((F.coalesce(F.max("alat"), F.max("celldm")) * BOHR).alias("alat"))
    named = F.col("atoms") if label is None else F.filter("atoms", lambda a: F.lower(a["symbol"]) == label.lower())
    blocks = position_blocks(rows, key).withColumn("atom", F.try_element_at(named, F.lit(-1))).where("atom is not null")
    blocks = blocks.join(alat, key, "left").join(cells(rows, key), key, "left")

    def coordinate(k: int, c: str) -> Column:
        from_cell = sum((F.col(f"atom.{a}") * F.get(F.get(F.col("cell"), F.lit(i)), F.lit(k)) for i, a in enumerate("xyz")), F.lit(0.0))
        return F.when(F.col("unit") == "crystal", from_cell).otherwise(in_angstrom(F.col(f"atom.{c}"), F.col("unit"), F.col("alat"))).alias(c)

    return blocks.select(key, "block", "line_no", *[coordinate(k, c) for k, c in enumerate("xyz")])


def energies_with_geometry(rows: DataFrame, key: str = "job") -> DataFrame:
    """``job, step, energy, x, y, z``: each converged energy with the geometry that stands before it (null: the input's)."""
    where = last_atom_history(rows, key).select(key, "line_no", F.lit(None).cast("double").alias("energy"), F.struct("x", "y", "z").alias("at"))
    es = rows.where("converged_energy is not null").select(key, "line_no", F.col("converged_energy").alias("energy"), F.lit(None).cast("struct<x:double,y:double,z:double>").alias("at"))
    run = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    both = where.union(es).withColumn("at", F.last("at", ignorenulls=True).over(run)).where("energy is not null")
    step = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1
    return both.select(key, step.alias("step"), "energy", "at.*")


def force_blocks(rows: DataFrame, key: str = "job") -> DataFrame:
    """``job, block, forces`` after each forces header."""
    run = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = rows.withColumn("b", F.count_if(begins(F.col("w"), FORCES)).over(run))
    row = (F.get(F.col("w"), F.lit(0)) == "atom") & (F.get(F.col("w"), F.lit(4)) == "force") & numeric(F.col("w"), 8).isNotNull()
    force = F.struct("line_no", *[numeric(F.col("w"), k + 6).alias(c) for k, c in enumerate(("fx", "fy", "fz"))])
    return part.where((F.col("b") > 0) & row).groupBy(key, F.col("b").alias("block")).agg(F.array_sort(F.collect_list(force)).alias("forces"))


def attempt_summaries(rows: DataFrame, key: str = "job") -> DataFrame:
    """Summaries of each attempt's lines ``(job, attempt, line_no, line)``; :func:`pick_attempt` chooses among them."""
    each = rows.withColumn("_job", F.struct(key, "attempt"))
    return summaries(marked(each, "_job"), "_job").select("_job.*", "*").drop("_job")


def pick_attempt(attempts: DataFrame, key: str = "job") -> DataFrame:
    """Of several attempts of a job the last converged one, else the latest."""
    best = Window.partitionBy(key).orderBy(F.desc("relax_converged"), F.desc("attempt"))
    return attempts.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def attempt_number(name: Column) -> Column:
    """The number in ``name.r001.ext``; zero without one."""
    found = F.regexp_extract(name, r"\.r(\d+)(?:\.[^.]*)?$", 1)
    return F.when(found == "", 0).otherwise(found.try_cast("int"))


def diatomic_fit(history: DataFrame, key: str = "job", window: int = 5, reduced_mass_amu: float = 0.503912516) -> DataFrame:
    """``job, r_eq, curvature, wavenumber, zero_point``: a parabola through the ``window`` points around the least energy.

    ``history(job, r, energy)`` in angstrom and eV; equal distances are first averaged. The normal equations
    are summed per job and solved in closed form. An opening downwards gives nulls.
    """
    one = history.groupBy(key, F.round("r", 10).alias("r")).agg(F.avg("energy").alias("energy"))
    low = one.groupBy(key).agg(F.min_by("r", "energy").alias("r0"), F.min("energy").alias("e0"))
    near = one.join(low, key).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.col("r") - F.col("r0")), "r")))
    u, e = F.col("r") - F.col("r0"), F.col("energy") - F.col("e0")
    s = near.where(F.col("n") <= window).select(key, "r0", u.alias("u"), e.alias("e")).groupBy(key, "r0").agg(
        F.count("*").alias("s0"), *[F.sum(F.pow("u", F.lit(k))).alias(f"s{k}") for k in range(1, 5)],
        F.sum("e").alias("t0"), F.sum(F.col("u") * F.col("e")).alias("t1"), F.sum(F.col("u") * F.col("u") * F.col("e")).alias("t2"),
    )
    c = F.col
    det = c("s0") * (c("s2") * c("s4") - c("s3") * c("s3")) - c("s1") * (c("s1") * c("s4") - c("s2") * c("s3")) + c("s2") * (c("s1") * c("s3") - c("s2") * c("s2"))
    a = (c("s0") * (c("s2") * c("t2") - c("s3") * c("t1")) - c("s1") * (c("s1") * c("t2") - c("s2") * c("t1")) + c("t0") * (c("s1") * c("s3") - c("s2") * c("s2"))) / det
    b = (c("s0") * (c("t1") * c("s4") - c("s3") * c("t2")) - c("t0") * (c("s1") * c("s4") - c("s2") * c("s3")) + c("s2") * (c("s1") * c("t2") - c("s2") * c("t1"))) / det
    fit = s.select(key, "r0", F.when(F.abs(det) > 0, a).alias("a"), F.when(F.abs(det) > 0, b).alias("b"))
    k = 2 * F.col("a")
    # eV / angstrom^2 and atomic masses to 1 / s, then to 1 / cm and eV
    omega = F.sqrt(k * 16.02176634 / (reduced_mass_amu * 1.66053906660e-27))
    ok = F.col("a") > 0
    return fit.select(
        key, F.when(ok, F.col("r0") - F.col("b") / k).alias("r_eq"), F.when(ok, k).alias("curvature"),
        F.when(ok, omega / (2 * 3.141592653589793 * 2.99792458e10)).alias("wavenumber"), F.when(ok, omega * 6.582119569e-16 / 2).alias("zero_point"),
    )


def adsorption_energy(results: DataFrame, references: DataFrame, energy: Sequence[str] = ("E_bfgs_final_Ry", "E_converged_final_Ry"), slab: str = "clean_slab", gas: str = "H2", multiplier: float = 0.5, shift_ev: float | None = None) -> DataFrame:
    """Adds ``E_ads_Ry`` = E - E_slab(map) - multiplier * E_gas, and free energies with a shift.

    ``references(name, map_index, value)``: a null map counts for all maps unless the map has its own.
    """
    def value(name: str, alias: str) -> DataFrame:
        mine = references.where(F.col("name") == name)
        own = mine.where("map_index is not null").select("map_index", F.col("value").alias(f"{alias}_own"))
        every = mine.where("map_index is null").agg(F.max("value").alias(f"{alias}_all"))
        return own, every

    out = results
    for name, alias in ((slab, "_slab"), (gas, "_gas")):
        own, every = value(name, alias)
        out = out.join(F.broadcast(own), "map_index", "left").crossJoin(F.broadcast(every))
    e = F.coalesce(*[F.col(c) for c in energy if c in results.columns])
    ads = e - F.coalesce("_slab_own", "_slab_all") - multiplier * F.coalesce("_gas_own", "_gas_all")
    out = out.withColumn("E_ads_Ry", ads).drop("_slab_own", "_slab_all", "_gas_own", "_gas_all")
    if shift_ev is not None:
        out = out.withColumn("G_ads_CHE_Ry", F.col("E_ads_Ry") + shift_ev / RYDBERG_EV).withColumn("G_ads_CHE_eV", F.col("G_ads_CHE_Ry") * RYDBERG_EV)
    return out


def job_folder(template: str, **columns: Column) -> Column:
    """A folder template such as ``qe_job_{point_index}`` filled from columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else columns[p].cast("string") for i, p in enumerate(parts)])
