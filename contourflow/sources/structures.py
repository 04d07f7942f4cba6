"""Structure and volumetric files as DataFrames: one file, one row, parsed where it is read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANGSTROM = 0.529177210903
SYMBOLS = ("X H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
           "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi").split()


def folder_number(folder: Column) -> Column:
    """The last number in a folder's name, as a double; null without one."""
    return F.try_element_at(F.regexp_extract_all(folder, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1)).try_cast("double")


def find_files(spark: SparkSession, folders: str | Sequence[str], pattern: str = "*", recursive: bool = False) -> DataFrame:
    """``source_file`` and five more columns of source metadata, ``map_index`` by folder and path, and ``content``.

    A folder in which nothing matches is an error.
    """
    parts = []
    for n, folder in enumerate([folders] if isinstance(folders, str) else folders):
        got = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
        if got.limit(1).count() == 0:
            raise FileNotFoundError(f"no file matches {pattern} in {folder}")
        parts.append(got.select(F.lit(n).alias("_f"), F.col("path").alias("source_file"), F.decode("content", "UTF-8").alias("content")))
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    name = F.element_at(F.split("source_file", "/"), -1)
    folder = F.regexp_replace("source_file", "/[^/]*$", "")
    last = F.element_at(F.split(folder, "/"), -1)
    # the paths alone are numbered; the contents do not pass the window
    numbered = both.select("_f", "source_file", (F.row_number().over(Window.orderBy("_f", "source_file")) - 1).alias("map_index"))
    return both.join(numbered, ["_f", "source_file"]).select(
        "map_index", "source_file", name.alias("source_file_name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("source_file_stem"), folder.alias("source_folder"), last.alias("source_folder_name"),
        folder_number(last).alias("source_folder_number"), "content",
    )


def _scale(units: str, alat: float = 1.0) -> float:
    scales = {"bohr": ANGSTROM, "angstrom": 1.0, "alat": alat}
    if units not in scales:
        raise ValueError(f"unknown units: {units}")
    return scales[units]


def parse_xyz(text: str, units: str = "bohr") -> dict:
    """Cell, origin and atoms of one extended or plain XYZ text.

    Line 1 has the number of atoms and may have an origin; line 2 has one, three or nine numbers, or
    ``Lattice="..."`` and ``Origin="..."``. A single number is a cubic cell in angstrom, whatever the units.
    """
    import re

    lines = text.splitlines()
    head = lines[0].split()
    n, origin = int(head[0]), [float(x) for x in head[1:4]] if len(head) >= 4 else [0.0, 0.0, 0.0]
    found = re.search(r'Lattice="([^"]+)"', lines[1])
    numbers = [float(x) for x in (found[1] if found else lines[1]).split()]
    if at := re.search(r'Origin="([^"]+)"', lines[1]):
        origin = [float(x) for x in at[1].split()]
    scale = _scale(units, numbers[0] if numbers else 1.0)
    if len(numbers) == 1:
        cell = [numbers[0], 0, 0, 0, numbers[0], 0, 0, 0, numbers[0]]
    elif len(numbers) == 3:
        cell = [numbers[0] * scale, 0, 0, 0, numbers[1] * scale, 0, 0, 0, numbers[2] * scale]
    elif len(numbers) == 9:
        cell = [x * scale for x in numbers]
    else:
        raise ValueError("the cell needs one, three or nine numbers")
    atoms = [(p[0], *(float(x) * scale for x in p[1:4])) for p in (line.split() for line in lines[2 : 2 + n])]
    if len(atoms) != n:
        raise ValueError(f"{n} atoms announced, {len(atoms)} found")
    return {"cell": [float(x) for x in cell], "origin": [float(x) for x in origin], "atoms": atoms}


def parse_cube(text: str, units: str = "bohr") -> dict:
    """Atoms, grid and values of one cube text; the last axis runs fastest."""
    lines = text.splitlines()
    head = lines[2].split()
    n, origin = abs(int(head[0])), [float(x) for x in head[1:4]]
    axes = [line.split() for line in lines[3:6]]
    scalars = [int(a[0]) for a in axes]
    basis = [float(x) for a in axes for x in a[1:4]]
    scale = _scale(units)
    atoms = [(SYMBOLS[int(p[0])], *(float(x) * scale for x in p[2:5])) for p in (line.split() for line in lines[6 : 6 + n])]
    values = [float(x) for line in lines[6 + n :] for x in line.split()]
    if len(values) != scalars[0] * scalars[1] * scalars[2]:
        raise ValueError("the number of values does not match the grid")
    return {"scalars": scalars, "basis": basis, "origin": origin, "atoms": atoms, "values": values}


def read_atoms(files: DataFrame, fmt: str = "xyz+", units: str = "bohr") -> DataFrame:
    """``map_index, atom_index, symbol, ax, ay, az, cell, origin`` of all files."""
    if fmt not in ("xyz+", "cube"):
        raise ValueError(f"unknown format: {fmt}")
    parse = parse_xyz if fmt == "xyz+" else parse_cube

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m, text in zip(pdf["map_index"], pdf["content"], strict=True):
                got = parse(text, units)
                cell = got.get("cell") or [b * got["scalars"][i // 3] for i, b in enumerate(got["basis"])]
                rows += [(m, i, *a, cell, got["origin"]) for i, a in enumerate(got["atoms"])]
            yield pd.DataFrame(rows, columns=["map_index", "atom_index", "symbol", "ax", "ay", "az", "cell", "origin"])

    return files.select("map_index", "content").mapInPandas(run, "map_index int, atom_index int, symbol string, ax double, ay double, az double, cell array<double>, origin array<double>")


def read_volume(files: DataFrame, units: str = "bohr") -> DataFrame:
    """``map_index, cell_id, ix, iy, iz, value`` of cube files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m, text in zip(pdf["map_index"], pdf["content"], strict=True):
                got = parse_cube(text, units)
                n = len(got["values"])
                yield pd.DataFrame({"map_index": [m] * n, "cell_id": range(n), "ny": got["scalars"][1], "nz": got["scalars"][2], "value": got["values"]})

    raw = files.select("map_index", "content").mapInPandas(run, "map_index int, cell_id long, ny int, nz int, value double")
    return raw.select("map_index", "cell_id", F.expr("int(cell_id div (ny * nz))").alias("ix"), F.expr("int((cell_id div nz) % ny)").alias("iy"), F.expr("int(cell_id % nz)").alias("iz"), "value")


def write_cube(cells: DataFrame, value: str, shape: tuple[int, int, int], basis: Sequence[Sequence[float]], origin: Sequence[float], atoms: Sequence[tuple], path: str, comment: str = "contourflow") -> None:
    """A folder of text parts that make a cube file in order: header, then values, six a line within each column along z.

    Columns are range-sorted, so no task holds the volume.
    """
    spark = cells.sparkSession
    head = [comment, "", f"{len(atoms):5d} " + " ".join(f"{x:12.6f}" for x in origin)]
    head += [f"{n:5d} " + " ".join(f"{x:12.6f}" for x in row) for n, row in zip(shape, basis, strict=True)]
    head += [f"{SYMBOLS.index(s):5d} {0.0:12.6f} {x:12.6f} {y:12.6f} {z:12.6f}" for s, x, y, z in atoms]
    rows = cells.groupBy("ix", "iy").agg(F.array_sort(F.collect_list(F.struct("iz", F.col(value).alias("value")))).alias("v"))
    chunk = F.transform(F.sequence(F.lit(0), F.lit((shape[2] - 1) // 6)), lambda i: F.concat_ws(" ", F.transform(F.slice("v", i * 6 + 1, F.lit(6)), lambda x: F.format_string("% .5E", x["value"]))))
    lines = rows.select((F.col("ix") * shape[1] + F.col("iy")).cast("long").alias("n"), F.concat_ws("\n", chunk).alias("line"))
    top = spark.createDataFrame([(-1, "\n".join(head))], "n long, line string")
    top.union(lines).orderBy("n").select("line").write.mode("overwrite").text(path)
