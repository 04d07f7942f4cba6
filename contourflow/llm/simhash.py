"""SimHash near-duplicates: meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, forest, keyed_documents, lean

#: Variants that a worker holds at once; above it a bin is split by one more leading bit.
MOST_VARIANTS = 3_000_000
#: Mean number of distinct fingerprints that share a bin's prefix.
BIN_ROWS = 1024


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of one text.

    A-Z are lower-cased; words are maximal runs of bytes other than ASCII white space; all ``words``-word
    shingles count, repeats included (fewer words: the whole sequence). A bit is set where more than half
    the shingles' XXH64 values have it. Null, empty and blank texts give zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        block = hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(*keys, fp)``, all long, for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, words, seed) for x in batch.column(len(keys)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(fp.view(np.int64))], [*keys, "fp"])

    schema = "".join(f"{k} long, " for k in keys) + "fp long"
    return docs.select(*[F.col(k).cast("long").alias(k) for k in keys], "text").mapInArrow(lean(run), schema)


def _balls(fps: np.ndarray, bin_: int, b: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among ``fps`` that meet in a variant starting with the ``b`` bits ``bin_``."""
    free = 64 - b
    prefix = fps >> np.uint64(free) if b else np.zeros(len(fps), np.uint64)
    used = np.bitwise_count(prefix ^ np.uint64(bin_)).astype(np.int64)
    fps, left = fps[used <= half], half - used[used <= half]
    count = sum(int((left >= k).sum()) * math.comb(free, k) for k in range(half + 1))
    none = np.empty(0, np.uint64)
    if len(fps) < 2:
        return none, none
    if count > MOST_VARIANTS and free:
        parts = [_balls(fps, bin_ << 1 | bit, b + 1, half) for bit in (0, 1)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    low = np.uint64((1 << free) - 1)
    base = (fps & low) | np.uint64(bin_ << free & (1 << 64) - 1)
    variants, owner = [], []
    for k in range(half + 1):
        have = np.flatnonzero(left >= k)
        masks = np.array([sum(1 << j for j in c) for c in combinations(range(free), k)], np.uint64)
        if len(have) and len(masks):
            variants.append((base[have][:, None] ^ masks[None, :]).ravel())
            owner.append(np.repeat(have, len(masks)))
    v, who = np.concatenate(variants), np.concatenate(owner)
    ordered = np.sort(v)
    hits = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(hits):
        return none, none
    at = np.minimum(np.searchsorted(hits, v), len(hits) - 1)
    met = hits[at] == v
    at, who = at[met], who[met]
    order = np.lexsort((who, at))
    at, who = at[order], who[order]
    first = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]], np.arange(len(at)), 0))
    x, y = who[first], who
    pairs = np.unique((x * len(fps) + y)[x != y])
    return fps[pairs // len(fps)], fps[pairs % len(fps)]


def near_pairs(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints ``fp`` linked within ``radius`` bits.

    Two fingerprints within ``radius`` share a variant within half of it of both. All variants of a
    fingerprint fall into the bins of its prefix with at most half the radius flipped, so a row goes to
    these bins only (37 for eight prefix bits) and the bin's task expands, sorts and collides the variants
    in slices of bounded size. Those that meet in a variant form a star instead of all pairs, each link is
    verified, and a bin returns a spanning forest. ``radius`` must be even (an odd one: use the next even
    one; the verification still keeps to ``radius``).
    """
    half = (radius + 1) // 2
    n = distinct.count()
    b = min(40, max(4, math.ceil(math.log2(max(n, 1) / BIN_ROWS)))) if n else 4
    masks = [sum(1 << j for j in c) for k in range(half + 1) for c in combinations(range(b), k)]
    spread = distinct.select(
        "fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m")
    ).select("fp", F.shiftrightunsigned("fp", 64 - b).bitwiseXOR(F.col("m")).alias("bin"))

    def run(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy().view(np.uint64))
        x, y = _balls(fps, int(table.column("bin")[0].as_py()), b, half)
        near = np.bitwise_count(x ^ y) <= radius
        x, y = forest(x[near], y[near]) if near.any() else (x[:0], y[:0])
        return pa.table({"a": pa.array(x.view(np.int64)), "b": pa.array(y.view(np.int64))})

    return spread.groupBy("bin").applyInArrow(run, "a long, b long")


def fingerprint_roots(fp: DataFrame, radius: int) -> DataFrame:
    """``fp, low, root`` for each distinct fingerprint of ``fp(doc_id, fp)``: its smallest doc_id and its component."""
    classes = fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = components(near_pairs(classes.select("fp"), radius))
    return classes.join(linked, classes.fp == linked.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def keep_representatives(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """One row of ``docs`` for each component of :func:`simhash_components`, whole: that with the smallest doc_id.

    Null ids come last; of rows that share the id the choice goes by a hash of the text, and rows repeated
    as a whole count once.
    """
    keyed = keyed_documents(docs)
    fp = checkpoint(fingerprints(keyed, words, seed, ("doc_id", "k1", "k2")))
    labelled = fp.join(fingerprint_roots(fp, radius).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2"))
    kept = labelled.groupBy("root").agg(first.alias("first")).select("first.k1", "first.k2")
    rows = keyed.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return rows.select(*docs.columns)


def simhash_components(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` for every row of ``docs``.

    Fingerprints (see :func:`fingerprint`) link at ``radius`` or fewer differing bits; ``component_id`` is
    the smallest ``doc_id`` reachable, the row's own included, and ``kept`` marks that row. Equal
    fingerprints are collapsed by partial aggregation before any search, so copies cost nothing more.
    Null, empty and blank texts share fingerprint zero and link like any other. Rows with a null
    ``doc_id`` take part; a component with nothing else has a null ``component_id``. Rows repeated with
    one ``doc_id`` each get a row. Only ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    fp = checkpoint(fingerprints(docs, words, seed))
    roots = fingerprint_roots(fp, radius)
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = roots.join(lowest, "root").select("fp", "component_id")
    return fp.join(labels, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
