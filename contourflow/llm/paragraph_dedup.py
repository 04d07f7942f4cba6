"""Paragraph near-duplicates: MinHash banding, exact verification, removal by components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, compressed, forest, keyed_documents, stored

#: Words that are hashed at once.
CHUNK = 1 << 17
#: Members of a bucket that are compared in one task; larger buckets are compared tile by tile.
TILE = 2048
#: Repeated runs that are broadcast; beyond, they meet their places in a join.
MOST_BROADCAST = 200_000
_ODD = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tune_bands(threshold: float, recall: float = 0.995, rows: int = 2) -> int:
    """The number of bands of ``rows`` values with which a pair at the threshold collides with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def pieces(raw: bytes) -> tuple[list[bytes], list[tuple[int, int, int, int]]]:
    """Lower-cased words of a text, and its paragraphs as (first word, word after the last, first byte, byte after the last).

    Paragraphs end at line feeds and are whole, however long or short; lines without words are none.
    """
    words, found, offset = [], [], 0
    for line in raw.split(b"\n"):
        part = line.lower().split()
        if part:
            found.append((len(words), len(words) + len(part), offset, offset + len(line)))
        words += part
        offset += len(line) + 1
    return words, found


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = a * _ODD[61] + b
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(32)
    return v


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbours in ``h``, put together from runs of powers of two."""
    n = max(len(h) - size + 1, 0)
    block, width, out, done = h, 1, None, 0
    while True:
        if size & width:
            out = block[done : done + n] if out is None else _mix(out[:n], block[done : done + n])
            done += width
        if 2 * width > size:
            return out
        block = _mix(block[: max(len(block) - width, 0)], block[width:])
        width *= 2


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct hashes of a piece's shingles; a shorter piece is one shingle."""
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)], np.uint64)
    return np.unique(run_hashes(word_hashes(words), size))


def band_keys(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each part ``hashes[first:last]`` (none is empty) a key for each band of ``rows`` MinHash values."""
    ends = np.column_stack([first, last]).ravel()
    padded = np.append(hashes, np.uint64(0))  # a part may end with the hashes
    key = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(first), b + 1, np.uint64) * _ODD[63]
        for r in range(rows):
            v = padded * _ODD[b * rows + r]
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            k = (k ^ np.minimum.reduceat(v, ends)[::2]) * np.uint64(0x94D049BB133111EB)
            k ^= k >> np.uint64(31)
        key[:, b] = k
    return key


def passage_seeds(h: np.ndarray, passage: int) -> np.ndarray:
    """For each run of ``passage`` words the least hash of the runs of half its length inside it."""
    half = passage // 2
    low, width, inside = run_hashes(h, half), 1, passage - half + 1
    while 2 * width <= inside:
        low = np.minimum(low[: max(len(low) - width, 0)], low[width:])
        width *= 2
    n = max(len(h) - passage + 1, 0)
    return np.minimum(low[:n], low[inside - width : inside - width + n])


def _distinct_seeds(seed: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct seeds of a text's passages, and those of them that stand at several places."""
    at = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
    length = np.diff(np.r_[at, len(seed)])
    value, n = np.unique(seed[at], return_counts=True)
    return value, np.union1d(value[n > 1], seed[at[length > inside]])


def _colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of ``(uid, key)`` rows those whose key has several uids, and those at its ends, whose key may go on."""
    got = list(batches)
    if not got:
        return
    table = pa.Table.from_batches(got)
    both = np.unique(np.column_stack([table["key"].to_numpy(), table["uid"].to_numpy()]), axis=0)
    if not len(both):
        return
    key = both[:, 0]
    same = np.r_[False, key[1:] == key[:-1]]
    keep = same | np.r_[same[1:], False] | (key == key[0]) | (key == key[-1])
    yield pa.RecordBatch.from_pydict({"key": both[keep, 0], "uid": both[keep, 1]})


_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word of a text, and the byte after its last."""
    edge = np.diff(_SPACE[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _touched(raw: bytes, spans: Sequence) -> int:
    """How many paragraphs share words with ``spans(start, end)``."""
    first, last = np.array([x[2:] for x in pieces(raw)[1]], np.int64).reshape(-1, 2).T
    hit = np.zeros(len(first) + 1, np.int64)
    for x in spans:
        hit[np.searchsorted(last, x["start"], "right")] += 1
        hit[np.searchsorted(first, x["end"])] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def _stretches(raw: bytes, spans: Sequence, least: int) -> int:
    """How many runs of ``spans(start, end)`` with no words between them have ``least`` words or more."""
    joined: list[list[int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in spans):
        if joined and (start <= joined[-1][1] or not raw[joined[-1][1] : start].strip()):
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    return sum(len(raw[a:b].split()) >= least for a, b in joined)


def similar(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of shingle sets with Jaccard similarity >= threshold (``None``: pairs i < j within ``a``).

    Exact: shared shingles are counted by a product over those that occur more than once.
    """
    every = a if b is None else a + b
    flat = np.concatenate(every)
    size = np.array([len(x) for x in every])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[col] > 1
    used, col = np.unique(col[keep], return_inverse=True)
    row = np.repeat(np.arange(len(every)), size)[keep]
    na = len(a)
    out_a, out_b = [], []
    total = np.zeros((na, len(every) if b is None else len(b)), np.float32)
    start = 0 if b is None else na
    for c in range(0, len(used), 4096):
        m = np.zeros((len(every), min(4096, len(used) - c)), np.float32)
        here = (col >= c) & (col < c + 4096)
        m[row[here], col[here] - c] = 1
        total += m[:na] @ m[start:].T
    union = size[:na, None] + size[start:][None, :] - total
    out_a, out_b = np.nonzero(total >= threshold * union - 1e-9)
    if b is None:
        return out_a[out_a < out_b], out_b[out_a < out_b]
    return out_a, out_b


def paragraph_duplicates(
    docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.995, rows: int = 2, with_text: bool = False,
    passage: int | None = None,
) -> DataFrame:
    """``doc_id, n_bytes, n_paragraphs, n_removed, n_spans, n_linked, kept_sha256`` for every row (and ``text`` on demand).

    A text's whole paragraphs (see :func:`pieces`) of any length are compared as sets of ``shingle``-word
    shingles (a shorter paragraph is one), A-Z lower-cased, white space folded. Paragraphs with a Jaccard similarity of ``threshold`` or more are linked; of each component the occurrence
    with the smallest doc_id (then position) stays and the bytes of all others are removed: ``n_removed``
    bytes in ``n_spans`` runs; ``n_linked`` counts the row's pieces in components of several occurrences.

    With ``passage``, runs of that many words or more that occur again inside the paragraphs that stay (in
    any document, or twice in one text without overlap) are removed after that, whole, up to their first
    and last common word; the first occurrence stays. Runs are words in a row of the whole text, so they may cross
    line feeds, which need not stand at the same words in every occurrence. This is exact: equal runs have equal
    seeds (the least hash of the runs of half the length inside), so only runs whose seed occurs twice are hashed
    and grouped. A run that a removed paragraph takes part of is not removed, but counted. Paragraphs that hold words
    of a run count in ``n_linked``. ``n_linked`` counts short lines like long ones, so a column
    ``n_passages`` follows: the stretches of ``passage`` words or more that consist of nothing but such repeated
    paragraphs and runs next to each other, the first occurrences included.

    Bands are tuned for a recall of at least ``recall`` per link at the threshold; colliding pieces are
    verified exactly. Equal pieces are one class and link without a search. Buckets of very many different
    pieces are compared in tiles, whole, and a task returns a spanning forest. Rows repeated as a whole
    share their pieces and keep or lose them alike. Null and empty texts have no pieces; null ids sort last; an empty table gives
    no rows; other columns are ignored.
    """
    bands = tune_bands(threshold, recall, rows)
    keyed = keyed_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names = ("doc_id", "k1", "k2", "start", "end", "uid")
        rows_of: dict[str, list] = {c: [] for c in names}
        words: list[bytes] = []
        fresh: list[tuple[int, int, int]] = []  # row, first word, word after the last
        texts: list[tuple[int, int, int]] = []  # the same for a text, in the row of its first paragraph

        def close() -> pa.RecordBatch:
            n = len(rows_of["uid"])
            count = np.zeros(n + 1, np.int32)
            keys = np.empty((0, bands), np.uint64)
            at = np.array(fresh, np.int64).reshape(-1, 3)
            h = word_hashes(words)
            if len(at):
                keys = band_keys(run_hashes(h, shingle), at[:, 1], at[:, 2] - shingle + 1, bands, rows)
                count[at[:, 0] + 1] = bands
            lists = [pa.ListArray.from_arrays(np.cumsum(count, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))]
            if passage:
                found: list[list[np.ndarray]] = [[], []]
                counts = np.zeros((2, n + 1), np.int32)
                if texts:
                    seed = passage_seeds(h, passage)
                    for row, a, b in texts:
                        for k, v in enumerate(_distinct_seeds(seed[a : b - passage + 1], passage - passage // 2 + 1)):
                            found[k].append(v)
                            counts[k, row + 1] = len(v)
                for k in (0, 1):
                    flat = np.concatenate([np.empty(0, np.uint64), *found[k]]).view(np.int64)
                    lists.append(pa.ListArray.from_arrays(np.cumsum(counts[k], dtype=np.int32), pa.array(flat)))
            arrays = [*(pa.array(v, pa.int64()) for v in rows_of.values()), *lists]
            for v in (*rows_of.values(), words, fresh, texts):
                v.clear()
            return pa.RecordBatch.from_arrays(arrays, [*names, "keys", "seeds", "again"][: len(arrays)])

        for batch in batches:
            for doc, k1, k2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part, found = pieces((text or "").encode("utf-8", "surrogatepass"))
                base = len(words)
                words += part
                if passage and len(part) >= passage:
                    texts.append((len(rows_of["uid"]), base, len(words)))
                for a, b, start, end in found:
                    uid = xxhash.xxh64_intdigest(b" ".join(part[a:b]), 3) >> 1
                    if uid not in seen:
                        seen.add(uid)
                        if b - a >= shingle:  # shorter ones are alike only if equal
                            fresh.append((len(rows_of["uid"]), base + a, base + b))
                    for c, v in zip(names, (doc, k1, k2, start, end, uid), strict=True):
                        rows_of[c].append(v)
                if len(seen) > 1_000_000:
                    seen.clear()
                if len(words) > CHUNK:
                    yield close()
        yield close()

    schema = "doc_id long, k1 long, k2 long, start long, end long, uid long, keys array<bigint>"
    if passage:
        schema += ", seeds array<bigint>, again array<bigint>"
    scanned = keyed.select("doc_id", "k1", "k2", "text").mapInArrow(scan, schema)
    scanned = stored(scanned, "pieces")
    pieces_of = scanned.select("doc_id", "k1", "k2", "start", "end", "uid")
    banded = scanned.select("uid", F.explode("keys").alias("key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = banded.repartitionByRange(parts, "key", "uid").mapInArrow(_colliding, "key long, uid long")
    members = stored(members.distinct(), "members")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    # one occurrence of each member piece brings its shingles
    where = pieces_of.join(members.select("uid").distinct(), "uid", "left_semi").groupBy("uid").agg(
        F.min(F.struct("k1", "k2", "start", "end")).alias("at")
    )
    wanted = where.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("uid", "at.start", "at.end")).alias("at"))
    packed = compressed(keyed.select("doc_id", "k1", "k2", "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            uids, sets = [], []
            for z, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = unpack.decompress(z)
                for x in at:
                    uids.append(x["uid"])
                    sets.append(shingles(raw[x["start"] : x["end"]].lower().split(), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["uid", "hashes"])

    sets = packed.join(wanted, ["k1", "k2"]).select("z", "at").mapInArrow(cut, "uid long, hashes array<bigint>")
    sets = stored(sets.dropDuplicates(["uid"]), "sets")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tiled = members.join(sizes, "key").withColumn("t", F.pmod(F.xxhash64("uid"), tiles).cast("int"))
    tiled = tiled.withColumn("o", F.explode(F.sequence(F.lit(0), tiles - 1)))
    cells = tiled.select(
        "key", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "uid"
    ).join(sets, "uid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last = None

        def close() -> pa.RecordBatch:
            uid = np.array([x[1] for x in held], np.int64)
            t = np.array([x[0] for x in held])
            hashes = [x[2] for x in held]
            i, j = last[1], last[2]
            left, right = np.flatnonzero(t == i), np.flatnonzero(t == j)
            a, b = np.empty(0, np.int64), np.empty(0, np.int64)
            if len(left) and len(right):
                p, q = similar([hashes[x] for x in left], None if i == j else [hashes[x] for x in right], threshold)
                if len(p):
                    a, b = forest(uid[left[p]], uid[right[q]])
            return pa.RecordBatch.from_pydict({"a": a, "b": b})

        for batch in batches:
            key, i, j, t, uid = (batch.column(c).to_pylist() for c in range(5))
            lists = batch.column(5)
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for r in range(batch.num_rows):
                cell = (key[r], i[r], j[r])
                if cell != last and held:
                    if len(held) > 1:
                        yield close()
                    held = []
                last = cell
                held.append((t[r], uid[r], flat[offsets[r] : offsets[r + 1]]))
        if len(held) > 1:
            yield close()

    links = (
        cells.select("key", "i", "j", "t", "uid", "hashes")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(verify, "a long, b long")
    )
    def repeated(marked: DataFrame) -> DataFrame:
        """``k1, k2, span`` for the passages that repeat in paragraphs that stay; those of first places are not dropped."""
        owner = F.shiftrightunsigned(F.xxhash64("k1", "k2"), 1)
        # a seed that stands twice in one text has a second owner, the complement of the first
        owned = scanned.select(owner.alias("uid"), F.explode("seeds").alias("key")).union(
            scanned.select((-1 - owner).alias("uid"), F.explode("again").alias("key"))
        )
        owned = stored(owned.repartitionByRange(parts, "key", "uid").mapInArrow(_colliding, "key long, uid long").distinct(), "seeds")
        owned = owned.withColumn("twin", F.col("uid") < 0).withColumn("uid", F.greatest("uid", -1 - F.col("uid")))
        # of a text whose paragraphs all go, nothing is asked
        at = marked.where(F.size("gone") < F.col("n_paragraphs")).select("k1", "k2", "gone", owner.alias("uid"))
        owned = owned.join(at.select("uid"), "uid", "left_semi")
        several = owned.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        seeds = owned.where("not twin").join(several, "key").groupBy("uid").agg(F.collect_set("key").alias("seeds"))
        asked = at.join(seeds, "uid").select("k1", "k2", "gone", "seeds")

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor()
            last = None
            for batch in batches:
                for z, doc, k1, k2, gone, seeds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if seeds is None or (k1, k2) == last:
                        continue
                    last = k1, k2
                    raw = unpack.decompress(z)
                    words, found = pieces(raw)
                    dropped, out = np.zeros(len(words) + 1, np.int64), set(gone)
                    for a, b, start, _ in found:
                        dropped[a + 1 : b + 1] = start in out
                    dropped = np.cumsum(dropped)
                    lost = dropped[passage:] - dropped[:-passage]
                    h = word_hashes(words)
                    seed = passage_seeds(h, passage).view(np.int64)
                    hit = np.flatnonzero((lost < passage) & np.isin(seed, np.array(seeds, np.int64)))
                    if len(hit):
                        first, after = word_places(raw)
                        same = {"doc_id": doc, "k1": k1, "k2": k2}
                        columns = {c: pa.array([v] * len(hit), pa.int64()) for c, v in same.items()}
                        columns |= {"s": first[hit], "e": after[hit + passage - 1], "whole": lost[hit] == 0}
                        yield pa.RecordBatch.from_pydict({"seed": seed[hit], "run": run_hashes(h, passage).view(np.int64)[hit]} | columns)

        schema = "seed long, run long, doc_id long, k1 long, k2 long, s long, e long, whole boolean"
        # a left join on the same table as the last one's, so that the texts are dealt once for both
        found = packed.join(asked, ["k1", "k2"], "left").select("z", "doc_id", "k1", "k2", "gone", "seeds").mapInArrow(runs, schema)
        found = stored(found, "runs")
        place = F.when(F.col("whole"), F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "s", "k1", "k2", "e"))
        heads = found.groupBy("seed", "run").agg(F.min(place).alias("h"), F.count("*").alias("n")).where("n > 1").select("seed", "run", "h")
        heads = stored(heads, "heads")
        few = heads.count() <= MOST_BROADCAST
        met = found.join(F.broadcast(heads) if few else heads, ["seed", "run"])
        home = (F.col("k1") == F.col("h.k1")) & (F.col("k2") == F.col("h.k2"))
        # those that overlap the first place stay with it
        met = met.select("k1", "k2", "s", "e", (F.col("whole") & ~(home & (F.col("s") < F.col("h.e")))).alias("drop"))
        if not few:
            # the broadcast leaves a text's runs together; the shuffled join scatters them
            met = met.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "drop", "s")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Neighbouring runs as one."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                k1, k2, s, e, drop = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5))
                v = np.column_stack([k1, k2, drop, s, e])
                v = v[np.lexsort(v.T[::-1])]
                cut = np.r_[True, (v[1:, :3] != v[:-1, :3]).any(axis=1) | (v[1:, 3] > v[:-1, 4])]
                v = np.column_stack([v[cut, :4], v[np.r_[cut[1:], True], 4]])
                yield pa.RecordBatch.from_pydict(dict(zip(("k1", "k2", "drop", "s", "e"), v.T.copy(), strict=True)))

        merged = met.mapInArrow(merge, "k1 long, k2 long, drop long, s long, e long")
        return merged.select("k1", "k2", F.struct(F.col("s").alias("start"), F.col("e").alias("end"), (F.col("drop") > 0).alias("drop")).alias("span"))

    roots = components(links)
    labelled = pieces_of.join(roots, pieces_of.uid == roots.node, "left").select(
        "doc_id", "k1", "k2", "start", "end", "uid", F.coalesce("root", "uid").alias("root")
    )
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "start", "k1", "k2")
    groups = labelled.groupBy("root").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1")
    doubled = labelled.join(groups, "root").withColumn("drop", ~rank.eqNullSafe(F.col("first")))
    marks = doubled.select("k1", "k2", F.struct("start", "end", "drop").alias("span"))
    counts = pieces_of.groupBy("k1", "k2").agg(F.countDistinct("start").alias("n_paragraphs"))
    per_doc = marks.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))
    per_doc = counts.join(per_doc, ["k1", "k2"], "left")
    if passage:
        per_doc = stored(per_doc, "marks")
        gone = F.transform(F.filter("spans", lambda x: x["drop"]), lambda x: x["start"])
        marked = per_doc.select("k1", "k2", "n_paragraphs", F.coalesce(gone, F.array().cast("array<bigint>")).alias("gone"))
        found = repeated(marked).groupBy("k1", "k2").agg(F.collect_set("span").alias("runs"))
        per_doc = per_doc.join(found, ["k1", "k2"], "left")
    else:
        per_doc = per_doc.withColumn("runs", F.expr("cast(null as array<struct<start: bigint, end: bigint, drop: boolean>>)"))
    full = packed.join(per_doc, ["k1", "k2"], "left").select("doc_id", "z", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), "spans", "runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {"n_linked": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "n_passages": [], "text": []}
            for z, spans, more in zip(*(batch.column(c).to_pylist() for c in (1, 3, 4)), strict=True):
                raw = unpack.decompress(z)
                spans = (spans or []) + (more or [])
                runs: list[list[int]] = []
                for x in sorted((x for x in spans if x["drop"]), key=lambda x: x["start"]):
                    if runs and x["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["end"])
                    else:
                        runs.append([x["start"], x["end"]])
                edges = [0, *[x for run in runs for x in run], len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                out["n_linked"].append(_touched(raw, spans) if more else len(spans))
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["n_passages"].append(_stretches(raw, spans, passage) if passage else None)
                out["text"].append(kept.decode("utf-8", "ignore") if with_text else None)
            got = {"doc_id": batch.column(0), "n_paragraphs": batch.column(2)} | out
            if not with_text:
                del got["text"]
            if not passage:
                del got["n_passages"]
            kinds = {"kept_sha256": pa.string(), "text": pa.string()}
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, kinds.get(c, pa.int64())) for c, v in got.items()], list(got)
            )

    schema = "doc_id long, n_paragraphs long, n_linked long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passages long" * bool(passage)
    return full.mapInArrow(remove, schema + ", text string" * with_text)
