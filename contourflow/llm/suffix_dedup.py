"""Substring deduplication over a sparse suffix array."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, compressed, keyed_documents, lean

#: Bytes that are hashed to choose suffixes; every window of the wanted length holds a chosen one of its own.
LEAD = 80
#: Bytes of short texts that are hashed together.
BATCH_BYTES = 1 << 16
#: Bytes of text for each bucket of suffixes, at most about; neighbouring windows of a suffix that go to one bin.
BUCKET_BYTES = 64 << 20
TOGETHER = 16
#: Windows whose digests are held as objects of their own.
DIGESTS = 1 << 14
_TOP = np.uint64(2**64 - 1)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every ``w`` neighbours, by doubling."""
    have = 1
    while have * 2 <= w:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


class Sampler:
    """Chooses suffixes: in every window of ``length`` bytes within a text, a position of least leading hash.

    Equal windows choose equal positions, so two equal windows meet at suffixes with equal leading bytes.
    """

    def __init__(self, length: int):
        self.length, self.width = length, length - LEAD + 1
        self.up, self.down = _powers(_BASE, BATCH_BYTES * 2), _powers(pow(_BASE, -1, 1 << 64), BATCH_BYTES * 2)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the text, position, hash of the leading bytes and of the whole context of each suffix."""
        size = np.array([len(t) for t in texts], np.int64)
        b = np.frombuffer(b"".join(texts), np.uint8)
        n = len(b)
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[b] * self.up[:n], out=sums[1:])
        ends = np.cumsum(size)
        h = _mix((sums[LEAD:] - sums[:-LEAD]) * self.down[: n - LEAD + 1])
        for end in ends[:-1].tolist():
            h[max(0, end - LEAD + 1) : end] = _TOP
        low = _slide(h, self.width, np.minimum)
        edge = np.zeros(self.width - 1, np.uint64)
        at = np.flatnonzero((_slide(np.concatenate([edge, low, edge]), self.width, np.maximum) == h) & (h != _TOP))
        text = np.searchsorted(ends, at, side="right")
        begin = ends[text] - size[text]
        left, right = np.minimum(self.length - LEAD, at - begin), np.minimum(self.length, ends[text] - at)
        # another hash than that of the leading bytes, so that the two do not fail together
        digest = xxhash.xxh3_64_intdigest
        whole = b.tobytes()
        spans = zip((at - left).tolist(), (at + right).tolist(), strict=True)
        context = np.fromiter((digest(whole[i:j]) for i, j in spans), np.uint64, len(at))
        context = _mix(context ^ (left * 1021 + right).astype(np.uint64) * np.uint64(_BASE))
        return text, at - begin, h[at], context


def lcp(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each of the sorted, zero-padded ``rows`` with the one before (first: 0)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        for s in range(1, len(rows), 8192):
            same = rows[s : s + 8192] == rows[s - 1 : s - 1 + len(rows[s : s + 8192])]
            out[s : s + 8192] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
        out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of equally long byte rows: multikey quicksort over eight-byte symbols.

    Rows are split by their first symbol; only those that tie go on to the next.
    """
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    group = np.cumsum(np.diff(words[order, 0], prepend=words[order[:1], 0]) != 0)
    for k in range(1, words.shape[1]):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        part = order[tied]
        again = np.lexsort((words[part, k], group[tied]))
        order[tied] = part[again]
        value = words[order, k]
        new = np.zeros(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        inner = np.zeros(len(order), bool)
        inner[tied] = True
        new[1:] |= inner[1:] & inner[:-1] & (group[1:] == group[:-1]) & (value[1:] != value[:-1])
        group = np.cumsum(new)
    return order


def _padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, values), np.int64, len(values))
    flat = b"".join([v.ljust(width, b"\0") for v in values])
    return np.frombuffer(flat, np.uint8).reshape(len(values), width), size


def bucket_repeats(right: list[bytes], left: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows in one bucket of suffixes, and those that may go on in another bucket.

    ``right`` has up to ``length`` bytes from each suffix on, ``left`` what precedes it, backwards. Window d
    of a suffix starts d bytes before it. Returns a matrix (suffix, d) of windows that repeat in the
    bucket, one of windows to compare across boundaries (of equal ones the first), and the matrices' rows
    are in the order of the input. Equality is by bytes: suffixes are sorted, neighbours' common prefixes
    give the classes of every prefix length, and so do the left contexts for every d.
    """
    reach = length - LEAD
    r, rn = _padded(right, -(-length // 8) * 8)
    lft, ln = _padded(left, -(-reach // 8) * 8)
    n = len(r)
    by_right, by_left = multikey_order(r), multikey_order(lft)
    step_r, step_l = lcp(r[by_right], rn[by_right]), lcp(lft[by_left], ln[by_left])
    place_r, place_l = np.argsort(by_right), np.argsort(by_left)
    # how much of a suffix the bucket's first and last row share with it: all that other buckets can
    to_first = np.minimum.accumulate(np.r_[length, step_r[1:]]) if n else step_r
    to_last = np.minimum.accumulate(np.r_[length, step_r[:0:-1]])[::-1] if n else step_r
    shared = np.maximum(to_first, to_last)[place_r]
    repeat, cross = np.zeros((n, reach + 1), bool), np.zeros((n, reach + 1), bool)
    run = np.cumsum(step_r < LEAD)[place_r]
    edge = (run == run[by_right[0]]) | (run == run[by_right[-1]]) if n else np.zeros(0, bool)
    some = np.flatnonzero((np.bincount(run, minlength=1)[run] > 1) | edge)
    for d in range(reach + 1):
        rows = some[(ln[some] >= d) & (rn[some] >= length - d)]
        if not len(rows):
            continue
        key = np.cumsum(step_l < d)[place_l[rows]] * (n + 1) + np.cumsum(step_r < length - d)[place_r[rows]]
        _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        repeat[rows, d] = count[back] > 1
        lead = rows[first]
        cross[lead, d] = edge[lead] & (shared[lead] >= length - d)
    return repeat, cross, edge


def _intervals(repeat: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the bytes that each row's repeated windows cover, by runs of d."""
    wide = np.zeros((len(repeat), repeat.shape[1] + 2), np.int8)
    wide[:, 1:-1] = repeat
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    last = np.nonzero(step == -1)[1] - 1
    return row, at[row] - last, at[row] - first + length


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = list(batches)
    return pa.Table.from_batches(got).combine_chunks() if got else None


def find_repeats(keyed: DataFrame, length: int) -> DataFrame:
    """``(k1, k2, start, end)``: spans of the texts of ``keyed(k1, k2, text)`` covered by repeated windows."""
    reach = length - LEAD

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = Sampler(length)

        def flush(texts: list[bytes], keys: list[tuple[int, int]]) -> pa.RecordBatch:
            text, at, lead, context = choose(texts)
            k = np.array(keys, np.int64)[text]
            return pa.RecordBatch.from_pydict({"lead": lead.view(np.int64), "context": context.view(np.int64), "k1": k[:, 0], "at": k[:, 1] << 32 | at})

        texts, keys, size = [], [], 0
        for batch in batches:
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) >= length:
                    texts.append(raw)
                    keys.append((k1[i], k2[i]))
                    size += len(raw)
                    if size >= BATCH_BYTES:
                        yield flush(texts, keys)
                        texts, keys, size = [], [], 0
        if texts:
            yield flush(texts, keys)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None or not table.num_rows:
            return
        lead, context, k1, at = (table.column(c).to_numpy() for c in ("lead", "context", "k1", "at"))
        order = np.lexsort((context, lead))
        lead, context, k1, at = lead[order], context[order], k1[order], at[order]
        new_lead = np.r_[True, lead[1:] != lead[:-1]]
        new = new_lead | np.r_[True, context[1:] != context[:-1]]
        run, group = np.cumsum(new) - 1, np.cumsum(new_lead) - 1
        full = np.bincount(run)[run] > 1
        kinds = np.bincount(group[new])
        # what stands at an edge of the bucket may go on in the next one
        compare = new & ((kinds[group] > 1) | (group == 0) | (group == group[-1]))
        keep = full | compare
        yield pa.RecordBatch.from_pydict({"k1": k1[keep], "at": at[keep], "full": full[keep], "compare": compare[keep]})

    suffixes = keyed.mapInArrow(lean(sample), "lead long, context long, k1 long, at long")
    # as many buckets as the bytes need, so that a task's share does not grow with the corpus
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    bins = 16 * parts
    marked = suffixes.repartitionByRange(parts, "lead", "context", "k1", "at").mapInArrow(
        lean(classify), "k1 long, at long, full boolean, compare boolean"
    )
    marked = checkpoint(marked)
    pos, k2 = F.col("at").bitwiseAND(F.lit(2**32 - 1)), F.shiftright("at", 32)
    wanted = marked.where("compare").groupBy("k1", k2.alias("k2")).agg(F.collect_set(pos).alias("at"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {"right": [], "left": [], "k1": [], "at": []}
            for k1, k2, z, where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unpack.decompress(z)
                for p in set(where):
                    out["right"].append(raw[p : p + length])
                    out["left"].append(raw[max(0, p - reach) : p][::-1])
                    out["k1"].append(k1)
                    out["at"].append(k2 << 32 | p)
            yield pa.RecordBatch.from_pydict(
                {c: pa.array(v, pa.binary() if c in ("right", "left") else pa.int64()) for c, v in out.items()}
            )

    packed = compressed(keyed)
    pieces = packed.join(wanted, ["k1", "k2"]).select("k1", "k2", "z", "at").mapInArrow(
        lean(contexts), "right binary, left binary, k1 long, at long"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None or not table.num_rows:
            return
        right, left = table.column("right").to_pylist(), table.column("left").to_pylist()
        k1, at = table.column("k1").to_numpy(), table.column("at").to_numpy()
        pos, k2 = at & 2**32 - 1, at >> 32
        repeat, cross, _ = bucket_repeats(right, left, length)
        row, start, end = _intervals(repeat, pos, length)
        none = pa.nulls(len(row), pa.binary())
        names = ["k1", "k2", "start", "end", "bin", "blob"]
        yield pa.RecordBatch.from_arrays([k1[row], k2[row], start, end, pa.nulls(len(row), pa.int32()), none], names)
        row, d = np.nonzero(cross)
        if len(row):
            # with d, so that one window is not met again from another suffix inside it
            # one at a time: all windows of a bucket at once are a hundred times its bytes
            digest = np.empty((len(row), 2), "<i8")
            for a in range(0, len(row), DIGESTS):
                window = (j.to_bytes(4, "little") + left[i][:j][::-1] + right[i][: length - j] for i, j in zip(row[a : a + DIGESTS].tolist(), d[a : a + DIGESTS].tolist(), strict=True))
                some = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in window]), "<i8")
                digest[a : a + DIGESTS] = some.reshape(-1, 2)
            known = repeat[row, d].astype(np.int64)
            both = np.column_stack([digest, k1[row], k2[row], pos[row] - d, known])
            # neighbouring windows share a core, which deals them out by content
            block = d // TOGETHER * TOGETHER
            _, first, back = np.unique(row * (reach + 1) + block, return_index=True, return_inverse=True)
            cores = (left[row[i]][: block[i]][::-1] + right[row[i]][: length - block[i] - TOGETHER + 1] for i in first)
            where = np.array([int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little") % bins for c in cores])[back]
            for b in np.unique(where).tolist():
                zero = pa.array([0], pa.int64())
                blob = pa.array([both[where == b].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([zero, zero, zero, zero, pa.array([b], pa.int32()), blob], names)

    found = pieces.repartitionByRange(parts, "right", "left", "k1", "at").mapInArrow(
        lean(compare), "k1 long, k2 long, start long, end long, bin int, blob binary"
    )
    found = checkpoint(found)

    def across(table: pa.Table) -> pa.Table:
        both = np.frombuffer(b"".join(table.column("blob").to_pylist()), np.int64).reshape(-1, 6)
        _, back, count = np.unique(both[:, :2], axis=0, return_inverse=True, return_counts=True)
        both = both[(count[back.ravel()] > 1) & (both[:, 5] == 0)]
        both = both[np.lexsort((both[:, 4], both[:, 3], both[:, 2]))]
        k, start = both[:, 2:4], both[:, 4]
        new = np.r_[True, (k[1:] != k[:-1]).any(axis=1) | (start[1:] > start[:-1] + length)][: len(both)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, len(both) - 1][: len(first)]
        return pa.table({"k1": k[first, 0], "k2": k[first, 1], "start": start[first], "end": start[last] + length})

    spans = "k1 long, k2 long, start long, end long"
    whole = marked.where("full").select(
        "k1", k2.alias("k2"), F.greatest(pos - reach, F.lit(0)).alias("start"), (pos + length).alias("end")
    )
    return (
        whole.union(found.where("bin is null").select("k1", "k2", "start", "end"))
        .union(found.where("bin is not null").groupBy("bin").applyInArrow(across, spans))
    )


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_bytes, n_removed, n_spans, kept_sha256`` for every row (and ``text``, the bytes kept, on demand), after
    the columns ``carry`` of ``docs``, which must not be named like these.

    Texts are UTF-8 bytes (null: empty). Each byte covered by a ``length``-byte string that also starts
    anywhere else, in the same text or another, is removed; strings are judged on the input and matches do
    not cross texts. ``n_spans`` counts maximal removed runs. Rows repeated as a whole are occurrences of
    each other. Texts shorter than ``length`` stay whole; an empty table gives no rows; other columns are
    ignored. With text, bytes of a character cut by a span's edge are dropped from the text that is kept.

    Suffixes are sampled so that every window holds one that depends on the window alone; those whose
    leading bytes or whole context are unique are set aside after a hash comparison. The others are
    range-partitioned by their bytes with sampled splitters, sorted in their bucket by multikey quicksort,
    compared to their neighbours on both sides, and at the buckets' boundaries by digests of whole windows.
    Range partitioning splits leading bytes that very many suffixes share.
    """
    keyed = keyed_documents(docs.select(*dict.fromkeys([*carry, "doc_id", "text"])))
    spans = find_repeats(keyed.select("k1", "k2", "text"), length)
    # rows repeated as a whole share their keys and bring the same spans again
    by_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    packed = compressed(keyed.select(*carry, "k1", "k2", "text"))
    joined = packed.join(by_text, ["k1", "k2"], "left").select(*carry, "z", "spans.start", "spans.end")
    n = len(carry)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "text": []}
            for z, start, end in zip(batch.column(n).to_pylist(), batch.column(n + 1), batch.column(n + 2), strict=True):
                raw = unpack.decompress(z)
                runs = _runs(start, end, len(raw), length)
                edges = [0, *[x for run in runs for x in run], len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["text"].append(kept.decode("utf-8", "ignore") if with_text else None)
            if not with_text:
                del out["text"]
            kinds = {"kept_sha256": pa.string(), "text": pa.string()}
            made = [pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [*carry, *out])

    before = "".join(f"`{c}` {t}, " for c, t in docs.select(*carry).dtypes)
    return joined.mapInArrow(lean(cut), before + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text)


def _runs(start: pa.Scalar, end: pa.Scalar, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of spans, each cut to the text; what is then shorter than ``length`` is none."""
    if not start.is_valid:
        return []
    s, e = start.values.to_numpy(), np.minimum(end.values.to_numpy(), size)
    s, e = s[e - s >= length], e[e - s >= length]
    if not len(s):
        return []
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    first = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return list(zip(s[first].tolist(), e[np.r_[first[1:] - 1, len(e) - 1]].tolist(), strict=True))
