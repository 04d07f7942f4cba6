"""Byte-level BPE: ranked merges folded over distinct words by higher-order functions."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Words of more bytes are merged by a heap on the executor; the fold's work grows with the square of the length.
LONGEST_FOLD = 48
#: Text that a worker turns into one row of words.
BATCH_CHARS = 1 << 18
#: Distinct words after which a worker forgets what it has seen; bounds its memory.
MOST_WORDS = 400_000
#: Bits of an id.
ID_BITS = 17
NONE = 1 << ID_BITS
#: Bits of a byte's place in a word that is folded.
BYTE_BITS = 6


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every joinable pair of ids, as rows laid over each other in one array.

    Of ids a and b the entry at ``offset[a] + b`` is ``a << ID_BITS | rank`` if they join, else another
    pair's or -1. Longer rows are laid first, each at the first place where none of its entries is taken; of rows
    of one length each is laid after the one before it. Plans hold the arrays as text and every task holds them as
    objects, so they must be short: three entries for a pair of the 50k vocabulary.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
    size = max(ranks.values()) + 1
    offset, entries = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    length = at = 0
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        b, r = np.array(rows[a], np.int64).T
        if len(b) != length:
            length, at = len(b), 0
        span = 256
        while True:
            if len(entries) < at + span + size:
                entries = np.append(entries, np.full(len(entries) + span, -1, np.int64))
            places = np.arange(at, at + span)
            for x in b:
                places = places[entries[places + x] < 0]
                if not len(places):
                    break
            else:
                break
            at, span = at + span, min(4 * span, 1 << 15)
        offset[a] = at = places[0]
        entries[at + b] = a << ID_BITS | r
    return offset, entries[: offset.max() + size].copy()


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The arrays of :func:`pair_ranks` as a literal, without negative entries."""
    offset, entries = pair_ranks(ranks)
    entries[entries < 0] = NONE << ID_BITS  # no id's
    text = json.dumps({"o": offset.tolist(), "e": entries.tolist()}, separators=(",", ":"))
    return F.from_json(F.lit(text), "struct<o: array<bigint>, e: array<bigint>>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    # unlike the only item of a transformed array, what a fold ends with is neither copied nor asked for its type
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def encode_word(word: Column, offsets: Column, entries: Column) -> Column:
    """The ids of one word, given as the ids of its bytes: ranked merges folded over the array.

    The fold's state has a long for each piece: the rank of the piece joined with the next, above the piece's first
    byte, above its id. So the least long is the leftmost pair of lowest rank. Before them stands a greater long with
    a bit for each byte that begins a piece; those up to a piece count its place, so that no search is needed
    (``array_position`` leaves its loop by an exception). Each step joins the least pair and looks up the two ranks
    that change.
    """
    low_bits = F.lit(NONE - 1).cast("long")
    none = F.lit(NONE).cast("long")
    unranked = F.lit(NONE << BYTE_BITS + ID_BITS)

    def rank(a: Column, b: Column) -> Column:
        # differs from a in its low bits only if it is an entry of a, and is NONE or more otherwise
        return entries[offsets[a] + b].bitwiseXOR(F.shiftleft(a, ID_BITS))

    def pack(r: Column, rest: Column) -> Column:
        return F.shiftleft(r, BYTE_BITS + ID_BITS).bitwiseOR(rest)

    def byte(piece: Column) -> Column:
        return F.shiftright(piece, ID_BITS).bitwiseAND(F.lit((1 << BYTE_BITS) - 1)).cast("int")

    def bit(of: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), of)

    def start(x: Column, i: Column) -> Column:
        after, rest = F.get(word, i + 1), F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(x)
        return F.when(after.isNull(), pack(none, rest)).otherwise(pack(rank(x, after), rest))

    def merge(state: Column, least: Column) -> Column:
        begins = F.get(state, F.lit(0))

        def join(i: Column) -> Column:
            low, after, before = F.shiftright(least, BYTE_BITS + ID_BITS), F.get(state, i + 2), F.get(state, i - 1)
            joined = F.when(after.isNull(), none).otherwise(rank(low, after.bitwiseAND(low_bits)))
            new = pack(joined, least.bitwiseAND(F.lit((1 << BYTE_BITS) - 1 << ID_BITS)).bitwiseOR(low))
            left = begins.bitwiseXOR(bit(byte(F.get(state, i + 1))))
            rest = before.bitwiseAND(F.lit((1 << BYTE_BITS + ID_BITS) - 1))
            changed = pack(rank(before.bitwiseAND(low_bits), low), rest)

            def put(x: Column, k: Column) -> Column:
                before_them = F.when(k == 0, left).when(k == i - 1, changed).otherwise(x)
                return F.when(k > i, x).when(k == i, new).otherwise(before_them)

            # slice and concat build lists on their way, which takes longer
            return F.transform(F.array_remove(state, F.get(state, i + 1)), put)

        return _let(F.bit_count(begins.bitwiseAND(bit(byte(least) + 1) - 1)), join)

    def step(state: Column, _: Column) -> Column:
        least = F.array_min(state)
        return _let(least, lambda least: F.when(least >= unranked, state).otherwise(merge(state, least)))

    rounds = F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1)))
    begins = (bit(F.size(word)) - 1).bitwiseOR(F.lit(1 << 62))
    done = F.aggregate(rounds, F.flatten(F.array(F.array(begins), F.transform(word, start))), step)
    return F.transform(F.slice(done, F.lit(2), F.size(word)), lambda x: x.bitwiseAND(low_bits).cast("int"))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a word of any length, with a heap over a linked list of pieces."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], alive[j], nxt[i] = stop, False, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            joined = word[i : end[nxt[i]]]
            if joined in ranks:
                heapq.heappush(heap, (ranks[joined], i, end[nxt[i]]))
        if prev[i] >= 0:
            joined = word[prev[i] : end[i]]
            if joined in ranks:
                heapq.heappush(heap, (ranks[joined], prev[i], end[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


class Numbers(dict):
    """Numbers new keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Known:
    """The ids of all words of an epoch, end to end."""

    def __init__(self):
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, folded: pa.ListArray, late: pa.BinaryArray) -> None:
        """Appends words: ids by the fold, or where ``late`` has them, from there."""
        size = np.diff(folded.offsets.to_numpy()) if len(folded) else np.empty(0, np.int64)
        values = folded.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
        other = np.flatnonzero(late.is_valid().to_numpy(zero_copy_only=False))
        found = late.drop_null().to_pylist()
        start = np.cumsum(size) - size + len(self.flat)
        start[other] = len(self.flat) + len(values) + np.cumsum([0, *(len(x) // 4 for x in found)])[:-1]
        size = size.astype(np.int64)
        size[other] = [len(x) // 4 for x in found]
        self.flat = np.concatenate([self.flat, values, np.frombuffer(b"".join(found), np.uint32)])
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])

    def ids(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of words, and where in them the documents that end at ``ends`` begin and end."""
        size = self.size[words]
        stop = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[words] - stop[:-1], size) + np.arange(stop[-1])
        return self.flat[at], stop[np.concatenate([[0], ends])]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, batch_bytes: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and on demand ``ids``, as
    little-endian unsigned 32-bit integers) for every row of ``docs``.

    Each match of ``pattern`` in a whole text (null: empty) is a word of its own; no special tokens. A
    worker splits texts and hands on the words that are new to it; JVM higher-order functions fold the
    ranked merges over these words with the ranks as a literal; a second worker, fed by the first in the
    same task, puts the ids of each text together, decodes them by concatenating the pieces and digests
    both. Nothing is shuffled. Words that are a token keep its id, as the library does; words of over
    ``LONGEST_FOLD`` bytes are merged by a heap instead.
    Every row gives a row, repeated ids too; other columns are ignored; an empty table gives no rows.
    With ``batch_bytes`` (such as ``"8m"``) the session's Arrow batches are set to that, which bounds what
    passes between the workers where memory is scarce.
    """
    if batch_bytes:
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes)
    ranks = load_ranks(ranks_path)
    if max(ranks.values(), default=0) >= NONE or any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("the vocabulary must have every byte and ids below 2**17")

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words_of = regex.compile(pattern).findall
        whole = {token: packed([rank]) for token, rank in ranks.items()}
        byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        numbers = Numbers()
        epoch = 0
        step = 256 if batch_bytes else 1 << 30
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                if len(numbers) > MOST_WORDS:
                    numbers, epoch = Numbers(), epoch + 1
                known, size, keys, ends, rows = len(numbers), 0, [], [], array("I")
                number = numbers.__getitem__
                while at < len(ids) and size < BATCH_CHARS:
                    text = texts[at] or ""
                    rows.extend(map(number, words_of(text)))
                    size += len(text)
                    keys.append(ids[at])
                    ends.append(len(rows))
                    at += 1
                new = [w.encode("utf-8") for w in islice(numbers, known, None)]
                late = [whole.get(w) or (None if len(w) <= LONGEST_FOLD else packed(merge_long(w, ranks))) for w in new]
                short = [w if x is None else b"" for w, x in zip(new, late, strict=True)]
                stops = np.cumsum([0, *map(len, short)], dtype=np.int32)
                pieces = pa.ListArray.from_arrays(stops, byte_ids[np.frombuffer(b"".join(short), np.uint8)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "epoch": pa.array([epoch], pa.int32()),
                        "words": pa.ListArray.from_arrays(np.array([0, len(short)], np.int32), pieces),
                        "long_ids": pa.array([late], pa.list_(pa.binary())),
                        "docs": pa.array([rows.tobytes()], pa.binary()),
                        "doc_id": pa.array([keys], pa.list_(pa.int64())),
                        "ends": pa.array([ends], pa.list_(pa.int64())),
                    }
                )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        piece = pieces.__getitem__
        epoch = -1
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column(0)[row].as_py() != epoch:
                    epoch, known = batch.column(0)[row].as_py(), Known()
                known.add(batch.column(1)[row].values, batch.column(2)[row].values)
                flat, cuts = known.ids(np.frombuffer(batch.column(3)[row].as_py(), np.uint32), batch.column(5)[row].values.to_numpy())
                keys = batch.column(4)[row].as_py()
                out: dict[str, list] = {"doc_id": keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
                for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    ids = flat[start:end]
                    out["n_tokens"].append(end - start)
                    out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(b"".join(map(piece, ids.tolist()))).hexdigest())
                    out["ids"].append(ids.tobytes() if with_ids else None)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = list(out) if with_ids else list(out)[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(names, kinds, strict=False)], names)

    def encode(offsets: Column, entries: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.transform("words", lambda w: F.when(F.size(w) == 0, none).otherwise(encode_word(w, offsets, entries)))

    split_schema = "epoch int, words array<array<bigint>>, long_ids array<binary>, docs binary, doc_id array<bigint>, ends array<bigint>"
    out_schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    encoded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(split), split_schema).select(
        "epoch",
        _let(rank_map(ranks), lambda table: _let(table["o"], lambda o: _let(table["e"], lambda e: encode(o, e)))).alias("ids"),
        "long_ids",
        "docs",
        "doc_id",
        "ends",
    )
    return encoded.mapInArrow(lean(join), out_schema)


def decode_ids(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the pieces of ``ids_col`` concatenated (null ids: null)."""
    pieces = {rank: token for token, rank in load_ranks(ranks_path).items()}

    @F.pandas_udf("binary")
    def decode(ids):
        return ids.map(lambda x: None if x is None else b"".join([pieces[i] for i in np.frombuffer(x, "<u4").tolist()]))

    return encoded.withColumn("decoded", decode(F.col(ids_col)))
