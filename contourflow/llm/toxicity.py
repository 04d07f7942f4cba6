"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lean

#: Absolute discounts of a class's own continuation counts; the halves of the sample decide between them.
DISCOUNTS = (5.0, 2.0)
#: Word pairs, distinct within their texts, that a task holds before it sends them.
MOST_PAIRS = 1 << 21
#: Bits of a word pair: which of (ordinary, toxic) x (fold 0, fold 1) hold it.
ORDINARY, TOXIC = (1, 2), (4, 8)
_FOLDED = bytes(32 if i < 48 or 58 <= i < 65 or 91 <= i < 97 or 123 <= i < 128 else i for i in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text: maximal runs of bytes other than ASCII punctuation, space and controls."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def features(words: list[bytes], ratio: dict[bytes, float], unknown: float) -> tuple[float, float]:
    """Difference of the toxic and the ordinary log-likelihood a word, over all words and over the most telling one."""
    if not words:
        return 0.0, 0.0
    found = list(map(ratio.get, words, repeat(unknown)))
    return sum(found) / len(found), max(found)


def word_counts(pairs: DataFrame, samples: list[tuple[int, ...]]) -> DataFrame:
    """For each word of ``pairs(word, before, mask)`` and each sample of folds the numbers of different words before it.

    ``pairs`` has each distinct word pair once with the bits of what holds it. Sample i has the columns ``o<i>``
    (ordinary), ``t<i>`` (toxic) and ``n<i>`` (either class). Copies of a text add nothing to these counts.
    """
    columns = []
    for i, folds in enumerate(samples):
        o, t = (F.col("mask").bitwiseAND(F.lit(sum(of[f] for f in folds))) != 0 for of in (ORDINARY, TOXIC))
        columns += [F.count_if(o).alias(f"o{i}"), F.count_if(t).alias(f"t{i}"), F.count_if(o | t).alias(f"n{i}")]
    return pairs.groupBy("word").agg(*columns)


def word_ratios(counts: DataFrame, samples: int, discount: float = DISCOUNTS[0]) -> list[tuple[dict[bytes, float], float] | None]:
    """For each sample of :func:`word_counts` the log-likelihood ratios (toxic over ordinary) of words under
    Kneser-Ney models, and that of all other words.

    A word's count in a class is the number of different words before it. Each class discounts its counts by
    ``discount`` and falls back with the mass set free to the shared model: the counts over both classes. A word
    at or below the discount in both classes keeps nothing of its own, and the shared probability cancels out: its
    ratio is that of the two freed masses, whatever the word, and so is that of words never seen. Only the others are collected; each has over ``discount`` distinct pairs in the
    sample. None for a sample where a class has no words.
    """
    free = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(discount))).alias(f"free_{c}")
    sums = [x for i in range(samples) for c in "ot" for x in (F.sum(f"{c}{i}").alias(f"{c}{i}"), free(f"{c}{i}"))]
    s = counts.agg(*sums, *[F.sum(f"n{i}").alias(f"n{i}") for i in range(samples)]).first()
    usable = [i for i in range(samples) if s[f"o{i}"] and s[f"t{i}"]]

    def own(c: str, i: int) -> Column:
        left = F.lit(s[f"free_{c}{i}"]) * F.col(f"n{i}") / F.lit(float(s[f"n{i}"]))
        return (F.greatest(F.col(f"{c}{i}") - discount, F.lit(0.0)) + left) / F.lit(float(s[f"{c}{i}"]))

    out: list[tuple[dict[bytes, float], float] | None] = [None] * samples
    for i in usable:
        told = counts.where(F.greatest(f"o{i}", f"t{i}") > discount)
        table = told.select("word", F.log(own("t", i) / own("o", i)).cast("float").alias("ratio")).toArrow()
        unknown = float(np.log(s[f"free_t{i}"] / s[f"t{i}"]) - np.log(s[f"free_o{i}"] / s[f"o{i}"]))
        out[i] = dict(zip(table["word"].to_pylist(), table["ratio"].to_pylist(), strict=True)), unknown
    return out


def mean_model(a: tuple[dict[bytes, float], float], b: tuple[dict[bytes, float], float]) -> tuple[dict[bytes, float], float]:
    """The means of two models' log-likelihood ratios."""
    (one, u), (two, v) = a, b
    return {w: (one.get(w, u) + two.get(w, v)) / 2 for w in one.keys() | two.keys()}, (u + v) / 2


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50, times: np.ndarray | None = None) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton steps; row i counts ``times[i]`` times."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    times = np.ones(len(x)) if times is None else times
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (times * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (times * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _pairs(picked: DataFrame) -> DataFrame:
    """``word, before, mask`` for each distinct pair of neighbouring words in ``picked(toxic, fold, text)``.

    The word before is told by 60 bits of its hash. Pairs are shuffled as lists, one for each word and sixteenth of
    the hashes, which takes the bytes of a hash for a pair and still deals the pairs of a frequent word over many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = {b"": 0}, [], 0
        for batch in batches:
            cls, fold = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for c, f, text in zip(cls, fold, batch.column(2), strict=True):
                words = tokens(text.as_py())
                for w in words:
                    numbers.setdefault(w, len(numbers))
                at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                held.append(((ORDINARY, TOXIC)[c][f], np.unique(at << 32 | np.r_[0, at][:-1])))
                size += len(held[-1][1])
                if size > MOST_PAIRS:
                    yield from _packed(held, list(numbers))
                    numbers, held, size = {b"": 0}, [], 0
        yield from _packed(held, list(numbers))

    found = picked.mapInArrow(lean(run), "word binary, part int, pairs array<bigint>").repartition("word", "part")
    pair = found.select("word", "part", F.explode("pairs").alias("pair"))
    low = F.lit(15).cast("long")
    pair = pair.select("word", "part", F.col("pair").bitwiseAND(F.lit(-16).cast("long")).alias("before"), F.col("pair").bitwiseAND(low).cast("int").alias("mask"))
    return pair.groupBy("word", "part", "before").agg(F.bit_or("mask").alias("mask")).drop("part")


def _packed(held: list[tuple[int, np.ndarray]], words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """``word, part, pairs`` of the pairs ``held`` for each bit; a pair is the hash of the word before over its bits."""
    if not sum(len(k) for _, k in held):
        return
    key = np.concatenate([k for _, k in held])
    bits = np.repeat(np.array([bit for bit, _ in held], np.uint64), [len(k) for _, k in held])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    mask, key = np.bitwise_or.reduceat(bits[order], first), key[first]
    digest = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    word, pair = key >> 32, digest[key & 2**32 - 1] & ~np.uint64(15) | mask
    order = np.lexsort((pair, word))
    word, pair = word[order], pair[order]
    part = pair >> np.uint64(60)
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (part[1:] != part[:-1])])
    ends = np.r_[first[1:], len(pair)]
    for i in range(0, len(first), 1 << 15):
        here = slice(i, i + (1 << 15))
        a, b = first[here][0], ends[here][-1]
        lists = pa.ListArray.from_arrays(np.r_[first[here] - a, b - a].astype(np.int32), pa.array(pair[a:b].view(np.int64)))
        named = pa.array([words[w] for w in word[first[here]].tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([named, pa.array(part[first[here]].astype(np.int32)), lists], ["word", "part", "pairs"])


def log_loss(weights: np.ndarray, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> float:
    """Negative log-likelihood of the labels under a logistic's weights; row i counts ``times[i]`` times."""
    z = weights[0] + x @ weights[1:]
    return float((times * np.logaddexp(0.0, np.where(y == 1, -z, z))).sum())


def _examined(picked: DataFrame, pairs: list[list[tuple[dict[bytes, float], float]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels of ``picked(toxic, fold, text)`` and, for each pair of models, the features by the model of the row's fold."""
    sent = picked.sparkSession.sparkContext.broadcast(pairs)
    names = [f"{c}{i}" for i in range(len(pairs)) for c in ("mean", "top")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, found = batch.column(1).to_pylist(), map(tokens, batch.column(2).to_pylist())
            x = [[v for pair in sent.value for v in features(words, *pair[f])] for f, words in zip(fold, found, strict=True)]
            columns = np.array(x).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["y", *names])

    got = picked.mapInArrow(lean(run), "y int" + "".join(f", {n} double" for n in names)).orderBy("y", *names).toArrow()
    sent.destroy()
    return got["y"].to_numpy(), [np.column_stack([got[f"{c}{i}"].to_numpy() for c in ("mean", "top")]) for i in range(len(pairs))]


def with_toxicity(docs: DataFrame, labels: DataFrame, docs_per_class: int | None = None) -> DataFrame:
    """The rows of ``docs`` with a column ``score`` (one of that name is replaced).

    Learns ``labels.toxic`` (0 or 1) from all rows whose CRC-32 of the id's text is not divisible by five (given
    ``docs_per_class``, from that many of each class by lowest hash of the id). The ids with their labels and the
    words with enough neighbours are broadcast, and two pairs of features a labelled row reach the driver. :func:`word_ratios` makes the two class models. Every whole text
    is then scored in one pass without a shuffle: the toxic and the ordinary model's log-likelihoods are
    compared per word, over the whole text and over its most telling word (one insult in a long text hardly
    moves the former), and a logistic function maps both to (0, 1). Of ``DISCOUNTS`` that is taken whose logistic
    explains the sample's labels best: a small sample has too few neighbours of a word for a large one. It is fitted on halves of the sample, each
    scored by the other half's model, and texts are scored by the mean of both halves' ratios: a model of the whole
    sample knows more rare words, so that its ratios would not be those that were fitted. A
    sampled row counts in it as many times as its class has labels per
    sampled row, so 0.5 means the same whatever part of each class is sampled.

    Empty, blank and null texts have neutral features and get the logistic's value for them. Texts are scored
    whole, however long. Rows that repeat are scored alike; in training they add no word pairs. Null ids are
    scored and not held out; null labels are dropped and repeated ones merged (any toxic label counts). If a
    class is missing, nothing can be learned and every score is 0.0. An empty table gives no rows. Extra
    columns are kept, whatever their names.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known
    if docs_per_class is not None:
        chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_per_class) for c in (0, 1)]
        sample = chosen[0].union(chosen[1])
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = texts.join(F.broadcast(checkpoint(sample)), "doc_id").select("toxic", "fold", "text")
    counts = checkpoint(word_counts(_pairs(picked), [(0, 1), (1,), (0,)]))
    tried = [word_ratios(counts, 3, discount) for discount in DISCOUNTS]
    model, weights = None, np.zeros(3)
    if tried[0][0] is not None:
        # a half without one of the classes has no model; the other half's examples then go by the whole one
        pairs = [[half or whole for half in halves] for whole, *halves in tried]
        y, x = _examined(picked, pairs)
        times = np.ones(len(y))
        if docs_per_class is not None:
            labelled = dict(map(tuple, known.groupBy("toxic").count().collect()))
            times = np.array([max(labelled.get(c, 0) / docs_per_class, 1.0) for c in (0, 1)])[y]
        fits = [logistic(f, y.astype(np.float64), times=times) for f in x]
        best = min(range(len(fits)), key=lambda i: log_loss(fits[i], x[i], y, times))
        model, weights = mean_model(*pairs[best]), fits[best]
    del tried
    sent = spark.sparkContext.broadcast(model)
    docs = docs.drop("score")
    place = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is None:
                s = np.zeros(batch.num_rows)
            else:
                x = np.array([features(tokens(t), *sent.value) for t in batch.column(place).to_pylist()]).reshape(-1, 2)
                s = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, "score"])

    schema = "".join(f"`{c}` {t}, " for c, t in docs.dtypes)
    return docs.mapInArrow(lean(score), schema + "score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; see :func:`with_toxicity`.

    ``held_out`` says that the id's remainder kept its label from training; ``predicted`` is 1 from 0.5 on.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    return with_toxicity(docs.select(doc_id, "text"), labels, **settings).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
