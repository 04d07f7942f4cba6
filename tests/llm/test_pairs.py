"""Embedding, top-k, SimHash, suffix and paragraph operators against brute force, with awkward rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourflow.llm import common, embedding_dedup, paragraph_dedup, simhash, suffix_dedup, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECS = "vec_id long, embedding array<float>, label int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def roots(n, pairs):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def awkward(rng, n):
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    out = []
    for i in range(n):
        if i % 3 == 1 and out:
            text = out[rng.integers(len(out))][1] or ""
            parts = text.split(" ")
            parts[rng.integers(len(parts))] = "edited"
            out.append((i, " ".join(parts)))
        else:
            out.append((i, " ".join(rng.choice(words, rng.integers(1, 160)))))
    passage = " ".join(rng.choice(words, 60))
    out += [(n + k, " ".join(rng.choice(words, 20)) + " " + passage + "\n" + " ".join(rng.choice(words, 20))) for k in range(4)]
    out += [(n + 4, None), (n + 5, ""), (n + 6, "  \n "), (n + 7, "é" * 450), (n + 8, "ab" * 400), out[0], out[0]]
    return out


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)], "a long, b long")
    got = dict(map(tuple, common.components(e).collect()))
    assert got == {i: 0 for i in range(21)} | {30: 30, 31: 30}
    assert common.components(e.limit(0)).count() == 0


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + 0.15 * rng.normal(size=(20, 16)), base[:5], 3 * base[5:8]]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [1.0] * 3]
    rows += [(100 + i, v, 1) for i, v in enumerate(bad)] + [(0, rows[0][1], 0), (None, rows[1][1], 0)]
    got = embedding_dedup.embedding_components(spark.createDataFrame(rows, VECS)).toPandas()
    assert len(got) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    u = np.concatenate([u, u[:2]])
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    links = near.sum(axis=1)
    by = got.groupby("vec_id")["n_links"].apply(sorted)
    assert by[0] == [links[0], links[len(x)]] and all(by[i] == [links[i]] for i in range(1, len(x)))
    root = roots(len(u), zip(*np.nonzero(near), strict=True))
    comp = got.drop_duplicates("vec_id").set_index("vec_id")["component_id"]
    assert all(comp[i] == root[i] for i in range(len(x)))
    alone = got[got.vec_id >= 100]
    assert (alone.n_links == 0).all() and (alone.component_id == alone.vec_id).all() and alone.kept.all()
    assert embedding_dedup.embedding_components(spark.createDataFrame([], VECS)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(3)
    u = embedding_dedup.unit(rng.normal(size=(50, 24)))
    q, s, e = embedding_dedup.quantise(u)
    err = np.abs(u @ u.T - (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None])
    assert (err <= (1 + e[:, None]) * e[None] + e[:, None] + 1e-12).all()


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(150, 8)) * np.exp(rng.normal(size=(150, 1))), 1).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(200, None, 0), (300, [None] * 8, 0), (400, [float("inf")] * 8, 0), (500, [1.0, 2.0], 0), (None, [9.0] * 8, 0)]
    got = topk.top_inner_products(spark.createDataFrame(rows, VECS), F.col("id") % 10 == 0, k=5).toPandas()
    q = np.floor(1024 * np.concatenate([x, [[9.0] * 8]]).astype(float)).astype(np.int64)
    order = np.r_[np.arange(150), 10**6]
    for i in range(0, 150, 10):
        score = q @ q[i]
        best = [j for j in np.lexsort((order, -score)) if j != i][:5]
        part = got[got.query_id == i].sort_values("rank")
        assert part.score.tolist() == score[best].tolist()
        assert [None if v != v else int(v) for v in part.vec_id] == [None if j == 150 else j for j in best]
    assert set(got.query_id) == set(range(0, 150, 10))
    assert topk.top_inner_products(spark.createDataFrame([], VECS), F.col("id") % 10 == 0).count() == 0


def test_huge_scores_stop_at_the_ends():
    q = np.array([[2.0**40, 2.0**40]])
    assert topk._exact(q, q)[0, 0] == 2**63 - 1


def test_simhash(spark, monkeypatch):
    rows = awkward(np.random.default_rng(2), 60)
    got = simhash.simhash_components(docs(spark, rows)).toPandas()
    fp = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    root = roots(len(rows), zip(*np.nonzero(near), strict=True))
    want = {i: rows[r][0] for (i, _), r in zip(rows, root, strict=True)}
    assert len(got) == len(rows) and all(want[r.doc_id] == r.component_id for r in got.itertuples())
    assert {r.doc_id: int(r.fingerprint, 16) for r in got.itertuples()} == {i: int(f) for (i, _), f in zip(rows, fp, strict=True)}
    kept = simhash.keep_representatives(docs(spark, rows)).toPandas()
    assert sorted(kept.doc_id) == sorted(set(want.values())) and list(kept.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_ball_hashing_finds_every_close_pair(monkeypatch):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, *[fps ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (1, 2, 3, 4, 5)]]))
    for most in (simhash.MOST_VARIANTS, 20_000):
        monkeypatch.setattr(simhash, "MOST_VARIANTS", most)
        a, b = simhash._balls(fps, 0, 0, 2)
        n = {int(f): i for i, f in enumerate(fps)}
        got = roots(len(fps), [(n[int(x)], n[int(y)]) for x, y in zip(a, b, strict=True)])
        near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
        assert got == roots(len(fps), zip(*np.nonzero(near), strict=True))


def test_suffix_removal(spark):
    rows = awkward(np.random.default_rng(4), 50)
    got = suffix_dedup.remove_repeats(docs(spark, rows)).toPandas()
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = Counter()
    for (doc, _), b in zip(rows, raw, strict=True):
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                mask[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        want[doc, len(b), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(got[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == want
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_multikey_order_sorts_bytes():
    rng = np.random.default_rng(6)
    rows = rng.integers(97, 99, (500, 24), dtype=np.uint8)
    order = suffix_dedup.multikey_order(rows)
    assert [bytes(r) for r in rows[order]] == sorted(bytes(r) for r in rows)


@pytest.mark.parametrize("tile", [2048, 3])
def test_paragraphs(spark, monkeypatch, tile):
    monkeypatch.setattr(paragraph_dedup, "TILE", tile)
    rows = awkward(np.random.default_rng(7), 60)[:-2]
    got = paragraph_dedup.paragraph_duplicates(docs(spark, rows), recall=0.999999).toPandas().set_index("doc_id")
    occ, sets = [], []
    for doc, text in rows:
        words, found = paragraph_dedup.pieces((text or "").encode())
        for a, b, start, end in found:
            occ.append((doc, start, end))
            sets.append(set(paragraph_dedup.shingles(words[a:b], 5).tolist()))
    pairs = [(i, j) for i in range(len(occ)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    root, first, gone = roots(len(occ), pairs), {}, Counter()
    for i, o in enumerate(occ):
        first[root[i]] = min(first.get(root[i], o), o)
    for i, o in enumerate(occ):
        if first[root[i]] != o:
            gone[o[0]] += o[2] - o[1]
    assert pairs and {d: n for d, n in got["n_removed"].items() if n} == dict(gone)
    assert paragraph_dedup.paragraph_duplicates(docs(spark, [])).count() == 0


def removed_by_brute_force(rows, threshold=0.8):
    """Bytes removed per document when all paragraphs between line feeds are compared whole."""
    occ, sets = [], []
    for doc, text in rows:
        offset = 0
        for line in (text or "").encode().split(b"\n"):
            words = line.lower().split()
            if words:
                occ.append((doc, offset, len(line)))
                sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))})
            offset += len(line) + 1
    pairs = [(i, j) for i in range(len(occ)) for j in range(i) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9]
    root, gone = roots(len(occ), pairs), Counter()
    first = {}
    for i, o in enumerate(occ):
        first[root[i]] = min(first.get(root[i], o), o)
    for i, o in enumerate(occ):
        if first[root[i]] != o:
            gone[o[0]] += o[2]
    return dict(gone)


def test_long_paragraphs_are_compared_whole(spark):
    rng = np.random.default_rng(11)
    fresh = iter(f"w{i}" for i in range(10**6))
    rows = []
    for n, edits in [(64, 0), (100, 2), (400, 8), (1500, 30), (65, 1)]:
        words = [next(fresh) for _ in range(n)]
        other = list(words)
        for at in rng.choice(np.arange(10, n - 10, 11), edits, replace=False):
            other[at] = next(fresh)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other + [next(fresh)] * (n == 64)))]
    got = paragraph_dedup.paragraph_duplicates(docs(spark, rows), recall=0.999999).toPandas()
    want = removed_by_brute_force(rows)
    assert set(want) == {1, 3, 5, 7, 9} and {d: n for d, n in zip(got.doc_id, got.n_removed, strict=True) if n} == want


@pytest.mark.parametrize("most", [200_000, 0])
def test_passages_inside_longer_paragraphs(spark, monkeypatch, most):
    monkeypatch.setattr(paragraph_dedup, "MOST_BROADCAST", most)
    rng = np.random.default_rng(12)
    fresh = iter(f"w{i}" for i in range(10**6))

    def some(n):
        return [next(fresh) for _ in range(n)]

    rows, want = [], {}
    for n in (50, 51, 55, 60, 70, 80):
        for around in (0, 5, 100):
            passage = some(n)
            first, second = some(around) + passage + some(101), some(around) + [w.upper() for w in passage] + some(107)
            rows += [(len(rows), " ".join(first)), (len(rows) + 1, f"ünd so {next(fresh)}\n" + "  ".join(second))]
            want[len(rows) - 1] = len("  ".join(passage))
    twice = some(52)
    rows.append((len(rows), " ".join(twice + some(60) + twice + some(60))))
    want[len(rows) - 1] = len(" ".join(twice))
    short = some(49)
    rows += [(len(rows) + k, " ".join(some(30) + short + some(30))) for k in range(2)]
    rows.append((len(rows), " ".join(["ha"] * 90)))
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    got = paragraph_dedup.paragraph_duplicates(docs(spark, rows + rows[:1]), passage=50, with_text=True).toPandas()
    assert len(got) == len(rows) + 1
    assert {d: n for d, n in zip(got.doc_id, got.n_removed, strict=True) if n} == want
    assert set(got[got.n_linked > 0].doc_id) >= set(range(37))
    left = Counter(w.lower() for t in got.drop_duplicates("doc_id").text for w in t.split())
    assert all(left[f"w{i}"] >= 1 for i in range(1000))


def test_short_paragraphs_are_compared(spark):
    words = [f"w{i}" for i in range(19)]
    near = [*words[:1], "other", *words[1:]]
    lines = ["Hello", "one two three four", "a a a a a", " ".join(words), "  ", "w0 w1 w2 w3 w4 w5 w6 w7"]
    rows = [(0, "\n".join(lines)), (1, "hello\n\nOne two  three four\nalone"), (2, "one two three\na a a a a a a\n" + " ".join(words)),
            (3, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (4, " ".join(near)), (5, None), (6, "alone\nalone")]
    got = paragraph_dedup.paragraph_duplicates(docs(spark, rows), recall=0.999999).toPandas().set_index("doc_id")
    want = removed_by_brute_force(rows)
    assert set(want) == {1, 2, 3, 4, 6} and {d: n for d, n in got["n_removed"].items() if n} == want
    assert got["n_paragraphs"].to_dict() == {0: 5, 1: 3, 2: 3, 3: 1, 4: 1, 5: 0, 6: 2}


@pytest.mark.parametrize("most", [0, 200_000])
def test_one_passage_in_all_documents(spark, monkeypatch, most):
    """Whichever way its runs meet their first places, only the first document keeps it."""
    monkeypatch.setattr(paragraph_dedup, "MOST_BROADCAST", most)
    rng = np.random.default_rng(12)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n))
    passage = some(70)
    rows = [(i, f"{some(30)} {passage} {some(30)}") for i in range(400, 0, -1)]
    got = paragraph_dedup.paragraph_duplicates(docs(spark, rows), passage=50).toPandas().set_index("doc_id")
    assert (got.n_linked == 1).all() and got.n_removed[1] == 0
    assert (got.n_removed.drop(1) == len(passage)).all() and (got.n_spans.drop(1) == 1).all()


def test_paragraph_recall_at_the_query_s_settings(spark):
    """Of 400 pairs just above the threshold nearly all are linked; pairs just below it never are."""
    rng = np.random.default_rng(21)
    some = lambda n: ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, wanted, unwanted = [], 0, 0
    for i in range(440):
        a = some(200)
        b = list(a)
        for k in rng.choice(np.arange(8, 192, 12), 4 if i < 400 else 6, replace=False):
            b[k] = some(1)[0]
        j = len(sets(a) & sets(b)) / len(sets(a) | sets(b))
        assert (0.8 <= j < 0.83) == (i < 400)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = paragraph_dedup.paragraph_duplicates(docs(spark, rows), threshold=0.8, shingle=5).toPandas().set_index("doc_id")
    linked = got.n_linked.sort_index().to_numpy()
    assert linked[:800].mean() >= 0.98 and (linked[800:] == 0).all()


def test_one_row_repeated_very_often(spark):
    """Ten thousand copies of one row bring their spans once; all of their text repeats."""
    text = " ".join(str(i * 7919 % 10007) for i in range(120))
    rows = [(1, text)] * 10_000 + [(2, text[100:400] + "!"), (3, None), (4, "")]
    got = suffix_dedup.remove_repeats(docs(spark, rows), length=200)
    n = len(text)
    assert got.where(f"doc_id = 1 and n_bytes = {n} and n_removed = {n} and n_spans = 1").count() == 10_000
    assert got.where("doc_id = 2").first()["n_removed"] == 300 and got.where("doc_id > 2 and n_removed = 0 and n_bytes = 0").count() == 2


@pytest.mark.parametrize("most", [0, 200_000])
def test_long_passages_are_told_from_short_lines(spark, monkeypatch, most):
    """Lines that repeat are linked, whatever their length; only stretches of 50 repeated words count as passages."""
    monkeypatch.setattr(paragraph_dedup, "MOST_BROADCAST", most)
    fresh = iter(f"w{i}" for i in range(10**6))
    some = lambda n: " ".join(next(fresh) for _ in range(n))
    inside, whole, lines = some(55), some(60), "\n \n".join(some(20) for _ in range(3))
    rows = [(0, f"{some(30)}\nall rights reserved\n{some(70)}"), (1, f"all rights reserved\n{some(49)}"), (2, f"{some(30)} {inside} {some(80)}"),
            (3, f"{some(9)}\n{some(70)} {inside} {some(90)}"), (4, f"{whole}\n{some(20)}"), (5, f"{some(20)}\n{whole}\n{some(4)}"),
            (6, f"{some(8)}\n{lines}\n{some(60)}"), (7, f"{lines}\n{some(6)}"), (8, some(300)), (9, None)]
    got = paragraph_dedup.paragraph_duplicates(docs(spark, rows), passage=50).toPandas().set_index("doc_id")
    assert got["n_passages"].to_dict() == {i: int(2 <= i <= 7) for i in range(10)}
    assert got["n_linked"].to_dict() == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 3, 7: 3, 8: 0, 9: 0}
    assert "n_passages" not in paragraph_dedup.paragraph_duplicates(docs(spark, rows)).columns


@pytest.mark.parametrize("most", [0, 200_000])
def test_passages_across_line_feeds(spark, monkeypatch, most):
    """Runs of 50 words are found wherever the lines of their occurrences end, and removed whole but for the first."""
    monkeypatch.setattr(paragraph_dedup, "MOST_BROADCAST", most)
    rng = np.random.default_rng(33)
    fresh = iter(f"w{i}" for i in range(10**6))
    some = lambda n: [next(fresh) for _ in range(n)]

    def broken(words, every):
        return "".join(w + ("\n" if i % every == every - 1 else " ") for i, w in enumerate(words)).strip()

    rows, removed, linked, passages = [], {}, {}, {}

    def add(text, gone=0, lines=0, marked=0):
        i = len(rows)
        rows.append((i, text))
        removed[i], linked[i], passages[i] = gone, lines, marked

    for n in (49, 50, 51, 64, 120):
        passage, hit = some(n), n >= 50
        add(" ".join(some(9)) + " " + broken(passage, 30) + " " + " ".join(some(70)), 0, hit * -(-n // 30), hit)
        later = broken([w.upper() for w in passage], 17)
        add(" ".join(some(33)) + "\n\n" + later + " " + " ".join(some(61)), hit * len(later), hit * -(-n // 17), hit)
    line, rest = some(20), some(40)
    add(" ".join(line) + "\n" + " ".join(some(80)), 0, 1, 0)
    add(" ".join(some(25) + line + rest + some(30)), 0, 1, 1)
    # its first line goes, so the run of 60 is not whole any more: it counts, but nothing else is removed
    add(" ".join(line) + "\n" + " ".join(rest + some(30)), len(" ".join(line)), 2, 1)
    twice = some(60)
    text = broken(twice, 25) + " " + " ".join(some(7)) + "\n" + " ".join(some(5)) + " " + broken(twice, 40) + " " + " ".join(some(90))
    add(text, len(" ".join(twice)), 5, 2)
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    got = paragraph_dedup.paragraph_duplicates(docs(spark, shuffled), passage=50).toPandas().set_index("doc_id").sort_index()
    assert got["n_removed"].to_dict() == removed
    assert got["n_linked"].to_dict() == linked
    assert got["n_passages"].to_dict() == passages
