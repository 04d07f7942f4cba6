"""BPE, WARC, toxicity, mixing, URL filter and the pipeline on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from contourflow.llm import bpe, mixing, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " ", "\n\n  a", "Hello  world's 123", "é" * 70, "a" * 3000, "日本語のテキスト ñandú\u00a0\u2003x", "<|endoftext|>", "ab " * 500, "🙂🙃 don't"]


def test_bpe_matches_the_library(spark):
    rows = [(i, t, "x", None, None) for i, t in enumerate(TEXTS)] + [(0, "again", "x", None, None), (None, "no id", "x", None, None)]
    got = bpe.encode_documents(spark.createDataFrame(rows, DOCS), PATH, public_tokenizers.PATTERN, with_ids=True)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    want = sorted((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows for ids in [enc.encode_ordinary(t or "")])
    found = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()]
    assert sorted(found) == want
    back = bpe.decode_ids(got, PATH).where("doc_id = 4").first()
    assert bytes(back["decoded"]).decode() == TEXTS[4]
    assert bpe.encode_documents(spark.createDataFrame([], DOCS), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_words_merge_alike():
    ranks = bpe.load_ranks(PATH)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 60, 900):
        w = bytes(rng.choice(list(b"abcdeth \xc3\xa9"), n).astype(np.uint8))
        assert bpe.merge_long(w, ranks) == enc._encode_single_piece(w)


def test_pair_ranks_cover_every_split():
    ranks = bpe.load_ranks(PATH)
    offset, entries = bpe.pair_ranks(ranks)
    for token, rank in list(ranks.items())[::37]:
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                assert entries[offset[a] + b] == a << bpe.ID_BITS | rank


def test_pair_ranks_are_dense():
    ranks = bpe.load_ranks(PATH)
    offset, entries = bpe.pair_ranks(ranks)
    cuts = [(ranks.get(t[:i]), ranks.get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t))]
    pairs = {(a, b): r for a, b, r in cuts if a is not None and b is not None}
    assert len(entries) < 4 * len(pairs)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(0, len(offset), 7), np.arange(0, len(offset), 97)))
    told = entries[offset[a] + b]
    found = np.flatnonzero((told >= 0) & (told >> bpe.ID_BITS == a))
    low = told[found] & bpe.NONE - 1
    assert dict(zip(zip(a[found].tolist(), b[found].tolist(), strict=True), low.tolist(), strict=True)) == {
        (a, b): r for (a, b), r in pairs.items() if a % 7 == 0 and b % 97 == 0
    }
    low = entries[[offset[a] + b for a, b in pairs]]
    assert low.tolist() == [a << bpe.ID_BITS | r for (a, _), r in pairs.items()]
    alone = {bytes([i]): i for i in range(256)}
    assert (bpe.pair_ranks(alone)[1] == -1).all()


def test_bpe_query_bounds_its_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        __spark_entry__.queries()["op3_bpe"](spark, SF)
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.set(key, before)
    assert bpe.BATCH_CHARS <= 1 << 18


PAGES = "page_id long, url string, html string, extra string"


def test_warc_round_trip(spark, tmp_path):
    long = "x" * 150
    rows = [(3, "http://a/", long, ""), (1, "http://b/\r\nX: y", long, ""), (2, None, None, ""), (4, "http://c/", "", ""), (5, "u", "é" * 60, ""), (5, "u", "é" * 60, ""), (None, "u", long, "")]
    pages = spark.createDataFrame(rows, PAGES)
    got = warc.page_records(pages, str(tmp_path / "one")).toPandas()
    assert len(got) == len(rows)
    one = got[got.page_id == 3].iloc[0]
    assert (one.record_type, one.refers_to, one.payload_bytes, one.payload_digest) == ("revisit", 1, 150, hashlib.sha256(long.encode()).hexdigest())
    assert (got[got.page_id.isin([2, 4, 5])].record_type == "response").all()
    full = warc.reconstruct(spark, str(tmp_path / "one")).where("page_id = 1").first()
    head, _, body = bytes(full["record"]).partition(b"\r\n\r\n")
    assert full["url"] == "http://b/\r\nX: y" and body == long.encode() + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: response") and b"http://b/%0D%0AX: y" in head
    assert warc.page_records(spark.createDataFrame([], PAGES), str(tmp_path / "two")).count() == 0


def _compare(got, sql, views):
    con = duckdb.connect()
    for name, frame in views.items():
        con.register(name, frame)
    want = con.sql(sql).df()
    c = sorted(want.columns)
    got, want = (x[c].sort_values(c).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_sql_twins(spark):
    pages, docs = pd.read_parquet(f"{SF}/pages.parquet"), pd.read_parquet(f"{SF}/documents.parquet")
    _compare(__spark_entry__.queries()["op6_warc"](spark, SF).toPandas(), warc.SQL, {"pages": pages})
    _compare(__spark_entry__.queries()["op8_mixing"](spark, SF).toPandas(), mixing.SQL, {"documents": docs})


def test_mixing_awkward(spark):
    rows = [(i, "w " * (i % 7), None, s, None) for i, s in enumerate(["a"] * 40 + ["b"] * 5 + [None] * 20 + ["é"] * 3)] + [(None, None, None, "empty", None), (1, "w", None, "a", None)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(df).toPandas()
    _compare(got[["doc_id", "size", "source_size", "target", "taken", "position"]], mixing.SQL, {"documents": df.toPandas().astype({"doc_id": "Int64"})})
    assert (got.taken <= 2 * got["size"]).all() and len(got) == len(rows)
    by = got.assign(source=got.source.fillna("-")).groupby("source").agg({"taken": "sum", "target": "first"})
    assert (by.taken - by.target).abs().max() <= 0.5
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    clash = "doc_id long, text string, source string, slope string, weight int, start long, key string, tag string, target long, `a.b` int"
    rows = [(i, "w " * i, "s", "x", 1, 2, "k", "t", 9, 7) for i in range(6)]
    got = mixing.mix_sources(spark.createDataFrame(rows, clash))
    assert got.columns == ["doc_id", "text", "source", "slope", "weight", "start", "key", "tag", "a.b", "size", "source_size", "target", "taken", "position"]
    assert got.agg({"taken": "sum"}).first()[0] == 23 and got.where("slope = 'x' and weight = 1 and start = 2 and key = 'k'").count() == 6
    again = mixing.mix_sources(mixing.measured(df), is_measured=True)
    same = ["doc_id", "size", "source_size", "target", "taken", "position"]
    assert sorted(map(str, again.select(*same).collect())) == sorted(map(str, mixing.mix_sources(df).select(*same).collect()))


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeiorstn"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, rng.integers(20, 120)))
        bad = i % 4 == 0
        if bad:
            for k in rng.integers(0, len(words), 4):
                words[k] = rng.choice(["moronic", "idiot", "scumbag"])
        rows.append((i, " ".join(words), "en", "s", None))
        labels.append((i, 0, int(bad)))
    rows += [(1000, None, None, None, None), (None, "", None, None, None)]
    labels += [(5000, None, None), (None, 1, 1), (0, 0, 1)]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(df, lab).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    known = got[got.doc_id < 400]
    assert ((known.doc_id.astype(int) % 4 == 0) == (known.predicted == 1))[known.held_out].mean() > 0.95
    assert all(h == (zlib.crc32(str(int(i)).encode()) % 5 == 0) for i, h in zip(known.doc_id, known.held_out, strict=True))
    assert (toxicity.score_toxicity(df, lab.limit(0)).toPandas().score == 0).all()
    assert toxicity.score_toxicity(df.limit(0), lab).count() == 0


def _ratios(pairs, folds, discount):
    """Ratios of all words by the formula, from (word, before, class, fold) rows."""
    kinds = [{(w, b) for w, b, c, f in pairs if c == k and f in folds} for k in (0, 1)]
    count = [collections.Counter(w for w, _ in k) for k in kinds]
    both = collections.Counter(w for w, _ in kinds[0] | kinds[1])
    mass, n = [sum(c.values()) for c in count], sum(both.values())
    free = [sum(min(x, discount) for x in c.values()) for c in count]
    out = {}
    for w, x in both.items():
        shared = x / n
        p = [(max(count[k][w] - discount, 0) + free[k] * shared) / mass[k] for k in (0, 1)]
        out[w] = math.log(p[1] / p[0])
    return out


def test_toxicity_models_against_brute_force(spark):
    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(30)]
    rows = [(int(i % 3 == 0), i % 2, " ".join(rng.choice(names, 25, p=np.arange(1, 31) / 465))) for i in range(40)]
    rows += [rows[0], (1, 0, None), (0, 1, "  "), (0, 0, "Solo")]
    pairs = toxicity._pairs(spark.createDataFrame(rows, "toxic int, fold int, text string"))
    plain = [(w, b, c, f) for c, f, t in rows for w, b in zip((t or "").lower().split(), ["", *(t or "").lower().split()], strict=False)]
    samples = [(0, 1), (0,), (1,)]
    counts = toxicity.word_counts(pairs, samples)
    for discount in (1.0, 5.0):
        for folds, (got, unknown) in zip(samples, toxicity.word_ratios(counts, 3, discount), strict=True):
            want = _ratios(plain, folds, discount)
            assert 0 < len(got) <= len(want)
            for w, v in want.items():
                assert abs(got.get(w.encode(), unknown) - v) < 1e-5
    assert toxicity.word_ratios(counts.limit(0), 1) == [None]


def test_toxicity_scores_by_the_formula(spark):
    rng = np.random.default_rng(2)
    fill = [f"{a}{b}" for a in "abcde" for b in "fghij"]
    rows = [(i, " ".join([*rng.choice(fill, 8), "vile" if i % 3 == 0 else "kind", *rng.choice(fill, 3)]), "n", "s", None) for i in range(300)]
    rows += [(301, "nothing but vile things " + "a b " * 300_000, "n", "s", None), (302, "x" * 2_000_000, "n", "s", None), (5, "again vile", "n", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, before string, mask string, score double")
    got = toxicity.with_toxicity(df, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    assert got.columns == ["doc_id", "text", "before", "mask", "score"] and got.count() == len(rows)
    score = {r["doc_id"]: r["score"] for r in got.collect() if r["doc_id"] != 5}
    assert all((score[i] >= 0.5) == (i % 3 == 0) for i in range(300) if i != 5) and score[301] > score[302]


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/71", "https://x.com/en/5", "http://example.net/de/80?x", "http://a.net/de/1", "ftp://b.org/es/#f", "no scheme", None, "http://cheap-pills.biz/fr/1", "http://notexample.com/en/7", "x://y/com/en/", "http://com/en/"]
    pages = spark.createDataFrame([(i, u, "<title>cheap pills and win</title>", "e") for i, u in enumerate(urls)], PAGES.replace("html string", "html string"))
    got = url_filter.judge_urls(pages).toPandas().set_index("page_id").sort_index()
    assert got["rule"].fillna("").tolist() == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", "org/es/", "", "", "", "com/en/", "", "com/en/"]
    assert got["verdict"].tolist()[:5] == ["allow", "block", "block", "allow", "block"]
    assert (got.loc[0].host, got.loc[0].path) == ("www.example.com", "/en/71") and (got.loc[5].host, got.loc[6].path) == ("", "")
    assert url_filter.segment("cheappills", {"cheap": 5, "pills": 5, "chea": 1}, 11) == ["cheap", "pills"]
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES)).count() == 0
    _compare(got.reset_index()[["page_id", "host", "path", "rule"]], url_filter.SQL, {"pages": pages.toPandas()})


def test_url_filter_against_brute_force(spark):
    """The whole method over again in plain Python, on one host with a third of all rows, long and odd urls."""
    rng = np.random.default_rng(4)
    words = ["cheap", "pills", "good", "news", "star", "art", "start", "ab"]
    rows = []
    for i in range(300):
        host = "www.hot.com" if i % 3 == 0 else "".join(rng.choice(words, 2)) + "." + "".join(rng.choice(words, 1)) + str(rng.choice([".com", ".net", ".org", ".info"]))
        rows.append((i, f"http://{host}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice(words)}{rng.choice(words)}/{rng.integers(0, 99)}?q", f"<title>{' '.join(rng.choice(words, 3))} Ünïon {i}</title>", "e"))
    rows += [rows[0], (None, None, None, None), (7, "http:///", "", ""), (8, "http://a.org/" + "start" * 300, "<title>", "")]
    pages = spark.createDataFrame(rows, PAGES)
    titles = collections.Counter(w for *_, h, _ in rows for t in re.findall(r"(?is)<title[^>]*>(.*?)</title>", h or "") for w in re.findall(r"[^\W\d_]+", t.lower()))
    total = sum(titles.values())

    def tokens(host, path):
        labels = host.split(".")
        inner = ".".join(labels[: max(1, len(labels) - 1)])
        out = ["h:" + w for n in re.findall(r"[^\W_]+", inner) for w in url_filter.segment(n, titles, total)]
        for n in re.findall(r"[^\W_]+", path.lower()):
            out += ["p:#"] if n.isdigit() else ["p:" + w for w in url_filter.segment(n, titles, total)]
        return out

    for most in (0, 1000):
        got = url_filter.judge_urls(pages, most_broadcast=most).toPandas()
        assert len(got) == len(rows)
        ruled = {r: v for v, r in url_filter.RULES}
        count = {v: collections.Counter() for v in ("block", "allow")}
        for h, p, r in zip(got.host, got.path, got.rule, strict=True):
            if isinstance(r, str):
                count[ruled[r]].update(tokens(h, p))
        kinds = len(set(count["block"]) | set(count["allow"]))
        size = {v: sum(c.values()) + kinds for v, c in count.items()}
        for h, p, r, v, o in zip(got.host, got.path, got.rule, got.verdict, got.log_odds, strict=True):
            want = sum(math.log((count["block"][t] + 1) / size["block"] * size["allow"] / (count["allow"][t] + 1)) for t in tokens(h, p) if count["block"][t] + count["allow"][t])
            assert abs(want - o) < 1e-6
            assert v == (ruled[r] if isinstance(r, str) else "block" if round(want, 9) > 0 else "allow")
    assert set(got.verdict[got.rule.isna()]) == {"block", "allow"}


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in ("toxicity", "simhash_dedup"):
            assert docs.join(before, before.columns, "left_anti").count() == 0 and 0 < counts[-1] < counts[-2]
    assert counts[3] == counts[2] and counts[5] == counts[4]
    assert "decoded_sha256" in docs.columns and docs.where("n_tokens is null").count() == 0


def test_pipeline_awkward(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(4000)])
    plain = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    long = " ".join(rng.choice(words, 300_000))
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(plain)]
    rows += [(30, None, None, None, None), (31, "", "en", "a", 0), (None, "alone " + plain[0], "en", "a", 1), (32, long, "en", None, len(long))]
    rows += [rows[3], (33, plain[4], "en", "b", 1), (34, plain[5], "en", "a", 1)]
    clash = DOCS + ", score double, root long, k1 long, spans int, size int, copy int, ids int, `a.b` int"
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(20)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    empty.write.parquet(str(tmp_path / "none" / "labels.parquet"))

    def through(docs, sf_dir):
        kept = []
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = f"{sf_dir}/{docs.sparkSession.sparkContext.applicationId}-{i}"
            stage(spark, docs, sf_dir).write.parquet(out)
            docs = spark.read.parquet(out)
            kept.append(docs.toPandas())
            assert name == "bpe" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return dict(zip([name for name, _ in corpus_pipeline.STAGES], kept, strict=True))

    got = through(spark.createDataFrame([(*r, 0.9, 1, 2, 3, 4, 5, 6, 7) for r in rows], clash), str(tmp_path / "none"))
    assert len(got["toxicity"]) == len(rows)
    # the repeated row, the copies 33 and 34 and one of the two texts without words go; all else stays
    ids = got["simhash_dedup"].doc_id
    assert ids.dropna().astype(int).sort_values().tolist() == [*range(31), 32] and ids.isna().sum() <= 1
    cut = got["suffix_dedup"].set_index("doc_id").text
    assert len(cut) == len(ids) and cut[30] == "" and cut[32] == long and cut[7] == plain[7]
    assert len(got["bpe"]) == len(got["mixing"]) >= 30
    by = {h for h in got["bpe"].decoded_sha256}
    assert by == {hashlib.sha256(t.encode()).hexdigest() for t in got["mixing"].text}
    scored = through(spark.createDataFrame([(*r, 0.9, 1, 2, 3, 4, 5, 6, 7) for r in rows], clash), str(tmp_path))
    assert len(scored["toxicity"]) <= len(rows)
    (tmp_path / "bare").mkdir()
    labels.write.parquet(str(tmp_path / "bare" / "labels.parquet"))
    assert all(len(v) == 0 for v in through(spark.createDataFrame([], DOCS), str(tmp_path / "bare")).values())


def test_toxicity_threshold_does_not_depend_on_the_sample(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(50)]
    rows = [(i, " ".join(rng.choice(words, 20))) for i in range(450)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(450)], "doc_id long, toxic int")
    whole, some = (toxicity.score_toxicity(df, lab, docs_per_class=n).toPandas().score.mean() for n in (8000, 40))
    assert abs(whole - 1 / 9) < 0.05 and abs(some - whole) < 0.08


def test_toxicity_discount_is_the_one_that_explains_the_labels(spark):
    """Few toxic documents: five different neighbours of an insult are not to be had, two are."""
    rng = np.random.default_rng(6)
    fill = [f"{a}{b}{c}" for a in "abcd" for b in "efgh" for c in "ij"]
    rows = [(i, " ".join([*rng.choice(fill, 15), "vile" if i % 10 == 0 else "kind", *rng.choice(fill, 15)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(df, spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(120)], "doc_id long, toxic int"))
    assert all((r["doc_id"] % 10 == 0) == (r["predicted"] == 1) for r in got.collect())
    x, y = np.array([[0.0, 0.0], [2.0, 1.0]]), np.array([0, 1])
    weights = np.array([0.1, 1.0, -0.5])
    p = 1 / (1 + np.exp(-np.array([0.1, 1.6])))
    assert abs(toxicity.log_loss(weights, x, y, np.array([3.0, 1.0])) + 3 * np.log(1 - p[0]) + np.log(p[1])) < 1e-12


def test_word_pairs_are_sent_as_lists():
    """A frequent word takes sixteen rows of a task's pairs at most, and no pair is lost or told wrongly."""
    words = [b"", b"the", *(b"w%d" % i for i in range(1000))]
    key = np.array([1 << 32 | b for b in range(2, 1002)] + [5 << 32 | 1])
    got = [r for batch in toxicity._packed([(1, key), (8, key[:500])], words) for r in batch.to_pylist()]
    assert 2 <= len(got) <= 17 and {r["word"] for r in got} == {b"the", b"w3"}
    told = {(r["word"], p & 2**64 - 16): p & 15 for r in got for p in r["pairs"]}
    want = {(b"the", toxicity.xxhash.xxh64_intdigest(w) & 2**64 - 16): 9 if i < 500 else 1 for i, w in enumerate(words[2:])}
    assert told == want | {(b"w3", toxicity.xxhash.xxh64_intdigest(b"the") & 2**64 - 16): 1}


def test_fold_finds_places_without_a_search(spark):
    """Words of every foldable length, with many equal pairs, are merged leftmost first; no position is searched for."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(31)
    words = [bytes(rng.choice(list(b"aeht"), n).tolist()) for n in range(1, bpe.LONGEST_FOLD + 1)] + [b"a" * 48, b"ab" * 24, b"\xff" * 48]
    words = [w for w in words if w not in ranks]  # a token is not folded
    rows = [(i, [ranks[bytes([x])] for x in w]) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "i int, word array<bigint>")
    table = bpe.rank_map(ranks)
    folded = df.select("i", bpe._let(table, lambda t: bpe.encode_word(bpe.F.col("word"), t["o"], t["e"])).alias("ids"))
    assert "array_position" not in folded._jdf.queryExecution().analyzed().toString()
    assert {r["i"]: r["ids"] for r in folded.collect()} == {i: bpe.merge_long(w, ranks) for i, w in enumerate(words)}


def test_fold_concatenates_nothing(spark):
    """A step of the fold changes its array in place of cutting and joining it; pairs without a rank stay apart."""
    ranks = bpe.load_ranks(PATH)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(41)
    words = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in range(2, bpe.LONGEST_FOLD + 1)]
    words += [" erthtion".encode() * k for k in (1, 2, 5)] + ["éèçßñ".encode() * 4, b"\x00\xff" * 20]
    rows = [(i, [ranks[bytes([x])] for x in w]) for i, w in enumerate(words) if w not in ranks]
    table = bpe.rank_map(ranks)
    df = spark.createDataFrame(rows, "i int, word array<bigint>")
    folded = df.select("i", bpe._let(table, lambda t: bpe.encode_word(bpe.F.col("word"), t["o"], t["e"])).alias("ids"))
    plan = folded._jdf.queryExecution().analyzed().toString()
    assert "concat(" not in plan and plan.count("slice(") == 1
    assert {r["i"]: r["ids"] for r in folded.collect()} == {i: enc._encode_single_piece(words[i]) for i, _ in rows}
