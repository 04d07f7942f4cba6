"""URL filters: host and path rules, else naive Bayes over Viterbi-segmented host and path words."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Rules as (verdict, host and path prefix).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Letters of a word that a name is split into, at most.
LONGEST_WORD = 24
#: Names whose scores are broadcast; beyond, they meet the urls in a join.
MOST_BROADCAST = 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and on
    from there up to ``?``, ``#`` or the end. Both empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = [F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2)]
    return F.translate(found[0], upper, upper.lower()), found[1]


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (of equal length: the first in order) whose host is ``host`` or a parent domain and whose path starts ``path``."""

    def fits(rule: str) -> Column:
        domain, slash, rest = rule.partition("/")
        return ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)

    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for _, r in ordered], F.lit(None).cast("string"))


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """Splits a concatenated name into words by the most probable unigram sequence (Viterbi).

    ``counts`` has those of the name's substrings that are words, ``total`` is the number of all words counted.
    Unknown words get 10 / (total * 10**length), so that known ones win wherever they fit; of equally
    probable splits the one with the longer last word stays.
    """
    unknown = math.log(10 / total)
    best, cut = [0.0], [0]
    for end in range(1, len(name) + 1):
        top, at = -math.inf, end - 1
        for start in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(name[start:end])
            p = best[start] + (math.log(n / total) if n else unknown - (end - start) * math.log(10))
            if p > top:
                top, at = p, start
        best.append(top)
        cut.append(at)
    words, end = [], len(name)
    while end:
        words.append(name[cut[end] : end])
        end = cut[end]
    return words[::-1]


def _runs(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"({kind}+)"), F.lit(1))


def url_names(host: Column, path: Column) -> Column:
    """Names of a url: runs of letters and digits in host labels but the last (``h:``) and in the path (``p:``).

    Path names are lower-cased; those of digits alone are ``p:#``.
    """
    labels = F.split(host, r"\.")
    inner = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), ".")
    of_host = F.transform(_runs(inner, r"[\p{L}\p{N}]"), lambda n: F.concat(F.lit("h:"), n))
    of_path = F.transform(
        _runs(F.lower(path), r"[\p{L}\p{N}]"), lambda n: F.when(n.rlike("^[0-9]+$"), F.lit("p:#")).otherwise(F.concat(F.lit("p:"), n))
    )
    return F.concat(of_host, of_path)


def unigrams(pages: DataFrame) -> DataFrame:
    """``word, n``: the words (runs of letters, of at most ``LONGEST_WORD``) in the titles of all pages, with their counts."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    words = pages.select(F.explode(_runs(F.lower(title), r"\p{L}")).alias("word")).where(F.length("word") <= LONGEST_WORD)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """``name, words`` for each row of ``names(name)``, by :func:`segment`.

    The dictionary ``words(word, n)`` meets the names' substrings in a join, so neither is held anywhere as a whole.
    """
    total = words.agg(F.sum("n")).first()[0] or 1
    length = F.length("name")
    starts = names.select("name", F.explode(F.sequence(F.lit(1), length)).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), length - F.col("start") + 1))
    parts = starts.select("name", "start", F.explode(sizes).alias("size")).select("name", F.col("name").substr(F.col("start"), F.col("size")).alias("word"))
    hits = parts.distinct().join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hits = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            split = [segment(name, {h["word"]: h["n"] for h in found or ()}, total) for name, found in zip(names, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], ["name", "words"])

    return names.join(hits, "name", "left").select("name", "hits").mapInArrow(run, "name string, words array<string>")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``page_id, host, path, rule, verdict, log_odds`` for every row of ``pages``.

    ``rule`` is the longest that fits (see :func:`match_rule`), else null, and ``verdict`` is that rule's.
    Other urls are blocked where multinomial naive Bayes finds their words likelier in blocked than in
    allowed urls (``log_odds`` > 0). It learns from all urls that a rule decides, classes weighing the
    same, add-one smoothed over the tokens seen in them; a token is a word of a segmented name with ``h:`` or
    ``p:`` before it. Words not seen there say nothing. Names are segmented by the counts of all titles' words.

    Dictionary, counts and scores are tables that grow with the pages; the driver holds three sums. Urls without
    any word score zero and are allowed. Null and malformed urls have empty host and path. Names of any length
    are split whole. Every row gives a row, repeated ones too; a null html has no title; null ids are kept; extra
    columns are ignored; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("rule", match_rule(F.col("host"), F.col("path"), rules))
    verdicts = {r: v for v, r in rules}
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in verdicts.items()], F.lit(None).cast("string"))
    parsed = checkpoint(parsed.withColumn("by_rule", by_rule).withColumn("row", F.monotonically_increasing_id()))
    held = parsed.select("row", "by_rule", F.explode(url_names(F.col("host"), F.col("path"))).alias("tag"))
    seen = {v: F.count_if(F.col("by_rule") == v).alias(v) for v in ("block", "allow")}
    names = checkpoint(held.groupBy("tag").agg(seen["block"], seen["allow"]))
    plain = names.where("tag <> 'p:#'").select(F.substring("tag", 3, 1 << 30).alias("name")).distinct()
    split = checkpoint(segmented(plain, checkpoint(unigrams(pages))))
    kind = F.substring("tag", 1, 2)
    tokens = names.where("tag <> 'p:#'").join(split, F.substring("tag", 3, 1 << 30) == F.col("name"))
    tokens = tokens.select("tag", "block", "allow", F.explode("words").alias("word")).withColumn("token", F.concat(kind, "word"))
    tokens = checkpoint(tokens.drop("word").union(names.where("tag = 'p:#'").select("tag", "block", "allow", F.col("tag").alias("token"))))
    counts = tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).where("block + allow > 0")
    block, allow, kinds = counts.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    chance = lambda c, n: (F.col(c) + 1) / F.lit(float((n or 0) + max(kinds, 1)))
    odds = counts.select("token", F.log(chance("block", block) / chance("allow", allow)).alias("odds"))
    scored = tokens.join(odds, "token").groupBy("tag").agg(F.sum("odds").alias("odds"))
    scored = checkpoint(scored)
    if scored.count() <= most_broadcast:
        scored = F.broadcast(scored)
    total = held.join(scored, "tag").groupBy("row").agg(F.round(F.sum("odds"), 9).alias("log_odds"))
    judged = parsed.join(total, "row", "left").withColumn("log_odds", F.coalesce("log_odds", F.lit(0.0)))
    by_method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "log_odds")


#: The columns that SQL can express, for tests: all but the method's verdicts.
SQL = """
WITH u AS (
  SELECT page_id, strpos(coalesce(url, ''), '://') AS pos, coalesce(url, '') AS url FROM pages
), h AS (
  SELECT page_id,
         CASE WHEN pos = 0 THEN '' ELSE translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*', 0),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
         CASE WHEN pos = 0 THEN '' ELSE regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM u
), r AS (
  SELECT * FROM (VALUES ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'),
    ('net', '/de/', 'net/de/', 'allow'), ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block'))
    AS t(domain, start, rule, verdict)
)
SELECT h.page_id, h.host, h.path,
       (SELECT arg_max(rule, length(rule)) FROM r
        WHERE (h.host = r.domain OR ends_with(h.host, '.' || r.domain)) AND starts_with(h.path, r.start)) AS rule
FROM h
"""
