"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Leading hex digits of the order key by which a source's running total is split into ranges.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], slopes: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source of ``sizes(source, source_size)`` its weight, slope and target.

    Sources by code point, null last, take weights and slopes in turn. All targets sum to ``share`` times
    all sizes; none exceeds ``most`` times its source's size, and what stands above is shared again by
    weight among the others. With sources in order of cap over weight, the level (target over weight of
    the uncapped) is the largest of (total - caps before) / (weights from here on).
    """
    turn = Window.orderBy(F.asc_nulls_last("source"))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    numbered = sizes.withColumn("n", F.row_number().over(turn) - 1)
    w = numbered.withColumn("weight", pick([float(x) for x in weights], F.pmod("n", F.lit(len(weights))) + 1)).withColumn(
        "slope", pick([float(x) for x in slopes], F.pmod("n", F.lit(len(slopes))) + 1)
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    level = w.withColumn("level", (total - before) / rest)
    best = F.max("level").over(Window.partitionBy())
    return level.withColumn("target", F.least(F.col("cap"), best * F.col("weight"))).select(
        "source", "source_size", "weight", "slope", "target"
    )


def order_key(doc_id: Column, text: Column) -> Column:
    """MD5 of the id and of the text's MD5: rows that share an id, or have none, are spread by their texts."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key`` of every row, written once, so that texts are read once for all that follows."""
    return checkpoint(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("key"))
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    slopes: tuple[float, ...] = (0.5, 0.0, -0.5),
    share: float = 1.5,
    most: float = 2.0,
    is_measured: bool = False,
) -> DataFrame:
    """The rows of ``docs`` with ``size, source_size, target, taken, position``.

    ``size`` is the number of words (null text: 0), ``source_size`` and ``target`` are the row's source's
    (see :func:`source_targets`; a null source is one of its own), ``taken`` the words that the mix takes
    from the row, repeats counted. Within a source rows stand in order of :func:`order_key`: all
    are taken floor(target / source_size) times and the first of them, up to the word, once more, so a
    source's words add up to its rounded target and no row is taken more than ``most`` times.

    A source's weight at training time t in [0, 1] is ``weight * (1 + slope * (2 t - 1))``, slope in
    [-1, 1]. Its demand up to t is the integral; ``position`` is the t at which the demand reaches the
    middle of the row's words, in closed form; a row's repeats stand together. Rows taken zero times have a null
    position. The result is range-sorted by position. Empty and null texts have size zero; rows repeated as a
    whole tie, and which of them has the cut inside it is left open; an empty table gives no rows. ``docs`` may
    have more columns of any names, which are kept; those named like a result column are replaced. With
    ``is_measured`` ``docs`` comes from :func:`measured` instead of holding texts, and loses its ``key``.

    Running totals are taken in ranges of the order key, so no source is ordered in one task.
    """
    new = ["size", "source_size", "target", "taken", "position"]
    names = [c for c in docs.columns if c not in new and not (is_measured and c == "key")]
    # columns go by number inside, so that none of the caller's names meets one of ours
    own = {c: f"c{i}" for i, c in enumerate(names)}
    if is_measured:
        size, key = F.col("size"), F.col("key")
    else:
        size, key = word_count(F.col("text")), order_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()], size.alias("size"), key.alias("key"))
    source = F.col(own["source"])
    rows = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)).withColumn("tag", F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    parts = checkpoint(rows.groupBy("tag", "range").agg(F.sum("size").alias("words"), F.first(source).alias("source")))
    sizes = parts.groupBy("tag").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, slopes, share, most)
    targets = targets.withColumn("tag", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    run = Window.partitionBy("tag").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("tag", "range", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("start"))
    starts = checkpoint(starts.join(targets, "tag"))
    placed = rows.join(starts, ["tag", "range"])
    inside = Window.partitionBy("tag", "range").orderBy("key", "size")
    earlier = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("before", (F.col("start") + earlier).cast("long"))
    some = F.col("source_size") > 0
    whole = F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = F.floor(F.col("target") + 0.5).cast("long")
    placed = placed.withColumn("whole", whole).withColumn("cut", goal - F.col("whole") * F.col("source_size"))
    extra = lambda upto: F.least(F.greatest(F.col("cut") - F.col("before"), F.lit(0)), upto)
    placed = placed.withColumn("taken", (F.col("whole") * F.col("size") + extra(F.col("size"))).cast("long"))
    drawn = F.col("whole") * F.col("before") + F.least(F.col("before"), F.col("cut"))
    y = (drawn.cast("double") + F.col("taken").cast("double") * 0.5) / goal.cast("double")
    g = F.col("slope")
    t = F.when(g == 0, y).otherwise((F.sqrt((1.0 - g) * (1.0 - g) + 4.0 * g * y) - (1.0 - g)) / (2.0 * g))
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, t)).orderBy(F.asc_nulls_last("position"), "key")
    return placed.select(*[F.col(o).alias(c) for c, o in own.items()], *new)


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
         CAST(CASE n % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0 ELSE -0.5 END AS DOUBLE) AS slope,
         CAST(source_size AS DOUBLE) * CAST(2 AS DOUBLE) AS cap
  FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, slope, least(cap, max(level) OVER () * weight) AS target FROM l
), j AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(floor(t.target + CAST(0.5 AS DOUBLE)) AS BIGINT) AS goal
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, goal - whole * source_size AS cut FROM j
), k AS (
  SELECT *, CAST(whole * size + least(greatest(cut - before, 0), size) AS BIGINT) AS taken FROM c
), y AS (
  SELECT *, (CAST(whole * before + least(before, cut) AS DOUBLE) + CAST(taken AS DOUBLE) * CAST(0.5 AS DOUBLE))
            / CAST(goal AS DOUBLE) AS y
  FROM k
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN y
         ELSE (sqrt((CAST(1 AS DOUBLE) - slope) * (CAST(1 AS DOUBLE) - slope) + CAST(4 AS DOUBLE) * slope * y)
               - (CAST(1 AS DOUBLE) - slope)) / (CAST(2 AS DOUBLE) * slope) END END AS position
FROM y
"""
