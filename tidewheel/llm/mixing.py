"""Mixing sources to target weights: floor(rate) copies and one seeded coin.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.scratch import stored
from tidewheel.llm.tables import Aside, table

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most so many times.
MOST = 3
#: Names the coins: another seed gives another draw.
SEED = "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, size) per document.

    The targets share the total by weight; none is above ``most`` times its
    source, and what that cuts off is shared again by weight among the rest.
    This is filling to a common level: ordered by the level at which a source
    is full, the full ones come first, and the level is the first that fits.
    The window over all sources holds one row per source, after the grouping.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    per = per.withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(fill), F.lit(0))
    share = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(fill), F.lit(0))
    per = per.withColumn("level", left.cast("double") / share)
    per = per.withColumn("nth", F.row_number().over(Window.orderBy("full_at", F.col("source").asc_nulls_last())))
    per = per.withColumn("top", F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.col("nth"))).over(whole))
    target = F.least(F.col("w") * F.col("top"), F.lit(float(most)) * F.col("source_size"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _with_copies(held: Aside, key: str, text: str, source: str, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """The table set aside, with size, source_size, target and n_copies."""
    rows = held.df.withColumn("size", size_of(F.col(held.of(text))))
    # One row a source, stored: Spark sees its size and sends it to the rows if it is small, so that no text is shuffled.
    targets = source_targets(rows.select(F.col(held.of(source)).alias("source"), "size"), weights, most)
    targets = stored(targets.withColumnRenamed("source", "of_source"), "targets")
    both = rows.join(targets, F.col(held.of(source)).eqNullSafe(F.col("of_source")), "left")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(rate)
    return both.withColumn("n_copies", whole + (coin(F.col(held.of(key)), seed) < rate - whole).cast("long"))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and n_copies of each document.

    Null texts have size 0 and sources without words the target 0 (no copy);
    a null source is a source of its own; rows with the same key share a coin, null keys too.
    Texts of any length count whole.  Names that the columns of ``docs`` already have are replaced, others may be any.  An empty table
    stays empty.
    """
    held = Aside(docs, ("size", "source_size", "target", "n_copies"))
    return held.back(_with_copies(held, key, text, source, weights, most, seed), "size", "source_size", "target", "n_copies")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as ``copies`` says, with all columns of ``docs``, whatever their names."""
    held = Aside(docs)
    out = _with_copies(held, key, text, source, weights, most, seed)
    return held.back(out.withColumn("nth", F.explode(F.array_repeat(F.lit(1), F.col("n_copies").cast("int")))))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of ``documents``. Nulls, ties and repeats as in ``copies``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), o AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), f AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS full_at FROM o
), g AS (
  SELECT f.*, ((SELECT sum(source_size) FROM f) - 3 * coalesce((SELECT sum(source_size) FROM f e WHERE e.full_at < f.full_at), 0))::DOUBLE
     / ((SELECT sum(w) FROM f) - coalesce((SELECT sum(w) FROM f e WHERE e.full_at < f.full_at), 0)) AS level
  FROM f
), t AS (
  SELECT source, source_size, least(w * (SELECT arg_min(level, full_at) FROM g WHERE level <= full_at), 3.0::DOUBLE * source_size)::DOUBLE AS target FROM g
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0)::DOUBLE, 0) AS rate,
    ('0x' || substr(md5('mix-1:' || d.doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
