"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the row's key.  Only
a bucket above its byte limit is split on one more bit, so a shard is the
shortest hash prefix whose rows fit the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.scratch import Scratch
from tidewheel.llm.tables import Aside, table

#: Bytes of text in a shard.
LIMIT = 8 << 20
#: Bits of hash that there are; rows that agree in all of them stay together.
BITS = 60
#: Bits by which an oversized region is looked into at a time.
STEP = 12
#: A directory of up to so many shards (some 5 MB), of up to so many depths, is sent to the rows.
SENT, FEW = 50_000, 12


def hash_of(key: Column, text: Column) -> Column:
    """60 bits of an MD5 of the key and the text, as a long. Null reads as an empty text."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows, over_limit): the shards for ``rows(h, bytes)``.

    The table is read once per ``step`` bits of depth.  Each pass groups what
    still lies in oversized regions by the next bits (partial sums before the
    shuffle), rolls the sums up to every shorter prefix, and takes as shards
    the prefixes that fit while their parent does not.  A prefix of all bits
    that is still too large can't be split; it is a shard with over_limit.
    An empty table has no shards.
    """
    work = Scratch(rows.sparkSession)
    found, deep, open_ = None, 0, None
    while True:
        new = min(BITS, deep + step)
        part = rows.withColumn("p", F.shiftright("h", BITS - new))
        if open_ is not None:
            part = part.withColumn("q", F.shiftright("p", new - deep)).join(open_, "q", "left_semi")
        fine = work.store(part.groupBy("p").agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")), f"fine{new}")
        levels = fine.select("b", "n", "p", F.explode(F.sequence(F.lit(deep), F.lit(new))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(p, {new} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        sums = work.store(sums, f"sums{new}")
        over = sums.where(F.col("b") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent")).distinct()
        fits = sums.where((F.col("b") <= limit) if new < BITS else ((F.col("b") <= limit) | (F.col("depth") == BITS)))
        under = fits.withColumn("parent", F.shiftright("prefix", 1)).join(over, ["depth", "parent"], "left_semi")
        if deep == 0:  # the root fits by itself
            under = under.unionByName(fits.where("depth = 0").withColumn("parent", F.lit(0).cast("long")), allowMissingColumns=True)
        got = under.select("depth", "prefix", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"), (F.col("b") > limit).alias("over_limit"))
        found = got if found is None else found.unionByName(got)
        if new == BITS:
            return found
        open_ = sums.where((F.col("depth") == new) & (F.col("b") > limit)).select(F.col("prefix").alias("q"))
        if not open_.limit(1).count():
            return found
        deep = new


def assigned(docs: DataFrame, limit: int = LIMIT, step: int = STEP, key: str = "doc_id", text: str = "text", sent: int = SENT) -> DataFrame:
    """``docs`` with shard (its hash prefix as bits, "" for the whole), shard_bytes and over_limit.

    Bytes are those of the text in UTF-8; a null text has none, a null key reads as empty.  Repeated rows
    have the same hash and share a shard; ties of hash stay together.  A document longer than the limit
    gets a shard of its own, marked over_limit.  Columns of these names are
    replaced, others may have any name; an empty table stays empty.  A directory of up to ``sent`` shards (counted) is sent to
    the rows, so no text is shuffled; a larger one meets them by an equi-join on the hash.
    """
    work = Scratch(docs.sparkSession)
    held = Aside(docs, ("shard", "shard_bytes", "over_limit"))
    h, size = hash_of(F.col(held.of(key)), F.col(held.of(text))), F.coalesce(F.octet_length(held.of(text)), F.lit(0)).cast("long")
    narrow = held.df.select(h.alias("h"), size.alias("bytes")).groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    narrow = work.store(narrow, "hashes")
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0"))
    shards = work.store(directory(narrow, limit, step).select("depth", "prefix", bits.alias("shard"), "shard_bytes", "over_limit"), "directory")
    found = {r["depth"]: r["n"] for r in shards.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # at most BITS + 1 numbers
    depths = sorted(found) or [0]
    at = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in depths])
    rows = held.df.withColumn("h", h)
    if sum(found.values()) <= sent and len(depths) <= FEW:
        for k, d in enumerate(depths):  # one small table for each depth that occurs
            part = shards.where(F.col("depth") == d).select(F.col("prefix").alias(f"p{k}"), F.struct("shard", "shard_bytes", "over_limit").alias(f"s{k}"))
            rows = rows.join(F.broadcast(part), F.shiftright("h", BITS - d) == F.col(f"p{k}"), "left")
        rows = rows.withColumn("s", F.coalesce(*[f"s{k}" for k in range(len(depths))]))
    else:
        where = narrow.select("h", F.explode(at).alias("at")).select("h", "at.depth", "at.prefix").join(shards, ["depth", "prefix"])
        where = where.select(F.col("h").alias("_h"), F.struct("shard", "shard_bytes", "over_limit").alias("s"))
        rows = rows.join(where, F.col("h") == F.col("_h"))
    return held.back(rows, F.col("s.shard"), F.col("s.shard_bytes"), F.col("s.over_limit"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every row of ``documents``. Nulls, ties and repeats as in ``assigned``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_bytes", F.octet_length("text").cast("long"))
    return assigned(docs).select("doc_id", "n_bytes", "shard", "shard_bytes", "over_limit")


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(text)::BIGINT AS n_bytes, coalesce(strlen(text), 0)::BIGINT AS b,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), l AS (
  SELECT h, b, depth, h >> (60 - depth)::INTEGER AS prefix FROM d, (SELECT unnest(range(0, 61)) AS depth)
), s AS (
  SELECT depth, prefix, sum(b)::BIGINT AS b FROM l GROUP BY depth, prefix
), m AS (
  SELECT s.depth, s.prefix, s.b FROM s LEFT JOIN s p ON p.depth = s.depth - 1 AND p.prefix = s.prefix >> 1
  WHERE (s.b <= {LIMIT} OR s.depth = 60) AND (s.depth = 0 OR p.b > {LIMIT})
)
SELECT d.doc_id, d.n_bytes, substr(lpad(bin(m.prefix), 60, '0'), 61 - m.depth, m.depth) AS shard, m.b AS shard_bytes, m.b > {LIMIT} AS over_limit
FROM d JOIN m ON m.prefix = d.h >> (60 - m.depth)::INTEGER
"""
