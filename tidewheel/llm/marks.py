"""A bounded map of bits that says which rows may hold a wanted hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map at most, some 20 MB where it is sent.
MARKS = 1 << 25


class Marks:
    """A map of bits for hashes, sent to rows that may hold one of them.

    It has 32 bits for each hash, and ``MARKS`` in all at most: beyond that more rows pass, and still none is lost.
    """

    def __init__(self, hashes: DataFrame):
        self.bits = min(MARKS, 1 << max(6, (32 * hashes.count()).bit_length()))
        at = F.pmod("h", F.lit(self.bits))
        self.words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))

    def passed(self, rows: DataFrame, h: Column, name: str) -> DataFrame:
        """The rows whose hash is marked."""
        rows = rows.withColumn(name, F.pmod(h, F.lit(self.bits)))
        words = self.words.select(F.col("word").alias(f"{name}_word"), F.col("mask").alias(f"{name}_mask"))
        met = rows.join(F.broadcast(words), F.shiftright(name, 6) == F.col(f"{name}_word"))
        return met.where(F.expr(f"shiftright({name}_mask, cast({name} & 63 as int)) & 1") == 1).drop(name, f"{name}_word", f"{name}_mask")
