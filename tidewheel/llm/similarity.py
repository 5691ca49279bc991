"""Exact candidates for set similarity across components. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.scratch import Scratch


def rare_shingles(at: DataFrame, percent: int, work: Scratch, ends: bool = False) -> DataFrame:
    """(t, id, n, left, root): of each set ``s`` the shingles that come first by rarity, as many as a similar set can't avoid.

    Only shingles that occur in two components at least are returned; ``left`` is
    how many of the set come after it, which bounds what a pair that first meets here can share.
    With ``ends`` also how many come before it (i), the last of these shingles in the order of rarity (end), and how many of the set come after that (tail).
    """
    tokens = at.select("id", "n", "root", F.explode("s").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    tokens = tokens.join(often.where("lo <> hi").select("t", "k"), "t")
    # Shingles of one component alone are never shared with another one; they only take places at the front.
    first = F.array_sort(F.collect_list(F.struct("k", "t")))
    kept = tokens.groupBy("id", "n", "root").agg(first.alias("x"))
    places = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("x"))
    kept = kept.where(places > 0).withColumn("front", F.slice("x", F.lit(1), places.cast("int")))
    last = [F.element_at("front", -1).alias("end"), (F.size("x") - F.size("front")).alias("tail")] if ends else []
    kept = kept.select("id", "n", F.size("x").alias("r"), "root", *last, F.posexplode("front").alias("i", "x"))
    return work.store(kept.select("x.t", "id", "n", (F.col("r") - 1 - F.col("i")).alias("left"), "root", *(["i", "end", "tail"] if ends else [])), "rare")


def far_pairs(at: DataFrame, percent: int, work: Scratch, ends: bool = False) -> DataFrame:
    """(id, n, o, on): all pairs of ``at(id, n, root, s)`` of different roots that can be similar enough.

    Exact: two sets of the wanted similarity share a shingle among the rarest
    of each, and the first one they share leaves enough after it.
    ``ends`` counts what a pair shares among them, and gives each pair once: of the set whose rarest shingles end first, everything shared is
    either counted or comes after them.  That is another shuffle, and leaves fewer pairs to compare.
    """
    rare = rare_shingles(at, percent, work, ends)
    other = rare.select("t", *[F.col(x).alias(f"o{x}") for x in rare.columns if x not in ("t", "id")], F.col("id").alias("o"))
    enough = lambda shared: (100 + percent) * shared >= percent * (F.col("n") + F.col("on"))
    met = rare.join(other, "t").where(F.col("root") < F.col("oroot"))
    first = enough(1 + F.least("left", "oleft"))
    if not ends:
        return met.where(first).select("id", "n", "o", "on")
    # What a pair shares lies before, at or after each of its meetings; where that can't be enough, no other meeting of the pair is.
    met = met.where(enough(F.least("i", "oi") + 1 + F.least("left", "oleft")))
    rest = F.when(F.col("end") < F.col("oend"), F.col("tail")).when(F.col("end") > F.col("oend"), F.col("otail")).otherwise(F.least("tail", "otail"))
    pairs = met.select("id", "n", "o", "on", first.alias("first"), rest.alias("rest")).groupBy("id", "n", "o", "on").agg(F.count("*").alias("k"), F.max("first").alias("first"), F.max("rest").alias("rest"))
    return pairs.where(F.col("first") & enough(F.col("k") + F.col("rest"))).select("id", "n", "o", "on")
