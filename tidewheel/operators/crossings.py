"""The first later bar beyond a level, for any number of levels, without meeting levels and bars in pairs."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.exprs import INDEX, KEY

c = F.col
#: Bars of a chunk.
CHUNK = 4096


def walked(bars: list[tuple[int, float]], levels: list[tuple[int, float, int]]) -> tuple[dict[int, int], set[int]]:
    """({id: first place at or after its own where the value is below the level}, the ids that are never met).

    ``bars`` are (place, value) and ``levels`` (place, level, id), both in the order of places.  Open levels are a heap with the highest
    on top, so a bar looks at those that it meets and one more.
    """
    met: dict[int, int] = {}
    heap: list[tuple[float, int]] = []
    k = 0
    for place, value in bars:
        while k < len(levels) and levels[k][0] <= place:
            heapq.heappush(heap, (-levels[k][1], levels[k][2]))
            k += 1
        while heap and -heap[0][0] > value:
            met[heapq.heappop(heap)[1]] = place
    return met, {i for _, i in heap} | {x[2] for x in levels[k:]}


def _in_chunk(bars: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
    """Where the levels of a chunk are met in it, null if they aren't."""
    b = bars.dropna(subset=["x"]).sort_values("bar")
    v = levels.sort_values("bar")
    met, missed = walked(list(zip(b["bar"].tolist(), b["x"].tolist(), strict=True)), list(zip(v["bar"].tolist(), v["level"].tolist(), v["id"].tolist(), strict=True)))
    own = {i: (s, lv, ch) for s, i, lv, ch in zip(v[KEY], v["id"], v["level"], v["chunk"], strict=True)}
    rows = [(own[i][0], i, own[i][1], own[i][2], met.get(i)) for i in (*met, *missed)]
    return pd.DataFrame(rows, columns=[KEY, "id", "level", "chunk", "met"]).astype({"id": "int64", "chunk": "int64", "level": "float64", "met": "Int64"})


def first_below(bars: DataFrame, levels: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(symbol, id, met): for each of ``levels(symbol, id, bar, level)`` the first bar from its own on whose x is below it, null if there is none.

    ``bars`` are (symbol, bar, x); ids are numbers, unique within a symbol.  Bars are cut into chunks.  A level is first looked for in its own chunk; what is left meets
    the chunks' minima (one row a chunk), and then the one chunk that holds its bar.  So a task holds a chunk, and each bar is read twice.
    Bars without an x meet nothing, and levels that are null are never met.
    """
    place = F.floor(c(INDEX) / chunk).cast("long")
    b = bars.select(KEY, c(INDEX).cast("long").alias("bar"), c("x").cast("double").alias("x"), place.alias("chunk")).where("bar is not null")
    v = levels.select(KEY, c("id").cast("long").alias("id"), c(INDEX).cast("long").alias("bar"), c("level").cast("double").alias("level"), place.alias("chunk")).where("level is not null")
    schema = f"{KEY} string, id long, level double, chunk long, met long"
    near = b.groupBy(KEY, "chunk").cogroup(v.groupBy(KEY, "chunk")).applyInPandas(_in_chunk, schema)
    left = near.where("met is null").select(KEY, "id", "level", (c("chunk") + 1).alias("bar"), F.lit(0).cast("long").alias("chunk"))
    least = b.groupBy(KEY, "chunk").agg(F.min("x").alias("x")).select(KEY, c("chunk").alias("bar"), "x", F.lit(0).cast("long").alias("chunk"))
    far = least.groupBy(KEY, "chunk").cogroup(left.groupBy(KEY, "chunk")).applyInPandas(_in_chunk, schema).where("met is not null")
    far = far.select(KEY, "id", "level", (c("met") * chunk).alias("bar"), c("met").alias("chunk"))
    there = b.groupBy(KEY, "chunk").cogroup(far.groupBy(KEY, "chunk")).applyInPandas(_in_chunk, schema)
    found = near.where("met is not null").select(KEY, "id", "met").unionByName(there.select(KEY, "id", "met"))
    names = {KEY: "_s", "id": "_i"}
    return levels.select(KEY, c("id").cast("long").alias("id")).join(found.withColumnsRenamed(names), (c(KEY) == c("_s")) & (c("id") == c("_i")), "left").select(KEY, "id", "met")
