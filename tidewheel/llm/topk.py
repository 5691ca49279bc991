"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import tiles
from tidewheel.llm.scratch import Scratch
from tidewheel.llm.tables import table

#: Neighbours of a query, and what a query's id is divisible by.
K, EVERY = 5, 50
#: Rows of a tile, and queries of a tile.
ROWS, QUERIES = 8192, 512


def _selected(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each pair of tiles the first ``k`` rows of each query; lists of the same queries that follow each other are one."""
    now, lists = None, None

    def emit() -> pa.RecordBatch:
        head, found = now, lists
        pick = [(s, i, u) for s, i, u in found]
        made = tiles.entries(*[np.concatenate([p[c] for p in pick]) for c in range(3)], [len(p[0]) for p in pick])
        n = head["a_n"]
        return pa.RecordBatch.from_arrays(
            [pa.array(tiles.longs(head["a_homes"])), pa.array(tiles.longs(head["a_places"])), pa.array(tiles.longs(head["a_ids"])), pa.array([head["node"]] * n, pa.int64()), made], ["home", "place", "query_id", "node", "top"]
        )

    for batch in batches:
        for row in batch.to_pylist():
            if now is not None and (row["a_tile"], row["node"]) != (now["a_tile"], now["node"]):
                yield emit()
                now = None
            scores = tiles.products(tiles.part(row, "a"), tiles.part(row, "r"))
            ids, unknown = tiles.longs(row["r_ids"]), np.frombuffer(row["r_unknown"], bool)
            homes, places = tiles.longs(row["a_homes"]), tiles.longs(row["a_places"])
            own = homes == row["r_tile"]
            if now is None:
                now, lists = row, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * row["a_n"]
            for q in range(row["a_n"]):
                line = scores[q]
                at = tiles.best(line, k + 1 if own[q] else k)
                if own[q]:
                    at = at[at != places[q]][:k]
                s, i, u = (np.concatenate(x) for x in zip(lists[q], (line[at], ids[at], unknown[at]), strict=True))
                first = np.lexsort((i, u, -s))[:k]
                lists[q] = s[first], i[first], u[first]
    if now is not None:
        yield emit()


def neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by ``every`` the ``k`` other rows of the highest integer inner product.

    Components are floors of 256 times the value.  Of equal scores the smaller id comes first, null ids last; a row with a null
    id asks nothing but can be found.  Repeated ids are rows of their own: each asks, and each finds the others.  Rows whose
    vector is null or has a null or non-finite component take no part.  Vectors of different lengths are compared as if the shorter one
    ended in zeros, and the empty vector scores 0 with all.  A product beyond the range of longs counts as the nearest long.  Other columns are ignored, whatever their
    names; an empty table gives no rows.

    Every tile of queries meets every tile of rows in one matrix product, of which each query's first ``k`` are kept at once; a tree merges these lists.
    """
    work = Scratch(vectors.sparkSession)
    narrow = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), F.lit(0).alias("label"))
    pairs, nodes, _ = tiles.met(tiles.packed(narrow, every, ROWS, QUERIES, None, work))
    lists = pairs.mapInArrow(lambda batches: _selected(batches, k), f"home long, place long, query_id long, node long, top {tiles.TOP}")
    lists = work.store(lists, "lists")
    work.release("tiles")
    top = tiles.tops(lists, ["home", "place", "query_id"], k, nodes, work, "level")
    found = top.select("query_id", F.posexplode("top").alias("rank", "entry"))
    return found.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("entry.vec_id").alias("vec_id"), tiles.score(F.col("entry")).alias("score"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row of ``embeddings`` whose vec_id is divisible by 50. Nulls, ties and repeats as in ``neighbours``."""
    return neighbours(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
