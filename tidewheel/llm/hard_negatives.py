"""Hard negatives by a two-dimensional block product of anchors and rows.

Vectors are cut both ways, into tiles of rows and chunks of dimensions.  Each task multiplies one chunk of an anchor tile with the same
chunk of a row tile; the partial score tiles are shuffled to where their pair of tiles is added up, and there the
whole scores are reduced to what an anchor can still need of the tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import tiles
from tidewheel.llm.scratch import Scratch
from tidewheel.llm.tables import table

#: What an anchor's id is divisible by, positives of an anchor, negatives of a positive, and the least share of the positive's score in percent.
EVERY, POSITIVES, NEGATIVES, PERCENT = 100, 5, 5, 80
#: Rows of a tile, anchors of a tile, and dimensions of a chunk.
ROWS, ANCHORS, DIMS = 4096, 256, 32
#: What of a tile its partial scores carry, from the first chunk only.
KEPT = ["a_ids", "a_homes", "a_places", "a_labels", "r_ids", "r_unknown", "r_labels"]
PARTIAL = "a_tile long, r_tile long, chunk int, node long, a_n int, r_n int, scores binary, " + ", ".join(f"{c} binary" for c in KEPT)
REDUCED = f"home long, place long, anchor_id long, node long, same {tiles.TOP}, other {tiles.TOP}"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial scores of each pair of tiles over one chunk of dimensions."""
    names = [x.split()[0] for x in PARTIAL.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in PARTIAL.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            row["scores"] = tiles.products(tiles.part(row, "a"), tiles.part(row, "r")).tobytes()
            if row["chunk"]:
                row |= dict.fromkeys(KEPT)
            yield pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds, strict=True)], names)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a + b``; beyond the range of longs, the nearest long."""
    with np.errstate(over="ignore"):
        s = a + b
    over = ((a ^ s) & (b ^ s)) < 0
    s[over] = np.where(a[over] > 0, tiles.MOST, -tiles.MOST)
    return s


def least_of(score: int, percent: int) -> int:
    """The least integer that is ``percent`` percent of ``score`` or more."""
    return -(-percent * int(score) // 100)


def _reduced(batches: Iterator[pa.RecordBatch], positives: int, negatives: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Adds up the partial scores of each pair of tiles, chunk by chunk, and reduces the whole ones.

    Of an anchor's same-label rows in the tile the first ``positives`` are kept.  Of the others those stay that a positive's window can hold:
    positives reach at least what the last of the tile's own ones reaches, a window never holds scores below zero, and of equal
    scores the first ``negatives`` come before the rest wherever they are wanted.
    """
    now, total = {}, None

    def emit() -> pa.RecordBatch:
        n = now["a_n"]
        homes, places, anchors, labels = (tiles.longs(now[f"a_{c}"]) for c in ("homes", "places", "ids", "labels"))
        ids, unknown, of = tiles.longs(now["r_ids"]), np.frombuffer(now["r_unknown"], bool), tiles.longs(now["r_labels"])
        same, other = [], []
        for q in range(n):
            line = total[q]
            alike = of == labels[q]
            if homes[q] == now["r_tile"]:
                alike[places[q]] = False
            own = np.flatnonzero(alike)
            same.append(own[tiles.best(line[own], positives)])
            least = max(0, least_of(line[same[-1][-1]], percent)) if len(own) >= positives else 0
            rest = np.flatnonzero((of != labels[q]) & (line >= least))
            order = rest[np.lexsort((rest, -line[rest]))]
            held = line[order]
            # Places among equal scores: the distance from where the score first stands.
            starts = np.searchsorted(-held, -held, "left")
            other.append(order[np.arange(len(order)) - starts < negatives])
        lists = [tiles.entries(np.concatenate([total[q][p] for q, p in enumerate(x)]), ids[np.concatenate(x)], unknown[np.concatenate(x)], [len(p) for p in x]) for x in (same, other)]
        return pa.RecordBatch.from_arrays([pa.array(homes), pa.array(places), pa.array(anchors), pa.array([now["node"]] * n, pa.int64()), *lists], [x.split()[0] for x in ("home", "place", "anchor_id", "node", "same", "other")])

    for batch in batches:
        for row in batch.to_pylist():
            part = tiles.longs(row["scores"]).reshape(row["a_n"], row["r_n"])
            if now and (row["a_tile"], row["r_tile"]) == (now["a_tile"], now["r_tile"]):
                total = added(total, part)
                continue
            if now:
                yield emit()
            now, total = row, part
    if now:
        yield emit()


def mined(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT, dims: int = DIMS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive the hardest negatives.

    Anchors are the rows whose key is divisible by ``every``; its positives are the first ``positives`` other rows of the same label by
    integer inner product, and a positive's negatives the first ``negatives`` rows of other labels that score at most as high
    and at least ``percent`` percent of it.  Of equal scores the smaller id comes first, null ids last.  Rows with a null label, a null vector or a null or non-finite component
    take no part.  Repeated ids are rows of their own.  Vectors of different lengths are compared as if the shorter one ended in zeros;
    sums beyond the range of longs count as the nearest long.  Other columns are ignored, whatever their names; an empty table, or one label alone, gives no rows.
    """
    work = Scratch(vectors.sparkSession)
    narrow = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").cast("long").alias("label")).where("label is not null")
    pairs, nodes, n = tiles.met(tiles.packed(narrow, every, ROWS, ANCHORS, dims, work))
    partial = pairs.select("a_tile", "r_tile", "chunk", "node", "a_n", "r_n", *[f"{s}_{c}" for s in "ar" for c in ("cells", "kind", "width")], *KEPT).mapInArrow(_partial, PARTIAL)
    met = partial.repartition(n, "a_tile", "r_tile").sortWithinPartitions("a_tile", "r_tile", "chunk")
    reduced = work.store(met.mapInArrow(lambda batches: _reduced(batches, positives, negatives, percent), REDUCED), "reduced")
    work.release("tiles")
    anchor = ["home", "place", "anchor_id"]
    same = tiles.tops(reduced.select(*anchor, "node", F.col("same").alias("top")), anchor, positives, nodes, work, "positives")
    same = work.store(same.select(*anchor, F.posexplode("top").alias("nth", "positive")), "same")
    # A window never holds negative scores: 80 * p <= 100 * p holds for p >= 0 alone.
    score, most = tiles.score(F.col("positive")), F.col("positive.down")
    fits = lambda e: (e["down"] >= most) & (-e["down"] >= F.ceil(score.cast("decimal(20,0)") * percent / 100).cast("long"))
    lists = reduced.select(*anchor, "node", "other").join(same, anchor).withColumn("top", F.slice(F.array_sort(F.filter("other", fits)), 1, negatives)).where(F.size("top") > 0)
    windows = work.store(lists.select(*anchor, "nth", "positive", "node", "top"), "windows")
    work.release("reduced", "same")
    found = tiles.tops(windows, [*anchor, "nth", "positive"], negatives, nodes, work, "negatives")
    found = found.select("anchor_id", "positive", F.posexplode("top").alias("rank", "entry"))
    return found.select("anchor_id", F.col("positive.vec_id").alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("entry.vec_id").alias("negative_id"), score.alias("positive_score"), tiles.score(F.col("entry")).alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of ``embeddings`` whose vec_id is divisible by 100, with one in seven labels shifted. Nulls, ties and repeats as in ``mined``."""
    rows = table(spark, sf_dir, "embeddings")
    return mined(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.own, a.vec_id AS anchor_id, c.own AS other, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.own <> c.own WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.own, p.other ORDER BY n.score DESC, n.vec_id) AS rank
  FROM p JOIN s n ON p.own = n.own AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
) WHERE rank <= 5
"""
