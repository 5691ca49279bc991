"""Vectors as tiles of integers, exact products of tiles, and trees that merge top lists.

A table of vectors is packed once into tiles of bounded size, stored, and from then on every row is known by its tile and
place, so repeated and null ids stay apart.  The rows that ask are packed a second time as tiles of their own.  Asking tiles
meet row tiles on a grid: both are dealt to cells by an equi-join, and each task holds one pair of tiles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.scratch import Scratch

#: Each component x becomes floor(SCALE * x).
SCALE = 256
#: Components of a tile at most (one longer vector is a tile by itself).
CELLS = 1 << 20
#: Tiles of either kind that meet in a cell of the grid, once there are so many.
ASKING, ROWS = 16, 64
#: Lists that a node of a merging tree joins, about.
FAN = 32
MOST = np.iinfo(np.int64).max
#: Below this length of two vectors, products and all their partial sums are below 2**53 and exact as doubles; so for floats and 2**24.
SINGLE, DOUBLE = 1 << 12, 1 << 26

#: Entries of a top list: in their natural order the best comes first, of equal scores the smallest id, and null ids last.
TOP = "array<struct<down: long, unknown: boolean, vec_id: long>>"
TOP_TYPE = pa.list_(pa.struct([("down", pa.int64()), ("unknown", pa.bool_()), ("vec_id", pa.int64())]))
TILES = "asks boolean, tile long, chunk int, n int, ids binary, unknown binary, homes binary, places binary, labels binary, width int, kind string, cells binary"


def integers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, sizes, values) of the rows whose vector is there and all of its components finite, as floors of their multiples."""
    vectors = batch.column("vector")
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fine = (odd[ends] == odd[ends - sizes]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    kept = np.repeat(fine, sizes)
    with np.errstate(over="ignore"):
        values = np.nan_to_num(np.floor(SCALE * flat[kept]))
    return np.flatnonzero(fine), sizes[fine], values


def matrix(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of these sizes, shorter ones filled up with zeros."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def cuts(sizes: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows that make a tile: ``rows`` at most, and ``CELLS`` components once filled up."""
    start, wide = 0, 0
    for i, size in enumerate(sizes.tolist()):
        wider = max(wide, size)
        if i > start and (i - start == rows or wider * (i - start + 1) > CELLS):
            yield start, i
            start, wider = i, size
        wide = wider
    if start < len(sizes):
        yield start, len(sizes)


def packed(vectors: DataFrame, every: int, rows: int, asking: int, dims: int | None, work: Scratch) -> DataFrame:
    """The tiles of ``vectors(vec_id, vector, label)``, stored: those of all rows, and (``asks``) those of the rows whose id is divisible by ``every``.

    Null vectors and ones with a null or non-finite component are left out.  Tiles hold ``rows`` (asking ones ``asking``)
    rows at most and are cut into chunks of ``dims`` dimensions (None: one).  In a tile rows stand by id, null ids last.
    """

    def chunks(asks: bool, tile: int, m: np.ndarray, ids: np.ndarray, unknown: np.ndarray, homes: np.ndarray, places: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        top = np.abs(m).max(initial=0)
        kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
        width = dims or max(1, m.shape[1])
        out = [(asks, tile, c, len(ids), ids.tobytes(), unknown.tobytes(), homes.tobytes(), places.tobytes(), labels.tobytes(), part.shape[1], kind, part.astype(kind).tobytes()) for c in range(max(1, -(-m.shape[1] // width))) for part in [m[:, c * width : (c + 1) * width]]]
        kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int32(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in TILES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made, held, n_held = 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            """The rows that ask so far, as tiles."""
            nonlocal made
            sizes = np.concatenate([h[0] for h in held])
            values = np.concatenate([h[1] for h in held])
            ends = np.cumsum(sizes)
            rest = [np.concatenate([h[k] for h in held]) for k in range(2, 7)]
            for a, b in cuts(sizes, asking):
                yield chunks(True, first + made, matrix(sizes[a:b], values[ends[a] - sizes[a] : ends[b - 1]]), *[x[a:b] for x in rest])
                made += 1

        for batch in batches:
            at, sizes, values = integers(batch)
            column = batch.column("vec_id").take(pa.array(at))
            ids, unknown = pc.fill_null(column, 0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            labels = pc.fill_null(batch.column("label"), 0).to_numpy()[at].astype(np.int64)
            ends = np.cumsum(sizes)
            for a, b in cuts(sizes, rows):
                m = matrix(sizes[a:b], values[ends[a] - sizes[a] : ends[b - 1]])
                order = a + np.lexsort((ids[a:b], unknown[a:b]))
                m, own = m[order - a], np.full(b - a, first + made)
                places = np.arange(b - a)
                yield chunks(False, first + made, m, ids[order], unknown[order], own, places, labels[order])
                made += 1
                asks = np.flatnonzero((ids[order] % every == 0) & ~unknown[order])
                if len(asks):
                    lengths = sizes[order][asks]
                    picked = m[asks]
                    held.append((lengths, picked[np.arange(m.shape[1]) < lengths[:, None]], ids[order][asks], unknown[order][asks], own[asks], places[asks], labels[order][asks]))
                    n_held += len(asks)
                    if n_held >= asking:
                        yield from flush()
                        held, n_held = [], 0
        if held:
            yield from flush()

    return work.store(vectors.select("vec_id", F.col("vector").cast("array<double>"), F.col("label").cast("long")).mapInArrow(run, TILES), "tiles")


def met(tiles: DataFrame) -> tuple[DataFrame, int, int]:
    """Each asking tile beside each row tile, chunk by chunk (columns a_... and r_...), the number of groups of row tiles, and that of partitions.

    Tiles of either kind are dealt into groups by hash; a cell of the grid is a pair of groups, so a tile is sent once for each group of
    the other kind, and what a task holds is a pair of tiles.  ``node`` is the row tile's group.
    """
    conf = tiles.sparkSession.conf
    there = {r.asks: r.n for r in tiles.where("chunk = 0").groupBy("asks").agg(F.count("*").alias("n")).collect()}
    parallel = int(conf.get("spark.sql.shuffle.partitions"))
    asking = -(-there.get(True, 1) // ASKING)
    rows = max(-(-there.get(False, 1) // ROWS), min(4 * there.get(False, 1), -(-parallel // asking)))
    n = max(parallel, asking * rows // 4)
    group = lambda groups: F.pmod(F.xxhash64("tile"), F.lit(groups))
    other = lambda groups: F.explode(F.expr(f"sequence(0L, {groups - 1}L)"))
    names = [c for c in tiles.columns if c not in ("asks", "chunk")]
    a = tiles.where("asks").select("chunk", group(asking).alias("row"), other(rows).alias("node"), *[F.col(c).alias(f"a_{c}") for c in names])
    r = tiles.where("not asks").select("chunk", other(asking).alias("row"), group(rows).alias("node"), *[F.col(c).alias(f"r_{c}") for c in names])
    keys = ["chunk", "row", "node"]
    return a.repartition(n, *keys).hint("merge").join(r.repartition(n, *keys), keys), rows, n


def part(row: dict, side: str) -> np.ndarray:
    """The components of one side of a pair of tiles, as doubles that are integers."""
    return np.frombuffer(row[f"{side}_cells"], row[f"{side}_kind"]).reshape(row[f"{side}_n"], row[f"{side}_width"]).astype(np.float64)


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of ``a`` and ``b``, exact as longs (beyond their range, the nearest long).

    The product of two lengths bounds every partial sum; by it rows go to floats, doubles or whole numbers of any size.
    """
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        of = [np.searchsorted([SINGLE, DOUBLE], np.sqrt((x * x).sum(1)), "right") for x in (a, b)]
    for i in np.unique(of[0]):
        for j in np.unique(of[1]):
            x, y, at = a[of[0] == i], b[of[1] == j], np.ix_(of[0] == i, of[1] == j)
            if max(i, j) == 0:
                out[at] = x.astype(np.float32) @ y.T.astype(np.float32)
            elif max(i, j) == 1:
                out[at] = x @ y.T
            else:
                whole = [np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (x, y)]
                out[at] = np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64) if wide else 0
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The positions of the ``k`` highest scores, the highest first and of equal ones the first position first."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > least)
        at = np.concatenate([at, np.flatnonzero(scores == least)[: k - len(at)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))][:k]


def entries(scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray, sizes: np.ndarray | list[int]) -> pa.Array:
    """Top lists of these sizes, as an Arrow column."""
    values = pa.StructArray.from_arrays([pa.array(-scores), pa.array(unknown), pa.array(ids, mask=unknown)], fields=list(TOP_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values, type=TOP_TYPE)


def tops(lists: DataFrame, keys: list[str], k: int, nodes: int, work: Scratch, name: str) -> DataFrame:
    """``lists(node, top, keys...)`` merged to the first ``k`` entries for each key, level by level: a node joins the lists of ``FAN`` nodes below it."""
    level = 0
    while True:
        nodes = -(-nodes // FAN)
        joined = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        lists = lists.groupBy(*keys, F.expr(f"node div {FAN}").alias("node")).agg(joined.alias("top"))
        level += 1
        if nodes <= 1:
            return lists.drop("node")
        lists = work.store(lists, f"{name}{level}")


def score(entry: Column) -> Column:
    return -entry["down"]
