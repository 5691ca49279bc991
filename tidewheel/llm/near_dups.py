"""Near-duplicate documents by an LSH forest of MinHash signatures.

The signature of a document's set of word shingles is read in several
orders, the trees.  In each, documents are sorted by their signature values; those that share
a prefix form a region, and those that share the longest prefix are neighbours.  Small regions are
compared at the shortest depth, larger ones deeper.  Every link is confirmed
on the full sets, and components come from distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm import text as tx
from tidewheel.llm.components import connected_components
from tidewheel.llm.scratch import Scratch
from tidewheel.llm.similarity import far_pairs
from tidewheel.llm.tables import Aside, table

#: Words of a shingle and the least similarity in percent.
SHINGLE, PERCENT = 2, 80
#: Trees, and signature values of a region's prefix; half of those that a tree is sorted by. A pair of similarity 0.8
#: shares no region with a probability of (1 - 0.8**4)**24, three in a million.
TREES, DEPTH = 24, 4
#: Regions of up to so many documents are compared with their first document; larger ones with the first at each greater depth.
REGION = 32

_rng = np.random.default_rng(9)
_A = _rng.integers(1, 2**62, 512, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**62, 512, dtype=np.int64).astype(np.uint64)


def shingle_sets(texts: list[bytes], words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct sorted shingle hashes of all texts, number of them for each text).

    Fewer words than a shingle make one shingle of them all; no words, none.
    """
    doc, code, _, _ = tx.words(texts, tx.NOT_BLANK)
    n = np.bincount(doc, minlength=len(texts))
    if not len(code):
        return np.zeros(0, np.uint64), n
    first = np.cumsum(n) - n
    size = np.minimum(n, words)[doc]
    starts = np.flatnonzero(np.arange(len(code)) - first[doc] + size <= n[doc])
    h, size = np.zeros(len(starts), np.uint64), size[starts]
    for k in range(words):
        more = size > k
        h[more] = tx.mix(h[more] * _A[511] + code[starts[more] + k])
    owner = doc[starts]
    at = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))


def _packed(values: np.ndarray) -> np.ndarray:
    """The leading 16 bits of four values each, in order, as one sortable number."""
    h = np.zeros(len(values), np.uint64)
    for k in range(values.shape[1]):
        h = h << np.uint64(16) | values[:, k] >> np.uint64(48)
    return h


def _signatures(trees: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, rows = tx.texts_of(batch.column("text")), batch.column("id"), batch.column("row")
            for a, b in tx.groups(texts):
                sets, n = shingle_sets(texts[a:b], words)
                full = np.flatnonzero(n)
                at = (np.cumsum(n) - n)[full]
                d1, d2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                prefix, deeper = np.zeros((b - a, trees), np.uint64), np.zeros((b - a, trees), np.uint64)
                if len(full):
                    d1[full], d2[full] = np.add.reduceat(tx.mix(sets), at), np.add.reduceat(tx.mix(sets ^ _B[511]), at)
                    sig = np.stack([np.minimum.reduceat((sets ^ _B[k]) * _A[k], at) for k in range(trees * DEPTH)], axis=1)
                    sig = tx.mix(sig)  # minima are small numbers: their leading bits say little until they are mixed
                    for t in range(trees):
                        order = (np.arange(2 * DEPTH) + t * DEPTH) % (trees * DEPTH)
                        prefix[full, t], deeper[full, t] = _packed(sig[:, order[:DEPTH]]), _packed(sig[:, order[DEPTH:]])
                lists = [pa.ListArray.from_arrays(np.arange(0, (b - a + 1) * trees, trees, dtype=np.int32), tx.signed(x.ravel())) for x in (prefix, deeper)]
                cols = [ids.slice(a, b - a), rows.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(tx.signed(d1)), pa.array(tx.signed(d2)), *lists]
                yield pa.RecordBatch.from_arrays(cols, ["id", "row", "n", "d1", "d2", "prefix", "deeper"])

    return run


def forest_pairs(batches: Iterator[pa.RecordBatch], region: int = REGION) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of a sorted part of the forest: rows (tree, prefix, deeper, m, cls).

    Each document is paired with its neighbour, with whom it shares the longest prefix, and
    with the first document of its region: at the shortest depth if the region (of m documents) is small,
    else at each greater depth.  A region that a part's end cuts has a first document on either side.
    """
    last = None  # the row before, and the first document of its run at each depth
    leads = np.zeros(DEPTH + 1, np.int64)
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        tree, prefix, deeper, m, cls = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "prefix", "deeper", "m", "cls"))
        before = (np.append(x[:1] if last is None else v, x[:-1]) for x, v in zip((tree, prefix, deeper, cls), last or (0, 0, 0, 0)))
        tree0, prefix0, deeper0, cls0 = before
        same = (tree == tree0) & (prefix == prefix0)
        same[0] &= last is not None
        off = (deeper ^ deeper0).view(np.uint64)
        # A run at depth DEPTH + k goes on while the k leading deeper values agree too.
        goes_on = [same & ((off >> np.uint64(64 - 16 * k)) == 0 if k else True) for k in range(DEPTH + 1)]
        first = []
        for k, on in enumerate(goes_on):
            start = np.maximum.accumulate(np.where(on, -1, np.arange(size)))
            first.append(np.where(start < 0, leads[k], cls[np.maximum(start, 0)]))
        small = m <= region
        pick = [np.where(small, first[0], first[1]), *first[2:], np.where(same, cls0, cls)]
        keep = [pick[0] != cls, *[~small & (p != cls) for p in pick[1:-1]], same]
        pairs = np.concatenate([np.stack([p[k], cls[k]], 1) for p, k in zip(pick, keep, strict=True)])
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        for i in range(0, len(pairs), 1 << 16):
            part = pairs[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[:, 0])), pa.array(np.ascontiguousarray(part[:, 1]))], ["a", "b"])
        last = (tree[-1], prefix[-1], deeper[-1], cls[-1])
        leads = np.array([f[-1] for f in first], np.int64)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = tx.texts_of(batch.column("text")), batch.column("cls")
            for a, b in tx.groups(texts):
                sets, n = shingle_sets(texts[a:b], words)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(ends, tx.signed(sets))], ["cls", "s"])

    return run


def _found(docs: DataFrame, words: int, percent: int, trees: int, key: str, text: str) -> DataFrame:
    """(id, row, n, least, lead) for each row: row is the text's hash, least the least id of its component, lead its first (id, row)."""
    spark = docs.sparkSession
    work = Scratch(spark)
    at_key, at_text = docs.columns.index(key), docs.columns.index(text)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(F.col(f"c{at_key}").alias("id"), F.col(f"c{at_text}").alias("text"))
    kind = rows.schema["id"].dataType
    rows = rows.withColumn("row", F.xxhash64("text"))
    long, many = T.LongType(), T.ArrayType(T.LongType())
    field = lambda name, of: T.StructField(name, of)
    schema = T.StructType([field("id", kind), field("row", long), field("n", long), field("d1", long), field("d2", long), field("prefix", many), field("deeper", many)])
    signed = work.store(rows.mapInArrow(_signatures(trees, words), schema), "signatures")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    # Equal sets are one class, with a number of its own; ids can be of any kind, null or repeated.
    equal = signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(first).alias("first"), F.first("prefix").alias("prefix"), F.first("deeper").alias("deeper"))
    classes = work.store(equal.withColumn("cls", F.monotonically_increasing_id()), "classes")
    placed = classes.select("cls", "n", F.posexplode(F.arrays_zip("prefix", "deeper")).alias("tree", "x")).select("cls", "n", F.col("tree").cast("byte").alias("tree"), "x.prefix", "x.deeper")
    regions = placed.groupBy("tree", "prefix").agg(F.count("*").alias("m")).where("m > 1")
    # Sums that are joined back are stored first: then Spark can split a hot region among tasks.
    placed = work.store(placed.join(work.store(regions, "regions"), ["tree", "prefix"]), "placed")
    sorted_ = placed.repartitionByRange("tree", "prefix", "deeper", "cls").sortWithinPartitions("tree", "prefix", "deeper", "cls")
    pairs = work.store(sorted_.select("tree", "prefix", "deeper", "m", "cls").mapInArrow(forest_pairs, "a long, b long").distinct(), "pairs")
    wanted = work.store(placed.select("cls").distinct().join(classes.select("cls", "first.id", "first.row"), "cls"), "wanted")
    wanted = wanted.select("cls", F.col("id").alias("_id"), F.col("row").alias("_row"))
    # Texts are dealt out at any size, as they are at the sizes that matter.
    texts = rows.join(wanted.hint("merge"), (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))).select("cls", "text")
    sets = work.store(texts.mapInArrow(_sets(words), T.StructType([field("cls", long), field("s", many)])), "sets")
    if sets.groupBy("cls").count().where("count > 1").limit(1).count():  # rows that share id and text
        sets = work.store(sets.dropDuplicates(["cls"]), "sets_once")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
        same, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
        # The sizes alone rule out many; they are looked at first.
        both = both.where(100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
        return both.select("a", "b", same.alias("same"), total.alias("total")).where(100 * F.col("same") >= percent * (F.col("total") - F.col("same"))).select("a", "b")

    edges = work.store(linked(pairs), "edges")
    roots = work.store(connected_components(edges), "roots")
    # What is left of regions that still hold several components is compared exactly:
    # two sets of the wanted similarity share a shingle among the rarest of each.
    at = placed.select("tree", "prefix", "cls", "n").join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = work.store(at.groupBy("tree", "prefix").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tree", "prefix"), "several")
    left = work.store(at.join(several, ["tree", "prefix"], "left_semi").select("cls", "n", "root").distinct(), "left")
    work.release("placed", "regions", "several", "wanted")
    far = far_pairs(work.store(left.join(sets, "cls").withColumnRenamed("cls", "id"), "open_sets"), percent, work)
    far = far.where(100 * F.least("n", "on") >= percent * F.greatest("n", "on"))
    far = far.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
    more = work.store(linked(work.store(far.join(pairs, ["a", "b"], "left_anti"), "more")), "more_edges")
    if more.limit(1).count():
        roots = work.store(connected_components(edges.unionByName(more)), "all_roots")
    work.release("sets", "sets_once", "open_sets", "rare", "pairs", "more", "left", "edges")
    named = classes.select("d1", "d2", "n", "cls", "first").join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = work.store(named, "named")
    leads = work.store(named.groupBy("root").agg(F.min("first").alias("lead")), "leads")
    named = work.store(named.join(leads, "root").select("d1", "d2", "n", "lead"), "leads_of")
    work.release("classes", "named", "leads", "roots", "all_roots", "more_edges")
    return signed.select("id", "row", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left").select("id", "row", "n", F.col("lead.id").alias("least"), "lead")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    Texts with equal sets are one class, grouped before anything else, so
    copies are never expanded.  Then, on one representative of each class:
    each tree's documents are sorted by their signature and compared with their neighbours and with the first
    of their region.  What is left of regions that still have several components is compared exactly,
    whatever the regions' sizes: all documents there of different components
    that share one of their rarest shingles.  Pairs of one component are not looked at again.

    Null and empty texts have an empty set and link to nothing.  Rows that
    share an id but not the text are linked by their texts alone; rows that share both, like any copies.  Rows without an id link
    others but never lead a component unless it has no other.  Ids can be of any kind that sorts.  Texts of
    any length count whole, other columns are ignored, and an empty table stays empty.
    """
    found = _found(docs, words, percent, trees, key, text)
    component = F.coalesce("least", "id")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with its own columns: that of the least id (null last) and then text hash.

    Documents without a set (null, empty or blank texts) each stay; rows that share id and text stay once.  Two different texts
    of one id are told apart.
    """
    work = Scratch(docs.sparkSession)
    found = _found(docs, words, percent, trees, key, text)
    leads = found.where("lead is null or (row = lead.row and id <=> lead.id)").groupBy("id", "row").agg(F.count("*").alias("rows"))
    leads = work.store(leads.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "rows"), "kept")
    held = Aside(docs)
    out = held.df.withColumn("_at", F.xxhash64(held.of(text)))
    out = out.join(leads.drop("rows"), (F.col("_at") == F.col("_row")) & F.col(held.of(key)).eqNullSafe(F.col("_id")), "left_semi")
    if leads.where("rows > 1").limit(1).count():  # rows that share id and text
        out = out.dropDuplicates([held.of(key), "_at"])
    return held.back(out)


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every row of ``documents``. Nulls, ties and repeats as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 1], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n) GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 180 * count(*) >= 80 * (na.n + nb.n)
), l AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), c(id, seen) AS (
  SELECT a, b FROM l UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.seen
), m AS (
  SELECT id, min(seen) AS root FROM c GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(m.root, d.doc_id), d.doc_id) AS component_id, coalesce(least(m.root, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""
