"""Benchmark decontamination with suffix arrays over the training words.

Each task sorts the suffixes of its documents (a shard of a few MB at a time)
and looks up every test suffix by binary search.  The test set is what is
sent to the tasks: whole up to a checked size, in which case documents are never shuffled, and beyond it block after block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm import text as tx
from tidewheel.llm.scratch import Scratch
from tidewheel.llm.tables import Aside, table

#: Words of a window.
WINDOW = 10
#: Bytes of test texts that a task holds at once, with an index of some twenty times as many; a larger test set is searched in blocks.
BLOCK_BYTES = 4 << 20
MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))]


class TestSuffixes:
    """The sorted vocabulary and the window of every test suffix of a block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.names = window, [i for i, _ in items]
        owner, code, _, _ = tx.words([t for _, t in items], tx.ALNUM)
        self.vocabulary = np.unique(code)
        ids = np.searchsorted(self.vocabulary, code).astype(np.int64) + 1
        n = np.bincount(owner, minlength=len(items))
        first = np.cumsum(n) - n
        at = np.arange(len(code)) - first[owner]
        self.size = np.minimum(n, window)[owner]  # words of the window that starts here
        starts = np.flatnonzero(at + self.size <= n[owner])
        self.item, self.word, self.size = owner[starts], at[starts], self.size[starts]
        grid = ids[np.minimum(starts[:, None] + np.arange(window), len(ids) - 1)] if len(ids) else np.zeros((0, window), np.int64)
        inside = np.arange(window) < self.size[:, None]
        self.low = keys_of(np.where(inside, grid, 0))
        self.high = keys_of(np.where(inside, grid, 0xFFFFFFFF))
        v = np.int64(len(self.vocabulary) + 1)
        pair = lambda k: np.unique(grid[self.size > k + 1, k] * v + grid[self.size > k + 1, k + 1])
        self.single = np.unique(grid[self.size == 1, 0])
        self.shortest = int(self.size[self.size > 1].min()) if (self.size > 1).any() else 0
        #: The word pairs at each even place that all windows of two words or more reach.
        self.pairs = [pair(k) for k in range(0, self.shortest - 1, 2)]


def keys_of(ids: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings that sort like the rows."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").ravel() if len(ids) else np.zeros(0, f"S{4 * max(1, ids.shape[1])}")


def _isin(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def search(texts: list[bytes], test: TestSuffixes) -> tuple[np.ndarray, list[list[dict]]]:
    """(words of each text, its maximal verbatim matches) for one shard of texts."""
    w = test.window
    doc, code, _, _ = tx.words(texts, tx.ALNUM)
    n = np.bincount(doc, minlength=len(texts))
    found: list[list[dict]] = [[] for _ in texts]
    if not len(code) or not len(test.vocabulary):
        return n, found
    at = np.minimum(np.searchsorted(test.vocabulary, code), len(test.vocabulary) - 1)
    ids = np.where(test.vocabulary[at] == code, at + 1, 0).astype(np.int64)
    padded, owner = np.append(ids, np.zeros(w, np.int64)), np.append(doc, np.full(w, -1))
    # Suffixes that can start a window: their leading words occur so in some test suffix.
    may = np.flatnonzero(ids > 0)
    v = np.int64(len(test.vocabulary) + 1)
    chosen = may[_isin(ids[may], test.single)] if len(test.single) else may[:0]
    if test.shortest:
        for k, known in enumerate(test.pairs):
            may = may[owner[may + 2 * k + 1] == doc[may]]
            may = may[_isin(padded[may + 2 * k] * v + padded[may + 2 * k + 1], known)]
        chosen = np.union1d(chosen, may)
    if not len(chosen):
        return n, found
    grid = chosen[:, None] + np.arange(w)
    keys = keys_of(np.where(owner[grid] == doc[chosen][:, None], padded[grid], 0))
    order = np.argsort(keys, kind="stable")
    suffixes, keys = chosen[order], keys[order]
    low, high = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.high, "right")
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    if not len(which):
        return n, found
    place = suffixes[np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
    # Neighbouring windows on one diagonal make one longest match.
    item, word = test.item[which], test.word[which]
    order = np.lexsort((place, place - word, item))
    item, word, place, size = item[order], word[order], place[order], test.size[which][order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (word[1:] != word[:-1] + 1) | (doc[place[1:]] != doc[place[:-1]])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(new)) - 1
    first = np.cumsum(n) - n
    for h, t in zip(head.tolist(), last.tolist(), strict=True):
        d = int(doc[place[h]])
        found[d].append({"item_id": test.names[item[h]], "item_word": int(word[h]), "doc_word": int(place[h] - first[d]), "n_words": int(place[t] + size[t] - place[h])})
    return n, found


def covered(matches: list[dict]) -> int:
    """Words inside any match."""
    total, end = 0, 0
    for a, b in sorted((m["doc_word"], m["doc_word"] + m["n_words"]) for m in matches):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def scanned(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit and matches (item_id, item_word, doc_word, n_words).

    Words are runs of ASCII letters (A-Z lower-cased), digits and all that is
    not ASCII.  Test items of fewer than ``window`` words are one window;
    items without words, null texts among them, match nothing, nor do null or empty documents.
    Texts of any length are searched whole.  Repeated items count once by item_id, repeated documents each.  Columns of the three names are
    replaced, others may have any name.  Empty tables on either side give no matches.
    """
    spark = docs.sparkSession
    held = Aside(docs, ("n_words", "n_hit", "matches"))
    at = held.of(text)
    items = items.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    test = lambda part: spark.sparkContext.broadcast(TestSuffixes([(r[0], r[1].encode()) for r in part.sort("item_id", "text").toLocalIterator()], window))
    none = F.array().cast(T.ArrayType(MATCH))
    schema = T.StructType([*held.df.schema.fields, *ADDED])
    if blocks == 1:
        out, last = held.df.withColumn("matches", none), test(items)
    else:
        out, last = held.df.withColumn("matches", none), test(items.limit(0))
        found = _in_blocks(held.df.select(F.col(at).alias("text")), items, blocks, test)
        one, two = F.xxhash64(at), F.xxhash64(F.lit(1), F.col(at))
        out = held.df.join(found, (one == F.col("_one")) & (two == F.col("_two")), "left").withColumn("matches", F.coalesce("_found", none)).drop("_one", "_two", "_found")
    zero = F.lit(0).cast("long")
    out = out.select(*held.df.columns, zero.alias("n_words"), zero.alias("n_hit"), "matches").mapInArrow(_scanner(last, at), schema)
    return held.back(out, "n_words", "n_hit", "matches")


def _in_blocks(texts: DataFrame, items: DataFrame, blocks: int, test) -> DataFrame:
    """(_one, _two, _found): the matches of each different text that has any, by two hashes of it.

    One block of the test set is sent out at a time, its matches are stored, and it is taken back before the next: driver and
    tasks hold one block whatever the size of the test set.
    """
    work = Scratch(texts.sparkSession)
    zero = F.lit(0).cast("long")
    rows = texts.where("text is not null").select("text", zero.alias("n_words"), zero.alias("n_hit"), F.array().cast(T.ArrayType(MATCH)).alias("matches"))
    found = None
    for b in range(blocks):
        sent = test(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b))
        hits = rows.mapInArrow(_scanner(sent, "text"), T.StructType([T.StructField("text", T.StringType()), *ADDED])).where("n_hit > 0")
        hits = work.store(hits.select(F.xxhash64("text").alias("_one"), F.xxhash64(F.lit(1), F.col("text")).alias("_two"), "matches"), f"block{b}")
        sent.destroy()
        once = hits.groupBy("_one", "_two").agg(F.first("matches").alias("matches"))
        found = once if found is None else found.unionByName(once)
    found = work.store(found.groupBy("_one", "_two").agg(F.flatten(F.collect_list("matches")).alias("_found")), "matches")
    work.release(*[f"block{b}" for b in range(blocks)])
    return found


def _scanner(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value
        for batch in batches:
            texts = tx.texts_of(batch.column(text))
            counts, hits, matches = [], [], []
            before = batch.column("matches").to_pylist()
            for a, b in tx.groups(texts):
                n, found = search(texts[a:b], test)
                counts += n.tolist()
                found = [(x or []) + y for x, y in zip(before[a:b], found, strict=True)]
                hits += [covered(m) for m in found]
                matches += found
            keep = [i for i, name in enumerate(batch.schema.names) if name not in ("n_words", "n_hit", "matches")]
            kind = batch.schema.field("matches").type
            cols = [batch.column(i) for i in keep] + [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(matches, kind)]
            yield pa.RecordBatch.from_arrays(cols, [batch.schema.names[i] for i in keep] + ["n_words", "n_hit", "matches"])

    return run


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents without any window of a test item, with all their own columns, whatever the names."""
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(how.pop('text', 'text'))}"
    return scanned(numbered, items, text=text, **how).where("n_hit = 0").drop("n_words", "n_hit", "matches").toDF(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each row of ``documents`` shares with ``benchmark``. Nulls, ties and repeats as in ``scanned``."""
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), o AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)
), h AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM o) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
