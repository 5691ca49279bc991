"""Exact substring dedup: every byte covered by a 200-byte string that starts twice is removed.

1. Each text is cut into spans around content-chosen anchors (the least hash
   of the 64-byte strings in every 200-byte window), so that two equal windows lie at the same
   place of spans with the same anchor hash.  Only hashes are shuffled here, about one in seventy bytes.
2. Spans whose anchor occurs once hold no repeat.  Equal spans are grouped
   before anything is sent; the different spans of one anchor go, as text, to a shard.
3. A shard sorts its suffixes by Larsson-Sadakane refinement, takes common
   prefixes after Kasai, and reads off the windows that start twice.
4. An anchor with very many spans is dealt to several shards; their sorted
   window arrays are merged by binary search in each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import text as tx
from tidewheel.llm.scratch import Scratch
from tidewheel.llm.tables import table

#: Bytes of a repeated string, and of the strings among which anchors are chosen.
LENGTH, GRAM = 200, 64
#: Bytes of spans in a shard, and spans of one anchor that a shard takes at most.
SHARD_BYTES, SHARD_SPANS = 2 << 20, 4096
#: Texts are hashed in groups of so many bytes.
HASH_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """64-bit hashes of any substrings of a buffer, from prefix sums."""

    def __init__(self, buf: np.ndarray, cache: dict):
        n = len(buf) + 1
        if cache.get("n", 0) < n:
            cache["n"] = max(n, HASH_BYTES * 2)
            cache["p"], cache["q"] = _powers(_P, cache["n"]), _powers(_PINV, cache["n"])
        self.q = cache["q"]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(tx.BYTE_CODE[buf] * cache["p"][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tx.mix((self.sums[end] - self.sums[start]) * self.q[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        return tx.mix((self.sums[k:] - self.sums[:-k]) * self.q[: len(self.sums) - k])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def spans(texts: list[bytes], length: int, gram: int, cache: dict) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, span hash, first window, windows) of all spans of the texts.

    A span is a run of window starts with one anchor; it reaches ``length - 1`` bytes beyond its last start.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(n)
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    hasher = Hasher(buf, cache)
    hashes = hasher.grams(gram)
    bits = max(1, int(len(buf)).bit_length())
    place = np.arange(len(hashes), dtype=np.uint64)
    least = window_min((hashes >> np.uint64(bits) << np.uint64(bits)) | place, length - gram + 1)
    anchor = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    starts = np.arange(len(anchor))
    doc = np.searchsorted(ends, starts, "right")
    valid = starts + length <= ends[doc]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1
    shift = (anchor[head] - head).astype(np.uint64)
    code = tx.mix(hasher.of(head, stop + length - 1) + shift * np.uint64(0xD1B54A32D192ED03))
    return doc[head], hashes[anchor[head]], code, head - (ends - n)[doc[head]], stop - head


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``codes`` (bytes) sorted by their first ``depth`` bytes at least.

    Larsson and Sadakane: suffixes are sorted by their first bytes and
    then, only within groups that are still equal, by the group of the suffix
    as many places on, which doubles the sorted depth each time.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    wide = np.append(codes.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64))
    for k in range(7):  # 9 bits a byte: 0 is the end of the text
        key = (key << np.uint64(9)) | wide[k : k + n]
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)
    h = 7
    stop = np.append(np.flatnonzero(new)[1:], n)
    group = np.repeat(stop - 1, np.diff(np.append(np.flatnonzero(new), n)))  # a group's number is its last place
    rank[sa] = group
    while h < depth:
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            break
        s = sa[open_]
        at = s + h
        key = rank[s] * (n + 1) + np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[open_] = s
        fresh = np.ones(len(s), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[open_] = fresh
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(s)))
        rank[s] = np.repeat(open_[first + size - 1], size)
        h *= 2
    return sa


def common_prefixes(codes: np.ndarray, sa: np.ndarray, most: int, stride: int = 32) -> np.ndarray:
    """Bytes that each suffix shares with its predecessor in ``sa``, counted up to ``most``.

    Kasai: going through the text, the shared length drops by one at most; ``sa`` must be in full order for that.
    Every ``stride``-th place starts anew and all strides advance together.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int64)
    padded = np.append(codes, np.zeros(8, codes.dtype)).astype(np.uint8)
    word = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1)) if n else padded[:0]
    last = np.zeros(-(-n // stride), np.int64)
    for k in range(stride):
        i = np.arange(k, n, stride)
        have = np.maximum(last[: len(i)] - 1, 0)
        j = before[i]
        have[j < 0] = 0
        live = np.flatnonzero(j >= 0)
        while len(live):
            a, b = i[live] + have[live], j[live] + have[live]
            room = np.minimum(n - np.maximum(a, b), most - have[live])
            same = (word[np.minimum(a, n)] == word[np.minimum(b, n)]).astype(np.uint8)
            run = np.minimum(np.where(same.all(1), 8, same.argmin(1)), np.maximum(room, 0))
            have[live] += run
            live = live[(run == 8) & (room > 8)]
        shared[i] = have
        last[: len(i)] = have
    return shared[sa]


def repeated_windows(texts: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each span, which of its windows start elsewhere in the shard too, and each window's class.

    The classes number the different windows of the shard in sorted order.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(n)
    sa = suffix_array(buf, len(buf))  # in full order, as common_prefixes carries lengths from one suffix to the next
    same = common_prefixes(buf, sa, length) >= length
    cls = np.empty(len(buf), np.int64)
    cls[sa] = np.cumsum(~same)
    starts = np.arange(len(buf))
    window = starts + length <= ends[np.searchsorted(ends, starts, "right")]
    count = np.bincount(cls[window], minlength=len(buf) + 2)
    twice = count[cls] > 1
    at = [(e - k, e - length + 1) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
    return [twice[a:b] for a, b in at], [cls[a:b] for a, b in at]


def merged(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted runs of different values, which values of each run occur in another: binary search in the merged order."""
    whole = np.sort(np.concatenate(runs)) if runs else np.zeros(0)
    return [np.searchsorted(whole, r, "right") - np.searchsorted(whole, r, "left") > 1 for r in runs]


def find_spans(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans of a table (id, row, text): id, row, anchor, span, first, windows."""
    names = ["id", "row", "anchor", "span", "first", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            texts = tx.texts_of(batch.column("text"))
            for a, b in tx.groups(texts, HASH_BYTES):
                doc, *rest = spans(texts[a:b], length, gram, cache)
                for k in range(0, len(doc), 1 << 16):
                    at, (h, code, first, windows) = pa.array(doc[k : k + (1 << 16)] + a), [x[k : k + (1 << 16)] for x in rest]
                    cols = [batch.column("id").take(at), batch.column("row").take(at), tx.signed(h), tx.signed(code), first.astype(np.int32), windows.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in cols], names)

    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"id {kind}, row long, anchor long, span long, first int, windows int")


def cut_spans(wanted: DataFrame, length: int) -> DataFrame:
    """Texts of spans: from (text, at array<struct>) one row for each span."""
    names = ["anchor", "span", "shard", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, got in zip(tx.texts_of(batch.column("text")), batch.column("at").to_pylist(), strict=True):
                cols = [pa.array([x[k] for x in got]) for k in names]
                cols.append(pa.array([data[x["first"] : x["first"] + x["windows"] + length - 1] for x in got], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [*names, "bytes"])

    return wanted.mapInArrow(run, "anchor long, span long, shard long, hot boolean, bytes binary")


def runs_of(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true values, in turn."""
    return np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).tolist()


SHARD = "anchor long, span long, runs array<int>, shard long, digest long, place int"


def _shard(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """One shard. It is cut between anchors where it came out larger than meant."""
        group = group.sort_values(["anchor", "span"], kind="stable")
        anchor, code, hot, shard = (group[c].tolist() for c in ("anchor", "span", "hot", "shard"))
        texts = group["bytes"].tolist()
        rows: list[tuple] = []
        cache: dict = {}
        start, held = 0, 0
        for k in range(1, len(texts) + 1):
            held += len(texts[k - 1])
            if k < len(texts) and (anchor[k] == anchor[k - 1] or held < SHARD_BYTES):
                continue
            twice, classes = repeated_windows(texts[start:k], length)
            sent: set[int] = set()
            for i in range(start, k):
                hit = twice[i - start]
                rows.append((anchor[i], code[i], runs_of(hit), shard[i], None, None))
                if hot[i]:  # other shards hold spans of this anchor: each different window goes to the merge once
                    keep = []
                    for p, c in enumerate(classes[i - start].tolist()):
                        if c not in sent:
                            keep.append(p)
                            sent.add(c)
                    at = np.array(keep, np.int64)
                    digest = tx.signed(Hasher(np.frombuffer(texts[i], np.uint8), cache).of(at, at + length))
                    rows += [(anchor[i], code[i], None, shard[i], d, p) for d, p in zip(digest.tolist(), keep, strict=True)]
            start, held = k, 0
        return pd.DataFrame(rows, columns=["anchor", "span", "runs", "shard", "digest", "place"]).astype({"digest": "Int64", "place": "Int32"})

    return run


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Windows of one digest range that occur in several shards."""
    group = group.sort_values(["shard", "digest"], kind="stable")
    digest, shard = group["digest"].to_numpy(np.int64), group["shard"].to_numpy(np.int64)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    hit = np.concatenate(merged(np.split(digest, cuts)))
    out = group[hit]
    return pd.DataFrame({"anchor": out["anchor"], "span": out["span"], "runs": [[p, p + 1] for p in out["place"].tolist()]})


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tx.texts_of(batch.column("text"))
            for first, last in tx.groups(texts):
                spans_, kept = [], []
                for data, hits in zip(texts[first:last], batch.column("hits").slice(first, last - first).to_pylist(), strict=True):
                    at = sorted((x["first"] + r[k], x["first"] + r[k + 1] - 1 + length) for x in hits for r in [x["runs"]] for k in range(0, len(r), 2))
                    cut: list[dict] = []
                    for a, b in at:
                        if cut and a <= cut[-1]["end"]:
                            cut[-1]["end"] = max(cut[-1]["end"], b)
                        else:
                            cut.append({"start": a, "end": b})
                    ends = [0, *[c["end"] for c in cut]]
                    kept.append(b"".join(data[e:s] for e, s in zip(ends, [*[c["start"] for c in cut], len(data)], strict=True)))
                    spans_.append(cut)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                own = [batch.column(c).slice(first, last - first) for c in ("id", "row")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(spans_, kind), pa.array(kept, pa.binary())], ["id", "row", "removed", "kept"])

    return run


def _with(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joins on the document's id, which may be null, and row hash."""
    right = right.withColumnsRenamed({"id": "_id", "row": "_row"})
    return left.join(right, (left["row"] == right["_row"]) & left["id"].eqNullSafe(right["_id"]), how).drop("_id", "_row")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_spans: int = SHARD_SPANS) -> DataFrame:
    """(id, row, removed, kept) of the documents that hold repeated strings.

    ``removed`` are the maximal byte ranges covered by a string of ``length``
    bytes that starts anywhere else too, ``kept`` the bytes that are left;
    ``row`` is the hash of the text.  Null and empty texts, and those
    shorter than ``length``, hold none.  Rows with equal id and text count as
    separate copies of each other (all of it goes), and are returned once.
    Texts of any length are taken whole.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    work = Scratch(spark)
    keyed = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("text")).where(F.octet_length("text") >= length)
    found = work.store(find_spans(keyed, length, gram), "spans")
    # Sums that are joined back are stored first: then Spark can split the spans of a hot anchor among tasks.
    often = work.store(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    shared = work.store(found.join(often.hint("merge"), "anchor", "left_semi"), "shared")
    work.release("spans", "often")
    first = [F.first(c).alias(c) for c in ("id", "row", "first", "windows")]
    classes = work.store(shared.groupBy("anchor", "span").agg(F.count("*").alias("m"), *first), "classes")
    groups = classes.groupBy("anchor").agg(F.count("*").alias("c"), F.sum(F.col("windows") + length).alias("bytes")).where("c > 1")
    groups = work.store(groups, "groups")
    shards = max(1, -(-(groups.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    parts = F.ceil(F.col("c") / F.lit(shard_spans))
    opened = classes.join(groups, "anchor").withColumn("hot", F.col("c") > shard_spans)
    shard = F.when(F.col("hot"), F.xxhash64("anchor", F.pmod("span", parts))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    opened = opened.withColumn("shard", shard)
    at = F.collect_list(F.struct("anchor", "span", "shard", "hot", "first", "windows")).alias("at")
    # Texts are dealt out twice, to have spans cut and to have repeats removed; rows that share id and text are one.
    once = keyed
    if keyed.groupBy("id", "row").agg(F.count("*").alias("m")).where("m > 1").limit(1).count():
        once = work.store(keyed.groupBy("id", "row").agg(F.first("text").alias("text")), "held")
    cut = cut_spans(_with(once, work.store(opened.groupBy("id", "row").agg(at), "cuts").hint("merge"), "inner").select("text", "at"), length)
    judged = work.store(cut.groupBy("shard").applyInPandas(_shard(length), SHARD), "judged")
    hits = judged.where("size(runs) > 0").select("anchor", "span", "runs")
    windows = judged.where("digest is not null")
    buckets = -(-windows.count() // (1 << 19))
    if buckets:
        across = windows.groupBy(F.pmod("digest", F.lit(buckets)).alias("bucket")).applyInPandas(_merge, "anchor long, span long, runs array<int>")
        hits = hits.unionByName(across)
    hits = hits.groupBy("anchor", "span").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    alike = classes.where("m > 1").select("anchor", "span", F.array(F.lit(0), F.col("windows")).alias("runs"))
    hits = hits.join(classes.where("m = 1").select("anchor", "span"), ["anchor", "span"], "left_semi").unionByName(alike)
    hits = work.store(hits, "hits")
    work.release("classes", "groups", "judged", "cuts")
    rows = shared.join(hits, ["anchor", "span"]).groupBy("id", "row").agg(F.collect_set(F.struct("first", "runs")).alias("hits")).hint("merge")
    kind = docs.schema[key].dataType.simpleString()
    return _with(once, rows, "inner").mapInArrow(_removed(length), f"id {kind}, row long, removed array<struct<start:int,end:int>>, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every row of ``documents``, by doc_id and text. Nulls, ties and repeats as in ``repeats``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bytes_ = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    all_ = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"), F.octet_length(bytes_).cast("long").alias("n_bytes"), F.sha2(bytes_, 256).alias("whole"))
    cut = repeats(docs).select("id", "row", F.size("removed").cast("long").alias("n"), F.octet_length("kept").cast("long").alias("left"), F.sha2("kept", 256).alias("sha"))
    both = _with(all_, cut, "left")
    return both.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.coalesce("left", "n_bytes")).alias("n_removed"), F.coalesce("n", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, h, unnest(range(1, n - {LENGTH} + 2)) AS i FROM d WHERE n >= {LENGTH})
), r AS (
  SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), g AS (
  SELECT doc_id, i, (i - lag(i, 1, -{LENGTH}) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH})::INT AS new FROM r
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + {LENGTH - 1} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run
), p AS (
  SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS x, a - 1 AS y FROM s
  UNION ALL SELECT s.doc_id, max(d.n) + 1, max(b) + 1, max(d.n) FROM s JOIN d USING (doc_id) GROUP BY s.doc_id
), q AS (
  SELECT doc_id, string_agg(substr(h, (2 * x - 1)::BIGINT, (2 * (y - x + 1))::BIGINT), '' ORDER BY a) AS left_hex FROM p JOIN d USING (doc_id) GROUP BY doc_id
), t AS (
  SELECT doc_id, sum(b - a + 1)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, sha256(unhex(coalesce(q.left_hex, d.h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN q USING (doc_id)
"""
