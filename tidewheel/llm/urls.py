"""URL filters on a sorted digest array.

A list of rules, each a host with its subdomains and a path prefix, becomes a sorted
array of 64-bit xxhash keys in a file that Spark hands to every executor.
Tasks map it into memory, probe it by vectorised binary search and confirm
each hit against the stored rule.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.tables import Aside, table

#: (verdict, rule): a host with all its subdomains, then the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Verdict where no rule fits.
OTHERWISE = "allow"
#: Digests that are probed at a time.
PROBES = 1 << 18


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: both empty for null or without ``://``."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def write_digests(rules: Iterable[tuple[str, str]], folder: str) -> dict:
    """Writes the sorted keys and the rules in their order; returns what a probe needs besides.

    Of equal rules the last one holds.  A rule without a slash has an empty
    path and fits every path.
    """
    last = {rule: verdict for verdict, rule in rules}
    keyed = sorted((xxhash.xxh64_intdigest(rule), rule) for rule in last)
    base = f"digests-{uuid.uuid4().hex}"
    np.array([k for k, _ in keyed], np.uint64).tofile(os.path.join(folder, f"{base}.keys"))
    texts = [r.encode() for _, r in keyed]
    with open(os.path.join(folder, f"{base}.rules"), "wb") as f:
        f.write(b"".join(texts))
    np.cumsum([0] + [len(t) for t in texts]).astype(np.int64).tofile(os.path.join(folder, f"{base}.ends"))
    np.array([last[r] == "block" for _, r in keyed], np.uint8).tofile(os.path.join(folder, f"{base}.block"))
    sizes = sorted({len(r.partition("/")[1] + r.partition("/")[2]) for r in last}, reverse=True)
    labels = sorted({r.partition("/")[0].count(".") + 1 for r in last})
    return {"base": base, "path_sizes": sizes, "labels": labels, "n": len(keyed)}


class Digests:
    """The memory-mapped array on an executor."""

    def __init__(self, made: dict, folder: str):
        at = lambda end: os.path.join(folder, f"{made['base']}.{end}")
        self.sizes, self.labels, self.n = made["path_sizes"], made["labels"], made["n"]
        if self.n:
            self.keys, self.ends = np.memmap(at("keys"), np.uint64, "r"), np.memmap(at("ends"), np.int64, "r")
            self.rules, self.block = np.memmap(at("rules"), np.uint8, "r"), np.memmap(at("block"), np.uint8, "r")

    def probe(self, candidates: list[str]) -> np.ndarray:
        """For each candidate its index in the array, or -1."""
        if not self.n or not candidates:
            return np.full(len(candidates), -1)
        keys = np.fromiter((xxhash.xxh64_intdigest(c) for c in candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys, "left")
        out = np.full(len(candidates), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, self.n - 1)] == keys).tolist():
            k, want = int(at[i]), candidates[i].encode()
            while k < self.n and self.keys[k] == keys[i]:  # digests of different rules can collide
                if self.rules[self.ends[k] : self.ends[k + 1]].tobytes() == want:
                    out[i] = k
                    break
                k += 1
        return out

    def candidates(self, host: str, path: str) -> list[str]:
        """Every rule that could fit: of the host's ends only those with as many labels as some rule has."""
        if not host or not self.labels:
            return []
        ends = host.rsplit(".", self.labels[-1])[::-1][: self.labels[-1]]
        hosts = [".".join(ends[:k][::-1]) for k in self.labels if k <= host.count(".") + 1]
        return [h + path[:n] for h in hosts for n in self.sizes if n <= len(path)]


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, otherwise: str = OTHERWISE, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The longest rule that fits wins (two different rules of one length can't both
    fit unless one's host is longer; then that one wins); where none fits, the rule is null and the
    verdict is ``otherwise``.  Null or malformed URLs have an empty host and
    path and fit no rule.  Columns of the four names are replaced, others may have any name.  Repeated rows are judged alike, URLs of any length
    whole.  Empty tables and empty rule lists are fine.  One map over the URLs, no shuffle.
    """
    spark = pages.sparkSession
    held = Aside(pages, ("host", "path", "rule", "verdict"))
    folder = tempfile.mkdtemp(prefix="digests-")  # on the driver alone; Spark hands the files to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = write_digests(rules, folder)
    for end in ("keys", "rules", "ends", "block"):
        path = os.path.join(folder, f"{made['base']}.{end}")
        if os.path.getsize(path):
            spark.sparkContext.addFile(path)
    host, path = parts(F.col(held.of(url)))
    both = held.df.withColumns({"host": host, "path": path})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = Digests(made, SparkFiles.getRootDirectory())
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule: list[str | None] = []
            verdict: list[str] = []
            start = 0
            while start < len(hosts):
                flat: list[str] = []
                owner: list[int] = []
                end = start
                while end < len(hosts) and len(flat) < PROBES:
                    c = array.candidates(hosts[end], paths[end])
                    flat += c
                    owner += [end] * len(c)
                    end += 1
                best: dict[int, tuple[int, int]] = {}
                hit = array.probe(flat)
                for i in np.flatnonzero(hit >= 0).tolist():
                    best[owner[i]] = max(best.get(owner[i], (-1, -1, -1)), (len(flat[i]), len(flat[i].partition("/")[0]), i))
                for r in range(start, end):
                    i = best[r][2] if r in best else -1
                    rule.append(flat[i] if i >= 0 else None)
                    verdict.append(otherwise if i < 0 else "block" if array.block[hit[i]] else "allow")
                start = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "rule", "verdict"])

    found = both.mapInArrow(run, T.StructType([*both.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    return held.back(found, "host", "path", "rule", "verdict")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every row of ``pages``. Nulls, ties and repeats as in ``judged``."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT p.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
