"""WARC archives of pages, and a capture index merged from sorted runs.

Archives are written and read by Spark's own sources, so they can lie in any
store.  A task packs its records, each a gzip member of its own, into archives of a bounded size as it meets them; a file holds one
archive, its members and nothing else, as any WARC or gzip tool reads it.  An entry's offset and length are those of its
member in the archive, so a record can be read alone.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.scratch import Scratch, new_path
from tidewheel.llm.tables import table

#: Payloads of at least so many bytes are kept once.
LEAST = 1000
#: Records of an archive, and packed bytes of all its records, at most (one larger record is an archive by itself).
RECORDS, ARCHIVE_BYTES = 20_000, 32 << 20
ENDING = ".warc.gz"
#: Index entries of a key range that is merged in one task, about.
MERGE_ROWS = 250_000
#: The capture time of page 0; each page is a second later (beyond some 7,000 years it starts anew). The table has no times of its own.
EPOCH, SECONDS = "2024-01-01T00:00:00Z", 230_000_000_000
CLOSE = "\r\n\r\n"
CDX = "urlkey string, timestamp string, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, archive string, offset long, length long"
CDX_NAMES = [x.split()[0] for x in CDX.split(", ")]


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: the host's labels reversed, then path and query; lower-case, no port or fragment."""
    rest = url.lower().partition("://")[2] or url.lower()
    host, slash, path = re.match(r"([^/?#]*)(/?)([^#]*)", rest, re.S).groups()
    labels = host.rpartition("@")[2].partition(":")[0].split(".")
    if labels[0] == "www" or (labels[0] == "m" and len(labels) > 2):
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")/" + (path or "")


class LoserTree:
    """Merges k sorted iterators: each pop replays one leaf-to-root path of about log2(k) comparisons."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(self.runs)
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._seed(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an ended run comes last, ties go to the lower run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _seed(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + self.k) // 2
            while node:
                if self._less(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column, refers_url: Column) -> Column:
    """A WARC/1.1 record as bytes, without the two line ends that close it.

    Revisits of an identical payload name the response and carry no block.
    """
    stamp = lambda c: F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + F.pmod(F.coalesce(c.cast("long"), F.lit(0)), F.lit(SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    safe = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", "")
    revisit = refers_to.isNotNull()
    body = F.when(revisit, F.lit(b"")).otherwise(payload)
    line = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    head = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(page_id)),
        line("WARC-Target-URI", safe),
        line("WARC-Date", stamp(page_id)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Payload-Length", F.octet_length(payload).cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(refers_to)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CLOSE),
    )
    return F.concat(F.encode(head, "UTF-8"), body)


def _packed(batches: Iterator[pa.RecordBatch], records: int, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives without their last byte, which is zero and which the text writer adds as the end of its line (bytes as they are: it doesn't look at them)."""
    held: list[bytes] = []
    size = 0

    def archive() -> pa.RecordBatch:
        # A member ends with its length, so with a zero unless it is of 16 MB or more; then an empty member follows.
        end = [] if held[-1][-1] == 0 else [gzip.compress(b"", mtime=0)]
        return pa.RecordBatch.from_arrays([pa.array([b"".join([*held, *end])[:-1]], pa.binary())], ["archive"])

    for batch in batches:
        for x in batch.column("record"):
            member = gzip.compress(x.as_py() + CLOSE.encode(), 6, mtime=0)
            if held and (len(held) >= records or size + len(member) > archive_bytes):
                yield archive()
                held, size = [], 0
            held.append(member)
            size += len(member)
    if held:
        yield archive()


def _named(spark: SparkSession, path: str) -> None:
    """Gives the written files the ending of archives."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(fs_path(path), False)
    while files.hasNext():
        at = files.next().getPath()
        if at.getName().endswith(".txt"):
            fs.rename(at, fs_path(at.getParent(), at.getName()[: -len(".txt")] + ENDING))


def write_archives(pages: DataFrame, path: str, records: int = RECORDS, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record per row of ``pages(page_id, url, html)`` to archives below ``path``.

    Of equal payloads of ``least`` bytes or more, that of the largest page id is written
    whole and the others as revisits (of several rows with that largest id each is whole).  Payloads are compared by their SHA-1,
    which only page ids and digests are shuffled for, partial maxima first;
    the pages meet the revisits among them in one equi-join on page_id.
    A null html is an empty payload, a null url an empty one; rows without a page id are responses.
    An archive holds ``records`` records and ``archive_bytes`` packed bytes at most, by the running size: a long record closes
    the archive before it and changes no other. Files are named ``ENDING`` by the driver, once they are all written.
    """
    work = Scratch(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    narrow = work.store(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= least), "digests")
    # Sums that are joined back are stored first: then Spark can split a hot digest among tasks.
    kept = work.store(narrow.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null"), "kept")
    again = narrow.join(kept.select("digest", "target"), "digest").where("page_id <> target").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "target").distinct()
    again = work.store(again, "revisits")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = rows.join(again, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    made = record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("target"), F.lit(None))
    archives = rows.select(made.alias("record")).mapInArrow(lambda batches: _packed(batches, records, archive_bytes), "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    _named(pages.sparkSession, path)
    work.release("digests", "kept", "revisits")


def members(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(record, offset, length) of each gzip member of an archive that is not empty, one at a time."""
    at, whole = 0, memoryview(data)
    while at < len(data):
        unzip = zlib.decompressobj(wbits=31)
        record, end = [], at
        while not unzip.eof:
            if end >= len(data):
                raise ValueError(f"the member at {at} is cut off")
            piece = whole[end : end + (1 << 16)]
            record.append(unzip.decompress(piece))
            end += len(piece) - len(unzip.unused_data)
        if any(record):
            yield b"".join(record), at, end - at
        at = end


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of each record of an archive; the stated length says where a block ends."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        end = head + 4 + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end at {end}")
        yield headers, at, end + 4 - at, data[head + 4 : end]
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The capture index entries of all archives below ``path``, each archive's as one sorted run (archive, nth).

    Digests and lengths of responses are taken from the payload as read; records are unpacked one at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ENDING}").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if " long" in x else pa.string() for x in CDX.split(", ")]
        for batch in batches:
            for name, packed in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                short = name.rpartition("/")[2]
                for h, at, size, block in ((h, at, size, block) for record, at, size in members(packed.as_py()) for h, _, _, block in parse(record)):
                    whole = h["WARC-Type"] == "response"
                    digest = hashlib.sha1(block).hexdigest() if whole else h["WARC-Payload-Digest"].partition(":")[2]
                    to = h.get("WARC-Refers-To")
                    number = lambda x: None if x is None or x == "<urn:page:none>" else int(x[len("<urn:page:") : -1])
                    stamp = re.sub(r"\D", "", h["WARC-Date"])
                    url = h["WARC-Target-URI"]
                    rows.append((url_key(url), stamp, number(h["WARC-Record-ID"]), url, digest, len(block) if whole else int(h["WARC-Payload-Length"]), h["WARC-Type"], number(to), short, at, size))
                rows.sort(key=order_of)
                for k in range(0, len(rows), 4096):
                    part = rows[k : k + 4096]
                    cols = [pa.array(c, kind) for c, kind in zip(zip(*part, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(range(k, k + len(part)), pa.int64())], [*CDX_NAMES, "nth"])

    return files.mapInArrow(run, f"{CDX}, nth long")


def order_of(row: tuple) -> tuple:
    """URL key and time, then what makes the order total."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def merged_index(runs: DataFrame) -> DataFrame:
    """The capture histories in global order: by URL key, then time.

    The runs are dealt out in key ranges (a range can end within one key's
    history, so a hot key is no hot task), as many as hold about ``MERGE_ROWS`` entries each, by
    their count, which is what a task holds; in each range the pieces of the
    runs, still sorted, are merged by a loser tree.  ``part`` and ``position`` give the order.
    """
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // MERGE_ROWS))
    keys = [F.col("urlkey"), F.col("timestamp"), F.col("page_id").asc_nulls_last(), F.col("archive"), F.col("offset")]
    dealt = runs.repartitionByRange(ranges, *keys).sortWithinPartitions("archive", "nth").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[pa.RecordBatch]] = {}
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            archives = batch.column("archive").to_pylist()
            start = 0
            for i in range(1, len(archives) + 1):
                if i == len(archives) or archives[i] != archives[start]:
                    pieces.setdefault(archives[start], []).append(batch.slice(start, i - start))
                    start = i

        def rows(held: list[pa.RecordBatch]) -> Iterator[tuple]:
            for b in held:
                for row in zip(*[b.column(n).to_pylist() for n in CDX_NAMES], strict=True):
                    yield order_of(row), row

        out: list[tuple] = []
        done = 0
        kinds = [pa.int64() if " long" in x else pa.string() for x in CDX.split(", ")]

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(out), pa.int32()), pa.array(range(done, done + len(out)), pa.int64())], [*CDX_NAMES, "part", "position"])

        for _, row in LoserTree(rows(h) for h in pieces.values()):
            out.append(row)
            if len(out) == 4096:
                yield flush()
                done += len(out)
                out = []
        if out:
            yield flush()

    return dealt.select(*CDX_NAMES, "part").mapInArrow(run, f"{CDX}, part int, position long")


def captured(pages: DataFrame, path: str | None = None, records: int = RECORDS) -> DataFrame:
    """Writes ``pages`` to archives (below ``path``, else in the shared folder), reads them back and merges their index.

    An empty table gives an empty index.  Columns other than page_id, url and
    html are ignored, whatever their names; repeated rows are captures of their own, and of rows that share the largest page id of equal payloads each is
    a response.  Null urls and payloads are empty ones, null page ids come last.  Payloads of any length are kept whole.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "archives")
    write_archives(pages, path, records)
    return merged_index(Scratch(spark).store(read_archives(spark, path), "runs"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every row of ``pages``, as read back from its archive. Nulls, ties and repeats as in ``captured``."""
    return captured(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.payload_bytes >= 1000 AND p.page_id <> m.target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.payload_bytes >= 1000 AND p.page_id <> m.target THEN m.target END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
