"""Every registered query and the pipeline over tables with nulls, repeats, long texts and foreign columns, over empty ones, and the stages against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import registry, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["kept", "row", "shard", "target", "a.b", "x1", "_in0", "n_words", "bucket", "word", "n"]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "re", "the", "or", "ü", "é", "in", "lo"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents():
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(60, 200)) + "\n" + prose(rng, 20) for _ in range(60)]
    near = [" ".join(t.split(" ")[:-2] + ["changed"]) for t in texts[:12]]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "book", None]), len(t)) for i, t in enumerate(texts + near)]
    rows += [(500, None, None, None, None), (501, "", "en", "web", 0), (502, " \t\n", None, "book", 3), (503, prose(rng, 30_000), "de", "web", 1), (None, texts[20], "en", "web", 1), (None, None, None, None, None), (504, texts[21], "en", "web", 1), (504, texts[21], "en", "web", 1), (7, texts[22] + " more", "en", "web", 1)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(documents(), DOCS).select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASH])
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    pages = [(1, "http://a.com/en/x", "x" * 1500), (2, None, None), (None, "no scheme", "x" * 1500), (3, "http://www.example.com/en/", ""), (3, "http://www.example.com/en/", ""), (4, "ftp://B.net/es/?q", "é" * 700)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("kept", F.lit(1)).write.parquet(f"{at}/pages.parquet")
    items = [(1, " ".join(documents()[30][1].split(" ")[5:25])), (2, None), (3, ""), (None, "absent words"), (4, documents()[31][1].split(" ")[3].upper() + " unseen word")]
    spark.createDataFrame(items, "item_id long, text string").withColumn("matches", F.lit(1)).write.parquet(f"{at}/benchmark.parquet")
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(8)], i % 3) for i in range(120)] + [(None, [0.1] * 8, 1), (100, [0.2] * 8, None), (100, None, 1), (150, [0.1, None] * 4, 1), (200, [float("nan")] * 8, 1), (250, [], 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


ROWS = {"op1_warc": 6, "op8_urls": 6} | dict.fromkeys(("op2_secrets", "op3_shard", "op4_decontaminate", "op5_fuzzy_lines", "op6_suffix_dedup", "op7_quality", "op9_near_dups", "op10_mix"), len(documents()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_over_odd_and_empty_tables(spark, odd, empty, name):
    found = registry.QUERIES[name](spark, odd).collect()
    if name in ROWS:
        assert len(found) == ROWS[name]
        key = "page_id" if "page_id" in found[0] else "doc_id"
        assert sum(r[key] is None for r in found) == (1 if key == "page_id" else 2)
        repeated = [r for r in found if r[key] == (3 if key == "page_id" else 504)]
        assert len(repeated) == 2 and repeated[0] == repeated[1]
    else:
        assert found
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_pipeline_over_an_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages_against_plain_python(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()), key=str)
    given = rows(docs)

    # Near duplicates: all pairs of different rows, then a walk over the links.
    once = list(dict.fromkeys(given))
    sets = [shingles(r[1], 5) for r in once]
    root = list(range(len(once)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(once)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(once)):
        groups[find(i)].append(i)
    want = Counter(min((once[i][0] for i in m if once[i][0] is not None), default=None) for m in groups.values() if sets[m[0]])
    kept = rows(stage["near duplicates"](spark, docs, odd))
    assert Counter(r[0] for r in kept if shingles(r[1], 5)) == want
    assert [r for r in kept if not shingles(r[1], 5)] == [r for r in given if not shingles(r[1], 5)]

    # Decontamination: all windows of all items.
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))
    clean = rows(stage["benchmark decontamination"](spark, docs, odd))
    assert clean == [r for r in given if not hit(r[1])] and len(clean) < len(given)

    # Mixing: targets filled up level by level, each document as often as floor or ceiling of its source's rate.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for r in given:
        total[r[3]] += size(r[1])
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, {s for s in names if total[s]}, sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
        free -= over
    mixed = Counter(rows(stage["mixing sources"](spark, docs, odd)))
    times = Counter(given)
    for r, n in times.items():
        rate = target.get(r[3], 0) / total[r[3]] if total[r[3]] else 0
        assert int(rate + 1e-9) * n <= mixed[r] <= (int(rate + 1e-9) + 1) * n, r[:1]

    # Sharding: every document once, copies together, shards within the limit.
    dealt = stage["sharding"](spark, docs, odd).collect()
    assert sorted((tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in dealt), key=str) == given
    weighed = defaultdict(int)
    for r in dealt:
        weighed[r["shard"]] += len((r.text or "").encode())
    assert all(v <= sharding.LIMIT for v in weighed.values())
    assert len({(hashlib.md5((r.text or "").encode()).hexdigest(), r["shard"]) for r in dealt}) == len({r.text or "" for r in dealt})
