"""The corpus operators against brute force, on small fixtures with the odd cases in them."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewheel.llm import decontaminate, fuzzy_lines, mixing, near_dups, quality, secrets, sharding, suffix_dedup, urls, warc
from tidewheel.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "re", "the", "or", "ü", "é", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """Exact and near copies, repeats, nulls, empties, one very long text, ties, null keys."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    base = prose(rng, 150)
    for k in range(12):
        w = base.split(" ")
        for _ in range(k):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        texts.append(" ".join(w))
    passage = prose(rng, 60)
    texts += [prose(rng, 10) + " " + passage + "\n" + prose(rng, 15) for _ in range(6)]
    texts += [texts[0], texts[0], texts[1], None, "", " \t\n", "one", "a" * 700, "x y " * 300, "$$$ ### " * 60, prose(rng, 12000)]
    docs = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*docs, (None, texts[2], "en", "s1", 1), docs[5]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # An extra column whose name the operators use themselves must do no harm.
    return spark.createDataFrame(rows, SCHEMA).withColumns({"n_words": F.lit("mine"), "kept": F.lit("mine")}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 130)) and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(text, words):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_like_all_pairs(rows, docs, words):
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [(r[0], sets_of(r[1], words)) for r in rows]
    for (a, x), (b, y) in itertools.combinations(s, 2):
        if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    for r in near_dups.near_duplicates(docs, words=words).collect():
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id)
            assert r.n_shingles == len(next(x for i, x in s if i == r.doc_id))
        else:
            assert r.component_id == find(2)
    kept = near_dups.one_of_each(docs, words=words)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {i for i in parent if find(i) == i}


def brute_removed(texts, n):
    seen = Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if seen[t[p : p + n]] > 1:
                cover[p : p + n] = True
        out.append((int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~cover])))
    return out


@pytest.mark.parametrize("spans", [4096, 1])
def test_suffix_dedup_like_all_windows(rows, docs, spans):
    want = {(r[0], xxh(r[1])): w for r, w in zip(rows, brute_removed([(r[1] or "").encode() for r in rows], 200))}
    got = {(r.id, r.row): r for r in suffix_dedup.repeats(docs, shard_spans=spans).collect()}
    for (i, h), (removed, n, kept) in want.items():
        r = got.get((i, h))
        if r is None:
            assert removed == 0
        else:
            assert (sum(x["end"] - x["start"] for x in r.removed), len(r.removed), bytes(r.kept)) == (removed, n, kept), i


def xxh(text):
    v = xxhash.xxh64_intdigest((text or "").encode(), seed=42) if text is not None else 42
    return v - (1 << 64) if v >> 63 else v


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for b in (rng.integers(97, 99, 500).astype(np.uint8), np.full(300, 97, np.uint8), np.zeros(0, np.uint8)):
        t = b.tobytes()
        sa = suffix_dedup.suffix_array(b, len(b) + 1)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = suffix_dedup.common_prefixes(b, sa, 10_000)
        for k in range(1, len(t)):
            x, y = t[sa[k - 1] :], t[sa[k] :]
            assert lcp[k] == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


def test_near_copies_just_over_the_length():
    for seed in range(150):
        rng = np.random.default_rng(seed)
        base, texts = rng.integers(97, 123, 320).astype(np.uint8), []
        for _ in range(6):
            t = base.copy()
            t[rng.integers(200, 320)] = rng.integers(97, 123)
            texts.append(np.concatenate([rng.integers(97, 123, rng.integers(0, 40)).astype(np.uint8), t[: rng.integers(230, 320)], rng.integers(97, 123, 30).astype(np.uint8)]).tobytes())
        texts += [rng.integers(97, 123, 400).astype(np.uint8).tobytes() for _ in range(3)]
        twice, cls = suffix_dedup.repeated_windows(texts, 200)
        windows = [[t[i : i + 200] for i in range(len(t) - 199)] for t in texts]
        count = Counter(w for ws in windows for w in ws)
        assert [x.tolist() for x in twice] == [[count[w] > 1 for w in ws] for ws in windows], seed
        assert len({(w, c) for ws, cs in zip(windows, cls, strict=True) for w, c in zip(ws, cs.tolist(), strict=True)}) == len(count) == len({c for cs in cls for c in cs.tolist()}), seed


def test_decontamination_like_all_windows(spark, rows, docs):
    items = [(1, " ".join(rows[0][1].split(" ")[3:20]).upper()), (2, "one"), (3, None), (4, "..."), (5, "absent words only"), (11, " ".join(rows[0][1].split(" ")[3:20])), (None, "x, y")]
    item_table = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])].add(str(i) if i is not None else "null")
    for block in (16 << 20, 40):
        for r in decontaminate.scanned(docs, item_table, block_bytes=block).collect():
            w = words(r.text)
            hit, found = set(), set()
            for win, ids in windows.items():
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit |= set(range(p, p + len(win)))
                        found |= ids
            assert (r.n_words, r.n_hit, {m.item_id for m in r.matches}) == (len(w), len(hit), found), r.doc_id
    longest = max((m.n_words for r in decontaminate.scanned(docs, item_table).where("doc_id = 0").collect() for m in r.matches), default=0)
    assert longest == 17
    assert decontaminate.clean(docs, item_table.limit(0)).count() == docs.count()


def test_quality_counts_and_verdicts(rows, docs):
    got = quality.judged(docs)
    assert got.count() == len(rows)
    for r in got.collect():
        t = r.text or ""
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_rejects_planted_menus_and_symbols(spark):
    rng = random.Random(3)
    made = [(i, prose(rng, rng.randint(60, 200))) for i in range(300)]
    menu = lambda: " | ".join(prose(rng, 2) for _ in range(60))
    junk = lambda: " ".join(rng.choice(["$$#", "<%>", "&*"]) + prose(rng, 1) for _ in range(80))
    made += [(i, menu()) for i in range(300, 320)] + [(i, junk()) for i in range(320, 330)]
    shares = [t.count("|") / len(t.replace(" ", "")) for _, t in made[300:320]]
    assert 0.06 < min(shares) and max(shares) < 0.15
    docs = spark.createDataFrame([(i, t, "en", "s1") for i, t in made], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == set(range(300, 330))


def test_robust_estimate_ignores_a_quarter_of_outliers(spark):
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (300, 4)) * 0.3 + [1, 0, 0, 0], rng.normal(0, 0.1, (60, 4)) + [9, 5, 5, 5]
    stats = spark.createDataFrame([("g", *map(float, x)) for x in np.vstack([good, bad])], "g string, x1 double, x2 double, x3 double, x4 double")
    r = quality.estimates(stats, ["g"]).first()
    assert abs(r.u_x1 - 1) < 0.15 and abs(r.u_x2) < 0.15


def test_mixing_meets_targets(spark, docs, rows):
    got = mixing.copies(docs).collect()
    total = sum(len(WORD.findall(r[1] or "")) for r in rows)
    by = defaultdict(set)
    for r in got:
        assert 0 <= r.n_copies <= 3
        by[r.source].add((r.source_size, r.target))
    assert all(len(v) == 1 for v in by.values())
    targets = {k: next(iter(v)) for k, v in by.items()}
    assert abs(sum(t for _, t in targets.values()) - total) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in targets.values())
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    for r in mixing.copies(many).groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("taken"), F.first("target").alias("t")).collect():
        assert abs(r.taken - r.t) < 0.05 * r.t
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(r.n_copies for r in got)


def test_shards_fit_and_are_minimal(docs):
    limit = 3000
    got = sharding.assigned(docs, limit, step=3).collect()
    assert len(got) == docs.count()
    size = Counter()
    for r in got:
        size[r.shard] += len((r.text or "").encode())
    for r in got:
        assert size[r.shard] == r.shard_bytes and r.over_limit == (r.shard_bytes > limit)
        if r.over_limit:
            assert len(r.shard) == sharding.BITS
    for s in size:  # the parent of a shard would be too large
        assert s == "" or sum(v for k, v in size.items() if k.startswith(s[:-1])) > limit


def test_fuzzy_lines_lose_no_link(docs, rows):
    got = fuzzy_lines.judged(docs).collect()
    form = {}
    for r in got:
        form.setdefault(re.sub(r"[ \t\n\x0b\f\r]+", " ", r.line.lower()).strip(" "), r.class_id)
    sets = {f: frozenset(f[i : i + 5] for i in range(max(1, len(f) - 4))) for f in form}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if 10 * len(x & y) >= 9 * len(x | y):
            assert form[a] == form[b]
    first = {}
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.line_no)):
        first.setdefault(r.class_id, (r.doc_id, r.line_no))
    for r in got:
        assert r.kept == (first[r.class_id] == (r.doc_id, r.line_no))


def test_fuzzy_links_at_the_threshold_share_a_band(spark):
    rng, made, want = random.Random(11), [], []
    sets = lambda f: {f[i : i + 5] for i in range(max(1, len(f) - 4))}
    while len(want) < 800:
        a = prose(rng, 30)[: rng.randint(50, 120)].strip()
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            b[rng.randrange(len(b))] = rng.choice("xyzq")
        b = "".join(b)
        x, y = sets(a), sets(b)
        if 80 * len(x | y) <= 100 * len(x & y) < 90 * len(x | y):
            want.append((len(made), len(made) + 1))
            made += [(len(made), a), (len(made) + 1, b)]
    of = {r.doc_id: r.class_id for r in fuzzy_lines.judged(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert [p for p in want if of[p[0]] != of[p[1]]] == []


def test_fuzzy_query_has_a_row_for_each_row(spark, tmp_path):
    rows = [(1, "one text of id one\nand a second line"), (1, "another text of the same id"), (None, "a text without an id\nwith two lines"), (None, "one more without an id"), (2, "twice the same row\nof two lines")] + [(2, "twice the same row\nof two lines"), (3, None), (None, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = fuzzy_lines.op5_fuzzy_lines(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, [x.line_no for x in r.lines]) for r in got) == sorted((i is None, i or 0, list(range(len(t.split("\n")))) if t else []) for i, t in rows)
    assert all((r.n_lines, r.n_kept) == (len(r.lines), sum(x.kept for x in r.lines)) for r in got)
    assert sum(r.kept_chars for r in got) == sum(len(x) for _, t in rows for x in (t or "").split("\n"))


def test_fuzzy_query_has_every_document_and_class(spark, tmp_path):
    texts = ["one line\n\nanother line", None, "", " \n\t", "One  line"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fuzzy_lines.op5_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert {i: (r.n_lines, r.n_kept, r.kept_chars) for i, r in got.items()} == {0: (2, 2, 20), 1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 0, 0)}
    assert [(x.line_no, x.kept) for x in got[0].lines] == [(0, True), (2, True)] and got[1].lines == []
    assert got[4].lines[0].class_id == got[0].lines[0].class_id != got[0].lines[1].class_id


def test_url_rules(spark):
    cases = {
        "http://www.example.com/en/a?x": "www.example.com/en/", "http://a.example.com/en/a": "example.com/en/", "http://x.COM/": "com/", "http://x.com": None, "http://b.net/es/": "net/es/", "http://net/fr/1#t": "net/fr/",
        "http://bnet/es/": None, "no scheme": None, None: None, "": None, "http://a.example.com/EN/": "com/", "http://example.org/en/": None,
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("rule", F.lit("mine"))
    got = {r.url: r for r in urls.judged(pages).collect()}
    assert {u: r.rule for u, r in got.items()} == cases
    assert got["http://a.example.com/en/a"].verdict == "block" and got["http://www.example.com/en/a?x"].verdict == "allow"
    assert urls.judged(pages, []).where("rule is not null").count() == 0


def test_digest_collisions_are_confirmed(tmp_path):
    made = urls.write_digests([("block", "a.com/"), ("allow", "b.com/")], str(tmp_path))
    array = urls.Digests(made, str(tmp_path))
    keys = np.array(array.keys)
    array.keys = np.full(len(keys), keys[0])  # every probe of the first digest now meets both rules
    first = next(r for r in ("a.com/", "b.com/") if xxhash.xxh64_intdigest(r) == int(keys[0]))
    assert bytes(array.rules[array.ends[array.probe([first])[0]] :][: len(first)]) == first.encode()


def test_warc_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nx\r\n\r\n\r\n\r\n" * 40
    pages = [(1, "http://b.com/x", tricky), (2, "http://a.com/y\r\nEvil: 1", tricky), (3, None, None), (4, "http://a.com/y", ""), (5, "http://www.a.com/é", "é" * 600), (6, "http://a.com/y", "short"), (7, "http://a.com/y", "short"), (8, "http://a.com/y", tricky)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("extra", F.lit(1))
    got = warc.captured(df, f"file://{tmp_path}/w", records=3).collect()
    by = {r.page_id: r for r in got}
    for i, _, html in pages:
        data = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert [(i, by[i].refers_to) for i in sorted(by) if by[i].record_type == "revisit"] == [(1, 8), (2, 8)]
    order = [(r.urlkey, r.timestamp) for r in sorted(got, key=lambda r: (r.part, r.position))]
    assert order == sorted(order)
    assert warc.captured(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted((rng.randrange(9), i) for i in range(rng.randrange(7))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_secrets_base_spans_and_held_out(spark):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [prose(rng, 20) + f' PassWord : "{digits(18)}" ' + prose(rng, 5) + f" AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))} {digits(40)}" for _ in range(60)]
    texts += [None, "", "token=short", "api_key=\"" + "A" * 8 + "\" paſſword=abcdefgh1", "é " + "f" * 32]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secrets", F.lit(0))
    model = secrets.Grammar(secrets.labelled_sample(docs))
    got = {r.doc_id: r.secrets for r in secrets.scanned(docs, grammar=model).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [(s.start, s.kind, s.end) for s in got[i] if s.kind != "grammar"] == [(a, secrets.KINDS[k], b) for a, k, b in sorted(want)]
    fresh = [digits(40) for _ in range(100)]
    assert sum(map(model.accepts, fresh)) >= 90
    words = [w for _ in range(40) for w in prose(rng, 50).split(" ") if len(w) >= 12 and w.isascii()]
    assert sum(map(model.accepts, words)) <= 0.02 * len(words)


def test_empty_tables(spark, none):
    assert near_dups.near_duplicates(none).count() == 0 and near_dups.one_of_each(none).count() == 0
    assert suffix_dedup.repeats(none).count() == 0 and quality.judged(none).count() == 0
    assert mixing.mixed(none).count() == 0 and sharding.assigned(none).count() == 0
    assert fuzzy_lines.judged(none).count() == 0 and secrets.scanned(none).count() == 0
    assert decontaminate.scanned(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
