"""Odd rows for every operator: nulls, long and empty texts, ties, repeats, empty tables, clashing names; and what the methods add."""

import gzip
import hashlib
import itertools
import random
import re
import string
import struct
import subprocess
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewheel.llm import decontaminate, fuzzy_lines, mixing, near_dups, quality, secrets, sharding, suffix_dedup, urls, warc
from tidewheel.llm.components import connected_components

#: Names that operators use themselves, or that need quoting.
CLASH = ["kept", "n_words", "n_lines", "x1", "g1", "u_x1", "_h0", "_h", "h", "s", "_target", "_source", "target", "shard", "secrets", "matches", "a.b", "_in0", "c0", "row", "KEPT2", "n_copies", "rule", "host"]
SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "re", "the", "or", "ü", "é", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    rng = random.Random(4)
    texts = [prose(rng, 80) for _ in range(12)]
    long = " ".join(prose(rng, 1000) for _ in range(90))
    rows = [(i, t, "en", "s1") for i, t in enumerate(texts)]
    rows += [(100, None, None, None), (101, "", "en", None), (102, " \t\r\n\x0b", None, "s1"), (103, long, "de", "s2"), (None, texts[3], "en", "s1"), (None, None, None, None), (104, texts[0], "en", "s1"), (104, texts[0], "en", "s1"), (7, "another text of one id " * 20, "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, odd_rows()[0][1]), (2, None), (3, ""), (4, "absent")], "item_id long, text string")


ALL_COLUMNS = {
    "op2": (lambda d, i: secrets.scanned(d), ["secrets"]),
    "op3": (lambda d, i: sharding.assigned(d, 5000, step=4), ["shard", "shard_bytes", "over_limit"]),
    "op3 joined": (lambda d, i: sharding.assigned(d, 5000, step=4, sent=0), ["shard", "shard_bytes", "over_limit"]),
    "op4": (decontaminate.scanned, ["n_words", "n_hit", "matches"]),
    "op7": (lambda d, i: quality.judged(d), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept"]),
    "op8": (lambda d, i: urls.judged(d, url="text"), ["host", "path", "rule", "verdict"]),
    "op10": (lambda d, i: mixing.copies(d), ["size", "source_size", "target", "n_copies"]),
}


@pytest.mark.parametrize("name", sorted(ALL_COLUMNS))
def test_rows_and_foreign_columns_stay(odd, items, name):
    op, added = ALL_COLUMNS[name]
    out = op(odd, items)
    assert set(out.columns) == set(odd.columns) | set(added) and len(out.columns) == len(set(out.columns))
    rows = out.collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text or "") for r in rows) == sorted((r[0] is None, r[0], r[1] or "") for r in odd_rows())
    for r in rows:
        assert all(r[c] == f"mine {c}" for c in CLASH if c not in added)
    assert op(odd.limit(0), items.limit(0)).count() == 0
    twice = [r for r in rows if r.doc_id == 104]
    assert len(twice) == 2 and {k: v for k, v in twice[0].asDict().items()} == {k: v for k, v in twice[1].asDict().items()}


def test_stage_forms_keep_names(odd, items):
    for out in (near_dups.one_of_each(odd), decontaminate.clean(odd, items), mixing.mixed(odd)):
        assert out.columns == odd.columns
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in CLASH)


def test_lines_and_spans_of_odd_rows(odd):
    lines = fuzzy_lines.judged(odd).collect()
    assert {r.doc_id for r in lines} == {r[0] for r in odd_rows() if (r[1] or "").split()}
    gone = {(r.id, bytes(r.kept)) for r in suffix_dedup.repeats(odd).collect()}
    assert {i for i, _ in gone} == {0, 3, None, 104, 7} and (104, b"") in gone and (0, b"") in gone


def test_one_of_each_tells_texts_of_one_id_apart(spark, odd):
    got = [(r.doc_id, r.text) for r in near_dups.one_of_each(odd).collect()]
    assert len(got) == len(set(got))
    assert {t for i, t in got if i == 7} == {t for i, t, *_ in odd_rows() if i == 7}
    assert sum(t == odd_rows()[0][1] for _, t in got) == 1 and (0, odd_rows()[0][1]) in got
    named = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "one two three four")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(named).collect()} == {("a", "a", True), ("b", "a", False), (None, "a", False)}


def test_rows_without_an_id_link_by_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (5, " ".join([*words[:30], "x", *words[31:]])), (6, "quite another text")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 5, False), (5, 5, True), (6, 6, True)}


@pytest.mark.parametrize("region", [2, 32])
def test_many_near_copies_of_a_few_documents(spark, region, monkeypatch):
    monkeypatch.setattr(near_dups, "REGION", region)
    rng, rows, want = random.Random(8), [], {}
    for k in range(4):
        base = [f"{k}x{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(100)] = f"e{rng.randrange(10**9)}"
            want[len(rows)] = k
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: 40 * want[i] for i in got}


def test_lines_are_linked_from_the_threshold_on(spark):
    """Prose and long words with edits, one character more or less, short lines; linked pairs and those that must stay apart."""
    rng, made, pairs = random.Random(21), [], []
    sets = lambda f: {f[i : i + 5] for i in range(max(1, len(f) - 4))}

    def put(a, b):
        x, y = sets(a), sets(b)
        if a != b and a.strip() == a and b.strip() == b and "  " not in a + b:
            pairs.append((len(made), len(x & y) / len(x | y)))
            made.extend([a, b])

    while len(pairs) < 600:
        kind = len(pairs) % 3
        words = [prose(rng, 1) for _ in range(30)] if kind == 0 else ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(9, 14))) for _ in range(7)]
        a = " ".join(words) if kind < 2 else prose(rng, 12)[: rng.randint(12, 40)].strip()
        b = list(a)
        for _ in range(2 if kind < 2 else 1):
            b[rng.randrange(len(b))] = rng.choice("xyzq")
        put(a, "".join(b))
    for _ in range(100):
        a = "".join(rng.choices(string.ascii_lowercase, k=60))
        put(a, a + "x")
    of = {r.doc_id: r.class_id for r in fuzzy_lines.judged(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    near, far = [i for i, j in pairs if j >= 0.8], [i for i, j in pairs if j < 0.8]
    assert len(near) > 300 and len(far) > 30
    assert sum(of[i] == of[i + 1] for i in near) >= 0.99 * len(near)
    assert not any(of[i] == of[i + 1] for i in far)


def test_components_of_lines_like_all_pairs(spark, sf):
    """No link of the smallest table is lost, and none is made up."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = fuzzy_lines.judged(docs).select("line", "class_id").distinct().collect()
    form = {}
    for r in got:
        form[" ".join(r.line.lower().split())] = r.class_id
    names = sorted(form)
    sets = [{f[i : i + 5] for i in range(max(1, len(f) - 4))} for f in names]
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(range(len(names)), key=lambda i: len(sets[i]))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if 80 * len(sets[j]) > 100 * len(sets[i]):
                break
            if 180 * len(sets[i] & sets[j]) >= 80 * (len(sets[i]) + len(sets[j])):
                parent[find(i)] = find(j)
    want, have = {}, {}
    for i, f in enumerate(names):
        want.setdefault(find(i), set()).add(f)
        have.setdefault(form[f], set()).add(f)
    assert {frozenset(x) for x in want.values()} == {frozenset(x) for x in have.values()}


def test_lines_that_share_a_hash_are_told_apart(spark):
    rows = [(1, 10, "the first of two lines that share a key"), (1, 11, "something else altogether, with the same key"), (2, 20, "the first of two lines that share a key!"), (3, 30, "a third line")]
    roots, lines = fuzzy_lines.components(spark.createDataFrame(rows, "key long, other long, norm string"))
    key = {r.norm: r.key for r in lines.collect()}
    root = {r.key: r.root for r in roots.collect()}
    assert len(set(key.values())) == 4
    assert root[key[rows[0][2]]] == root[key[rows[2][2]]] and key[rows[1][2]] not in root


def test_code_of_buckets_is_short_enough_to_be_compiled(spark, tmp_path):
    """HotSpot leaves methods of more than 8000 bytes to its interpreter."""
    made = spark.range(9).select(F.col("id").alias("key"), F.array(*[F.hash("id", F.lit(k)) for k in range(fuzzy_lines.BINS)]).alias("mins"))
    made.write.parquet(f"{tmp_path}/made")
    placed = fuzzy_lines.buckets(spark.read.parquet(f"{tmp_path}/made"))
    parts = placed._jdf.queryExecution().debug().codegenToSeq()
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    assert sizes and 0 < max(sizes) <= 8000
    want = {(r.key, xxhash_of(b, *[r.mins[7 * k + (b + b // 7 * k) % 7] for k in range(5)])) for r in made.collect() for b in range(21)}
    assert {(r.key, r.bucket) for r in placed.collect()} == want and placed.count() == 9 * 21


def test_parities_rule_out_only_what_is_not_similar(spark):
    """No pair from the threshold on is ruled out, and of those that share a passage nearly all are."""
    rng, sets, want = random.Random(4), [], []
    for k in range(400):
        n = rng.randint(6, 300)
        core = [rng.getrandbits(63) for _ in range(n)]
        apart = rng.randint(0, n // 8) if k % 2 else n // 3
        x, y = [core + [rng.getrandbits(63) for _ in range(apart)] for _ in range(2)]
        want.append(len(core) / (len(core) + 2 * apart))
        sets += [(2 * k, x), (2 * k + 1, y)]
    bits = fuzzy_lines.parities(spark.createDataFrame(sets, "id long, s array<long>"))
    side = lambda odd, x: bits.where(F.col("id") % 2 == odd).select(F.expr("id div 2").alias("k"), *[F.col(c).alias(f"{x}{c}") for c in bits.columns[1:]])
    met = {r.k: r.ok for r in side(0, "x").join(side(1, "y"), "k").select("k", fuzzy_lines.may_share("x", "y", 80).alias("ok")).collect()}
    assert all(met[k] for k, j in enumerate(want) if j >= 0.8) and sum(j >= 0.8 for j in want) > 150
    assert sum(met[k] for k, j in enumerate(want) if j < 0.65) < 10 and sum(j < 0.65 for j in want) > 150


def test_large_buckets_store_few_pairs(spark, monkeypatch):
    """Lines that share a passage and little else meet in large buckets; no table of their meetings is written, and near copies among them are linked."""
    rng, made = random.Random(5), []
    passage = "".join(rng.choices(string.ascii_lowercase, k=160))
    for _ in range(150):
        a = passage + "".join(rng.choices(string.ascii_lowercase[:3], k=80))
        made += [a, a[:200] + "zz" + a[202:]]
    rows, store = {}, fuzzy_lines.Scratch.store

    def counted(self, df, name):
        out = store(self, df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(fuzzy_lines.Scratch, "store", counted)
    of = {r.doc_id: r.class_id for r in fuzzy_lines.judged(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    assert all(of[i] == of[i + 1] for i in range(0, 300, 2))
    assert rows["more"] < 4500 and max(rows.values()) <= 21 * 300


def xxhash_of(*ints):
    """Spark's xxhash64 of ints."""
    h = 42
    for x in ints:
        h = xxhash.xxh64_intdigest(struct.pack("<i", x), seed=h)
    return h - 2**64 if h >= 2**63 else h


def credentials(rng):
    """Made formats, each with a length of its own choice."""
    some = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    return {
        "aws": lambda n: "ASIA" + some(string.ascii_uppercase + "234567", n - 4), "base64": lambda n: some(alnum + "+/", n), "hex": lambda n: some(hexes, n), "mixed": lambda n: some(alnum, n),
        "host": lambda n: "ghp_" + some(alnum, n - 4), "live": lambda n: "sk_live_" + some(alnum, n - 8), "uuid": lambda n: "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)),
    }


def test_formats_of_labelled_credentials_at_other_lengths(spark):
    rng = random.Random(11)
    made = credentials(rng)
    labelled = [f"{prose(rng, 20)} secret={make(40)} {prose(rng, 5)}" for make in made.values() for _ in range(60)]
    planted = [(k, n, make(n)) for k, make in made.items() for n in ((20, 28, 36, 43, 64) if k != "uuid" else (36,)) for _ in range(12)]
    texts = [prose(rng, 15) + f" {'NAME=' if i % 2 else ''}{t} " + prose(rng, 9) for i, (_, _, t) in enumerate(planted)]
    phones = [f"{prose(rng, 10)} 555-{rng.randrange(1000, 9999)} Verantwortung SSverenung THERHAOU www.example.com/en/page?id=17 2024-11-28 2024-11-28T10:11:12 order-id-{rng.randrange(10**8)} getElementById MAX_VALUE_SIZE {prose(rng, 10)}" for _ in range(50)]
    parts = ["an", "ber", "co", "der", "ent", "fa", "gra", "hin", "it", "jo", "ka", "lo", "men", "no", "ol", "per", "qui", "ra", "st", "tion"]
    ordinary = [" ".join("".join(rng.choices(parts, k=rng.randint(2, 5))) for _ in range(60)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts + labelled + phones + ordinary)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scanned(docs).collect()}
    found = lambda i: [got[i].text[s.start : s.end] for s in got[i].secrets if s.kind == "grammar"]
    missed = {}
    for i, (k, n, t) in enumerate(planted):
        base = any(s.kind == "hex" for s in got[i].secrets)
        missed.setdefault(k, []).append(not base and t not in found(i))
    assert {k: sum(v) for k, v in missed.items() if sum(v) > 0.1 * len(v)} == {}
    assert [t for i in range(len(texts) + len(labelled), len(got)) for t in found(i)] == []
    assert all(s.bits > 0 for i in range(len(texts), len(texts) + len(labelled)) for s in got[i].secrets if s.kind == "assign")


def test_no_label_no_format(spark):
    rng = random.Random(12)
    texts = [f"{prose(rng, 30)} {make(40)} {prose(rng, 5)}" for k, make in credentials(rng).items() if k != "hex" for _ in range(30)]
    got = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [s for r in got for s in r.secrets if s.kind != "assign"] == []


def test_secret_query_columns_by_hand(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in secrets.op2_secrets(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        t, r = d.text or "", got[d.doc_id]
        assign = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 8]
        access = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        hexes = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert (r.n_assign, r.n_access, r.n_hex) == (len(assign), len(access), len(hexes))
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(assign + access + hexes))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("grammar:")) == base
        assert len(r.bits) == len([x for x in r.spans.split(",") if x])
    assert sum(r.n_assign + r.n_hex for r in got.values()) > 0


def concentrated(x, start, core, floors):
    """Concentration steps from a subset until it settles: (log determinant, centre)."""
    at = start
    for _ in range(30):
        u, cov = x[at].mean(0), np.cov(x[at].T, bias=True) / 0.6 + np.diag(np.square(floors))
        d = np.einsum("ij,jk,ik->i", x - u, np.linalg.inv(cov), x - u)
        new = np.sort(np.argsort(d, kind="stable")[:core])
        if np.array_equal(new, at):
            break
        at = new
    return np.linalg.slogdet(cov)[1], u


def test_least_determinant_of_many_starts(spark):
    rng = np.random.default_rng(3)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        cov = np.diag([0.3, 0.2, 0.25, 0.2]) @ (np.eye(4) + 0.6 * (np.ones((4, 4)) - np.eye(4))) @ np.diag([0.3, 0.2, 0.25, 0.2])
        x = np.vstack([rng.multivariate_normal([1.6, 0.5, 0.5, 0.5], cov, 240), rng.normal(0, 0.03, (60, 4)) + [3.0, 1.5, 0.0, 1.2]])
        stats = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, x1 double, x2 double, x3 double, x4 double")
        r = quality.estimates(stats, ["g"]).first()
        best = min((concentrated(x, rng.choice(len(x), 5, replace=False), 225, quality.FLOOR) for _ in range(500)), key=lambda b: b[0])
        m = np.zeros((4, 4))
        for i, j in itertools.product(range(4), range(4)):
            if j <= i:
                m[i, j] = r[f"m_{i}{j}"]
        log_det = -2 * np.log(np.diag(m)).sum()
        assert abs(log_det - best[0]) < 0.35 and np.abs(np.array([r[f"u_x{k}"] for k in range(1, 5)]) - best[1]).max() < 0.05


def test_records_can_be_read_alone(spark, tmp_path):
    rng = random.Random(5)
    pages = [(2**62, "http://b.com/", "x" * 1500), (10**13, "http://b.com/", "x" * 1500), (1, "http://a.com/1", "y" * 5_000_000), (2, None, None), (None, "http://c.com", "z" * 1200), (None, "http://c.com", "z" * 1200), (3, "http://a.com/0", prose(rng, 400)), (4, "http://a.com/0", "q" * 1100), (4, "http://a.com/0", "q" * 1100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("target", F.lit(1)).withColumn("digest", F.lit("mine"))
    got = warc.captured(df, f"file://{tmp_path}/w").collect()
    assert len(got) == len(pages)
    for r in got:
        data = next((tmp_path / "w").glob(r.archive)).read_bytes()[r.offset : r.offset + r.length]
        record = gzip.decompress(data)
        assert zlib.decompressobj(wbits=31).decompress(data) == record
        assert f"WARC-Type: {r.record_type}\r\n".encode() in record and record.endswith(b"\r\n\r\n")
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 1500} == {(2**62, "response", None), (10**13, "revisit", 2**62)}
    assert [r.record_type for r in got if r.page_id == 4] == ["response", "response"]
    assert {r.archive for r in got} == {r.archive for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}


def test_one_long_page_makes_few_archives(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("http://a.com/").alias("url"), F.when(F.col("id") == 500, F.repeat(F.lit("0123456789"), 4_000_000)).otherwise(F.concat(F.lit("page "), F.repeat(F.col("id").cast("string"), 300))).alias("html"))
    got = warc.captured(df.coalesce(2), f"file://{tmp_path}/w").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got)[500] == (500, 40_000_000) and len(got) == 1000
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert 1 <= len(files) <= 8 and not list((tmp_path / "w").glob("part-*.txt"))
    whole = b""
    for f in files:
        assert subprocess.run(["gzip", "-t", f], capture_output=True).returncode == 0
        whole += subprocess.run(["gzip", "-dc", f], capture_output=True, check=True).stdout
    assert len(re.findall(rb"WARC-Type: response\r\n", whole)) == 1000


def test_archives_are_cut_by_running_size(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, None, "".join(rng.choices(string.ascii_letters, k=90_000 if i == 40 else 1000))) for i in range(80)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w", archive_bytes=20_000)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("*.warc.gz"))
    assert sizes[-1] > 60_000 and all(s <= 20_000 for s in sizes[:-1]) and len(sizes) <= 12


def test_hosts_of_many_labels(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "example.com/en/x"), (2, "http://" + "a." * 100_000 + "org/")], "page_id long, url string")
    got = {r.page_id: r for r in urls.judged(pages).collect()}
    assert (got[1].rule, got[1].verdict, got[2].rule) == ("example.com/en/", "block", None)


def test_components_of_any_kind_of_id(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "y"), (None, "a")]
    assert {(r.id, r.root) for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
