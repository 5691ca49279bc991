"""Phrases against a loop over all texts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import marks, phrases

SCHEMA = "doc_id long, text string, lang string"


def rows():
    rng = random.Random(3)
    words = ["The", "river", "RUNS", "é", "É", "ab-c", "x'y", "und", "a" * 90, "İ", "日本"]
    text = lambda n: "".join(rng.choice(words[: rng.choice([3, 11])]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "!? "]) for _ in range(n))
    out = [(i, text(rng.randint(0, 60)), rng.choice(["en", "de", None, "und"])) for i in range(150)]
    out += [(200, None, "en"), (201, "", "de"), (202, " \t,.\n", None), (203, "the river runs " * 4000, "en"), (204, "of a of a of a of a of a of a of a", "fr"), (None, "the river", "en")]
    return out + [out[3]] * 4


def brute(rows, max_n, least, percent, first):
    by = {}
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            f = by.setdefault(lang or "und", Counter())
            f.update(tuple(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    out = []
    for lang, f in by.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in often.items():
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            if not any(100 * b >= percent * a and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in often.items()):
                found.append((-score, -a, " ".join(g).encode(), a, f[g[:k]], f[g[k:]], n, score))
        out += [(lang, i + 1, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(found)[:first])]
    return sorted(out)


@pytest.mark.parametrize(("max_n", "least", "percent", "first"), [(3, 10, 50, 2000), (4, 3, 70, 5), (2, 2, 50, 40)])
def test_same_as_loop(spark, max_n, least, percent, first):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3).select("*", *[F.lit(1).alias(c) for c in ("n", "a", "phrase", "words", "h", "a.b")])
    got = phrases.collocations(df, max_n=max_n, least=least, percent=percent, first=first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows(), max_n, least, percent, first)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 8


def test_full_map_of_bits_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(marks, "MARKS", 64)
    got = phrases.collocations(spark.createDataFrame(rows(), SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute(rows(), 3, 10, 50, 2000)


def test_scores_pass_64_bits(spark):
    a, l, r = 4_000_000_000, 5_000_000_000, 8_000_000_001
    row = spark.range(1).select(*[F.lit(x).cast(phrases.COUNT).alias(c) for x, c in ((a, "a"), (l, "l"), (r, "r"))])
    assert row.select(phrases.score_of(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * a * a // (l * r)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], SCHEMA)).count() == 0


def test_only_middle_lengths_are_laid_out_twice(spark, monkeypatch):
    """Single words and the longest phrases are counted in one pass over the pieces."""
    passes = Counter()
    placed = phrases.placed
    monkeypatch.setattr(phrases, "placed", lambda pieces, n: passes.update([n]) or placed(pieces, n))
    got = phrases.collocations(spark.createDataFrame(rows(), SCHEMA), max_n=4, least=3, percent=70, first=5)
    assert sorted(map(tuple, got.collect())) == brute(rows(), 4, 3, 70, 5) and passes == {2: 2, 3: 2, 4: 1}
