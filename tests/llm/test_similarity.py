"""Candidates for set similarity against all pairs."""

import random
from itertools import combinations

from tidewheel.llm.scratch import Scratch
from tidewheel.llm.similarity import far_pairs


def sets():
    """Templates with changed fields, near copies of them, subsets, small sets and strangers."""
    rng = random.Random(5)
    out = []
    for k in range(12):
        base = set(range(1000 * k, 1000 * k + rng.choice([6, 40, 90])))
        for j in range(14):
            kept = set(rng.sample(sorted(base), round(len(base) * rng.choice([1, 0.95, 0.9, 0.8, 0.6]))))
            out.append(kept | {10**6 + 100 * (20 * k + j) + x for x in range(rng.choice([0, 1, 3, round(len(base) * 0.4)]))})
    return list(enumerate([s for s in out if s]))


def test_counted_meetings_lose_no_link_and_drop_pairs(spark):
    rows = sets()
    at = spark.createDataFrame([(i, i, sorted(s), len(s)) for i, s in rows], "id long, root long, s array<long>, n int").repartition(3)
    plain = {tuple(sorted((r.id, r.o))) for r in far_pairs(at, 80, Scratch(spark)).collect()}
    found = [tuple(sorted((r.id, r.o))) for r in far_pairs(at, 80, Scratch(spark), ends=True).collect()]
    alike = {(a, b) for (a, s), (b, t) in combinations(rows, 2) if 100 * len(s & t) >= 80 * len(s | t)}
    assert len(found) == len(set(found)) and alike <= set(found) <= plain
    assert len(alike) > 50 and len(found) < len(plain)
