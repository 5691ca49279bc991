"""Quality rules with robust multivariate outliers. DataFrame functions only.

Counts are taken from each whole text with SQL functions.  Per language and
source the transformed counts get a minimum-covariance-determinant estimate
(concentration steps, each two grouped aggregations over the narrow table),
and documents far from it by Mahalanobis distance are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.scratch import Scratch
from tidewheel.llm.tables import Aside, table

BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Share of a group's documents that an estimate rests on, and concentration steps from each start.
CORE, STEPS = 0.75, 4
#: Order statistics are read from counts of bins: so wide for medians, and so many for each doubling of a distance.
MEDIAN_BIN, DISTANCE_BINS = 1.0 / 1024, 32
#: Squared distance of rejection: the chi-squared quantile of 4 degrees of freedom at 1 - 1e-12.
CUT = 62.0
#: Least standard deviation of each statistic, so that groups without any spread still have a scale:
#: of log word length, square roots of the symbol, duplicate-line and repeated-word shares.
FLOOR = (0.08, 0.03, 0.12, 0.12)
#: A group of fewer documents has no estimate of its own; it takes that of its language, or of all.
LEAST = 40
X = ("x1", "x2", "x3", "x4")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines; all 0 for null.

    Repeated 3-word windows: where the hashes of all windows are not distinct,
    they are sorted with their places, and those equal to a neighbour name the
    words.  Columns of these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_w", F.array_remove(F.split(whole, BLANK), ""))
    docs = docs.withColumn("_l", F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    docs = docs.withColumn("_h", F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))), 1, F.greatest(F.size("_w") - 2, F.lit(0))))
    docs = docs.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_any": F.size("_h") > F.size(F.array_distinct("_h")),
    })
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_s", F.when(F.col("_any"), pairs))
    h = lambda i: F.get("_s", i)["h"]
    twice = F.filter("_s", lambda x, i: (x["h"] == h(i - 1)) | (x["h"] == h(i + 1)))
    places = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    docs = docs.withColumn("n_repeat_words", F.when(F.col("_any"), F.size(places)).otherwise(0).cast("long"))
    return docs.drop("_w", "_l", "_h", "_any", "_s")


def _mean_and_cov(rows: DataFrame, by: list[str]) -> DataFrame:
    """Group means, covariances (with the floors) and count of x1..x4, from partial sums."""
    aggs = [F.count("*").alias("m")] + [F.avg(x).alias(f"u_{x}") for x in X]
    aggs += [F.covar_pop(a, b).alias(f"c_{a}{b}") for i, a in enumerate(X) for b in X[: i + 1]]
    return rows.groupBy(*by).agg(*aggs)


def _factors(groups: DataFrame, floors: tuple[float, ...] = FLOOR) -> DataFrame:
    """Adds m_ij, the inverse of the scatter's Cholesky factor, and the log of the determinant; one small step per column, so no expression repeats."""
    n = range(len(X))
    for i in n:
        for j in range(i + 1):
            v = F.col(f"c_{X[i]}{X[j]}") * F.col("scale")
            v = v + F.lit(floors[i] ** 2) if i == j else v
            for k in range(j):
                v = v - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            groups = groups.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l_{j}{j}"))
    for i in n:
        for j in range(i + 1):
            v = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                v = v - F.col(f"l_{i}{k}") * F.col(f"m_{k}{j}")
            groups = groups.withColumn(f"m_{i}{j}", v / F.col(f"l_{i}{i}"))
    groups = groups.withColumn("log_det", sum((F.log(f"l_{i}{i}") for i in n), F.lit(0.0)))
    return groups.drop(*[f"l_{i}{j}" for i in n for j in range(i + 1)])


FACTORS = [f"m_{i}{j}" for i in range(len(X)) for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns of ``_factors``."""
    total = F.lit(0.0)
    for i in range(len(X)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"m_{i}{j}") * (F.col(X[j]) - F.col(f"u_{X[j]}"))
        total = total + F.pow(z, F.lit(2.0))
    return total


def _at_share(counted: DataFrame, by: list[str], share: float) -> DataFrame:
    """The least bin of each group up to which ``share`` of its rows lie, from rows (by..., bin, n): one row for each bin, however many rows there were."""
    order = Window.partitionBy(*by).orderBy("bin")
    done = counted.withColumns({"upto": F.sum("n").over(order), "of": F.sum("n").over(Window.partitionBy(*by))})
    return done.where(F.col("upto") >= share * F.col("of")).groupBy(*by).agg(F.min("bin").alias("bin"))


def _medians(stats: DataFrame, by: list[str]) -> DataFrame:
    """Medians v_x of x1..x4 in each group, to ``MEDIAN_BIN``."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.floor(F.col(x) / MEDIAN_BIN).alias("bin")) for x in X])).alias("e")
    counted = stats.select(*by, each).groupBy(*by, "e.x", "e.bin").agg(F.count("*").alias("n"))
    middle = _at_share(counted, [*by, "x"], 0.5).withColumn("v", (F.col("bin") + 0.5) * MEDIAN_BIN)
    return middle.groupBy(*by).agg(*[F.max(F.when(F.col("x") == x, F.col("v"))).alias(f"v_{x}") for x in X])


def estimates(stats: DataFrame, by: list[str], core: float = CORE, steps: int = STEPS) -> DataFrame:
    """One row of location and scatter for each group of ``stats``: the minimum covariance determinant.

    Three starts, all from the medians: distances by the whole group's covariance, by its
    variances alone, and by the floors alone.  From each, concentration steps: the share ``core`` of least distance
    (by counts of bins, so to 2 percent of a distance) gives the next estimate, whose
    determinant can't be larger.  The start that ends with the least determinant is taken.
    Every step aggregates with partial sums and stores one row a group before that is joined to the
    narrow table, so no group is ever in one task as a whole.  Nothing is drawn at random or depends on the partitioning.
    """
    work = Scratch(stats.sparkSession)
    # The scatter of the inner part is that of a truncated normal: widened to the full one (four dimensions).
    widen = 1.0 / 0.6 if core < 0.9 else 1.0
    now = _mean_and_cov(stats, by).join(_medians(stats, by).withColumnsRenamed({k: f"_{k}" for k in by}), [F.col(k) == F.col(f"_{k}") for k in by])
    now = now.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    share = lambda a, b: F.when((F.col("start") == 0) | ((F.col("start") == 1) & F.lit(a == b)), F.col(f"c_{a}{b}")).otherwise(0.0)
    now = now.select(*by, "start", *[F.col(f"v_{x}").alias(f"u_{x}") for x in X], *[share(a, b).alias(f"c_{a}{b}") for i, a in enumerate(X) for b in X[: i + 1]], F.lit(1.0).alias("scale"))
    keys = [*by, "start"]
    for i in range(steps):
        now = work.store(_factors(now), f"mcd{i}")
        at = stats.join(now, by).withColumn("bin", F.floor(F.log2(_distance() + F.lit(2.0**-20)) * DISTANCE_BINS))
        counted = work.store(at.groupBy(*keys, "bin").agg(F.count("*").alias("n")), f"bins{i}")
        cut = work.store(_at_share(counted, keys, core).join(now, keys), f"cut{i}")
        inner = stats.join(cut.withColumnRenamed("bin", "top"), by).where(F.floor(F.log2(_distance() + F.lit(2.0**-20)) * DISTANCE_BINS) <= F.col("top"))
        now = _mean_and_cov(inner, keys).withColumn("scale", F.lit(widen))
    now = work.store(_factors(now), "mcd")
    best = now.groupBy(*by).agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    out = work.store(now.join(best, keys).select(*by, *[f"u_{x}" for x in X], *FACTORS), "estimates")
    work.release(*[f"{n}{i}" for i in range(steps) for n in ("mcd", "bins", "cut")], "mcd")
    return out


def judged(docs: DataFrame, text: str = "text", cut: float = CUT, with_text: bool = True, lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with the counts, base_failed, distance2 and kept; without the text, if so asked.

    The counted table is written once to the shared folder, so each text is gone through once.

    A null or empty text has counts of 0 and fails the base rule; texts of any length are counted whole.  Null
    languages and sources are groups like any other.  Groups of fewer than ``LEAST``
    documents that pass the base rule use the estimate of their language, or of all.  Only the side of
    much symbols, repeated lines or repeated words, and odd word lengths of either
    side, count as far.  An empty table stays empty; ties and repeated rows
    are judged alike.  Columns with the names of the result are replaced, others may have any name.
    """
    work = Scratch(docs.sparkSession)
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept")
    held = Aside(docs, made)
    cols = [c for c in held.df.columns if with_text or c != held.of(text)]
    counted = with_counts(held.df, held.of(text))
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(held.of(c)).cast("string")), F.lit(""))
    counted = counted.select(*cols, group(lang).alias("g1"), group(source).alias("g2"), *made[:5], "n_lines")
    counted = work.store(counted, "counted")
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    counted = counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counted = counted.withColumns({
        "x1": F.log(chars / n),
        "x2": F.sqrt(F.col("n_symbols") / chars),
        "x3": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        "x4": F.sqrt(F.col("n_repeat_words") / n),
    })
    # Each document counts for its language and source, for its language, and for all.
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col("g1") if k else F.lit("")).alias("g1"), (F.col("g2") if k > 1 else F.lit("")).alias("g2")) for k in (2, 1, 0)])).alias("g")
    stats = work.store(counted.where("not base_failed").select(levels, *X).select("g.*", *X), "stats")
    by = ["level", "g1", "g2"]
    sizes = work.store(stats.groupBy(*by).agg(F.count("*").alias("size")), "sizes")
    enough = sizes.where((F.col("size") >= LEAST) | (F.col("level") == 0)).select(*by)
    fields = [f"u_{x}" for x in X] + FACTORS
    # Stored, so that every sum over it is taken before rows are dealt out by group.
    fine = work.store(stats.join(enough, by, "left_semi"), "fine")
    found = estimates(fine, by).select(*by, F.struct(*fields).alias("e"))
    ways = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col("own1") if k else F.lit("")).alias("g1"), (F.col("own2") if k > 1 else F.lit("")).alias("g2")) for k in (2, 1, 0)])).alias("g")
    est = sizes.where("level = 2").select(F.col("g1").alias("own1"), F.col("g2").alias("own2")).select("own1", "own2", ways).select("own1", "own2", "g.*")
    est = est.join(found, by).groupBy("own1", "own2").agg(F.max_by("e", "level").alias("e"))
    est = work.store(est.select(F.col("own1").alias("g1"), F.col("own2").alias("g2"), "e.*"), "of_group")
    work.release("stats", "fine", "sizes", "estimates")
    both = counted.join(est, ["g1", "g2"], "left")
    # Cleaner than the centre is not odd: only word length counts on both sides.
    both = both.withColumns({x: F.greatest(F.col(x), F.coalesce(F.col(f"u_{x}"), F.col(x))) for x in X[1:]})
    both = both.withColumn("distance2", F.when(~F.col("base_failed"), _distance()))
    both = both.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cut))
    return held.back(both, *made, without=None if with_text else text)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every row of ``documents``. Nulls, ties and repeats as in ``judged``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs, with_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
