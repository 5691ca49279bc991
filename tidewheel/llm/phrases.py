"""Phrase collocations. DataFrame functions only.

Texts are cut into pieces of words once.  Every n-gram of a piece becomes a row, and rows are counted per language.
A phrase cannot be counted often unless both phrases of one word less in it are, so only such places are looked at.  Where most phrases
are rare, hashes alone are counted first, and what passes is counted again, exactly, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.marks import Marks
from tidewheel.llm.scratch import Scratch
from tidewheel.llm.tables import table

#: Words of a phrase, occurrences, share (percent) of them in a longer phrase from which a phrase is dropped, and phrases of a language.
MAX_N, LEAST, PERCENT, FIRST = 3, 10, 50, 2000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENDS = "[.,;:!?\\x0A-\\x0D]"
#: Parts into which a language is cut before its first phrases are ranked.
PARTS = 32
#: Counts are decimals in scores: a * a * 10**6 has 36 digits at most.
COUNT = "decimal(15,0)"


def pieces_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, piece) for every piece with a word: its words in lower case (A-Z alone), one space between them."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Without other letters than ASCII ones, the plain lower() does the same.
    low = F.when(whole.rlike("[^\\x00-\\x7F]"), F.translate(whole, UPPER, UPPER.lower())).otherwise(F.lower(whole))
    cut = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.explode(F.split(low, ENDS)).alias("piece"))
    odd = F.contains("piece", F.lit("\t")) | F.contains("piece", F.lit("  "))
    piece = F.trim(F.when(odd, F.regexp_replace("piece", "[ \\t]+", " ")).otherwise(F.col("piece")))
    return cut.select("lang", piece.alias("piece")).where("piece <> ''")


def placed(pieces: DataFrame, n: int) -> DataFrame:
    """(lang, words, i): the places i from 0 where ``n`` words of the piece start."""
    words = pieces.select("lang", F.split("piece", " ").alias("words")).where(F.size("words") >= n)
    return words.select("lang", "words", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("i"))


def gram(at: Column, n: int) -> Column:
    """A hash of the language and the ``n`` words from place ``at`` on."""
    return F.xxhash64("lang", *[F.get("words", at + k) for k in range(n)])


def told(pieces: DataFrame, n: int, shorter: Marks | None) -> DataFrame:
    """``placed``, without places where a part of one word less isn't marked in ``shorter``."""
    rows = placed(pieces, n)
    if shorter is not None:
        rows = shorter.passed(rows, gram(F.col("i"), n - 1), "front")
        rows = shorter.passed(rows, gram(F.col("i") + 1, n - 1), "back")
    return rows


def often(phrases: DataFrame, least: int, *keys: str) -> DataFrame:
    return phrases.groupBy(*keys).agg(F.count("*").alias("f")).where(F.col("f") >= least)


def counted(pieces: DataFrame, max_n: int, least: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f): all phrases of up to ``max_n`` words with ``least`` occurrences or more, counted by their text; and
    (lang, total): the words of each language.

    Single words are few and counted as they are.  Two words next to each other are mostly rare: their hashes alone are counted first, and those with a
    frequent hash then as text, like every number of words between.  The longest phrases are counted as text at once, where both their parts passed.
    """
    words = work.store(pieces.select("lang", F.explode(F.split("piece", " ")).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("f")), "words")
    found = words.where(F.col("f") >= least).select("lang", F.lit(1).alias("n"), "phrase", "f")
    marks = Marks(found.select(F.xxhash64("lang", "phrase").alias("h"))) if max_n > 1 else None
    for n in range(2, max_n + 1):
        if n == 2 or n < max_n:
            hashes = often(told(pieces, n, marks).select(gram(F.col("i"), n).alias("h")), least, "h").select("h")
            marks = Marks(work.store(hashes, f"level{n}"))
            rows = marks.passed(placed(pieces, n), gram(F.col("i"), n), "gram")
        else:
            rows = told(pieces, n, marks)
        rows = rows.select("lang", F.concat_ws(" ", *[F.get("words", F.col("i") + k) for k in range(n)]).alias("phrase"))
        own = work.store(often(rows, least, "lang", "phrase"), f"counted{n}")
        found = found.unionByName(own.select("lang", F.lit(n).alias("n"), "phrase", "f"))
    return found, work.store(words.groupBy("lang").agg(F.sum("f").alias("total")), "sizes")


def score_of(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exactly: products are decimals of up to 38 digits."""
    a, l, r = (c.cast(COUNT) for c in (a, l, r))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST, percent: int = PERCENT, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of 2 to ``max_n`` words by score.

    a, l and r count the phrase and its two parts at the cut of the lowest score, n all words of the language.  Phrases that
    lie in a longer one with ``percent`` percent of their occurrences or more are dropped.  Null texts are empty and null languages ``und``;
    repeated rows count each time, and texts of any length whole.  A language without a phrase gives no rows, and an empty table none.
    Other columns are ignored, whatever their names.
    """
    work = Scratch(docs.sparkSession)
    pieces = work.store(pieces_of(docs, text, lang), "pieces")
    # Sums that are joined are stored first: then Spark can split a hot part among tasks.
    f, sizes = counted(pieces, max_n, least, work)
    cut = f.where("n > 1").select("lang", "phrase", "n", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    words = F.split("phrase", " ")
    cut = cut.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("front"), F.array_join(F.slice(words, F.col("k") + 1, F.col("n")), " ").alias("back"))
    part = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = work.store(cut.join(part("front", "l"), ["lang", "front"]), "fronts").join(part("back", "r"), ["lang", "back"])
    scored = cut.withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    # A phrase of two words more holds one of one word more, which occurs as often at least: extensions by one word are enough.
    inner = f.where("n > 2").select("lang", "f", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("n") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("n") - 1), " "))).alias("phrase"))
    inner = work.store(inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer")), "inner")
    scored = work.store(scored, "scored").join(inner.where("longer > 0"), ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {percent} * a").drop("longer")
    order = [F.col("low.score").desc(), F.col("a").desc(), F.col("phrase")]
    # First the best of each of a language's parts, so that the last task of a language holds that many lists at most.
    spread = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    over = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = work.store(spread.withColumn("rank", over("lang", "part")).where(F.col("rank") <= first).drop("rank", "part"), "best")
    work.release("pieces", "words", "fronts", "inner", "scored", *[f"{name}{n}" for name in ("level", "counted") for n in range(2, max_n + 1)])
    ranked = best.withColumn("rank", over("lang")).where(F.col("rank") <= first).join(sizes.select(F.col("lang").alias("_lang"), "total"), F.col("lang") == F.col("_lang"))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("total").alias("n"), F.col("low.score").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two and three words of each language of ``documents``. Nulls, ties and repeats as in ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, unnest([ws[i : i + k - 1] for i in range(1, len(ws) - k + 2)]) AS gram FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k
), f AS (
  SELECT lang, k, gram, array_to_string(gram, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL
), c AS (
  SELECT lang, k, gram, phrase, f AS a FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.*, part, array_to_string(gram[1:part], ' ') AS front, array_to_string(gram[part + 1:], ' ') AS back FROM c, (SELECT unnest([1, 2]) AS part) WHERE part < k
), s AS (
  SELECT cuts.*, x.f AS l, y.f AS r, ((a::HUGEINT * a * 1000000) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = front JOIN f y ON y.lang = cuts.lang AND y.phrase = back
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, part) = 1
), kept AS (
  SELECT * FROM low WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = low.lang AND c.k > low.k AND contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' ') AND 100 * c.a >= 50 * low.a)
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
"""
