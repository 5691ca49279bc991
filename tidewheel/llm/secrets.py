"""Secret scans with grammar inference.

Patterns find labelled credentials in every whole text.  A bounded sample of them is
sorted by the characters they are made of; for each such shape the states of a prefix tree are merged where their statistics
agree (ALERGIA), which gives a probabilistic automaton, and so for ordinary
tokens.  Every candidate, the patterns' own matches too, is then scored by the likelihood of its format.  Nothing but the
labelled credentials of the table says what a format is.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.scratch import Scratch
from tidewheel.llm.tables import Aside, table

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: The part of a token after its last "=" that is not padding: the value of an unquoted name=value.
VALUE = re.compile(r"=([^=]{8,}=*)$")
KINDS = ("assign", "access", "hex")
ADDED, ORDINARY = "grammar", "ordinary"
#: Strings of each kind that an automaton is fitted on, those of the least hash.
FIT = 400
#: Share of wrongly refused merges.
ALPHA = 0.05
#: Probability of a class that a state has never seen: credentials have strict formats, ordinary tokens vary.
STRICT, LOOSE = 1e-6, 1e-3
#: Ordinary tokens are more varied, so more of them are fitted: occurrences, so that a token counts as often as it is met.
FIT_ORDINARY = 6000
#: Credentials that make a shape of their own; rarer shapes are joined where their letters agree.
SHAPED = 8
#: How many standard errors a token's mean may lie below that of held-out credentials, least odds against ordinary text in bits a
#: character, and least odds in all: one ordinary token in a million is as likely as that by chance.
ERRORS, LEAST_BITS, LEAST_ODDS = 3.0, 0.5, 20.0
#: How often the ordinary tokens are fitted again without those that a shape explains better.
ROUNDS = 2
#: Tokens with so many occurrences in the sample are ordinary.
COMMON = 3
#: From twice so many examples on, half of them are held out to set the threshold.
HELD = 20
#: Character classes and their sizes; any other character of a token is its own class.
CLASSES = (("abcdef", "a"), ("ghijklmnopqrstuvwxyz", "g"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), ("0123456789", "0"))
CLASS_OF = str.maketrans({c: k for cs, k in CLASSES for c in cs})
BITS = {k: math.log2(len(cs)) for cs, k in CLASSES}


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, credential) of the patterns' matches, in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def other_tokens(text: str, base: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, token) of tokens outside all base spans; of a name=value the value too, after the whole."""
    k, reach = 0, 0
    for m in TOKEN.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if m.start() >= reach:
            yield m.start(), m.end(), m[0]
            if "=" in m[0] and (v := VALUE.search(m[0])):
                yield m.start() + v.start(1), m.end(), v[1]


def shape(credential: str) -> tuple[str, str, str]:
    """What a credential is made of: the letters (by the narrowest alphabet), its other characters but digits, and what stands before the first of them."""
    made = set(credential.translate(CLASS_OF))
    letters = "hex" if not made & {"g", "A"} else "lower" if "A" not in made else "upper" if not made & {"a", "g"} else "mixed"
    symbols = "".join(sorted(made - {"a", "g", "A", "0"}))
    return letters, symbols, re.split("[^A-Za-z0-9]", credential)[0] if symbols else ""


def shaped(labelled: dict[str, dict[str, int]]) -> dict[tuple[str, str, str], list[str]]:
    """The labelled credentials of all kinds by shape, each once.

    Of shapes with fewer than ``SHAPED`` credentials what stands first is left out of account, then the symbols ("*"); what is still rare goes.
    """
    by: dict[tuple[str, str, str], list[str]] = defaultdict(list)
    for s in dict.fromkeys(s for k in KINDS for s in labelled.get(k, ())):
        by[shape(s)].append(s)
    for wider in (lambda k: (k[0], k[1], "*"), lambda k: (k[0], "*", "*")):
        joined: dict[tuple[str, str, str], list[str]] = defaultdict(list)
        for k, v in sorted(by.items()):
            joined[k if len(v) >= SHAPED else wider(k)] += v
        by = joined
    return {k: v for k, v in by.items() if len(v) >= SHAPED}


class Automaton:
    """A probabilistic automaton over character classes; how long its strings are is what its states' ends say."""

    def __init__(self, strings: Iterable[str], unseen: float = STRICT, alpha: float = ALPHA, times: dict[str, int] | None = None):
        self.unseen = unseen
        self.n, self.end, self.to, self.seen = [0], [0], [{}], [{}]
        for s in strings:
            q, k = 0, times[s] if times else 1
            for c in s.translate(CLASS_OF):
                self.n[q] += k
                self.seen[q][c] = self.seen[q].get(c, 0) + k
                if c not in self.to[q]:
                    self.to[q][c] = len(self.n)
                    for x, v in ((self.n, 0), (self.end, 0), (self.to, {}), (self.seen, {})):
                        x.append(v)
                q = self.to[q][c]
            self.n[q] += k
            self.end[q] += k
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _differ(self, fa: int, na: int, fb: int, nb: int) -> bool:
        return abs(fa / na - fb / nb) > self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states and all that follows them are statistically compatible (Hoeffding's bound)."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.n[a], self.n[b]
            if self._differ(self.end[a], na, self.end[b], nb):
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if self._differ(self.seen[a].get(c, 0), na, self.seen[b].get(c, 0), nb):
                    return False
                if c in self.to[a] and c in self.to[b]:
                    todo.append((self.to[a][c], self.to[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the subtree of b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            for c, k in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + k
                if c in self.to[a]:
                    todo.append((self.to[a][c], self.to[b][c]))
                else:
                    self.to[a][c] = self.to[b][c]

    def _merge_states(self) -> None:
        kept = [0]
        while True:
            # The most frequent state next to the kept ones is judged next: its statistics are the surest.
            fringe = [(q, c) for q in kept for c in sorted(self.to[q]) if self.to[q][c] not in kept]
            if not fringe:
                return
            q, c = max(fringe, key=lambda x: (self.n[self.to[x[0]][x[1]]], -x[0]))
            new = self.to[q][c]
            for old in kept:
                if self._alike(old, new):
                    self.to[q][c] = old
                    self._fold(old, new)
                    break
            else:
                kept.append(new)

    def steps(self, token: str) -> tuple[list[float], float]:
        """log2 of the probability of each character of the token, and of its end after them.

        An end that a state has never seen counts half, so other lengths than those of the examples are unlikely and not impossible.
        """
        q, out = 0, []
        for c in token.translate(CLASS_OF):
            p = self.seen[q].get(c, 0) / self.n[q] if self.n[q] else 0
            out.append(math.log2(max(p, self.unseen)) - BITS.get(c, 0.0))
            q = self.to[q].get(c, q)
        return out, math.log2(max(self.end[q], 0.5) / (self.n[q] + 1))

    def bits(self, token: str) -> float:
        """log2 of the token's probability."""
        path, end = self.steps(token)
        return sum(path) + end


class Grammar:
    """Automata of the shapes of labelled credentials against that of ordinary tokens."""

    def __init__(self, labelled: dict[str, dict[str, int]]):
        self.shapes: dict[tuple[str, str, str], Automaton] = {}
        self.fits: dict[tuple[str, str, str], tuple[float, float]] = {}
        for name, examples in shaped(labelled).items():
            # Every other example fits the automaton, the rest say how likely fresh ones are; few examples do both.
            apart = len(examples) >= 2 * HELD
            made = Automaton(examples[::2] if apart else examples)
            paths = [made.steps(s)[0] for s in (examples[1::2] if apart else examples)]
            means = [sum(p) / len(p) for p in paths]
            mean = sum(means) / len(means)
            # Spread of a character's bits: within strings, or between them if that is more.
            within = sum((x - mean) ** 2 for p in paths for x in p) / sum(map(len, paths))
            between = sum((m - mean) ** 2 * len(p) for m, p in zip(means, paths, strict=True)) / len(means)
            self.shapes[name], self.fits[name] = made, (mean, math.sqrt(max(within, between)))
        ordinary = labelled.get(ORDINARY) or {"": 1}
        self.rest = Automaton(ordinary, LOOSE, times=ordinary)
        # Unlabelled credentials among the ordinary tokens would teach the automaton of ordinary ones what they look like: rare
        # tokens that a shape explains better are taken out.
        for _ in range(ROUNDS):
            kept = {t: n for t, n in ordinary.items() if n >= COMMON or not any(self.likeliest(x) > self.rest.bits(x) for x in (t, *VALUE.findall(t)))} or {"": 1}
            self.rest = Automaton(kept, LOOSE, times=kept)
        self.known: dict[str, float | None] = {}

    def likeliest(self, token: str) -> float:
        """log2 of the token's probability in the likeliest of the shapes in which it is as likely as their own credentials, for its length; else minus infinity."""
        best, n = -math.inf, max(1, len(token))
        for name, made in self.shapes.items():
            mean, spread = self.fits[name]
            path, end = made.steps(token)
            if sum(path) / n >= mean - ERRORS * spread / math.sqrt(n):
                best = max(best, sum(path) + end)
        return best

    def odds(self, token: str) -> float:
        """Bits a character by which the token's likeliest shape explains it better than ordinary text does."""
        most = max((a.bits(token) for a in self.shapes.values()), default=0.0)
        return (most - self.rest.bits(token)) / max(1, len(token))

    def score(self, token: str) -> float | None:
        """The odds of a token that some shape accepts and that is less likely as an ordinary one, else null."""
        if token not in self.known:
            n, best = max(1, len(token)), self.likeliest(token)
            odds = best - self.rest.bits(token) if best > -math.inf else -math.inf
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[token] = odds / n if odds >= max(LEAST_ODDS, LEAST_BITS * n) else None
        return self.known[token]

    def accepts(self, token: str) -> bool:
        return self.score(token) is not None


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) >> 1


def labelled_sample(docs: DataFrame, text: str = "text", fit: int = FIT, fit_ordinary: int = FIT_ORDINARY) -> dict[str, dict[str, int]]:
    """For each kind the ``fit`` different strings of least hash in the whole table, and other tokens with their counts in a sample of ``fit_ordinary`` occurrences (those of least hash of token and text)."""
    most = dict.fromkeys(KINDS, fit) | {ORDINARY: fit_ordinary}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, set[tuple[int, str]]] = {k: set() for k in (*KINDS, ORDINARY)}
            for t in batch.column(0).to_pylist():
                base, seed = base_spans(t or ""), _hash(t or "")
                for _, k, _, secret in base:
                    held[KINDS[k]].add((_hash(secret), secret))
                held[ORDINARY] |= {(xxhash.xxh64_intdigest(token, seed) >> 1, token) for _, _, token in other_tokens(t or "", base)}
            rows = [(k, s, h) for k, v in held.items() for h, s in sorted(v)[: most[k]]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], (pa.string(), pa.string(), pa.int64())[i]) for i in range(3)], ["kind", "token", "hash"])

    work = Scratch(docs.sparkSession)
    found = work.store(docs.select(F.col(f"`{text}`")).mapInArrow(run, "kind string, token string, hash long").distinct(), "labelled")
    sample = {k: dict(Counter(r.token for r in found.where(F.col("kind") == k).orderBy("hash", "token").limit(most[k]).select("token").collect())) for k in (*KINDS, ORDINARY)}
    work.release("labelled")
    return sample


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("bits", T.DoubleType())]))


def found_in(text: str, model: Grammar) -> list[dict]:
    """The spans of one text, by start and then kind."""
    base = base_spans(text)
    found = [(s, k, e, model.odds(secret)) for s, k, e, secret in base]
    reach = 0
    for s, e, token in other_tokens(text, base):
        bits = model.score(token)
        if bits is None:
            continue
        if s >= reach:
            found.append((s, len(KINDS), e, bits))
            reach = e
        else:  # of a name=value the whole comes first, and the value counts if it is one by itself
            found[-1] = (s, len(KINDS), e, bits)
    return [{"kind": (*KINDS, ADDED)[k], "start": s, "end": e, "bits": bits} for s, k, e, bits in sorted(found)]


def scanned(docs: DataFrame, text: str = "text", grammar: Grammar | None = None) -> DataFrame:
    """``docs`` with ``secrets``: spans (kind, start, end, bits) in code points, by start and then kind.

    Base spans are those of the patterns; the automata add tokens of 8 characters or more
    outside them, of kind "grammar".  Every span has its score: the bits a character by which its likeliest shape explains it better than
    ordinary text does (without any labelled credential, against a chance of one).  Null and empty texts have
    none, texts of any length are scanned whole, and repeated rows alike; a column named secrets is replaced, others may have any name; an empty table stays empty.  The
    automata are small: fitted on at most ``FIT`` strings of each kind and ``FIT_ORDINARY`` occurrences of others, those of least hash.
    """
    spark = docs.sparkSession
    held = Aside(docs, ("secrets",))
    at = held.of(text)
    shared = spark.sparkContext.broadcast(grammar or Grammar(labelled_sample(held.df, at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
        for batch in batches:
            out = [found_in(t or "", model) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "secrets"])

    return held.back(held.df.mapInArrow(run, T.StructType([*held.df.schema.fields, T.StructField("secrets", SPAN)])), "secrets")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every row of ``documents``, and the score of each (``bits``, in the order of ``spans``). Nulls, ties and repeats as in ``scanned``."""
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["kind"] != ADDED)
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), F.transform("secrets", lambda x: F.round(x["bits"], 6)).alias("bits"))
