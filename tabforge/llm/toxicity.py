"""Toxic passages by maximum-scoring segments of token log-odds, with extreme-value calibration.

Fitting uses a bounded sample of labelled rows (``MAX_ROWS`` a label, the ids of smallest hash).  All of them give the words; for the
calibration each half of them is judged by words from the other half.  ``Z`` and ``POWER`` were chosen by three-fold cross-validation
inside fit rows alone.  A token is a word with its beginnings of 3 to 6 letters, so inflected forms share evidence.  The
numbers of texts with each by label, summed in Spark, give log-odds with an informative Dirichlet prior: ``PRIOR`` of the number in both labels
together.  Each piece's log-odds, of either sign, are shrunk by their standard error: at ``Z`` of them half is left, more above and less
below, and none is cut.  A token scores its strongest piece's shrunk log-odds less a
constant drift, and an unknown token minus the drift, so clean text drifts down; a drift of 1 keeps a language or a topic with up to e times the
odds of others from being evidence by its own words.  In a text a linear scan finds all
maximal scoring segments: each is a run whose score no extension raises and that overlaps no other.  For clean text the best
segment follows an extreme-value law: its decay is the positive root of E exp(decay * score) = 1 over the other half's clean tokens, its
location is fitted on the same texts; the two halves' values are averaged.  A segment's evidence is decay * score - ln(K * length); significant ones (over 0) are
passages.  A logistic curve in the best evidence and the sum of significant evidence gives the score.

Scoring is one narrow map over whole texts with a bounded word list.  Null and empty texts have no evidence; without
labels of both kinds the score is the share of label 1 (0 without any); several labels of an id count as the largest;
repeated rows are scored each; result columns replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import fresh, id_bucket, one_label, quoted, ship, whole, without
from tabforge.llm.quality import fit_curve
from tabforge.session import cut_lineage

MAX_ROWS, Z, POWER, PRIOR, DRIFT, KEEP_WORDS = 6000, 2.0, 6, 0.1, 1.0, 500_000
#: pieces weaker than this are no entry in the model: they would move a token's score by less than a hundredth of the drift
TRACE = 0.01
TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return TOKEN.findall(text.lower())


def pieces(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [word, *(word[:k] + "-" for k in range(3, min(6, len(word)) + 1))]


class Lexicon(dict):
    """Log-odds of words by their strongest piece, 0 for none; words met are kept up to a bound."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> float:
        s = max((self.scores.get(p, 0.0) for p in pieces(word)), key=abs, default=0.0)
        if len(self) < KEEP_WORDS:
            self[word] = s
        return s


def segments(score: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text whose tokens score -drift but for the given
    (position, score) ones, in order; linear, as each left end is found along the stack's links to smaller ones."""
    stack: list[list[float]] = []  # first, last, total before the segment, total with it, nearest earlier one with a smaller total before
    total, at = 0.0, 0
    for place, gain in score:
        total -= drift * (place - at)
        at = place + 1
        if gain <= 0:
            total += gain
            continue
        new = [place, place, total, total + gain]
        total += gain
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= new[2]:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= new[3]:
                stack.append([*new, k])
                break
            new, at_left = [stack[k][0], new[1], stack[k][2], new[3]], stack[k][4]
            del stack[k:]
            k = at_left
    return [(int(a), int(b), right - left) for a, b, left, right, _ in stack]


@dataclass(frozen=True)
class Model:
    words: dict
    decay: float
    location: float
    weights: tuple[float, ...]
    offset: float

    @cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon(self.words)

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens; (first token, last token, evidence) of each maximal segment."""
        toks, score = tokens(text), self.lexicon
        hits = [(k, s - DRIFT) for k, w in enumerate(toks) if (s := score[w])]
        cost = self.location + math.log(max(1, len(toks)))
        return len(toks), [(a, b, self.decay * s - cost) for a, b, s in segments(hits, DRIFT)]

    def inputs(self, text: str) -> tuple[float, float, float]:
        """Best evidence (kept within -20 .. 20), log of one more than the significant evidence, of the number of segments."""
        return self.judged(text)[0]

    def judged(self, text: str) -> tuple[tuple[float, float, float], int]:
        """The curve's inputs, and the number of significant passages."""
        _, found = self.passages(text)
        best = max((e for *_, e in found), default=-20.0)
        x = min(20.0, max(-20.0, best)), math.log1p(sum(max(0.0, e) for *_, e in found)), math.log1p(len(found))
        return x, sum(e > 0 for *_, e in found)

    def measured(self, text: Column) -> Column:
        """The curve's inputs of a column of texts."""
        model = self

        @F.pandas_udf("array<double>")
        def inputs(texts: pd.Series) -> pd.Series:
            return pd.Series([list(map(float, model.inputs(t))) for t in texts], dtype=object)

        return inputs(text)

    def score(self, docs: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
        """``docs`` with score, predicted and n_passages (the number of significant ones)."""
        ship(docs.sparkSession)
        model = self

        @F.pandas_udf("score double, n_passages int")
        def judge(texts: pd.Series) -> pd.DataFrame:
            seen = [model.judged(t) for t in texts]
            x = np.array([inputs for inputs, _ in seen]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights or (0, 0, 0)) + model.offset, -50, 50)))
            return pd.DataFrame({"score": p, "n_passages": np.array([n for _, n in seen], "int32")})

        kept = without(docs, "score", "predicted", "n_passages")
        verdict, = fresh(docs, "verdict")
        judged = docs.select(*[quoted(c) for c in kept], judge(whole(text)).alias(verdict))
        return judged.select(*[quoted(c) for c in kept], f"{verdict}.*", (F.col(f"{verdict}.score") >= threshold).cast("int").alias("predicted"))

    def find(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with passages: the significant segments as (first token, last token, evidence)."""
        ship(docs.sparkSession)
        model = self

        @F.pandas_udf("array<struct<first:int,last:int,evidence:double>>")
        def found(texts: pd.Series) -> pd.Series:
            return pd.Series([[{"first": a, "last": b, "evidence": e} for a, b, e in model.passages(t)[1] if e > 0] for t in texts], dtype=object)

        return docs.withColumn("passages", found(whole(text)))


def constant(share: float) -> Model:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Model({}, 1.0, 0.0, (), math.log(p / (1 - p)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", held_out: tuple[int, int] = (4, 2)) -> Model:
    """Word scores and calibration from labelled rows whose id's crc32 modulo held_out[0] is not held_out[1]."""
    ship(docs.sparkSession)
    known = one_label(labels, label).where(id_bucket("doc_id", held_out[0]) != held_out[1])
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return constant(share)
    by_hash = F.xxhash64(F.lit("sample"), "doc_id")
    sample = known.where(F.col(label) == 0).orderBy(by_hash, "doc_id").limit(MAX_ROWS).unionByName(
        known.where(F.col(label) == 1).orderBy(by_hash, "doc_id").limit(MAX_ROWS))
    # at most 2 * MAX_ROWS ids: the side to broadcast is bounded by the parameter
    rows = docs.select("doc_id", whole(text).alias("t")).join(F.broadcast(sample), "doc_id")
    side = F.pmod(F.xxhash64(F.lit("side"), "doc_id"), F.lit(2))

    def tally(batches):
        for b in batches:
            seen = {(j, k): Counter() for j in (0, 1) for k in (0, 1)}
            for t, y, j in zip(b["t"], b["y"], b["side"], strict=True):
                seen[j, y].update({p for w in set(tokens(t)) for p in pieces(w)})
            words = set().union(*seen.values())
            yield pd.DataFrame([(w, *(seen[j, k][w] for j in (0, 1) for k in (0, 1))) for w in words], columns=["word", "no0", "yes0", "no1", "yes1"])

    counted = rows.select("t", F.col(label).alias("y"), side.alias("side")).mapInPandas(tally, "word string, no0 long, yes0 long, no1 long, yes1 long")
    by_word = cut_lineage(counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("no0", "yes0", "no1", "yes1")]))
    halves = [lexicon(by_word, F.col(f"yes{j}"), F.col(f"no{j}")) for j in (0, 1)]
    words = lexicon(by_word, F.col("yes0") + F.col("yes1"), F.col("no0") + F.col("no1"))
    if not words or not all(halves):
        return constant(share)
    # each half's texts are judged by the other half's words
    models, seen = [], []
    for j in (0, 1):
        others = rows.where(side == 1 - j)
        decay, location = law(halves[j], others.where(F.col(label) == 0))
        models.append(Model(halves[j], decay, location, (), 0.0))
        seen += others.select(label, models[j].measured(F.col("t")).alias("x")).collect()  # three numbers a sampled row
    decay, location = (float(np.mean([getattr(m, c) for m in models])) for c in ("decay", "location"))
    y = np.array([r[label] for r in seen], float)
    if len(set(y)) < 2:
        return constant(share)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    weights, offset = fit_curve(np.array([r["x"] for r in seen]), y, weight)
    return Model(words, decay, location, tuple(map(float, weights)), offset)


def shrunk(odds: Column, spread: Column) -> Column:
    """Log-odds shrunk by their standard error: at ``Z`` of them half is left."""
    trust = F.pow(odds / (F.lit(Z) * spread), F.lit(POWER))
    return odds * trust / (trust + 1)


def lexicon(by_word: DataFrame, yes: Column, no: Column) -> dict[str, float]:
    """Shrunk log-odds of the pieces that ``yes`` and ``no`` texts hold; empty if a label has none or nothing scores above the drift."""
    c = by_word.select("word", yes.alias("yes"), no.alias("no")).where("yes + no > 0")
    n = c.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    if not n["yes"] or not n["no"]:
        return {}
    prior, mass = F.lit(PRIOR) * (F.col("yes") + F.col("no")), PRIOR * (n["yes"] + n["no"])
    side = [F.ln((F.col(k) + prior) / (F.lit(n[k] + mass) - F.col(k) - prior)) for k in ("yes", "no")]
    spread = F.sqrt(1 / (F.col("yes") + prior) + 1 / (F.col("no") + prior))
    scored = c.select("word", shrunk(side[0] - side[1], spread).alias("odds")).where(F.abs("odds") >= TRACE)
    # at most the words of the bounded sample
    found = scored.orderBy("word").toArrow()
    words = dict(zip(found["word"].to_pylist(), found["odds"].to_pylist(), strict=True))
    return words if max(words.values(), default=0.0) > DRIFT else {}


def law(words: dict[str, float], clean: DataFrame) -> tuple[float, float]:
    """Decay and location of the extreme-value law of the best segments of clean texts ``t``."""
    top = max(words.values()) - DRIFT
    raw = Model(words, 1.0, 0.0, (), 0.0)

    def spent(batches):
        for b in batches:
            n = Counter()
            for t in b["t"]:
                n.update(round(raw.lexicon[w] - DRIFT, 3) for w in tokens(t))
            yield pd.DataFrame(list(n.items()), columns=["score", "n"])

    # scores in thousandths: a few thousand rows; half a token of the highest score, should clean text have none above zero
    per_score = clean.select("t").mapInPandas(spent, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").collect()
    gains = np.array([top] + [r["score"] for r in per_score])
    shares = np.array([0.5] + [r["n"] for r in per_score])
    shares = shares / shares.sum()

    def excess(decay: float) -> float:
        return (shares * np.exp(np.minimum(decay * gains, 700))).sum() - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    decay = (low + high) / 2
    judge = Model(words, decay, 0.0, (), 0.0)

    @F.pandas_udf("double")
    def best(texts: pd.Series) -> pd.Series:
        return pd.Series([max((e for *_, e in judge.passages(t)[1]), default=-1e10) for t in texts], dtype="float64")

    seen = [r["x"] for r in clean.select(best("t").alias("x")).collect()]  # one number a sampled row
    hit = sorted(x for x in seen if x > -1e9)
    # a text without a scoring token has no segment; the law's location puts the rest's share at its place
    if not hit:
        return decay, 0.0
    k = 0.9
    q = float(np.quantile(np.array(seen), k)) if len(hit) > (1 - k) * len(seen) else hit[-1]
    return decay, q + math.log(-math.log(k))


def classify(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2), threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score, predicted and n_passages."""
    scored = fit(docs, labels, held_out=held_out).score(docs, threshold=threshold)
    return scored.withColumn("held_out", id_bucket("doc_id", held_out[0]) == held_out[1])
