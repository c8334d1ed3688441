"""Quality scores by compression with zstandard dictionaries of good and of bad labelled text.

Fitting uses a bounded sample of labelled rows: of each label the ids of smallest hash, at most ``MAX_ROWS`` of them and as many as
together hold at most ``MAX_BYTES`` of text (rows come whole or not at all).  Each label's dictionary is trained, in the same way at every size, over all
pieces of its sampled texts, of up to ``DICT_BYTES`` (less for less text); half of the sampled
documents feed the dictionaries and the other half the calibration.  A text is cut into blocks of ``BLOCK`` bytes
and each block is compressed with either dictionary, so long texts do not wash the difference out.  The inputs are the difference
of the two compressed sizes, normalised by the larger one and by the text's bytes, and the two normalised sizes it is the difference of; a
logistic curve in them, fitted with the labels' own shares as weights, gives the score.  Scoring is one narrow map over whole texts with two dictionaries of fixed size.

Labels other than 0 and 1 and labels without a text are left out; of several labels of an id the largest counts.  Without
labels of both kinds every score is the share of label 1 (0.5 without any).  Null and empty texts have difference 0.
Repeated rows are scored each; result columns replace columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import id_bucket, one_label, ship, whole

MAX_ROWS, MAX_BYTES, BLOCK, DICT_BYTES, LEVEL = 4000, 24 << 20, 512, 112_640, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    offset: float

    def score(self, docs: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
        """``docs`` with score (0 to 1) and predicted (1 if score >= threshold)."""
        ship(docs.sparkSession)
        scored = docs.withColumn("score", self.scores(whole(text)))
        return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

    def scores(self, text: Column) -> Column:
        if not self.good:
            return F.lit(1 / (1 + math.exp(-self.offset)))
        model = self

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            x = inputs(texts.tolist(), model.good, model.bad) @ np.array(model.weights) + model.offset
            return pd.Series(1 / (1 + np.exp(-np.clip(x, -50, 50))))

        return score(text)


def sizes(texts, good: bytes, bad: bytes) -> np.ndarray:
    """Per text: bytes of its compressed blocks with the good dictionary, with the bad one, and as they are."""
    import zstandard as zstd

    def packer(d: bytes):
        data = zstd.ZstdCompressionDict(d)
        data.precompute_compress(level=LEVEL)
        return zstd.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    a, b = packer(good), packer(bad)
    out = np.zeros((len(texts), 3))
    for k, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        blocks = [raw[p:p + BLOCK] for p in range(0, len(raw), BLOCK)]
        out[k] = sum(len(a(x)) for x in blocks), sum(len(b(x)) for x in blocks), len(raw)
    return out


def inputs(texts, good: bytes, bad: bytes) -> np.ndarray:
    """Per text: size difference (bad less good) over the larger size and over the bytes, and the two sizes over the bytes."""
    n = sizes(texts, good, bad)
    g, b, raw = n[:, 0], n[:, 1], np.maximum(n[:, 2], 1)
    return np.column_stack([(b - g) / np.maximum(n[:, :2].max(axis=1), 1), (b - g) / raw, g / raw, b / raw])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic curve (Newton steps; a small ridge on the scaled weights)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    pull = ridge * weight.sum() * np.r_[np.ones(x.shape[1]), 1e-6]
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag(pull), a.T @ (weight * (p - y)) + pull * w)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", held_out: tuple[int, int] = (5, 0)) -> Model:
    """Dictionaries and calibration from labelled rows whose id's crc32 modulo held_out[0] is not held_out[1]."""
    ship(docs.sparkSession)
    known = one_label(labels, label).where(id_bucket("doc_id", held_out[0]) != held_out[1])
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return constant(share)
    by_hash = F.xxhash64(F.lit("sample"), "doc_id")
    first = known.where(F.col(label) == 0).orderBy(by_hash, "doc_id").limit(MAX_ROWS).unionByName(
        known.where(F.col(label) == 1).orderBy(by_hash, "doc_id").limit(MAX_ROWS))
    # at most 2 * MAX_ROWS ids: the side to broadcast is bounded by the parameter
    texts = docs.select("doc_id", whole(text).alias("t"))
    sizes_of = texts.join(F.broadcast(first), "doc_id").groupBy("doc_id", label).agg(F.sum(F.octet_length("t")).alias("n")).orderBy(by_hash, "doc_id").collect()
    sample, room = [], {0: MAX_BYTES, 1: MAX_BYTES}
    for r in sizes_of:
        if r["n"] <= room[r[label]]:
            room[r[label]] -= r["n"]
            sample.append((r["doc_id"], r[label]))
    sample = docs.sparkSession.createDataFrame(sample, first.schema)
    rows = texts.join(F.broadcast(sample), "doc_id")
    side = F.pmod(F.xxhash64(F.lit("side"), "doc_id"), F.lit(2))
    pieces = rows.where((side == 0) & (F.length("t") > 0)).select(label, F.explode(F.expr(
        f"transform(sequence(0, int((octet_length(t) - 1) / {BLOCK})), k -> substring(encode(t, 'utf-8'), k * {BLOCK} + 1, {BLOCK}))")).alias("piece"))
    pieces = pieces.select(label, "piece", F.xxhash64(F.lit("piece"), "piece").alias("h"))
    halves = {k: [bytes(r["piece"]) for r in pieces.where(F.col(label) == k).dropDuplicates(["h"]).orderBy("h").collect()] for k in (0, 1)}
    good, bad = dictionaries(halves[1], halves[0])
    if not good or not bad:
        return constant(share)
    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(inputs(texts.tolist(), good, bad)), dtype=object)

    # at most 2 * MAX_ROWS rows of a label and four numbers
    seen = rows.where(side == 1).select(label, measured("t").alias("x")).collect()
    y = np.array([r[label] for r in seen], float)
    if len(set(y)) < 2:
        return constant(share)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    weights, offset = fit_curve(np.array([r["x"] for r in seen]), y, weight)
    return Model(good, bad, tuple(map(float, weights)), offset)


def constant(share: float) -> Model:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Model(b"", b"", (), math.log(p / (1 - p)))


def dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """The two labels' dictionaries, made alike."""
    return trained(good), trained(bad)


def trained(pieces: list[bytes]) -> bytes:
    """A zstandard dictionary trained over all of the pieces, no larger than they are (empty: none)."""
    import zstandard as zstd

    joined = b"".join(pieces)
    if len(pieces) < 8:  # zstandard asks for a number of samples
        step = len(joined) // 8 + 1
        pieces = [joined[p:p + step] for p in range(0, len(joined), step)]
    try:
        # split_point 1: no piece is set aside for testing the dictionary only
        return zstd.train_dictionary(min(DICT_BYTES, max(256, len(joined))), pieces, d=8, steps=4, split_point=1.0, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        if len(joined) > DICT_BYTES:
            raise
        return joined  # a few words


def classify(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    scored = fit(docs, labels, held_out=held_out).score(docs, threshold=threshold)
    return scored.withColumn("held_out", id_bucket("doc_id", held_out[0]) == held_out[1])
