"""Benchmark decontamination against a plain search, and its index against plain suffixes."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, lang string, source string, n_chars long", "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, size=10):
    """Per document: (number of words, merged spans, items)."""
    phrases = {}
    for item, text in items:
        w = words(text)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            phrases.setdefault(tuple(w[k:k + m]), set()).add("" if item is None else str(item))
    lengths = {len(p) for p in phrases}
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (got := phrases.get(tuple(w[k:k + m]))):
                    found |= got
                    hit |= set(range(k, k + m))
        spans = [(a, b) for a, b in decontam.merged([(h, h + 1) for h in hit])]
        out.append((len(w), spans, sorted(found)))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    vocab = ["alpha", "Beta", "gamma", "delta7", "été", "zeta", "eta", "中文", "x"]
    prose = lambda n, v=vocab: " ".join(rng.choice(v) for _ in range(n))
    items = [(k, prose(rng.randrange(8, 40))) for k in range(12)]
    items += [(3, prose(14)), (None, prose(11)), (None, None), (50, ""), (51, " ... !"), (52, "Solo"), (53, "two words"), (54, items[0][1]), (100, prose(2500))]
    docs = [None, "", "  \n", "solo", "Two--WORDS, two words", prose(9), prose(3000)]
    for k in range(60):
        a = items[rng.randrange(12)][1]
        docs.append(prose(rng.randrange(30), ["other", "words", *vocab]) + " " + a.upper() + "! " + prose(5, ["zzz"]) + "\n" + items[k % 12][1])
    docs += [items[20][1] + " " + prose(50), "a\x00solo\x7fb", docs[-1], docs[-1]]
    return docs, items


@pytest.mark.parametrize("settings", [{}, {"PIECE_WORDS": 7, "BLOCK_WORDS": 900}])
def test_against_plain_search(spark, case, monkeypatch, settings):
    docs, items = case
    for k, v in settings.items():
        monkeypatch.setattr(decontam, k, v)
    rows = [(k, t, None, "s", k) for k, t in enumerate(docs)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in ("Spans", "items", "__found", "n_words", "__text"):
        df = df.withColumn(c, F.lit("clash"))
    bench = spark.createDataFrame(items, ITEMS).withColumn("item", F.lit(0)).withColumn("words", F.lit(0))
    got = decontam.decontaminate(df, bench)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "__found", "__text", "n_words", "spans", "items"]
    cut = {r["doc_id"]: r["text"] for r in decontam.removed(got).collect()}
    want = plain(docs, items)
    for r in got.collect():
        n, spans, found = want[r["doc_id"]]
        assert (r["n_words"], [(s["first"], s["end"]) for s in r["spans"]], r["items"]) == (n, spans, found)
        assert r["__found"] == r["__text"] == "clash"
        raw = (docs[r["doc_id"]] or "").encode()
        for s in r["spans"]:
            assert words(raw[s["first_byte"]:s["end_byte"]].decode()) == words(raw.decode())[s["first"]:s["end"]]
        gone = set().union(*[range(a, b) for a, b in spans]) if spans else set()
        assert words(cut[r["doc_id"]]) == [w for k, w in enumerate(words(docs[r["doc_id"]])) if k not in gone]
    assert got.count() == len(docs)


def test_shards_in_a_worker_are_small(case):
    """The same with shards of a few words, so that stretches are cut in parts that overlap."""
    docs, items = case
    pieces = [("" if i is None else str(i), words(t)) for i, t in items if words(t)]
    old = decontam.SHARD
    try:
        for size in (old, 16, 64, 257):
            decontam.SHARD = size
            shard = decontam.Shard(decontam.Phrases(pieces, 10))
            for t in docs:
                shard.add((t or "").encode())
            got = [(d["n_words"], [(s["first"], s["end"]) for s in d["spans"]], d["items"]) for d in shard.spans()]
            assert got == plain(docs, items)
    finally:
        decontam.SHARD = old


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c")], ITEMS)
    assert decontam.decontaminate(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b c", None, None, None)], DOCS)
    r = decontam.decontaminate(docs, spark.createDataFrame([], ITEMS)).first()
    assert (r["n_words"], r["spans"], r["items"]) == (3, [], [])


def test_index_against_plain_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        top, n = int(rng.integers(1, 6)), int(rng.integers(1, 60))
        t = np.append(rng.integers(0, top + 1, n), 0).astype(np.int32)

        def suffix(i, t=t):
            end = i + int(np.flatnonzero(t[i:] == 0)[0]) + 1
            return t[i:end].tolist(), i

        assert decontam.suffix_order(t, top.bit_length()).tolist() == sorted(range(len(t)), key=suffix)
        index, m = decontam.FMIndex(t, top), int(rng.integers(1, 5))
        phrases = rng.integers(1, top + 1, (20, m))
        found = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(*index.search(phrases), strict=True)}
        for k, p in enumerate(phrases):
            assert found.get(k, []) == [i for i in range(len(t) - m + 1) if (t[i:i + m] == p).all()]
