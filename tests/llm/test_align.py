"""Token alignment against the two libraries on whole texts and groups found byte by byte."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tabforge.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string"


def plain(texts):
    """Per text: (n_a, n_b, groups as text, links)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(x): x for x in shown} | {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    out = []
    for t in texts:
        if not t:
            out.append((0, 0, "", []))
            continue
        raw, x, y = (" " + t).encode(), a.encode(" " + t, add_special_tokens=False), b.encode(t)
        xs = [(i, bytes(of[c] for c in s) if s != "<|endoftext|>" else s.encode()) for i, s in zip(x.ids, x.tokens, strict=True)]
        ys = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in y]
        if b"".join(s for _, s in xs) != raw or b"".join(s for _, s in ys) != raw:
            out.append((0, 0, "", []))
            continue
        ends = [{}, {}]
        for side, tokens in enumerate((xs, ys)):
            at = 0
            for k, (_, s) in enumerate(tokens):
                at += len(s)
                ends[side][at] = k
        common, i, j, text, links = sorted(set(ends[0]) & set(ends[1])), 0, 0, [], []
        for e in common:
            p, q = ends[0][e] + 1, ends[1][e] + 1
            text.append(",".join(str(n) for n, _ in xs[i:p]) + "|" + ",".join(str(n) for n, _ in ys[j:q]))
            links.append((xs[p - 1][0], ys[q - 1][0]))
            i, j = p, q
        out.append((len(xs), len(ys), ";".join(text), links))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    pick = lambda n, v: "".join(rng.choice(v) for _ in range(n))
    hard = [" ", "\n", "\r", "\t", ";\r\n", "  ", "a", "the", " {\r", "é", "1", "\x1c", "\x85", "\xa0", "　", " ", "</s>", "<|endoftext|>", "'s", "中", "\U0001f600"]
    fixed = [None, "", " ", "  ", "\n", "a ", " a", "a\r\nb", "a;\r\n\nb  \r", "x▁y", "x ▁", "<unk> <s>", "<0x41>", "\x00z", "é ﬁ Ｆ", "a" * 700,
             "12345 " * 90, "straße für Mädchen", "​﻿", "Hello  wörld\n\tx "]
    table = [pick(rng.randrange(1, 60), hard) for _ in range(300)]
    return fixed + table + [pick(300, "".join(map(chr, range(32, 0x2FFF)))), " ".join(pick(5, "abcdeé") for _ in range(4000))] + table[:40]


def test_segments_equal_whole_texts(texts):
    it = align.Aligner(A, B)
    assert it.cut
    want = plain(texts)
    got = it.align([t or "" for t in texts], True)
    for k, t in enumerate(texts):
        n_a, n_b, written, links = want[k]
        assert (got["n_a"][k].as_py(), got["n_b"][k].as_py(), got["groups"][k].as_py()) == (n_a, n_b, written), repr(t)
        assert got["links"][k].as_py() == [x * it.n_b + y for x, y in links] and got["n_groups"][k].as_py() == len(links)
    it.cut = None  # without safe cuts a text is one segment
    it.forget()
    assert it.align([t or "" for t in texts], True)["groups"].to_pylist() == [w for _, _, w, _ in want]


@pytest.mark.parametrize("pairs", [align.BROADCAST_PAIRS, 10])
def test_against_plain(spark, texts, monkeypatch, pairs):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", pairs)
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(None, "null id", None), (3, "the the", "en"), (3, "the the", "en")], DOCS).repartition(4)
    for c in ("N_A", "row", "links", "__row", "alignment", "__alignment", "pair", "n"):
        df = df.withColumn(c, F.lit("clash"))
    rows = df.collect()
    want = plain([r["text"] for r in rows])
    counts = Counter(x for w in want for x in w[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    expected = sorted(((r["doc_id"] is None, r["doc_id"] or 0, n_a, n_b, len(links), len(links), sum(counts[x] == highest[x[1]] for x in links),
                        sum(counts[x] for x in links), hashlib.sha256(w.encode()).hexdigest() if w else "") for r, (n_a, n_b, w, links) in zip(rows, want, strict=True)))
    out = align.align_tokens(df, A, B, with_groups=True)
    assert out.columns == ["doc_id", "text", "lang", "row", "links", "__row", "alignment", "__alignment", "pair", "n", *align.RESULT, "groups"]
    got = out.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in align.RESULT]) for r in got) == expected
    assert all(r[c] == "clash" for r in got for c in ("row", "links", "__row", "alignment", "__alignment", "pair", "n"))
    assert all((hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"] for r in got)


def test_empty_table(spark):
    assert align.align_tokens(spark.createDataFrame([], DOCS), A, B).collect() == []


def test_pointer_jumping_on_long_groups():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 200))

        def cut(share, n=n):
            ends = np.flatnonzero(np.append(rng.random(n - 1) < share, True)) + 1
            return np.diff(np.concatenate([[0], ends]))
        a, b = cut(rng.random()), cut(rng.random())
        common = sorted(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))
        b_end = np.cumsum(b).tolist()
        last = np.array([b_end.index(e) for e in common])
        want = [last[np.searchsorted(common, np.cumsum(side))].tolist() for side in (a, b)]
        assert [x.tolist() for x in align.groups(a, b)] == want
    shifted = np.full(100_000, 2)  # one group: no end in common but the last
    a, b = np.concatenate([[1], shifted, [1]]), np.concatenate([shifted, [2]])
    assert set(align.groups(a, b)[0].tolist()) == {len(b) - 1}
