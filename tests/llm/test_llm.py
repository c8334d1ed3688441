"""The training-data operators against plain versions, the tokenizers' own libraries, and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tabforge.llm import ann, bpe, chat, components, line_dedup, mixing, quality, repetition, simhash, token_count, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def rng_text(rng, n, alphabet="abc de f\n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [None, "", "   ", " \n\t x", "a" * 3000, "=-" * 400, "<|endoftext|> hi<|endoftext|>", "don't 'S 's", "  　x\x1c\x1dy",
            "\U0001f600\U0001f600é naïve 中文", rng_text(rng, 2000), "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(800)),
            "The same line.\nThe same line.\n\nOther", rng_text(rng, 90_000), "bé" * 700]


@pytest.fixture(scope="module")
def edge(spark, texts):
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 1), (None, "null id", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("n_tokens", "score", "fingerprint", "kept", "weight", "epoch", "n_lines", "_total_"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- tokenizers
def test_token_counts_equal_the_library(edge):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    got = token_count.token_counts(edge, JSON, P.PATTERN).collect()
    assert len(got) == edge.count()
    for r in got:
        t = r["text"] or ""
        assert r["n_tokens"] == len(lib.encode(t, add_special_tokens=False).ids)
        assert r["n_bytes"] == len(t.encode()) and r["over_limit"] == (r["n_tokens"] > 512)


def test_chunk_maps_compose(texts):
    whole = token_count.Transducer(JSON, P.PATTERN)
    old = token_count.CHUNK
    try:
        counts = {}
        for size in (old, 7, 64):
            token_count.CHUNK = size
            counts[size] = [whole.count(t or "") for t in texts if len(t or "") < 5000]
        assert counts[old] == counts[7] == counts[64]
    finally:
        token_count.CHUNK = old


def test_machine_may_forget(texts):
    a, b = token_count.Transducer(JSON, P.PATTERN), token_count.Transducer(JSON, P.PATTERN)
    for t in texts[:12]:
        n = a.count(t or "")
        b.reset()
        b.clear()
        assert b.count(t or "") == n


def test_bpe_equals_the_library_and_decodes(edge):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(RANKS, P.PATTERN).ranks, special_tokens={})
    got = bpe.decode(bpe.encode(edge.select("doc_id", "text"), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    for r in got:
        t = r["text"] or ""
        assert r["ids"] == lib.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    for r in bpe.round_trip(edge, RANKS, P.PATTERN).collect():
        t = r["text"] or ""
        ids = np.array(lib.encode_ordinary(t), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_words_forgotten_and_long_words(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 3)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 20)
    c, rng = bpe.Codec(RANKS, P.PATTERN), random.Random(9)
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for _ in range(4):
        many = [rng_text(rng, 60), rng_text(rng, 700, "the"), "aaa" * rng.randrange(1, 300)]
        assert [x.tolist() for x in c.encode(many)] == [lib.encode_ordinary(t) for t in many]


# ---------------------------------------------------------------- SimHash
def test_bpe_long_texts_and_long_words(monkeypatch):
    """Runs and windows against the library: letter runs, repeats of every period, texts over a slice."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    c = bpe.Codec(RANKS, P.PATTERN)
    words = [rng_text(rng, n, "abcdefghijklmnopqrstuvwxyz") for n in (513, 1024, 5000, 20_000)] + [rng_text(rng, 3000, "=-#"), rng_text(rng, 4000, "aeé")]
    words += [("abcdefghijk"[:p] * 3000)[:2000 + p] for p in range(1, 12)] + ["a" * 9000, "=" * 2500, "ab" * 700 + "c", "中" * 900, rng_text(rng, 2000, "0123456789")]
    for w in words:
        assert c.encode([w])[0].tolist() == lib.encode_ordinary(w), w[:20]
    monkeypatch.setattr(bpe, "RUN_WORDS", 50)
    monkeypatch.setattr(bpe, "RUN_IDS", 70)
    text = "\n".join(words[:3]) + " " + rng_text(rng, 6000, "abc de fg  \n.") + " end"
    ids = np.concatenate(list(c.runs(text)))
    assert ids.tolist() == lib.encode_ordinary(text) and b"".join(c.spelled(ids)) == text.encode()
    n, a, b = bpe.digest(c, text)
    assert (n, a, b) == (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_of_a_very_long_text(spark):
    base = " ".join(rng_text(random.Random(1), 9, "abcdefgh") for _ in range(3000)) + " "
    text = (base + "word " * 7000) * 70  # over 4 MB a row, several slices
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").withColumn("__codes", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.round_trip(df, RANKS, P.PATTERN).collect()}
    assert got[1]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[1]["__codes"] == "clash"
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).where("doc_id = 1").first()
    assert bytes(back["decoded"]) == text.encode() and len(back["ids"]) == got[1]["n_tokens"]


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPACE.findall(t)
    s = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(prints):
    """ids -> smallest id reachable, by comparing all pairs of a small fixture."""
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def test_simhash_against_all_pairs(spark, texts):
    rng = random.Random(8)
    base = [" ".join(rng.choice(["red", "Blue", "grün", "x", "y"]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    rows = list(enumerate([t for t in texts if len(t or "") < 5000] + base + base[:5] + [b + " x" for b in base[:20]]))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = {k: plain_fingerprint(t) for k, t in rows}
    want = plain_components(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {k: (f"{prints[k]:016x}", want[k]) for k in prints}


@pytest.mark.parametrize("bucket", [256, 4])
def test_links_lose_nothing_in_large_buckets(spark, monkeypatch, bucket):
    """Close fingerprints around a few centres, with buckets small enough that deeper levels run."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(60)}
    fps = sorted(simhash.signed(x) for x in fps)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = components.components(simhash.links(nodes)).collect()
    unsigned = {x: x & (2 ** 64 - 1) for x in fps}
    want = plain_components(unsigned)
    found = {r["node"]: r["root"] for r in got}
    groups = lambda m: sorted(tuple(sorted(k for k in fps if m(k) == r)) for r in {m(k) for k in fps})
    assert groups(lambda k: found.get(k, k)) == groups(lambda k: want[k])


def test_masks_cover_every_pair_of_three_bits():
    rng = random.Random(1)
    for masks in ([m for _, m in simhash.mask_levels()[0]],):
        assert len(masks) == 15
        for _ in range(2000):
            bits = rng.sample(range(64), 3)
            assert any(not any(m >> b & 1 for b in bits) for m in masks)
    deep = {}
    for level in simhash.mask_levels()[1:]:
        for above, mask in level:
            deep.setdefault(above, []).append(mask)
            assert above & mask == above
    for above, masks in list(deep.items())[:60]:
        free = [b for b in range(64) if not above >> b & 1]
        for _ in range(50):
            bits = rng.sample(free, min(3, len(free)))
            assert any(not any(m >> b & 1 for b in bits) for m in masks)
    assert max(64 - m.bit_count() for _, m in simhash.mask_levels()[2]) <= 8


def test_keep_one_and_null_ids(spark, edge, nothing):
    kept = simhash.keep_one(edge.select("doc_id", "text", "lang"))
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "lang"]
    assert len([r for r in rows if r[0] is not None]) == len({r[0] for r in rows if r[0] is not None})
    assert (0, None) in rows and (1, "") not in rows  # the empty ones are one group
    assert (None, "null id") in rows and (None, None) not in rows
    assert simhash.keep_one(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


def test_keep_one_with_one_id_on_unlike_texts(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(rng.choice("river stone light paper walk green music".split()) + str(rng.randrange(50)) for _ in range(60)) for _ in range(3))
    rows = [(5, a, "x"), (5, b, "x"), (9, b, "x"), (8, a, "x"), (None, b, "x"), (None, c, "x"), (None, c, "x"), (7, None, "x"), (7, "", "y")]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3))
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] != 7), key=repr)
        assert got == sorted([(5, a), (5, b), (None, c)], key=repr)
        assert kept.where("doc_id = 7").count() == 1
    # text a's group is named by id 2, and id 5 is on a row of it and on text b
    rows = [(2, a, "x"), (5, a, "x"), (5, b, "x"), (9, b, "x")]
    for order in (rows, rows[::-1]):
        got = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, lang string").coalesce(1)).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(2, a), (5, b)])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(999, 999), (None, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: k for e in edges if None not in e for k in e}
    for _ in range(len(want)):
        for a, b in edges:
            if a is not None:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


# ---------------------------------------------------------------- line dedup
def test_line_dedup_by_hand(spark, nothing):
    rows = [(k, f"menu \nonly {k}\n\n menu", "a") for k in range(8)] + [(20, "menu", "a"), (21, None, "a"), (22, "", "a")]
    rows += [(k, f"menu\nown {k}", "b") for k in range(30, 34)] + [(40, "menu\nz", None), (41, "menu\ny", None)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_pages=5, ratio=0.5, keep_whole=True).collect()}
    assert got[3]["text"] == "only 3\n" and (got[3]["n_lines"], got[3]["n_dropped"]) == (4, 2)
    assert got[20]["text"] == "menu" and got[20]["n_dropped"] == 0  # nothing else would be left
    assert got[21]["text"] is None and got[21]["n_lines"] == 0 and got[22]["text"] == ""
    assert got[31]["text"] == "menu\nown 31" and got[40]["text"] == "menu\nz"  # too few pages
    assert line_dedup.dedup_lines(nothing).count() == 0
    cut = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_pages=5, ratio=0.5)
    assert tuple(cut.where("doc_id = 20").select("text", "n_lines", "n_dropped").first()) == ("", 1, 1)


def test_line_dedup_with_clashing_names_and_long_lists(spark):
    listed = [f"menu {k}" for k in range(400)]
    rows = [(k, "\n".join([f"own {k}", *listed[k % 3::3]]), "a") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["_site", "_bad", "_keep", "_t", "__site", "__bad", "__text", "__hits", "__left", "__lines", "__dropped", "N_Lines"]
    got = line_dedup.dedup_lines(df.select("*", *[F.lit("clash").alias(c) for c in names]), ratio=0.05)
    assert got.columns == ["doc_id", "text", "source", *names[:-1], "n_lines", "n_dropped"]
    for r in got.collect():
        assert r["text"] == f"own {r['doc_id']}" and r["n_dropped"] == r["n_lines"] - 1 and all(r[c] == "clash" for c in names[:-1])


def test_line_dedup_drops_a_line_on_a_few_pages_in_a_hundred(spark):
    sites = {"small": (100, (5, 10)), "middle": (1000, (30, 100)), "hot": (6000, (180, 600))}
    rows = [(f"{site} {k}", "\n".join([f"own {site} {k}"] + [f"planted {n}" for n in planted if k < n] + ["rare"] * (k < 4)), site)
            for site, (pages, planted) in sites.items() for k in range(pages)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        site, k = r["doc_id"].split()
        assert r["text"] == f"own {site} {k}" + "\nrare" * (int(k) < 4)  # four pages are no pattern
        assert r["n_dropped"] == sum(int(k) < n for n in sites[site][1])


def test_line_dedup_edges_and_shuffle_join(spark, edge, monkeypatch):
    a = sorted(map(repr, line_dedup.dedup_lines(edge, ratio=0.01, min_pages=1).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert a == sorted(map(repr, line_dedup.dedup_lines(edge, ratio=0.01, min_pages=1).collect()))
    assert len(a) == edge.count()


# ---------------------------------------------------------------- mixing
def test_mix_uses_every_document_and_meets_the_weights(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randrange(1, 40), "hot" if k % 3 else f"s{k % 7}") for k in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] for r in out} == set(range(3000))
    spent = {}
    for r in out:
        spent[r["source"]] = spent.get(r["source"], 0) + r["n_tokens"]
    weight = {r["source"]: r["weight"] for r in out}
    total = sum(spent.values())
    assert abs(sum(weight.values()) - 1) < 1e-6
    assert all(abs(spent[s] / total - w) < 0.01 for s, w in weight.items())
    h = -sum(w * math.log(w) for w in weight.values())
    assert h >= 0.9 * math.log(len(weight)) - 1e-6
    own = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in weight}
    reps = [weight[s] / own[s] for s in weight]
    assert max(reps) <= 4.0001 * min(reps)
    for s in weight:  # whole epochs hold every document once
        ids = [r["doc_id"] for r in out if r["source"] == s and r["epoch"] == 0]
        assert len(ids) == len(set(ids))


def test_mix_with_clashing_names(spark):
    rows = [(k, "w " * (k % 9), f"s{k % 3}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["_site", "_total", "_h", "_block", "_left", "_upto", "_blocks", "__c0", "Epoch", "weight"]
    plain = sorted(tuple(r) for r in mixing.mix(df).collect())
    got = mixing.mix(df.select(*[F.lit("clash").alias(c) for c in names], "*"))
    assert got.columns == [*names[:-2], "doc_id", "text", "source", *mixing.RESULT]
    assert sorted(tuple(r)[8:] for r in got.collect()) == plain


def test_mix_exponent_by_plain_bisection(spark):
    totals = {"a": 100_000, "b": 3000, "c": 700, "d": 50}
    df = spark.createDataFrame(list(totals.items()), "_site string, _total long")

    def entropy(a):
        p = [(t / sum(totals.values())) ** a for t in totals.values()]
        return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)
    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.9 * math.log(4) else (low, mid)
    assert abs(mixing.exponent(df, 0.9, 1e9) - low) <= 2 ** -20
    limit = 1 - math.log(4) / math.log(100_000 / 50)
    assert abs(mixing.exponent(df, 0.9999, 4.0) - limit) <= 2 ** -19
    assert mixing.exponent(df.where("_site = 'a'")) in (0.0, 1.0) and mixing.exponent(df.limit(0)) == 1.0


def test_mix_edges(edge, nothing, spark, monkeypatch):
    out = mixing.mix(edge)
    assert out.select("doc_id", "text").distinct().count() == edge.select("doc_id", "text").distinct().count()
    a = sorted(map(repr, out.collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    assert a == sorted(map(repr, mixing.mix(edge).collect()))
    assert mixing.mix(nothing).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in mixing.mix(blank).collect()) == [1, 2]


# ---------------------------------------------------------------- quality and toxicity
def labelled(spark, label, marked):
    rng = random.Random(6)
    words = ["river", "stone", "light", "paper", "walk", "green", "music", "table", "window", "song"]
    docs, labels = [], []
    for k in range(700):
        bad = k % 3 == 0
        ws = [rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(20, 80))]
        if bad:
            ws = marked(ws, rng)
        docs.append((k, " ".join(ws)))
        labels.append((k, int(bad) if label == "toxic" else int(not bad)))
    labels += [(5, 7), (None, 1), (10 ** 6, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {label} int")


def accuracy(out, labels, label):
    want = {r["doc_id"]: r[label] for r in labels.collect() if r[label] in (0, 1)}
    held = [r for r in out if r["held_out"]]
    assert held and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    return np.mean([r["predicted"] == want[r["doc_id"]] for r in held])


def test_quality_on_held_out(spark, edge, nothing):
    docs, labels = labelled(spark, "quality", lambda ws, rng: [w.upper() + rng.choice(["!!", "%%%"]) for w in ws])
    out = quality.classify(docs, labels).collect()
    assert accuracy(out, labels, "quality") > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    model = quality.fit(docs, labels)
    assert model.score(edge).count() == edge.count() and model.score(nothing).count() == 0
    for some in (labels.where("quality = 1"), labels.limit(0)):  # labels of one kind or none: a constant
        assert quality.classify(docs, some).select("score").distinct().count() == 1
    assert quality.classify(nothing, labels).count() == 0


@pytest.mark.parametrize("n_bad", [113_000, 283_000, 620_000, 900_000])
def test_quality_dictionaries_read_all_pieces(n_bad):
    """Of labels between the dictionary's size and eight times that, words past the first 112,640 bytes count too, and both are trained."""
    rng = random.Random(3)

    def pieces(n, words):
        text = " ".join(rng.choice(words) for _ in range(n // 6)).encode()[:n]
        return [text[p:p + quality.BLOCK] for p in range(0, len(text), quality.BLOCK)]

    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    late = ["".join(rng.choice("uvwxyz") for _ in range(5)) for _ in range(40)]
    head = pieces(quality.DICT_BYTES, words)
    bad = head + pieces(n_bad - quality.DICT_BYTES, late)
    good, found = quality.dictionaries(pieces(1_500_000, words), bad)
    magic = b"\x37\xa4\x30\xec"
    assert good.startswith(magic) and found.startswith(magic) and max(len(good), len(found)) <= quality.DICT_BYTES
    if n_bad > 200_000:
        assert sum(w.encode() in found for w in late) == len(late)


def test_quality_dictionaries_of_little_text():
    long = [bytes([97 + k % 7, 98 + k % 11]) * 256 for k in range(400)]
    for few in ([b"abc"], [b"some words of a label"], [b"x" * 512, b"some words of a label" * 20], [b"ab" * 256] * 6):
        good, bad = quality.dictionaries(long, few)
        assert good and bad
        assert quality.inputs(["some words", ""], good, bad).shape == (2, 4)
    assert quality.dictionaries([b"a", b"b"], [b"c"]) == (b"ab", b"c") and quality.dictionaries(long, [])[1] == b""


def test_toxicity_on_held_out(spark, edge, nothing):
    def mark(ws, rng):
        for _ in range(3):
            ws.insert(rng.randrange(len(ws)), rng.choice(["vexling", "grumthor", "grumthen"]))
        return ws
    docs, labels = labelled(spark, "toxic", mark)
    out = toxicity.classify(docs, labels).collect()
    assert accuracy(out, labels, "toxic") > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    model = toxicity.fit(docs, labels)
    found = model.find(spark.createDataFrame([(1, "river " * 30 + "vexling grumthor" + " stone" * 30), (2, "river stone"), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(p["first"], p["last"]) for p in found[0]["passages"]] == [(30, 31)] and not found[1]["passages"] and not found[2]["passages"]
    assert model.score(edge).count() == edge.count()
    assert toxicity.classify(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.classify(nothing, labels).count() == 0


def test_toxicity_of_a_smaller_language(spark):
    """Recall by language on held-out labels, where one language's marks are in too few texts for four standard errors."""
    rng = random.Random(9)
    talk = {"en": ["river", "stone", "light", "paper"], "es": ["mesa", "calle", "libro", "verde"]}
    marks = {"en": ["vexling", "grumthor"], "es": ["zorrupio", "malquento", "bruxardo"]}
    docs, labels, lang = [], [], {}
    for k in range(1600):
        lang[k] = "es" if k % 10 == 0 else "en"
        ws = [rng.choice(talk[lang[k]]) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randrange(20, 60))]
        bad = k % 40 in (0, 10, 1, 5, 9, 13, 17, 21, 25, 29, 33, 37)
        if bad:
            for _ in range(2):
                ws.insert(rng.randrange(len(ws)), rng.choice(marks[lang[k]]) + rng.choice(["", "a", "on", "ir"]))
        docs.append((k, " ".join(ws)))
        labels.append((k, int(bad)))
    out = toxicity.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    for one in ("en", "es"):
        held = [(r["predicted"], labels[r["doc_id"]][1]) for r in out if r["held_out"] and lang[r["doc_id"]] == one]
        assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.03
    words = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).words
    assert words["zorrupioon"] > 0 and min(words.values()) < 0


def test_only_significant_passages_are_counted(spark):
    model = toxicity.Model({"vexling": 4.0, "faint": 1.25}, 1.0, 0.0, (1.0, 1.0, 0.0), -3.0)
    text = " ".join(["river faint stone"] * 400 + ["vexling"] * 5 + ["stone river faint"] * 400)
    got = {r["doc_id"]: r["n_passages"] for r in model.score(spark.createDataFrame([(1, text), (2, "river faint " * 9), (3, None)], "doc_id long, text string")).collect()}
    assert len(model.passages(text)[1]) > 100 and got == {1: 1, 2: 0, 3: 0}


def plain_segments(scores):
    """All maximal scoring segments by their definition: recursively the best segment, then what is left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            s = sum(scores[a:b + 1])
            if s > 1e-12 and (best is None or s > best[2] + 1e-12):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return plain_segments(scores[:a]) + [best] + [(x + b + 1, y + b + 1, z) for x, y, z in plain_segments(scores[b + 1:])]


def test_segments_against_the_definition():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(0, 14)
        hits = {k: rng.choice([0.31, 0.77, 1.13, 2.09]) for k in range(n) if rng.random() < 0.5}
        got = toxicity.segments(sorted(hits.items()), 0.45)
        want = plain_segments([hits.get(k, -0.45) for k in range(n)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


# ---------------------------------------------------------------- repetition
def plain_repetition(ws, least):
    n = len(ws)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and ws[i + k] == ws[j + k]:
                k += 1
            best[i] = max(best[i], k)
    spans = lambda f: len({p for i in range(n) if (m := f(best[i])) for p in range(i, i + m)})
    return [spans(lambda b: 3 if b >= 3 else 0), spans(lambda b: b if b >= least else 0), max(best, default=0)]


def test_repetition_against_plain(monkeypatch):
    rng = random.Random(11)
    many = [rng_text(rng, rng.randrange(0, 120)) for _ in range(80)] + ["x " * 50, "", "one"]
    cut = [SPACE.findall(t) for t in many]
    raw = [t.encode().split() for t in many]
    assert repetition.measure(many, raw, 5).tolist() == [plain_repetition(ws, 5) for ws in cut]


def test_repetition_rules(spark, edge, nothing, monkeypatch):
    monkeypatch.setattr(repetition, "SLICE_WORDS", 100)
    out = repetition.repetition_rules(edge).collect()
    assert len(out) == edge.count()
    for r in out:
        t = r["text"] or ""
        ws = SPACE.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACE.search(line):
                dup += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(ws), sum(map(len, ws)), dup)
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["base_failed"] == (len(ws) < 50 or 100 * r["n_repeat_words"] > 50 * len(ws)) and not (r["base_failed"] and r["kept"])
    rng = random.Random(0)
    clean = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(400))
    passage = " ".join(f"p{k}" for k in range(120))
    d = spark.createDataFrame([(1, clean), (2, f"{clean} {passage} {clean[:900]}x {passage}"), (3, f"{passage} " * 3)], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["longest_repeat"]) for r in repetition.repetition_rules(d).collect()}
    assert got[1] == (True, 0) or got[1][0]
    assert got[2][0] is False and got[2][1] >= 120 and got[3] == (False, 240)
    assert repetition.repetition_rules(nothing).count() == 0


# ---------------------------------------------------------------- nearest neighbours
def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype("float32")
    x[700:900] = x[650]  # one vector many times
    rows = [(int(k), [float(c) for c in v], 1) for k, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [float("nan")] * 24, 1), (5003, [1.0, None] * 12, 1), (5004, [1.0], 1), (None, rows[0][1], 1), rows[101]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.search(df, F.col("id") % 50 == 0).collect()
    x = x.astype(float)
    hit = total = 0
    for q in range(0, 1500, 50):
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(1500), dist))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r["score"] - dist[r["vec_id"]]) < 1e-12 for r in mine)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(best.tolist()))
        total += 10
        if q in (750, 800, 850):  # copies: the smaller ids first
            assert [r["vec_id"] for r in mine] == [650, *range(700, 709)]
    assert hit / total >= 0.9 and len({r["query_id"] for r in got}) == 30


def test_neighbours_edges(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few, F.col("id") % 100 == 0).collect())
    assert got == [(0, 1, 7), (0, 2, 100), (100, 1, 7), (100, 2, 0)]
    assert ann.search(few.limit(0), F.col("id") % 100 == 0).count() == 0
    assert ann.search(few.where("vec_id = 0"), F.col("id") % 100 == 0).count() == 0


def test_rows_of_one_id_are_candidates_each(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (7, [5.0, 5.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).collect()
    lists = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got)
    a = [(7, 0.5), (7, 0.5), (100, round(2 ** 0.5, 6)), (7, round(41 ** 0.5, 6))]
    b = [(7, round(1.25 ** 0.5, 6)), (7, round(1.25 ** 0.5, 6)), (100, round(2 ** 0.5, 6)), (7, round(41 ** 0.5, 6))]
    assert lists == sorted((100, k + 1, *x) for side in (a, b) for k, x in enumerate(side))


def test_probes_retrieve_the_whole_ball():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 32))
    codes = ann.learn(x)
    index = ann.Index(np.arange(600), np.arange(600), x, codes)
    bits = codes.bits(x)
    for q in range(0, 600, 120):
        far, met = (bits != bits[q]).sum(axis=1), set()
        for radius, found in index.shells(bits[q]):
            assert not met & set(found.tolist())
            met |= set(found.tolist())
            assert set(np.flatnonzero(far <= radius).tolist()) <= met
        assert len(met) == 600


def test_radius_shrinks_as_neighbours_come_nearer():
    """Few buckets are read where neighbours are near: clusters of near copies among far rows."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(2000, 32)), 12, axis=0) + rng.normal(size=(24_000, 32)) * 0.05
    codes = ann.learn(x[::5])
    q = np.arange(0, 24_000, 400)
    pairs = [(np.linalg.norm(x[j] - x[i]), (codes.bits(x[j][None]) != codes.bits(x[i][None])).sum()) for i in q for j in range(i - i % 12, i - i % 12 + 12) if i != j]
    codes = ann.under_line(codes, *np.array(pairs).T)
    index, hit = ann.Index(np.arange(24_000), np.arange(24_000), x, codes), 0
    for i in q.tolist():
        best, dist = index.nearest(i, x[i], 10)
        true = np.argsort(np.linalg.norm(x - x[i], axis=1), kind="stable")[1:11]
        hit += len(set(best.tolist()) & set(true.tolist()))
    assert hit / (10 * len(q)) >= 0.9 and index.probed / len(q) < 0.05 * len(x)


# ---------------------------------------------------------------- chat
CONV = "conv_id long, turn long, role string, text string, extra int"


def test_segments_are_found_in_linear_time():
    """Hits whose running total falls all the way, as drift does in clean text."""
    class Counted(float):
        n = 0

        def __ge__(self, other):
            Counted.n += 1
            return float(self) >= float(other)

        def __sub__(self, other):
            return Counted(float(self) - float(other))

        def __add__(self, other):
            return Counted(float(self) + float(other))

        __radd__ = __add__

        def __rsub__(self, other):
            return Counted(float(other) - float(self))

    for size in (2_000, 20_000):
        Counted.n = 0
        hits = [(5 * k, Counted(1.0)) for k in range(size)] + [(5 * size, Counted(50.0))]
        assert len(toxicity.segments(hits, Counted(0.45))) == size + 1
        assert Counted.n < 20 * size


def test_preference_pairs_by_hand(spark):
    good = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "a", 0), (1, 2, "user", "more", 0), (1, 3, "assistant", "good", 0)]
    bad = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "a", 0), (1, 2, "user", "more", 0), (1, 3, "assistant", "bad one", 0)]
    p = chat.preference_pairs(chat.turns(spark.createDataFrame(good, CONV)), chat.turns(spark.createDataFrame(bad, CONV))).first()
    assert p["n_common"] == 3 and p["prompt"].count("<|im_start|>") == 3 and p["trains"]
    for side, said in (("chosen", "good"), ("rejected", "bad one")):
        (m,) = p[f"{side}_mask"]
        assert p[side][m["first"]:m["end"]] == f"{said}<|im_end|>"
        assert p[side] == f"<|im_start|>assistant\n{said}<|im_end|>\n"


def test_preference_edges(spark):
    rows = [(1, 0, None, None, 0), (1, 1, "assistant", "x", 0), (1, 1, "assistant", "x", 0), (None, 0, "user", "lost", 0), (2, None, "user", "lost", 0),
            (3, 0, "user", "echo", 0), (3, 1, "assistant", "echo", 0), (4, 0, "user", "u", 0), (5, 5, "assistant", "y" * 50_000, 0)]
    t = chat.turns(spark.createDataFrame(rows, CONV))
    got = {r["pair"]: r for r in chat.preference_pairs(t, chat.corrupted(t)).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1]["n_common"] == 1 and got[1]["rejected"] == "<|im_start|>assistant\n<|im_end|>\n" and got[1]["trains"]
    assert got[3]["n_common"] == 2 and got[3]["chosen"] == "" and not got[3]["trains"]
    assert got[4]["n_common"] == 1 and not got[4]["trains"]
    one = chat.preference_pairs(t.where("pair = 4"), t.where("pair = 1")).orderBy("pair").collect()
    assert (one[0]["chosen"], one[1]["rejected"]) == ("", "") and one[0]["n_common"] == 0
    empty = chat.turns(spark.createDataFrame([], CONV))
    assert chat.preference_pairs(empty, chat.corrupted(empty)).count() == 0
