"""The conversation trie against one built turn by turn."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabforge.llm import trie

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(c - 5 * int(c / 5)), [])[:h] + ts[h:]
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, cs in members.items():
        leaves, saved, todo = 0, 0, [node]
        while todo:
            x = todo.pop()
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
            leaves += x not in children
            todo += children.get(x, [])
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(df):
    got = trie.prefix_trie(*trie.rebuilt(trie.turns(df)))
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("chunk", [1024, 2])
def test_against_a_trie_built_turn_by_turn(spark, monkeypatch, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "RANGE", 8 if chunk == 2 else 4096)
    rng, rows = random.Random(5), []
    for c in [*range(90), -7, -5, -12, 400, 403, 1 << 40]:
        for k in range(rng.randrange(1, 14)):
            rows.append((c, k * 3 if k else None, rng.choice(["user", "user", None]), rng.choice(["a", "a", "a", "é", None])))
    rows += [(7, 2, "user", "a")] * 3 + [(None, 1, "user", "x"), (405, None, None, None), (406, 5, "user", "b")]
    rows += [(c, k, "user", "same" * (k % 2)) for c in range(500, 560) for k in range(3)]  # a group of copies
    rows += [(600, k, "user", str(k % 3)) for k in range(200)]  # one long conversation
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    for c in ("conv", "pos", "depth", "chunk", "n", "digest"):
        df = df.withColumn(c, F.lit("clash"))
    assert built(df) == plain(rows)


def test_no_conversations(spark):
    assert built(spark.createDataFrame([], ROWS)) == []
    assert built(spark.createDataFrame([(None, 1, "user", "x")], ROWS)) == []


def test_one_conversation_without_turns_left(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "hi")]
    assert built(spark.createDataFrame(rows, ROWS)) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
