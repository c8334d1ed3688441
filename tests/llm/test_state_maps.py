"""Chunk state maps: equal to one run over the whole word for chunks cut at every offset, and to the library."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tabforge.llm import token_count as TC

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def machine():
    return TC.Transducer(PATH, P.PATTERN)


def words():
    rnd = random.Random(11)
    yield "a" * 700
    yield "".join(rnd.choice("abcdefghijklmnop") for _ in range(600))
    yield "".join(rnd.choice(["token", "isation", "the", "ing", "é", "Straße", "数据"]) for _ in range(120))
    yield "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(200))


@pytest.mark.parametrize("word", list(words()))
def test_cut_at_every_offset(machine, word):
    raw = word.encode()
    want = machine.walk(raw, 0)
    for cut in range(1, len(raw)):
        maps = [TC.StateMap(lambda s, p=p: machine.walk(p, s)) for p in (raw[:cut], raw[cut:])]
        got = TC.prefix_scan(maps, 0)
        assert got[-1] == want and got[1] == machine.walk(raw[:cut], 0)
    for piece in (1, 2, 3, 7, 64, 100, len(raw), len(raw) + 5):
        maps = machine.state_maps(raw, piece)
        got = TC.prefix_scan(maps, 0)
        assert got[-1] == want and len(got) == len(maps) + 1
        assert got[:-1] == [machine.walk(raw[:k], 0) for k in range(0, len(raw), piece)]


def test_wrong_guess_does_not_matter(machine):
    raw = next(words()).encode()
    want = machine.walk(raw, 0)
    other = machine.walk(b"zq", 0)[0]
    maps = [TC.StateMap(lambda s, p=raw[k:k + 50]: machine.walk(p, s), other) for k in range(0, len(raw), 50)]
    assert TC.prefix_scan(maps, 0)[-1] == want


def test_composition_is_associative(machine):
    raw = list(words())[1].encode()
    a, b, c = (TC.StateMap(lambda s, p=p: machine.walk(p, s), 0) for p in (raw[:100], raw[100:333], raw[333:]))
    assert a.then(b).then(c).at(0) == a.then(b.then(c)).at(0) == machine.walk(raw, 0)


def test_long_words_equal_the_library(machine, monkeypatch):
    tok = Tokenizer.from_file(PATH)
    monkeypatch.setattr(TC, "PIECE", 256)
    monkeypatch.setattr(TC, "CHUNK", 1000)
    for word in words():
        for text in (word, word * 20, f"x {word}\n\n {word * 9} y", word + " " * 3000 + word):
            assert machine.count(text) == len(tok.encode(text, add_special_tokens=False).ids)
