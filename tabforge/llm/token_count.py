"""Token counts by a finite-state transducer compiled from a byte-level BPE tokenizer file.

**The machine.**  After some bytes of a word, byte-level BPE of just those bytes ends in one last token, and what
stands before that token is again the encoding of its bytes; two tokens may stand side by side if encoding their joined
bytes gives these two.  So the encoding of a longer prefix follows from: the places where some token could still
begin (at most a token's length back), the last token that ends at each of them, and how many tokens lie between.
These make a state, of which there are finitely many.  A transition reads a byte, finds the one
token that may end here, and is annotated with the change of the token count.  The deterministic machine is compiled as
far as the texts need it: states and transitions are made when first met and kept, up to a bound, per worker.

**Long words.**  A word's bytes are cut into chunks wherever a chunk is full.  A chunk's *state map* gives, for a state
that the machine may be in before it, the state after it and the tokens counted between.  Maps compose
associatively, and an exclusive prefix scan over them (up-sweep and down-sweep over pairs) gives the state before every chunk
and the count up to it.  A map is first filled for the state that the bytes just before the chunk lead to, which needs no earlier
chunk; it is nearly always the true one, as a state rests on a token's length of bytes, and where it isn't, the entry for the true state
is added when the scan asks for it.  So results never rest on the guess.

**Long texts.**  A text is cut into chunks.  A chunk's map from what precedes it to a count is held by what is before
its first certain boundary (white space after another character: no match of the pattern spans it), the count between
the first and the last one, and what is after the last.  These maps compose associatively, so neighbours are joined
pair by pair (a parallel prefix scan's up-sweep), and only the pieces at the seams are read again.

One narrow map over the rows: no shuffle, nothing on the driver, memory bounded by the batch, the longest text and the
machine's bounds.  Null and empty texts have no tokens; repeated rows are counted each; columns of the result's names
are replaced.
"""

from __future__ import annotations

import json
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import ship, whole

#: Bytes of a word's chunk, and bytes before it from which the state at its start is guessed.
PIECE, LOOK_BACK = 1 << 12, 64
#: Characters of a text's chunk; words whose counts, and transitions that a worker keeps before it starts anew.
CHUNK, KEEP_WORDS, KEEP_STEPS = 1 << 16, 500_000, 1_500_000


def byte_names() -> dict[str, int]:
    """The characters that byte-level BPE files use for the 256 bytes: printable Latin-1 characters for themselves,
    the others from U+0100 on in order (a fixed rule of the file format)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class StateMap:
    """A chunk of bytes as a map: ``at(state)`` is (state after it, tokens counted).  Entries are made when asked for."""

    def __init__(self, make, guess: int | None = None):
        self.make, self.entries = make, {}
        if guess is not None:
            self.at(guess)

    def at(self, state: int) -> tuple[int, int]:
        if state not in self.entries:
            self.entries[state] = self.make(state)
        return self.entries[state]

    def then(self, after: StateMap) -> StateMap:
        """The map of this chunk followed by another; known entries are carried over at once."""
        def both(state: int) -> tuple[int, int]:
            middle, count = self.at(state)
            end, more = after.at(middle)
            return end, count + more
        out = StateMap(both)
        for state in list(self.entries):
            out.at(state)
        return out


def prefix_scan(maps: list[StateMap], start: int) -> list[tuple[int, int]]:
    """(state, count) before each map and after the last, from ``start``: pairs are composed up to one map and the
    prefixes handed down again, each level's compositions independent of one another."""
    levels = [maps]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([row[k].then(row[k + 1]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)])
    before = [(start, 0)]
    for row in reversed(levels[:-1]):
        down = []
        for k, one in enumerate(row):
            state, count = before[k // 2]
            if k % 2:
                state, more = row[k - 1].at(state)
                count += more
            down.append((state, count))
        before = down
    end, more = maps[-1].at(before[-1][0])
    return [*before, (end, before[-1][1] + more)]


class Transducer(dict):
    """Token counts by word: ``transducer[word]``; a word not met before runs through the machine."""

    def __init__(self, tokenizer_json: str, pattern: str):
        import regex

        with open(tokenizer_json, encoding="utf-8") as f:
            spec = json.load(f)
        names, model = byte_names(), spec["model"]
        raw = {name: bytes(names[c] for c in name) for name in model["vocab"] if all(c in names for c in name)}
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]
        self.tokens = {raw[n]: k for n, k in model["vocab"].items() if n in raw and n not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.order = {(raw[a], raw[b]): k for k, (a, b) in enumerate(merges)}
        #: the tokens as a tree by bytes: node -> {byte: node}; the token that ends at a node
        self.tree: list[dict[int, int]] = [{}]
        self.ends: list[bytes | None] = [None]
        for tok in self.tokens:
            node = 0
            for b in tok:
                if b not in self.tree[node]:
                    self.tree[node][b] = len(self.tree)
                    self.tree.append({})
                    self.ends.append(None)
                node = self.tree[node][b]
            self.ends[node] = tok
        self.find = regex.compile(pattern).findall
        self.seam = regex.compile(r"\S(?=\s)")
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.beside: dict[tuple[bytes | None, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Back to the start state alone; counts already given stay right."""
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.n_steps = 0
        self.number(((0, None, 0),))

    def number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def merged(self, raw: bytes) -> list[bytes]:
        """The tokens of a few bytes by the merge list itself."""
        parts = [raw[k:k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            rank, k = min((self.order.get(p, len(self.order)), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.order):
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def may_follow(self, left: bytes | None, tok: bytes) -> bool:
        if (left, tok) not in self.beside:
            if len(self.beside) > KEEP_STEPS:
                self.beside.clear()
            self.beside[left, tok] = self.merged((left or b"") + tok) == ([tok] if left is None else [left, tok])
        return self.beside[left, tok]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: (next state, change of the count).  A state lists the places where a token may
        have begun: (node of the tree for the bytes since, token that ends there, its count against the newest)."""
        last, grown, going = None, 0, []
        for node, left, count in self.states[state]:
            if (child := self.tree[node].get(byte)) is None:
                continue
            if last is None and (tok := self.ends[child]) is not None and self.may_follow(left, tok):
                last, grown = tok, count + 1
            if self.tree[child]:
                going.append((child, left, count))
        if last is None:
            raise ValueError("the tokenizer has no token for a byte")
        found = self.number((*((n, left, c - grown) for n, left, c in going), (0, last, 0))), grown
        self.steps[state][byte] = found
        self.n_steps += 1
        return found

    def walk(self, raw: bytes, state: int) -> tuple[int, int]:
        """(state after the bytes, tokens counted)."""
        total, steps = 0, self.steps
        for byte in raw:
            state, grown = steps[state].get(byte) or self.step(state, byte)
            total += grown
        return state, total

    def state_maps(self, raw: bytes, piece: int) -> list[StateMap]:
        """The state maps of a word's chunks, each made without those before it."""
        return [StateMap(partial(self.walk, raw[k:k + piece]), self.walk(raw[max(0, k - LOOK_BACK):k], 0)[0])
                for k in range(0, len(raw), piece)]

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        total = self.walk(raw, 0)[1] if len(raw) <= PIECE else prefix_scan(self.state_maps(raw, PIECE), 0)[-1][1]
        if len(self) < KEEP_WORDS and len(word) <= 64:
            self[word] = total
        if self.n_steps > KEEP_STEPS:
            self.reset()
        return total

    def run(self, text: str) -> int:
        return sum(map(self.__getitem__, self.find(text)))

    def chunk_map(self, chunk: str) -> tuple[str, int, str] | str:
        """A chunk's map: (text before the first boundary, count, text after the last), or the chunk if it has none."""
        ends = [m.end() for m in self.seam.finditer(chunk)]
        return (chunk[:ends[0]], self.run(chunk[ends[0]:ends[-1]]), chunk[ends[-1]:]) if ends else chunk

    def join(self, a, b):
        """The map of two neighbouring stretches: the inner ends meet; a boundary between them, if any, is found again."""
        if isinstance(a, str) and isinstance(b, str):
            return self.chunk_map(a + b)
        if isinstance(a, str):
            return a + b[0], b[1], b[2]
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str) -> int:
        """Tokens of a whole text; special tokens' strings are one token each, as the library takes them."""
        if any(s in text for s in self.special):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.run(text)
        maps = [self.chunk_map(text[k:k + CHUNK]) for k in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.join(*maps[k:k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return self.run(maps[0]) if isinstance(maps[0], str) else self.run(maps[0][0]) + maps[0][1] + self.run(maps[0][2])


_MACHINE: dict[tuple[str, str], Transducer] = {}


def machine(tokenizer_json: str, pattern: str) -> Transducer:
    """This worker's machine for a tokenizer file."""
    if (tokenizer_json, pattern) not in _MACHINE:
        _MACHINE.clear()
        _MACHINE[tokenizer_json, pattern] = Transducer(tokenizer_json, pattern)
    return _MACHINE[tokenizer_json, pattern]


def token_counts(docs: DataFrame, tokenizer_json: str, pattern: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        m = machine(tokenizer_json, pattern)
        return pd.Series([m.count(t) for t in texts], dtype="int64")

    n = docs.withColumn("n_tokens", count(whole(text)))
    return n.withColumn("n_bytes", F.octet_length(whole(text)).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
