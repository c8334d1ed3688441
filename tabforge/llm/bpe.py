"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

A text is cut into matches of the vocabulary's pattern; every match ("word") is encoded on its own.  Words that
are tokens themselves need no merging.  For the others a task hands DuckDB one row per (word, position, token),
first the single bytes: a recursive query joins neighbouring rows with the merge table, contracts each word's
leftmost pair of the smallest rank, and goes on with the words that changed until none does.  Words are encoded once
per Python worker: a bounded table keeps their ids, whatever the text, and only saves work.  Decoding joins
(text, position, id) rows with the vocabulary and aggregates the bytes in order of position.

The work is one narrow map over the documents: no shuffle, no driver data, nothing kept between tasks that a retry
would miss.  Short texts go in slices of at most ``SLICE_CHARS`` characters; a longer text goes in runs of ``RUN_WORDS`` words and its ids in
runs of ``RUN_IDS`` (encoding is word by word, decoding token by token), so the database's memory is bounded whatever the
text, and it may not spill to a machine's own disk.  A word of over ``LONG_WORD`` bytes goes as overlapping windows of that
length: where two windows agree on the token that ends at a place, what is left of it is taken from one and what is right of it
from the other, because a sequence of tokens is the encoding of its bytes if each neighbouring pair is that of its own bytes, and every pair
left stands in one window.  Windows that agree nowhere (long repeats can have a period that shifts from window to window) are doubled.

Null and empty texts have no ids and decode to empty bytes; repeated rows each give a row; extra columns are left as
they are, except that the result columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import fresh, quoted, ship, whole, without

SLICE_CHARS, MEMORY = 1_000_000, "160MB"
#: Words whose ids a worker keeps before it starts anew, and the bytes of words sent to one recursive query.
KEEP_WORDS, QUERY_BYTES, RUN_WORDS, RUN_IDS = 300_000, 300_000, 100_000, 200_000
#: A word longer than this is encoded in windows; windows are doubled up to WIDEST, whose places the recursive query can hold.
LONG_WORD, WIDEST = 512, 16_384

#: One step: neighbours by position, the smallest merge of each word, its leftmost place; the right half goes.
#: rank, position and next position are packed into one whole number, positions being under 2 ** 15.
LEFTMOST = """
WITH RECURSIVE state(place, token, live) AS (
  SELECT word::BIGINT << 15 | pos, token, true FROM seed
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT place, place >> 15 AS word, token, lead(token) OVER by_place AS next_token, lead(place) OVER by_place AS next_place
     FROM state WHERE live WINDOW by_place AS (ORDER BY place)),
   best AS (
     SELECT p.word, min((m.rank::BIGINT << 30) | ((p.place & 32767) << 15) | (p.next_place & 32767)) AS first
     FROM pairs p JOIN merges m ON m.pair = (p.token::BIGINT << 32 | p.next_token)
     WHERE p.next_place >> 15 = p.word GROUP BY p.word)
   SELECT p.place, CASE WHEN (p.place & 32767) = ((b.first >> 15) & 32767) THEN (b.first >> 30)::INT ELSE p.token END, b.first IS NOT NULL
   FROM pairs p LEFT JOIN best b ON b.word = p.word WHERE b.first IS NULL OR (p.place & 32767) <> (b.first & 32767))
)
SELECT (place >> 15)::INT AS word, token FROM state WHERE NOT live ORDER BY place
"""

#: The same for one long word, all non-overlapping occurrences of the smallest rank at once (in a run of
#: overlapping occurrences every second one, from the left); each step is one query, so memory stays linear.
ALL_OCCURRENCES = """
CREATE OR REPLACE TEMP TABLE state AS
WITH pairs AS MATERIALIZED (
  SELECT s.pos, s.token, s.next_pos, s.nth, m.rank FROM (
    SELECT pos, token, lead(token) OVER w AS next_token, lead(pos) OVER w AS next_pos, row_number() OVER w AS nth
    FROM state WINDOW w AS (ORDER BY pos)) s
  LEFT JOIN merges m ON m.pair = (s.token::BIGINT << 32 | s.next_token)),
hits AS (
  SELECT pos, next_pos, rank, nth - row_number() OVER (ORDER BY pos) AS run FROM pairs
  WHERE rank = (SELECT min(rank) FROM pairs)),
taken AS MATERIALIZED (SELECT pos, next_pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) AS k FROM hits) WHERE k % 2 = 1)
SELECT p.pos, coalesce(t.rank, p.token)::INT AS token FROM pairs p LEFT JOIN taken t ON t.pos = p.pos
WHERE p.pos NOT IN (SELECT next_pos FROM taken)
"""

DECODE = """
WITH spelled AS (SELECT ids.text, ids.pos, v.hex FROM ids JOIN vocab v USING (token) ORDER BY ids.text, ids.pos)
SELECT text, string_agg(hex, '') AS hex FROM spelled GROUP BY text
"""


class Codec:
    """A rank file, its merge table in DuckDB, and the words this worker has encoded so far."""

    def __init__(self, rank_file: str, pattern: str):
        import pyarrow as pa
        import regex

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}
        self.pa, self.find, self.finditer = pa, regex.compile(pattern).findall, regex.compile(pattern).finditer
        #: a pair of tokens merges if its joined bytes are a token; the smaller that token's id, the earlier
        pairs = [((left << 32) | right, rank) for tok, rank in self.ranks.items() for cut in range(1, len(tok))
                 if (left := self.ranks.get(tok[:cut])) is not None and (right := self.ranks.get(tok[cut:])) is not None]
        self.merge_table = {"pair": np.array([p for p, _ in pairs], np.int64), "rank": np.array([r for _, r in pairs], np.int32)}
        self.opened = None
        self.size_of = {rank: len(tok) for tok, rank in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    @property
    def db(self):
        """The in-memory database, opened when first needed."""
        if self.opened is None:
            import duckdb

            self.opened = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
            self.load("merges", **self.merge_table)
            self.load("vocab", token=np.array(list(self.ranks.values()), np.int32), hex=self.pa.array([t.hex() for t in self.ranks]))
        return self.opened

    def rest(self) -> None:
        """Give the database's and Arrow's memory back between tasks; the words known stay."""
        if self.opened is not None:
            self.opened.close()
            self.opened = None
        self.pa.default_memory_pool().release_unused()

    def load(self, name: str, **columns) -> None:
        self.db.register("incoming", self.pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.start = array("i"), array("q", [0])

    def learn(self, words: list[str]) -> None:
        """Encode the words and give each a slot; ids of slot k are flat[start[k]:start[k + 1]]."""
        pending: list[tuple[str, bytes]] = []
        size = 0
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if (token := self.ranks.get(raw)) is not None:
                self.keep(word, [token])
            elif len(raw) > LONG_WORD:
                self.keep(word, self.long_word(raw))
            else:
                pending.append((word, raw))
                size += len(raw)
                if size > QUERY_BYTES:
                    self.merge(pending)
                    pending, size = [], 0
        if pending:
            self.merge(pending)

    def keep(self, word: str, ids) -> None:
        self.slot[word] = len(self.start) - 1
        self.flat.extend(ids)
        self.start.append(len(self.flat))

    def merge(self, words: list[tuple[str, bytes]]) -> None:
        counts, tokens = self.contracted([raw for _, raw in words])
        base, first = len(self.start) - 1, len(self.flat)
        self.flat.frombytes(tokens.tobytes())
        self.start.frombytes((first + np.cumsum(counts)).astype(np.int64).tobytes())
        self.slot.update((word, base + k) for k, (word, _) in enumerate(words))

    def contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each word has, and the tokens, by the recursive query."""
        sizes = np.array([len(raw) for raw in words])
        ends = np.cumsum(sizes)
        pos = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        self.load("seed", word=np.repeat(np.arange(len(words), dtype=np.int32), sizes), pos=pos.astype(np.int32),
                  token=self.of_byte[np.frombuffer(b"".join(words), np.uint8)])
        rows = self.db.sql(LEFTMOST).fetchnumpy()
        return np.bincount(rows["word"], minlength=len(words)), np.ascontiguousarray(rows["token"], np.int32)

    def windowed(self, raw: bytes, size: int) -> list[int] | None:
        """A long word's tokens from windows of ``size`` bytes that overlap by half; None if two of them agree nowhere."""
        half = size // 2
        firsts = list(range(0, max(1, len(raw) - half), half))
        out: list[int] = []
        before: tuple[list[int], list[int]] | None = None  # the last window's tokens and where each ends
        cut = 0  # up to where tokens are taken
        per = max(1, 20 * QUERY_BYTES // (size * size // 512))
        for k in range(0, len(firsts), per):
            counts, tokens = self.contracted([raw[f:f + size] for f in firsts[k:k + per]])
            at = 0
            for f, n in zip(firsts[k:k + per], counts.tolist(), strict=True):
                ids = tokens[at:at + n].tolist()
                at += n
                ends = np.cumsum([self.size_of[i] for i in ids]).tolist()
                ends = [f + e for e in ends]
                if before is not None:
                    # the first place in both windows' sight where the same token ends
                    own = {e: i for e, i in zip(ends, ids, strict=True) if e - self.size_of[i] >= f}
                    place = next((e for e, i in zip(before[1], before[0], strict=True) if e > max(cut, f) and own.get(e) == i and e - self.size_of[i] > f), None)
                    if place is None:
                        return None
                    out += [i for i, e in zip(*before, strict=True) if cut < e <= place]
                    cut = place
                before = ids, ends
        return out + [i for i, e in zip(*before, strict=True) if e > cut]

    def long_word(self, raw: bytes) -> list[int]:
        size = LONG_WORD
        while size <= WIDEST and size < len(raw):
            if (ids := self.windowed(raw, size)) is not None:
                return ids
            size *= 2
        return self.merge_long(raw)

    def merge_long(self, raw: bytes) -> list[int]:
        self.load("state", pos=np.arange(len(raw), dtype=np.int32), token=self.of_byte[np.frombuffer(raw, np.uint8)])
        size = len(raw)
        while True:
            self.db.execute(ALL_OCCURRENCES)
            now = self.db.sql("SELECT count(*) FROM state").fetchall()[0][0]
            if now == size:
                return self.db.sql("SELECT token FROM state ORDER BY pos").fetchnumpy()["token"].tolist()
            size = now

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as int32 arrays."""
        if len(self.slot) > KEEP_WORDS:
            self.forget()
        cut = [self.find(t) for t in texts]
        words, slot = list(chain.from_iterable(cut)), self.slot
        slots = np.fromiter(map(slot.get, words, repeat(-1)), np.int64, len(words))
        if len(unknown := np.flatnonzero(slots < 0)):
            unseen = [words[k] for k in unknown.tolist()]
            self.learn(list(dict.fromkeys(unseen)))
            slots[unknown] = [slot[w] for w in unseen]
        sizes = np.array([len(x) for x in cut], np.int64)
        start = np.frombuffer(self.start, np.int64)
        counts = start[slots + 1] - start[slots]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(self.flat, np.int32)[np.repeat(start[slots] - (ends - counts), counts) + np.arange(total)] if total else np.zeros(0, np.int32)
        del start
        word_ends = np.cumsum(sizes)
        at = np.concatenate([[0], ends])[np.concatenate([[0], word_ends])]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def runs(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a long text, a run of words at a time."""
        words: list[str] = []
        for m in self.finditer(text):
            words.append(m.group())
            if len(words) >= RUN_WORDS:
                yield self.of_words(words)
                words = []
        if words:
            yield self.of_words(words)

    def of_words(self, words: list[str]) -> np.ndarray:
        if len(self.slot) > KEEP_WORDS:
            self.forget()
        new = list(dict.fromkeys(w for w in words if w not in self.slot))
        if new:
            self.learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        start = np.array(self.start, np.int64)
        counts = start[slots + 1] - start[slots]
        ends = np.cumsum(counts)
        return np.array(self.flat, np.int32)[np.repeat(start[slots] - (ends - counts), counts) + np.arange(int(ends[-1]))]

    def spelled(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of a long list of ids, a run at a time."""
        for k in range(0, len(ids), RUN_IDS):
            yield self.decode([ids[k:k + RUN_IDS]])[0]

    def decode(self, many: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids; an id outside the vocabulary raises ValueError."""
        sizes = np.array([len(x) for x in many], np.int64)
        if not sizes.sum():
            return [b""] * len(many)
        ids = np.concatenate(many).astype(np.int64)
        if ids.min() < 0 or ids.max() >= len(self.ranks):
            raise ValueError("an id is outside the vocabulary")
        self.load("ids", text=np.repeat(np.arange(len(many), dtype=np.int32), sizes), pos=np.arange(len(ids)), token=ids.astype(np.int32))
        out = [b""] * len(many)
        for text, spelled in self.db.sql(DECODE).fetchall():
            out[text] = bytes.fromhex(spelled)
        return out


_CODEC: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    """This worker's codec for a rank file."""
    if (rank_file, pattern) not in _CODEC:
        _CODEC.clear()
        _CODEC[rank_file, pattern] = Codec(rank_file, pattern)
    return _CODEC[rank_file, pattern]


def slices(texts, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``chars`` characters, or one row."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def long(rows, a: int, b: int, most: int) -> bool:
    """Whether a slice is one row of over ``most`` characters or ids."""
    return b == a + 1 and len(rows[a]) > most


def digest(c: Codec, text: str) -> tuple[int, str, str]:
    """Number of ids, digest of the ids and of the decoded bytes of a long text, run by run."""
    n, ids_sha, raw_sha = 0, hashlib.sha256(), hashlib.sha256()
    for ids in c.runs(text):
        n += len(ids)
        ids_sha.update(ids.astype("<u4").tobytes())
        for raw in c.spelled(ids):
            raw_sha.update(raw)
    return n, ids_sha.hexdigest(), raw_sha.hexdigest()


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the column ``out``: the text's ids, in order."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(rank_file, pattern)
        try:
            for texts in batches:
                rows = texts.tolist()
                yield pd.Series([ids for a, b in slices(rows) for ids in (
                    [np.concatenate(list(c.runs(rows[a])))] if long(rows, a, b, SLICE_CHARS) else c.encode(rows[a:b]))], dtype=object)
        finally:
            c.rest()

    return docs.withColumn(out, ids_of(whole(text)))


def decode(rows: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the binary column ``out``: the bytes that the ids stand for (null ids: empty)."""
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(rank_file, pattern)
        try:
            for lists in batches:
                many = [np.asarray([] if x is None else x, np.int64) for x in lists]
                yield pd.Series([raw for a, b in slices(many, RUN_IDS) for raw in (
                    [b"".join(c.spelled(many[a]))] if long(many, a, b, RUN_IDS) else c.decode(many[a:b]))], dtype=object)
        finally:
            c.rest()

    return rows.withColumn(out, bytes_of(F.col(ids)))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: each text encoded, its ids decoded again, both digested."""
    ship(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(rank_file, pattern)
        try:
            for texts in batches:
                rows, out = texts.tolist(), []
                for a, b in slices(rows):
                    if long(rows, a, b, SLICE_CHARS):
                        out.append(digest(c, rows[a]))
                        continue
                    ids = c.encode(rows[a:b])
                    for one, raw in zip(ids, c.decode(ids), strict=True):
                        out.append((len(one), hashlib.sha256(one.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
                yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            c.rest()

    kept = without(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    codes, = fresh(docs, "codes")
    coded = docs.select(*[quoted(c) for c in kept], digests(whole(text)).alias(codes))
    return coded.select(*[quoted(c) for c in kept], f"{codes}.*")
