"""Benchmark decontamination with an FM-index over every shard of the training texts.

Texts and benchmark items are words (runs of letters, digits and non-ASCII characters, A-Z in lower case).  An item's phrases are
its windows of ``size`` words, or the whole item if it has fewer.  A task reads its documents in shards of about ``SHARD`` words and
indexes each: words of the benchmark are the alphabet and anything else separates, so only stretches of benchmark words as
long as the shortest phrase are kept, each ended by a separator that sorts by its place.  The shard's suffixes are ordered by
prefix doubling; the character before each of them (the Burrows-Wheeler transform) goes to a wavelet matrix of packed bits.
All phrases are searched together, last word first: a step takes two ranks a phrase, and phrases with an empty
range leave.  Occurrences are located by walking back to the nearest sampled suffix (every ``SAMPLED``-th place and every
stretch's first), and a document's overlapping or touching occurrences merge into removal spans.

Documents don't shuffle: an index lives as long as its shard, in one task.  The benchmark is the stated query set: it is cut into
pieces of at most about ``PIECE_WORDS`` words on Spark, whose number is counted, and dealt to blocks of about ``BLOCK_WORDS`` words;
a block is the only thing the driver holds and broadcasts.  Further blocks take further passes, each written to
the shared folder, whose spans merge natively.  A text longer than a shard is indexed in overlapping stretches.

Defined cases: null or wordless texts have no words and no spans; null or wordless items have no phrases; items
with the same id are one item, those without an id are the item ''; repeated rows are found each; columns named like
the result's are replaced, others stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import fresh, quoted, ship, whole, without
from tabforge.session import cut_lineage, scratch_path

SIZE, SHARD, SAMPLED, PIECE_WORDS, BLOCK_WORDS = 10, 1 << 20, 8, 1000, 2_000_000
#: bits of a place in a shard: sort keys carry the place, so a shard (its last batch included) is shorter than this
PLACE_BITS = 22
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same on UTF-8 bytes: capitals in lower case, everything that is in no word as a space
AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = ["n_words", "spans", "items"]
FOUND = "n_words long, spans array<struct<first:int,end:int,first_byte:int,end_byte:int>>, items array<string>"


def popcount_before(packed: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Set bits before each place."""
    words, before = packed
    w = at >> 6
    low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[w] + np.bitwise_count(words[w] & low)


def pack(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits in words of 64 and the number of set bits before each word."""
    raw = np.packbits(bits, bitorder="little")
    words = np.zeros(len(bits) // 64 + 1, np.uint64)
    words.view(np.uint8)[:len(raw)] = raw
    before = np.zeros(len(words), np.int64)
    np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
    return words, before


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Places of ``text`` (symbols of so many bits, 0 a separator, which ends the text too) in order of their suffixes up
    to the next separator, equal ones in order of place.  Each round sorts the places not yet told apart by their own and the
    next ranks; a key holds the place in its low bits, so plain values are sorted."""
    n, mask = len(text), (1 << PLACE_BITS) - 1
    known = (63 - PLACE_BITS) // bits
    padded = np.concatenate([text, np.zeros(known, text.dtype)]).astype(np.int64)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(known):
        s = np.where(alive, padded[k:n + k], 0)
        key = key << bits | s
        alive &= s > 0
    key = np.sort(key << PLACE_BITS | np.arange(n))
    order, key = key & mask, key >> PLACE_BITS
    slot = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    # a suffix that met its separator is in place; so is one without an equal
    settled = (key & ((1 << bits) - 1) == 0) | (head & np.append(head[1:], True))
    rank = np.empty(n, np.int64)
    rank[order] = np.where(settled, slot, np.maximum.accumulate(np.where(head, slot, 0)))
    slots = np.flatnonzero(~settled)
    while len(slots):
        places = order[slots]
        # a group's slots are neighbours, so its rank orders them; ranks and the entry's number fit the key in two steps
        nxt = rank[places + known]
        own = rank[places]
        group = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
        by_next = np.sort(nxt << PLACE_BITS | np.arange(len(places)))
        nth = by_next & mask
        seat = np.empty(len(places), np.int64)
        seat[nth] = np.cumsum(np.concatenate([[0], (by_next[1:] >> PLACE_BITS) != (by_next[:-1] >> PLACE_BITS)]))
        key = np.sort(group << (2 * PLACE_BITS - 2) | seat << (PLACE_BITS - 1) | np.arange(len(places))) if len(places) < 1 << (PLACE_BITS - 1) else None
        if key is None:
            turn = np.lexsort((np.arange(len(places)), seat, group))
            pair = (group[turn] << PLACE_BITS) | seat[turn]
        else:
            turn, pair = key & ((1 << (PLACE_BITS - 1)) - 1), key >> (PLACE_BITS - 1)
        places = places[turn]
        order[slots] = places
        head = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[places] = np.maximum.accumulate(np.where(head, slots, 0))
        slots = slots[~(head & np.append(head[1:], True))]
        known *= 2
    return order


class FMIndex:
    """Counts and places of phrases in a text of symbols 1 .. top; 0 separates and ends the text."""

    def __init__(self, text: np.ndarray, top: int):
        bits = max(1, int(top).bit_length())
        order = suffix_order(text, bits)
        before = text[order - 1]
        before[order == 0] = 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.levels, now = [], before
        for level in reversed(range(bits)):
            one = (now >> level & 1).astype(bool)
            self.levels.append((level, pack(one), len(now) - int(one.sum())))
            now = np.concatenate([now[~one], now[one]])
        symbols = np.arange(top + 1)
        self.base = self.down(symbols, np.zeros(top + 1, np.int64))
        sampled = (order % SAMPLED == 0) | (before == 0)
        self.sampled, self.places = pack(sampled), order[sampled]

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the wavelet matrix leads from places of its top row along the symbols' bits."""
        for level, packed, zeros in self.levels:
            ones = popcount_before(packed, at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.down(symbol, at) - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of symbols) that occur: their numbers, and their ranges [low, high) of the suffix order."""
        there = np.flatnonzero((np.diff(self.first)[phrases] > 0).all(axis=1))
        low, high = self.first[phrases[there, -1]], self.first[phrases[there, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[there, k]
            low, high = self.step(symbol, low), self.step(symbol, high)
            kept = low < high
            there, low, high = there[kept], low[kept], high[kept]
        return there, low, high

    def back(self, at: np.ndarray) -> np.ndarray:
        """From rows of the suffix order to the rows of the suffixes one symbol longer."""
        symbol = np.zeros(len(at), np.int64)
        for _, packed, zeros in self.levels:
            words, _ = packed
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = popcount_before(packed, at)
            at = np.where(bit, zeros + ones, at - ones)
            symbol = symbol << 1 | bit
        return self.first[symbol] + at - self.base[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text places of rows of the suffix order."""
        out, steps, waiting = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(waiting):
            words, _ = self.sampled
            hit = (words[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out[waiting[hit]] = self.places[popcount_before(self.sampled, rows[hit])] + steps
            waiting, rows = waiting[~hit], self.back(rows[~hit])
            steps += 1
        return out


class Phrases:
    """A block of the benchmark: the alphabet, and per length the phrases and their items."""

    def __init__(self, pieces: list[tuple[str, list[str]]], size: int):
        self.symbol: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in pieces})
        number = {item: k for k, item in enumerate(self.items)}
        rows: dict[int, list] = {}
        for item, words in pieces:
            s = [self.symbol.setdefault(w.encode("utf-8", "surrogatepass"), len(self.symbol) + 1) for w in words]
            m = min(size, len(s))
            rows.setdefault(m, []).extend((*s[k:k + m], number[item]) for k in range(len(s) - m + 1))
        self.by_length = {}
        for m, found in rows.items():
            found = np.unique(np.array(found, np.int64), axis=0)
            phrases, which = np.unique(found[:, :m], axis=0, return_inverse=True)
            # a phrase of several items: its items' numbers are item[start[k]:start[k + 1]]
            by = np.argsort(which.ravel(), kind="stable")
            self.by_length[m] = phrases, found[by, m], np.concatenate([[0], np.cumsum(np.bincount(which.ravel()))])
        self.shortest, self.longest = min(self.by_length, default=0), max(self.by_length, default=0)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, item) of each occurrence of each item's phrases in a text of symbols."""
        index = FMIndex(text, len(self.symbol))
        places, lengths, items = [], [], []
        for m, (phrases, item, start) in self.by_length.items():
            there, low, high = index.search(phrases)
            n = high - low
            rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = index.locate(rows)
            which = np.repeat(there, n)
            of = start[which + 1] - start[which]
            places.append(np.repeat(at, of))
            items.append(item[np.repeat(start[which] - (np.cumsum(of) - of), of) + np.arange(of.sum())])
            lengths.append(np.full(int(of.sum()), m))
        return np.concatenate(places), np.concatenate(lengths), np.concatenate(items)


class Shard:
    """Documents of a task that wait for their index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.n_words: list[int] = []
        self.texts: list[bytes] = []
        self.stretches: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.words = 0

    def add(self, text: bytes) -> None:
        p, raw = self.phrases, text.translate(AS_WORDS)
        words = raw.split()
        doc = len(self.n_words)
        self.n_words.append(len(words))
        self.texts.append(raw)
        if not p.shortest or len(words) < p.shortest:
            return
        symbols = np.fromiter(map(p.symbol.get, words, repeat(0)), np.int32, len(words))
        gaps = np.flatnonzero(symbols == 0)
        first = np.concatenate([[0], gaps + 1])
        end = np.append(gaps, len(words))
        kept = end - first >= p.shortest
        first, end = first[kept], end[kept]
        step = SHARD // 2
        if len(first) and (end - first).max() > step + p.longest:  # a stretch longer than half a shard, in overlapping parts
            parts = [(k, min(e, k + step + p.longest - 1)) for f, e in zip(first.tolist(), end.tolist(), strict=True) for k in range(f, max(f + 1, e - p.longest + 1), step)]
            first, end = (np.array(x, np.int64) for x in zip(*parts, strict=True))
        if len(first):
            self.stretches.append((np.full(len(first), doc), first, end, symbols))
            self.words += int((end - first).sum())

    def spans(self) -> list[dict]:
        """The found phrases of each waiting document."""
        spans: list[list] = [[] for _ in self.n_words]
        items: list[set] = [set() for _ in self.n_words]
        begin = 0
        while begin < len(self.stretches):  # at most about SHARD words at a time
            doc, first, place, parts, size, stop = [], [], [], [], 0, begin
            while stop < len(self.stretches) and (size < SHARD or stop == begin):
                d, a, b, symbols = self.stretches[stop]
                taken = 0
                while taken < len(a) and (size < SHARD or taken == 0):
                    doc.append(int(d[taken]))
                    first.append(int(a[taken]))
                    place.append(size)
                    parts += [symbols[a[taken]:b[taken]], np.zeros(1, np.int32)]
                    size += int(b[taken] - a[taken]) + 1
                    taken += 1
                if taken < len(a):
                    self.stretches[stop] = d[taken:], a[taken:], b[taken:], symbols
                    break
                stop += 1
            begin = stop
            self.found(np.concatenate(parts), np.array(doc), np.array(first), np.array(place), spans, items)
        out = []
        for n, raw, s, i in zip(self.n_words, self.texts, spans, items, strict=True):
            out.append({"n_words": n, "spans": with_bytes(raw, merged(s)), "items": sorted(i)})
        self.clear()
        return out

    def found(self, text, doc, first, place, spans, items) -> None:
        at, length, item = self.phrases.occurrences(text)
        if not len(at):
            return
        which = np.searchsorted(place, at, side="right") - 1
        word = first[which] + at - place[which]
        code, end = doc[which] << 32 | word, doc[which] << 32 | (word + length)
        for d, i in np.unique(np.column_stack([doc[which], item]), axis=0).tolist():
            items[d].add(self.phrases.items[i])
        by = np.argsort(code, kind="stable")
        code, top = code[by], np.maximum.accumulate(end[by])
        new = np.concatenate([[True], code[1:] > top[:-1]])
        low = (1 << 32) - 1
        for a, b in zip(code[new].tolist(), top[np.append(new[1:], True)].tolist(), strict=True):
            spans[a >> 32].append((a & low, b & low))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def with_bytes(raw: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words with the bytes from their first word's first to their last word's last."""
    if not spans:
        return []
    letter = np.frombuffer(raw, np.uint8) != 32
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    begins, ends = edge[::2], edge[1::2]
    return [{"first": a, "end": b, "first_byte": int(begins[a]), "end_byte": int(ends[b - 1])} for a, b in spans]


_PHRASES: dict[str, Phrases] = {}


def phrases_of(block: tuple[str, list, int]) -> Phrases:
    """This worker's phrases for a broadcast block."""
    name, pieces, size = block
    if name not in _PHRASES:
        _PHRASES.clear()
        _PHRASES[name] = Phrases(pieces, size)
    return _PHRASES[name]


def benchmark_pieces(benchmark: DataFrame, item_id: str, phrase: str, size: int) -> DataFrame:
    """(item, words, piece): the items' words in pieces that overlap by size - 1 words, so that each window is in one."""
    # regular expressions of the JVM take the characters of WORDS as they are
    words = F.regexp_extract_all(F.translate(whole(phrase), LETTERS, LETTERS.lower()), F.lit(WORDS), F.lit(0))
    item = F.coalesce(F.col(item_id).cast("string"), F.lit(""))
    w = benchmark.select(item.alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)), F.lit(PIECE_WORDS))
    p = w.select("item", "w", F.explode(starts).alias("piece"))
    return p.select("item", F.slice("w", F.col("piece") + 1, F.lit(PIECE_WORDS + size - 1)).alias("words"), "piece")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", phrase: str = "text",
                  size: int = SIZE) -> DataFrame:
    """``docs`` with n_words, spans (merged removal spans: words [first, end) and bytes [first_byte, end_byte) of the UTF-8
    text) and items (ids, as text and in order, of the benchmark items with a phrase in the text)."""
    spark = docs.sparkSession
    ship(spark)
    pieces = cut_lineage(benchmark_pieces(benchmark, item_id, phrase, size))
    n_blocks = max(1, -(-(pieces.agg(F.sum(F.size("words"))).first()[0] or 0) // BLOCK_WORDS))
    kept = without(docs, *RESULT)
    # a column of the result's name may be the text itself, so it is read before it goes
    name, had = fresh(docs, "found", "text")
    out = docs.select(*[quoted(c) for c in kept], whole(text).alias(had))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(n_blocks)))
    for k in range(n_blocks):
        block = [(r["item"], r["words"]) for r in dealt.where(F.col("block") == k).select("item", "words").collect()]
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block, size))
        one = finder(shared)(F.col(had))
        if k == 0:
            out = out.withColumn(name, one)
        else:  # an earlier block's spans wait in the shared folder, so a task holds one block and one index
            path = scratch_path(spark, "decontamination")
            out.write.parquet(path)
            out = spark.read.parquet(path).withColumn(had + "_", one)
            out = out.withColumn(name, union(name, had + "_")).drop(had + "_")
    return out.select(*[quoted(c) for c in kept], f"{name}.*")


def finder(shared):
    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shard = Shard(phrases_of(shared.value))
        span = pa.struct([(n, pa.int32()) for n in ("first", "end", "first_byte", "end_byte")])
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))])
        size = 0
        for texts in batches:
            for t in texts:
                raw = t.as_buffer().to_pybytes()
                shard.add(raw)
                size += len(raw)
                if shard.words >= SHARD or size >= 16 * SHARD:
                    yield pa.array(shard.spans(), kind)
                    size = 0
        if shard.n_words:
            yield pa.array(shard.spans(), kind)

    return find


def union(a: str, b: str) -> Column:
    """Two blocks' findings of one text as one, its spans merged again."""
    row = "named_struct('first', {0}.first, 'end', greatest({0}.end, {1}.end), 'first_byte', {0}.first_byte, 'end_byte', greatest({0}.end_byte, {1}.end_byte))"
    return F.expr(f"""named_struct('n_words', {a}.n_words, 'spans', aggregate(array_sort(concat({a}.spans, {b}.spans)), slice({a}.spans, 1, 0),
        (m, x) -> IF(size(m) > 0 AND x.first <= m[size(m) - 1].end, concat(slice(m, 1, size(m) - 1), array({row.format('m[size(m) - 1]', 'x')})), concat(m, array(x)))),
        'items', array_sort(array_distinct(concat({a}.items, {b}.items))))""")


def removed(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of ``decontaminate`` with its spans cut out of the texts."""
    t = f"CAST({quoted(text)} AS BINARY)"
    keep = f"""transform(sequence(0, size(spans)), k -> decode(substring({t}, IF(k = 0, 0, spans[k - 1].end_byte) + 1,
        IF(k = size(spans), octet_length({quoted(text)}), spans[k].first_byte) - IF(k = 0, 0, spans[k - 1].end_byte)), 'UTF-8'))"""
    return found.withColumn(text, F.when(F.size("spans") > 0, F.expr(f"array_join({keep}, '')")).otherwise(F.col(text)))
