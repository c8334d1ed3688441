"""Alignment of a text's tokens under two tokenizers, by pointer jumping over overlapping tokens.

A (byte-level BPE) and B (pieces with byte fallback) cut the same bytes, a space and the text.  Every token points to the token
of the other side that overlaps it and reaches farthest right; the B token of a common end points to itself.  Squaring the
pointers, all at once, leads each token to the last token of its group after a number of rounds logarithmic in the
longest group, and that token labels the group.  The A and B token of a group's common end are its link.

Most of a corpus is the same few words, so texts are cut at white space where neither tokenizer ever joins what stands on the two
sides (checked on the two vocabularies; otherwise texts stay whole): such a place ends a token on both sides, so a segment's
tokens, groups and links do not depend on the rest.  A worker keeps a bounded table of segments, which only saves
work.  A text with a segment that doesn't come back byte for byte is encoded as a whole before it is given up.

Two passes.  The first is a narrow map that writes a row's numbers and its links, a whole number each, to a table in the shared
folder.  The links of that table are counted (partial sums first, so that a pair with a third of all links is no hot key), each
B id's highest count is found, and the second pass adds the counts up by row: by a broadcast of the counted pairs if there are
at most ``BROADCAST_PAIRS``, else by a join of links pre-summed by row and pair.  The driver gets one number.

Defined cases: null and empty texts, and texts whose joined tokens of either side differ from the space and the text, have no
tokens: zeros and no groups; repeated rows are counted each; columns named like the result's are replaced, others
stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import fresh, quoted, ship, whole, without
from tabforge.llm.token_count import byte_names
from tabforge.session import cut_lineage, scratch_path

KEEP_SEGMENTS, RUN, SLICE_CHARS, BROADCAST_PAIRS = 400_000, 1000, 1_000_000, 1_000_000
RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
#: fixed values: the characters with Unicode's White_Space property, and how piece files write a space
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
SPACE_MARK = "▁"
#: what joins a token's number to the next one's: the same side, the other side, the next group; nothing at a segment's end
JOINTS = (",", "|", ";", "")


def farthest(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per end, the last of the tokens that start before it."""
    return np.searchsorted(start, end, side="left") - 1


def groups(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token (its number on side B) of the group of every A and every B token; both sides cut the same bytes."""
    n = len(a_len)
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    to_b = farthest(b_end - b_len, a_end)
    to_a = farthest(a_end - a_len, b_end)
    at = np.concatenate([n + to_b, np.where(a_end[to_a] > b_end, to_a, n + np.arange(len(b_len)))]) if n else np.zeros(0, np.int64)
    while True:
        further = at[at]
        if (further == at).all():
            return at[:n] - n, at[n:] - n
        at = further


class Aligner:
    """Two tokenizers, and the segments this worker has aligned so far."""

    def __init__(self, a_file: str, b_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        names = byte_names()
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[k] = bytes(names[c] for c in token) if all(c in names for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE_MARK, " ").encode() for k, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.n_b = len(pieces)
        self.names = [str(k) for k in range(max(len(self.a_bytes), self.n_b))]
        self.digits = np.array([len(x) for x in self.names], np.int64)
        with open(a_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = segments(spec, pieces, self.b.encode("\n"))
        #: a line feed, which no piece holds, keeps B's own space away from a segment's beginning
        self.guard = self.b.encode("\n") if self.cut else []
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = array("q")  # of a slot: A tokens, B tokens, groups (-1: not the same bytes)
        self.links, self.start = array("q"), array("q", [0])

    def learn(self, found: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, fine: np.ndarray) -> None:
        """Align texts given with their ids of both sides (of each text so many), all at once, and give each a slot."""
        a_last, b_last = groups(self.a_len[a], self.b_len[b])
        # a group's last B token is its own last; the A token of a link is the last one of the group
        ends = np.flatnonzero(b_last == np.arange(len(b)))
        closing = np.flatnonzero(np.diff(a_last, append=-1)) if len(a) else np.zeros(0, np.int64)
        links = a[closing] * self.n_b + b[ends]
        segment = np.repeat(np.arange(len(found)), n_b)
        n_groups = np.bincount(segment[ends], minlength=len(found))
        # the written groups: tokens by group, A before B
        key = np.concatenate([a_last * 2, b_last * 2 + 1])
        by = np.argsort(key, kind="stable")
        ids, key = np.concatenate([a, b])[by], key[by]
        of = np.concatenate([np.repeat(np.arange(len(found)), n_a), segment])[by]
        joint = np.full(len(ids), 3)
        joint[:-1] = np.where(key[1:] == key[:-1], 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, np.where(of[1:] == of[:-1], 2, 3)))
        text = "".join(chain.from_iterable(zip(map(self.names.__getitem__, ids.tolist()), map(JOINTS.__getitem__, joint.tolist()), strict=True)))
        edge = np.concatenate([[0], np.cumsum(self.digits[ids] + (joint < 3))])
        edge = edge[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        base, first = len(self.texts), len(self.links)
        self.texts += [text[p:q] for p, q in zip(edge[:-1], edge[1:], strict=True)]
        self.sizes.frombytes(np.column_stack([n_a, n_b, np.where(fine, n_groups, -1)]).astype(np.int64).tobytes())
        self.links.frombytes(links.astype(np.int64).tobytes())
        self.start.frombytes((first + np.cumsum(n_groups)).astype(np.int64).tobytes())
        self.slot.update((t, base + k) for k, t in enumerate(found))

    def learn_apart(self, found: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> None:
        """Texts with a list of ids for each side; one that isn't the same bytes on both has no tokens."""
        fine = [b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) == t.encode("utf-8", "surrogatepass")
                for t, x, y in zip(found, a_ids, b_ids, strict=True)]
        sides = []
        for ids in (a_ids, b_ids):
            kept = [x if ok else [] for x, ok in zip(ids, fine, strict=True)]
            n = np.array([len(x) for x in kept], np.int64)
            sides += [np.fromiter(chain.from_iterable(kept), np.int64, int(n.sum())), n]
        self.learn(found, *sides, np.array(fine, bool))

    def learn_segments(self, found: list[str]) -> None:
        """Segments are encoded in runs, whose ids are dealt to them by their bytes: between two of them both sides end a token."""
        usual = [t for t in found if t[0] == " " and t[-1] not in SPACES and SPACE_MARK not in t]
        odd = [t for t in found if not (t[0] == " " and t[-1] not in SPACES and SPACE_MARK not in t)]
        runs = [usual[k:k + RUN] for k in range(0, len(usual), RUN)]
        joined = ["".join(r) for r in runs]
        a = [e.ids for e in self.a.encode_batch_fast(joined, add_special_tokens=False)] if runs else []
        b = self.b.encode([j[1:] for j in joined], num_threads=1) if runs else []
        for run, text, x, y in zip(runs, joined, a, b, strict=True):
            if not b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) == text.encode("utf-8", "surrogatepass"):
                odd += run
                continue
            ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in run])
            x, y = np.array(x, np.int64), np.array(y, np.int64)
            at = [np.searchsorted(np.cumsum(n[ids]), ends) + 1 for n, ids in ((self.a_len, x), (self.b_len, y))]
            self.learn(run, x, np.diff(at[0], prepend=0), y, np.diff(at[1], prepend=0), np.ones(len(run), bool))
        if odd:
            n = len(self.guard)
            b = self.b.encode(["\n" + t for t in odd], num_threads=1)
            self.learn_apart(odd, [e.ids for e in self.a.encode_batch(odd, add_special_tokens=False)], [y[n:] if y[:n] == self.guard else [] for y in b])

    def learn_text(self, t: str) -> None:
        """A whole text with its space in front, as one segment."""
        self.learn_apart([t], [self.a.encode(t, add_special_tokens=False).ids], [self.b.encode(t[1:])])

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of all texts' segments (each text with a space in front), and where each text's begin."""
        if len(self.slot) > KEEP_SEGMENTS:
            self.forget()
        cut = [(self.cut(" " + t) if self.cut else [" " + t]) if t else [] for t in texts]
        words, edge = list(chain.from_iterable(cut)), np.concatenate([[0], np.cumsum([len(x) for x in cut])])
        flat = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        if len(unknown := np.flatnonzero(flat < 0)):
            unseen = [words[k] for k in unknown.tolist()]
            if self.cut:
                self.learn_segments(list(dict.fromkeys(unseen)))
            else:
                for t in dict.fromkeys(unseen):
                    self.learn_text(t)
            flat[unknown] = [self.slot[w] for w in unseen]
        odd = np.flatnonzero(np.frombuffer(self.sizes, np.int64)[flat * 3 + 2] < 0)
        if not len(odd):
            return flat, edge
        # some segment isn't the same bytes: the whole text decides
        parts = np.split(flat, edge[1:-1])
        for k in np.unique(np.searchsorted(edge, odd, side="right") - 1).tolist():
            if self.cut:
                self.learn_text(" " + texts[k])
            same = bool(self.cut) and self.sizes[-1] >= 0
            parts[k] = np.array([len(self.texts) - 1] if same else [], np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def align(self, texts: list[str], with_groups: bool) -> dict[str, pa.Array]:
        """Columns of the result for each text."""
        flat, edge = self.slots(texts)
        sizes, start = np.array(self.sizes, np.int64).reshape(-1, 3), np.array(self.start, np.int64)
        total = np.vstack([np.zeros((1, 3), np.int64), np.cumsum(sizes[flat], axis=0)])[edge]
        n = start[flat + 1] - start[flat]
        ends = np.cumsum(n)
        links = np.array(self.links, np.int64)[np.repeat(start[flat] - (ends - n), n) + np.arange(int(n.sum()))]
        spelled = list(map(self.texts.__getitem__, flat.tolist()))
        at = edge.tolist()
        written = [";".join(spelled[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)]
        n_a, n_b, n_groups = (pa.array(c) for c in np.diff(total, axis=0).T)
        out = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups,
               "links": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends])[edge], pa.int32()), pa.array(links)),
               "groups_sha256": pa.array([hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written])}
        return out | ({"groups": pa.array(written)} if with_groups else {})


def segments(spec: dict, pieces: list[str], guard: list[int]):
    """A function that cuts a text where both tokenizers end a token whatever stands around, or None if that isn't sure.

    A's pattern never has a match from a character that isn't white space on into white space, so it ends one there.  B
    can't join two characters that stand side by side in no piece.  Where some piece joins a white-space character to one before
    it, there is no cut before that character."""
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or any("\n" in p for p in pieces) or len(guard) != 2:
        return None
    joined = {y for p in pieces for x, y in zip(p.replace(SPACE_MARK, " "), p.replace(SPACE_MARK, " ")[1:], strict=False) if y in SPACES and x not in SPACES}
    if " " in joined:
        return None
    white, black = f"[{SPACES}]", f"[^{SPACES}]"
    held = f"(?:[{''.join(sorted(joined))}]{white}*{black}+)*(?:[{''.join(sorted(joined))}]{white}*\\Z)?" if joined else ""
    return re.compile(f"{white}*{black}+{held}|{white}+").findall


_ALIGNER: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """This worker's aligner."""
    if (a_file, b_file) not in _ALIGNER:
        _ALIGNER.clear()
        _ALIGNER[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNER[a_file, b_file]


def aligned(docs: DataFrame, a_file: str, b_file: str, text: str = "text", with_groups: bool = False) -> DataFrame:
    """One struct column beside those of ``docs``, named ``alignment``: n_a, n_b, n_groups, links (a's id times the size of B's
    vocabulary plus b's id, in order), groups_sha256 and, if asked for, groups (as `a1,a2|b1;a3|b2,b3`)."""
    ship(docs.sparkSession)
    kind = "n_a long, n_b long, n_groups long, links array<long>, groups_sha256 string" + (", groups string" if with_groups else "")

    @F.arrow_udf(kind)
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        it = aligner(a_file, b_file)
        for texts in batches:
            rows, out, k = texts.to_pylist(), [], 0
            while k < len(rows):
                first, size = k, 0
                while k < len(rows) and (k == first or size + len(rows[k]) <= SLICE_CHARS):
                    size += len(rows[k])
                    k += 1
                columns = it.align(rows[first:k], with_groups)
                out.append(pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))
            yield pa.concat_arrays(out)

    return docs.withColumn("alignment", align(whole(text)))


def vocabulary_size(b_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()


def align_tokens(docs: DataFrame, a_file: str, b_file: str, text: str = "text", keep: list[str] | None = None,
                 with_groups: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (None: all) with n_a, n_b, n_groups, n_links, n_best (links whose pair is its B id's most
    counted, ties included), count_sum (the links' counts in all rows together) and groups_sha256 (and groups, if asked for)."""
    spark = docs.sparkSession
    names = RESULT + (["groups"] if with_groups else [])
    kept = [c for c in without(docs, *names) if keep is None or c in keep]
    had, row, links, inside = fresh(docs, "text", "row", "links", "alignment")
    slim = docs.select(*[quoted(c) for c in kept], whole(text).alias(had))
    wide = aligned(slim.withColumnRenamed("alignment", inside), a_file, b_file, had, with_groups)
    first = wide.select(*[quoted(inside if c == "alignment" else c) for c in kept], F.monotonically_increasing_id().alias(row),
                        F.col("alignment.links").alias(links), *[f"alignment.{c}" for c in names if c not in ("n_links", "n_best", "count_sum")])
    path = scratch_path(spark, "alignment")
    first.write.option("compression", "zstd").parquet(path)
    first = spark.read.schema(first.schema).parquet(path)

    n_b = vocabulary_size(b_file)
    pairs = first.select(F.col(row).alias("row"), F.explode(links).alias("pair"))
    counts = cut_lineage(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    counts = counts.withColumn("b", F.col("pair") % n_b)
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    known = cut_lineage(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).cast("int").alias("best")))
    if known.count() <= BROADCAST_PAIRS:
        met = pairs.withColumn("times", F.lit(1)).join(F.broadcast(known), "pair")
    else:
        met = pairs.groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times")).join(known, "pair")
    per = met.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.col("times") * F.col("best")).alias("n_best"),
                                 F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = first.join(per.withColumnRenamed("row", row), row, "left") if row != "row" else first.join(per, "row", "left")
    number = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")}
    return out.select(*[F.col(inside if c == "alignment" else c).alias(c) for c in kept], *[number.get(c, F.col(c)) for c in names])
