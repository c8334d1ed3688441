"""Repetition rules by suffix arrays over words.

The words of many whole texts are sorted as suffixes at once by prefix doubling: ranks start from (text, word), so
suffixes of a text stand together and no comparison crosses texts, and only suffixes still tied are sorted again.
The ranks of every doubling give, by binary lifting, the longest common prefix of neighbouring suffixes.  A
suffix's larger common prefix with its two neighbours is the longest repeat that starts there, the deepest
longest-common-prefix interval it lies in; these repeats of ``MIN_REPEAT`` words or more, united, are the covered spans of all
maximal repeated substrings.  A text is dropped if they cover over ``MAX_COVERED`` of its words or the longest has over ``MAX_LONGEST``.

One narrow map over whole texts, a slice of at most ``SLICE_WORDS`` words (or one longer text) at a time: no shuffle, no state.
Null and empty texts have no words and fail the base rule; repeated rows are judged each; result columns replace columns of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import ship, whole

MIN_REPEAT, MAX_COVERED, MAX_LONGEST, SLICE_WORDS = 10, 0.3, 100, 400_000
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "covered_words long, longest_repeat long, base_failed boolean, kept boolean")


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word position, the length of the longest sequence of words from there that occurs elsewhere in the same
    text (occurrences may overlap).  ``words`` are ids, ``text`` the (ascending) number of the text of each."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    end = np.searchsorted(text, text, side="right")
    _, rank = np.unique(text.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(np.bincount(rank))[:-1]])
    rank = first[rank]  # of suffixes: how many are smaller by what is compared so far
    levels, width = [], 1
    while True:
        levels.append(np.append(rank, -1))
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        after = tied + width
        follows = np.where(after < end[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((follows, rank[tied])) if n >= 1 << 31 else np.argsort(rank[tied] * np.int64(n + 1) + follows, kind="stable")
        at, old, new = tied[order], rank[tied][order], follows[order]
        fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (new[1:] != new[:-1])])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        places = np.arange(len(at))
        rank = rank.copy()
        rank[at] = old + np.maximum.accumulate(np.where(fresh, places, 0)) - np.maximum.accumulate(np.where(group, places, 0))
        width *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        common += np.where((levels[k][x] == levels[k][y]) & (x < n) & (y < n), 1 << k, 0)
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def measure(texts: list[str], cut: list[list[bytes]], min_repeat: int = MIN_REPEAT) -> np.ndarray:
    """Per text: words in three-word windows found twice or more, words covered by repeats, longest repeat."""
    sizes = np.array([len(w) for w in cut], np.int64)
    ids: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter((ids[w] for ws in cut for w in ws), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(cut)), sizes)
    best = longest_repeats(words, text)

    def covered(start: np.ndarray, length) -> np.ndarray:
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=len(cut))

    triples, long = np.flatnonzero(best >= 3), np.flatnonzero(best >= min_repeat)
    longest = np.zeros(len(cut), np.int64)
    np.maximum.at(longest, text, best)
    return np.column_stack([covered(triples, 3), covered(long, best[long]), longest])


def repetition_rules(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
                     max_longest: int = MAX_LONGEST) -> DataFrame:
    """``docs`` with the base counts, covered_words, longest_repeat, base_failed and kept."""
    ship(docs.sparkSession)

    @F.pandas_udf(COLUMNS)
    def rules(texts: pd.Series) -> pd.DataFrame:
        out, part, held, cut = [], [], 0, []

        def flush():
            for t, ws, (repeat, cover, longest) in zip(part, cut, measure(part, cut, min_repeat).tolist(), strict=True):
                lines = [x for x in t.split("\n") if x.strip(SPACES)]
                failed = len(ws) < 50 or 100 * repeat > 50 * len(ws)
                out.append((len(ws), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeat,
                            cover, longest, failed, not failed and cover <= max_covered * len(ws) and longest <= max_longest))

        for t in texts:
            ws = t.encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at exactly the six ASCII spaces
            if part and held + len(ws) > SLICE_WORDS:
                flush()
                part, cut, held = [], [], 0
            part.append(t)
            cut.append(ws)
            held += len(ws)
        if part:
            flush()
        return pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    names = {c.split()[0] for c in COLUMNS.split(", ")}
    kept = docs.select(*[c for c in docs.columns if c not in names]).withColumn("_r", rules(whole(text)))
    return kept.select(*[c for c in kept.columns if c != "_r"], "_r.*")
