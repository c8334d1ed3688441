"""Removal of lines that a site repeats from page to page (site-relative line frequency).

A line belongs to a site's boilerplate if the share of the site's pages that contain it is over ``ratio`` and at least
``min_pages`` pages do.  ``RATIO`` is a hundredth: templates change between a site's sections and years, so one line of them is on a few
pages in a hundred, while pages written apart rarely agree on a whole line at all; the floor of pages holds where a
hundredth is a page or two.  Lines are compared without white space around them; lines of white space only are never
boilerplate.  Counting shuffles only (site, 128-bit line hash) with partial sums, so a line on a third of all rows
is pre-summed, not gathered.  What a site drops is bounded: each such line takes over ``ratio`` of its pages, so there
are fewer than (mean lines a page) / ratio of them however large the site.  They travel as one short array a
site, which joins the pages as a broadcast if counted small enough, else by a shuffle join in which AQE splits a hot
site's pages (its array is a single row).  A page's lines meet that array in one hashed intersection, then go row by row, in order.

Null sites are one site; null and empty texts stay as they are; repeated rows count as pages each.  A page every line of which is
boilerplate keeps its blank lines alone, and a deduplication after that sees all such pages as one text; with ``keep_whole`` such a
page, which is the copy of a page, is left whole for it.  Columns may have any names; n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import fresh, quoted, quoted_column, whole, without
from tabforge.session import cut_lineage

RATIO, MIN_PAGES, BROADCAST_LINES = 0.01, 5, 200_000


def _lines(text: str) -> str:
    """SQL: a text's lines in order, each with the hashes of what is left without white space around it (null: nothing)."""
    trimmed = f"transform(split({text}, '\n', -1), l -> named_struct('l', l, 'k', trim(BOTH ' \t\r\x0b\x0c' FROM l)))"
    return f"transform({trimmed}, x -> named_struct('l', x.l, 'h', CASE WHEN x.k <> '' THEN named_struct('a', xxhash64(x.k), 'b', xxhash64(7, x.k)) END))"


def boilerplate(pages: DataFrame, text: str = "text", site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row a site: _site (null as ''), _bad (array of its boilerplate lines' hashes)."""
    p = pages.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("_site"), whole(text).alias("_t"))
    totals = p.groupBy("_site").agg(F.count(F.lit(1)).alias("_pages"))
    lines = p.select("_site", F.explode(F.expr(f"array_distinct(filter(transform({_lines('_t')}, x -> x.h), h -> h IS NOT NULL))")).alias("_line"))
    with_line = lines.groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
    found = with_line.join(totals, "_site").where(F.col("_n") > F.lit(ratio) * F.col("_pages"))
    return found.groupBy("_site").agg(F.collect_list("_line").alias("_bad"))


def dedup_lines(pages: DataFrame, text: str = "text", site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                keep_whole: bool = False) -> DataFrame:
    """``pages`` with the text less its site's boilerplate lines, and n_lines, n_dropped (of the text before)."""
    bad = cut_lineage(boilerplate(pages, text, site, ratio, min_pages))
    size = bad.agg(F.coalesce(F.sum(F.size("_bad") + F.lit(1)), F.lit(0)).alias("n")).first()["n"]
    kept = without(pages, "n_lines", "n_dropped")
    at, listed, t, hits, left, n, gone = fresh(pages, "site", "bad", "text", "hits", "left", "lines", "dropped")
    p = pages.select(*[quoted(c) for c in kept], F.coalesce(F.col(site).cast("string"), F.lit("")).alias(at), F.col(text).alias(t))
    bad = bad.select(F.col("_site").alias(at), F.col("_bad").alias(listed))
    j = p.join(F.broadcast(bad) if size <= BROADCAST_LINES else bad, at, "left")
    # the page's own listed lines, found by hashing; a null hash (white space only) is none
    j = j.withColumn(hits, F.when(F.col(listed).isNotNull() & F.col(t).isNotNull(), F.expr(
        f"array_intersect(filter(transform({_lines(t)}, x -> x.h), h -> h IS NOT NULL), {listed})"))).drop(listed)
    j = j.withColumn(left, F.when(F.size(hits) > 0, F.expr(f"filter({_lines(t)}, x -> x.h IS NULL OR NOT array_contains({hits}, x.h))")))
    j = j.withColumn(n, F.when(F.col(t).isNull(), 0).otherwise(F.size(F.split(F.col(t), "\n", -1))).cast("long"))
    lost = F.when(F.col(left).isNull(), F.lit(0)).otherwise(F.col(n) - F.size(left))
    if keep_whole:
        lost = F.when(F.coalesce(F.expr(f"exists({left}, x -> x.h IS NOT NULL)"), F.lit(True)), lost).otherwise(F.lit(0))
    j = j.withColumn(gone, lost.cast("long"))
    cut = F.when(F.col(gone) > 0, F.expr(f"array_join(transform({left}, x -> x.l), '\n')")).otherwise(F.col(t))
    return j.select(*[cut.alias(c) if c == text else quoted_column(c) for c in kept], F.col(n).alias("n_lines"), F.col(gone).alias("n_dropped"))
