"""Mixing sources to target weights by temperature, with DataFrame functions only.

Weights are source token shares to the power of an exponent between 0 (all sources alike) and 1 (as they are),
normalised.  The exponent is bisected on a grid of 2 ** -20: the largest whose entropy reaches
``entropy_share`` of the most possible, raised as far as the smallest one under which no source is read more than
``max_repeat`` times as often as another.  Each round of the bisection is one small job that sums 33
candidate exponents over the table of sources; only those 33 sums come to the driver.

The budget is the smallest with which every document is used at least once, so nothing is dropped: a source gets its weight's part of it,
as whole epochs and one partial epoch.  A source's documents are dealt by hash to blocks of about
``BLOCK_TOKENS`` tokens, at most ``BLOCKS`` of them or, for larger sources, the square root of its tokens, and an epoch is a seeded permutation of the blocks.  The partial epoch takes blocks in its
permuted order while the budget lasts, and in the one block where it ends, documents by hash while it lasts.  A copy's place
in its source's stream, as a fraction, gives the ``mix_block`` of the mix, so every block of the mix has the target weights.

Token counts, block totals and source totals are grouped sums (pre-aggregated, a hot source is no hot task); windows run over one source's
blocks or one block's documents, both of which grow with the square root of a large source.  Text goes through row by row: the tables of sources and blocks join it as broadcasts
if counted small enough, else by (source, block), which splits a hot source.

Tokens are words of non-space characters.  Null and empty sources are one source, ''; a source without tokens, like documents without
words, takes part once an epoch and costs nothing; repeated rows (equal ids) are documents each; columns named like the result's are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import WORD, md5_long, whole, without
from tabforge.session import cut_lineage

ENTROPY_SHARE, MAX_REPEAT, BLOCK_TOKENS, BLOCKS, MIX_TOKENS, BROADCAST_ROWS = 0.9, 4.0, 16_384, 4096, 1_000_000, 100_000
GRID, ROUNDS = 32, 4
RESULT = ["n_tokens", "epoch", "weight", "mix_block", "mix_order"]


def _site(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def exponent(sources: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeat: float = MAX_REPEAT) -> float:
    """The exponent for a table (_site, _total) of sources, those without tokens left out."""
    s = sources.where("_total > 0")
    top = s.agg(F.count(F.lit(1)).alias("n"), F.max("_total").alias("hi"), F.min("_total").alias("lo"), F.sum("_total").alias("all")).first()
    if not top["n"]:
        return 1.0
    target = entropy_share * math.log(top["n"])
    shares = s.select((F.col("_total") / F.lit(float(top["all"]))).alias("p"))

    def search(accept) -> int:
        """The last of 0 .. 2 ** 20 that is accepted, for a test that holds up to some point (0 always counts as held)."""
        low, width = 0, GRID ** ROUNDS
        while width > 1:
            step = width // GRID
            at = F.explode(F.sequence(F.lit(1), F.lit(GRID))).alias("k")
            powers = shares.select("p", at).withColumn("a", (F.lit(low) + F.col("k") * F.lit(step)) / F.lit(float(GRID ** ROUNDS)))
            sums = powers.groupBy("k", "a").agg(F.sum(F.pow("p", F.col("a"))).alias("z"), F.sum(F.pow("p", F.col("a")) * F.ln("p")).alias("l")).collect()
            held = [r["k"] for r in sorted(sums, key=lambda r: r["k"]) if accept(r["a"], r["z"], r["l"])]
            low, width = low + step * (max(held) if held else 0), step
            if low >= GRID ** ROUNDS:
                return GRID ** ROUNDS
        return low

    by_entropy = search(lambda a, z, l: math.log(z) - a * l / z >= target)
    by_repeat = search(lambda a, z, l: (top["hi"] / top["lo"]) ** (1 - a) > max_repeat)
    repeat = 0 if top["hi"] <= max_repeat * top["lo"] else min(GRID ** ROUNDS, by_repeat + 1)
    return max(by_entropy, repeat) / GRID ** ROUNDS


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", entropy_share: float = ENTROPY_SHARE,
        max_repeat: float = MAX_REPEAT, seed: int = 7) -> DataFrame:
    """``docs``, each row once for every epoch that reads it, with n_tokens, epoch (from 0), weight of its source, and
    mix_block, mix_order: the order of the mix."""
    kept = without(docs, *RESULT)
    # the documents' columns go by number, so that none can have a name used here
    at = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.toDF(*at.values())
    text, source, doc_id = at[text], at[source], at[doc_id]
    base = docs.select(*dict.fromkeys([*[at[c] for c in kept], text, source, doc_id])).withColumn("_site", _site(source))
    base = base.withColumn("n_tokens", F.regexp_count(whole(text), F.lit(WORD)).cast("long")).withColumn("_h", md5_long(F.lit(seed), doc_id))
    narrow = cut_lineage(base.select("_site", "_h", "n_tokens"))
    sources = cut_lineage(narrow.groupBy("_site").agg(F.sum("n_tokens").alias("_total")))
    a = exponent(sources, entropy_share, max_repeat)
    total = sources.agg(F.sum("_total")).first()[0] or 0
    share = F.when(F.col("_total") > 0, F.pow(F.col("_total") / F.lit(float(max(total, 1))), F.lit(a))).otherwise(F.lit(0.0))
    z = sources.agg(F.sum(share)).first()[0] or 1.0
    weighed = sources.withColumn("weight", F.round(share / F.lit(z), 9))
    budget = weighed.where("weight > 0").agg(F.max(F.ceil(F.col("_total") / F.col("weight")))).first()[0] or 0
    most = F.greatest(F.lit(BLOCKS), F.ceil(F.sqrt(F.col("_total"))))
    blocks = F.greatest(F.lit(1), F.least(most, F.ceil(F.col("_total") / F.lit(BLOCK_TOKENS)))).cast("long")
    mine = F.greatest(F.col("_total"), F.floor(F.lit(float(budget)) * F.col("weight")).cast("long"))
    plan = cut_lineage(weighed.withColumn("_blocks", blocks).withColumn("_budget", mine)
                       .withColumn("_epochs", F.when(F.col("_total") > 0, F.floor(F.col("_budget") / F.col("_total"))).otherwise(1).cast("long"))
                       .withColumn("_rest", F.when(F.col("_total") > 0, F.col("_budget") - F.col("_epochs") * F.col("_total")).otherwise(0)))
    n_sources = plan.count()

    def with_plan(df: DataFrame) -> DataFrame:
        j = df.join(F.broadcast(plan) if n_sources <= BROADCAST_ROWS else plan, "_site")
        return j.withColumn("_block", F.pmod(F.col("_h"), F.col("_blocks")))

    # block totals, and each epoch's permutation of them; the last epoch is cut where the budget ends
    cells = with_plan(narrow).groupBy("_site", "_block").agg(F.sum("n_tokens").alias("_tokens"), F.first("_total").alias("_total"), F.first("_epochs").alias("_epochs"), F.first("_rest").alias("_rest"), F.first("_budget").alias("_budget"), F.first("weight").alias("weight"))
    cells = cells.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("_epochs") - F.when(F.col("_rest") > 0, 0).otherwise(1)).cast("int"))))
    order = Window.partitionBy("_site", "epoch").orderBy(md5_long(F.lit(seed), "_site", "epoch", "_block"), "_block")
    cells = cells.withColumn("_before", F.sum("_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_tokens"))
    cells = cells.where((F.col("epoch") < F.col("_epochs")) | (F.col("_before") < F.col("_rest")))
    ends = (F.col("epoch") == F.col("_epochs")) & (F.col("_before") + F.col("_tokens") > F.col("_rest"))
    cells = cut_lineage(cells.withColumn("_left", F.when(ends, F.col("_rest") - F.col("_before"))))
    n_cells = cells.count()
    # in a block where a budget ends: the largest hash that still fits
    last = cells.where("_left IS NOT NULL").select("_site", "_block", "_left")
    inside = with_plan(narrow).select("_site", "_block", "_h", "n_tokens").join(F.broadcast(last) if n_sources <= BROADCAST_ROWS else last, ["_site", "_block"])
    inside = inside.groupBy("_site", "_block", "_left", "_h").agg(F.sum("n_tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy("_site", "_block").orderBy("_h"))
    fits = inside.withColumn("_run", run).where("_run <= _left").groupBy("_site", "_block").agg(F.max("_h").alias("_upto"))
    n_mix = max(1, math.ceil(budget / MIX_TOKENS))
    share_before = F.when(F.col("_budget") > 0, (F.col("epoch") * F.col("_total") + F.col("_before")) / F.col("_budget").cast("double")).otherwise(F.lit(0.0))
    cells = cells.join(fits, ["_site", "_block"], "left").select(
        "_site", "_block", F.col("epoch").cast("int").alias("epoch"), "weight",
        F.when(F.col("_left").isNotNull(), F.coalesce("_upto", F.lit(-1))).alias("_upto"),
        F.least(F.lit(n_mix - 1), F.floor(share_before * F.lit(n_mix))).cast("long").alias("mix_block"))
    out = with_plan(base).drop(*[c for c in plan.columns if c != "_site"]).join(F.broadcast(cells) if n_cells <= BROADCAST_ROWS else cells, ["_site", "_block"])
    out = out.where(F.col("_upto").isNull() | (F.col("_h") <= F.col("_upto")))
    return out.withColumn("mix_order", md5_long(F.lit(seed), "epoch", doc_id)).select(*[F.col(at[c]).alias(c) for c in kept], *RESULT)


def oracle(entropy_share: float = ENTROPY_SHARE, max_repeat: float = MAX_REPEAT, seed: int = 7) -> str:
    """The same rows for the documents table, as DuckDB SQL (its words are those of WORD)."""
    n = GRID ** ROUNDS

    def md5_of(*parts: str) -> str:
        return "('0x' || substr(md5(" + " || '|' || ".join(f"coalesce(cast({p} as varchar), 'null')" for p in parts) + "), 1, 15))::BIGINT"

    rounds, low_e, low_r, width = [], "0", "0", n
    for k in range(ROUNDS):
        step = width // GRID
        e0, r0 = (f"(SELECT lo FROM e{k - 1})", f"(SELECT lo FROM r{k - 1})") if k else ("0", "0")
        rounds.append(f"""e{k} AS (SELECT {e0} + {step} * coalesce(max(k) FILTER (ln(z) - a * l / z >= {entropy_share!r} * ln(ns)), 0) AS lo FROM (
  SELECT k, a, sum(pow(p, a)) AS z, sum(pow(p, a) * ln(p)) AS l, count(*) AS ns FROM (SELECT p, k, ({e0} + k * {step}) / {float(n)!r}::DOUBLE AS a FROM shares, range(1, {GRID + 1}) g(k)) GROUP BY k, a)),
r{k} AS (SELECT {r0} + {step} * coalesce(max(k) FILTER (pow(hi::DOUBLE / lo, 1 - a) > {max_repeat!r}), 0) AS lo FROM (
  SELECT k, ({r0} + k * {step}) / {float(n)!r}::DOUBLE AS a, hi, lo FROM ext, range(1, {GRID + 1}) g(k)))""")
        width = step
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS site, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
  {md5_of(str(seed), 'doc_id')} AS h FROM documents),
s AS (SELECT site, sum(n_tokens)::BIGINT AS total FROM d GROUP BY site),
ext AS (SELECT max(total) AS hi, min(total) AS lo, sum(total)::DOUBLE AS every FROM s WHERE total > 0),
shares AS (SELECT total / every AS p FROM s, ext WHERE total > 0),
{', '.join(rounds)},
expo AS (SELECT least({n}, greatest((SELECT lo FROM e{ROUNDS - 1}), (SELECT CASE WHEN hi <= {max_repeat!r} * lo THEN 0 ELSE least({n}, (SELECT lo FROM r{ROUNDS - 1}) + 1) END FROM ext))) / {float(n)!r}::DOUBLE AS a),
powered AS (SELECT site, total, CASE WHEN total > 0 THEN pow(total / every, a) ELSE 0.0 END AS q FROM s, ext, expo),
weighed AS (SELECT site, total, round(q / (SELECT sum(q) FROM powered), 9) AS weight FROM powered),
b AS (SELECT max(ceil(total / weight))::DOUBLE AS budget FROM weighed WHERE weight > 0),
plan1 AS (SELECT site, total, weight, greatest(1, least(greatest({BLOCKS}, ceil(sqrt(total))), ceil(total / {BLOCK_TOKENS}.0)))::BIGINT AS blocks, greatest(total, floor(budget * weight)::BIGINT) AS mine FROM weighed, b),
plan AS (SELECT *, CASE WHEN total > 0 THEN mine // total ELSE 1 END AS epochs, CASE WHEN total > 0 THEN mine - (mine // total) * total ELSE 0 END AS rest FROM plan1),
dealt AS (SELECT d.*, d.h % p.blocks AS block FROM d JOIN plan p USING (site)),
cells AS (SELECT x.site, x.block, x.tokens, e.epoch, p.* EXCLUDE (site), sum(x.tokens) OVER (PARTITION BY x.site, e.epoch ORDER BY {md5_of(str(seed), 'x.site', 'e.epoch', 'x.block')}, x.block) - x.tokens AS before
  FROM (SELECT site, block, sum(n_tokens)::BIGINT AS tokens FROM dealt GROUP BY ALL) x JOIN plan p USING (site), LATERAL (SELECT unnest(range(p.epochs + CASE WHEN p.rest > 0 THEN 1 ELSE 0 END)) AS epoch) e),
cut AS (SELECT *, CASE WHEN epoch = epochs AND before + tokens > rest THEN rest - before END AS remaining FROM cells WHERE epoch < epochs OR before < rest),
runs AS (SELECT *, sum(n) OVER (PARTITION BY site, block ORDER BY h) AS run FROM (
  SELECT site, block, c.remaining, h, sum(n_tokens) AS n FROM dealt JOIN (SELECT site, block, remaining FROM cut WHERE remaining IS NOT NULL) c USING (site, block) GROUP BY ALL)),
fits AS (SELECT site, block, max(h) AS upto FROM runs WHERE run <= remaining GROUP BY ALL),
placed AS (SELECT c.site, c.block, c.epoch::INT AS epoch, c.weight, CASE WHEN c.remaining IS NOT NULL THEN coalesce(f.upto, -1) END AS upto,
  least(nmix - 1, floor(CASE WHEN c.mine > 0 THEN (c.epoch * c.total + c.before) / c.mine::DOUBLE ELSE 0.0 END * nmix))::BIGINT AS mix_block
  FROM cut c LEFT JOIN fits f USING (site, block), (SELECT greatest(1, ceil(budget / {MIX_TOKENS}.0))::BIGINT AS nmix FROM b))
SELECT doc_id, source, n_tokens, epoch, weight, mix_block, {md5_of(str(seed), 'epoch', 'doc_id')} AS mix_order
FROM dealt JOIN placed USING (site, block) WHERE upto IS NULL OR h <= upto"""
