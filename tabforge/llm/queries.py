"""The numbered queries over the driver tables, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import align, ann, bpe, chat, decontam, line_dedup, mixing, quality, repetition, simhash, token_count, toxicity, trie
from tabforge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_token_counts")
def op1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return token_count.token_counts(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@register("op2_simhash_near_dedup")
def op2(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


@register("op3_line_dedup", f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text FROM documents),
l AS (SELECT r, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
t AS (SELECT r, site, pos, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l),
n AS (SELECT site, count(*) AS pages FROM d GROUP BY site),
f AS (SELECT site, k FROM t JOIN n USING (site) WHERE k <> '' GROUP BY site, k, pages
      HAVING count(DISTINCT r) >= {line_dedup.MIN_PAGES} AND count(DISTINCT r) > {line_dedup.RATIO} * pages),
m AS (SELECT t.*, f.k IS NOT NULL AS bad FROM t LEFT JOIN f USING (site, k)),
w AS (SELECT r, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad,
      coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS cleaned FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_dropped,
       CASE WHEN n_bad > 0 THEN cleaned ELSE text END AS text FROM d LEFT JOIN w USING (r)""")
def op3(spark, sf):
    return line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "n_lines", "n_dropped", "text")


@register("op4_nearest_neighbours")
def op4(spark, sf):
    return ann.search(table(spark, sf, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


@register("op5_quality_rules")
def op5(spark, sf):
    return repetition.repetition_rules(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat")


@register("op6_toxicity")
def op6(spark, sf):
    d, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    return toxicity.classify(d, labels).select("doc_id", "held_out", "score", "predicted", "n_passages")


_SHOWN = "'<|im_start|>' || {0}.role || chr(10) || {0}.text || '<|im_end|>' || chr(10)"


@register("op7_preference_format", f"""WITH t AS (SELECT conv_id AS pair, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, role, text
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
l AS (SELECT pair, max(pos) FILTER (role = 'assistant') AS last, max(text) FILTER (pos = 0) AS echo FROM t GROUP BY pair),
r AS (SELECT pair, pos, role, CASE WHEN pos = last THEN echo ELSE text END AS text FROM t JOIN l USING (pair) WHERE last IS NULL OR pos <= last),
b AS (SELECT pair, pos, c, r FROM (SELECT pair, pos, t AS c FROM t) FULL JOIN (SELECT pair, pos, r FROM r) USING (pair, pos)),
s AS (SELECT pair, min(pos) FILTER (c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) AS cut_at FROM b GROUP BY pair),
x AS (SELECT b.*, cut_at IS NULL OR pos < cut_at AS same, length({_SHOWN.format('c')}) AS nc, length({_SHOWN.format('r')}) AS nr FROM b JOIN s USING (pair)),
y AS (SELECT *, coalesce(sum(nc) OVER w, 0) - coalesce(nc, 0) AS ac, coalesce(sum(nr) OVER w, 0) - coalesce(nr, 0) AS ar FROM x WINDOW w AS (PARTITION BY pair, same ORDER BY pos))
SELECT pair AS conv_id, count(*) FILTER (same) AS n_common,
  coalesce(string_agg({_SHOWN.format('c')}, '' ORDER BY pos) FILTER (same), '') AS prompt,
  coalesce(string_agg({_SHOWN.format('c')}, '' ORDER BY pos) FILTER (NOT same AND c IS NOT NULL), '') AS chosen,
  coalesce(string_agg({_SHOWN.format('r')}, '' ORDER BY pos) FILTER (NOT same AND r IS NOT NULL), '') AS rejected,
  coalesce(string_agg((ac + 13 + length(c.role))::BIGINT || '-' || (ac + nc - 1)::BIGINT, ' ' ORDER BY pos) FILTER (NOT same AND c.role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((ar + 13 + length(r.role))::BIGINT || '-' || (ar + nr - 1)::BIGINT, ' ' ORDER BY pos) FILTER (NOT same AND r.role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (NOT same AND c.role = 'assistant') > 0 AND
  coalesce(string_agg({_SHOWN.format('c')}, '' ORDER BY pos) FILTER (NOT same AND c IS NOT NULL), '') <> coalesce(string_agg({_SHOWN.format('r')}, '' ORDER BY pos) FILTER (NOT same AND r IS NOT NULL), '') AS trains
FROM y GROUP BY pair""")
def op7(spark, sf):
    t = chat.turns(table(spark, sf, "conversations"))
    p = chat.preference_pairs(t, chat.corrupted(t))
    shown = {c: F.expr(f"array_join(transform({c}, x -> concat(x.first, '-', x.end)), ' ')") for c in ("chosen_mask", "rejected_mask")}
    return p.withColumns(shown).withColumnRenamed("pair", "conv_id")


@register("op8_byte_bpe")
def op8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register("op9_source_mixing", mixing.oracle())
def op9(spark, sf):
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "source", *mixing.RESULT)


@register("op10_quality_classifier")
def op10(spark, sf):
    d, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    return quality.classify(d, labels).select("doc_id", "held_out", F.col("score"), "predicted")


def _words(text: str) -> str:
    """SQL: a text's words as ``decontam`` takes them."""
    upper, lower = decontam.LETTERS, decontam.LETTERS.lower()
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op11_benchmark_decontamination", f"""WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_words("text")} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), {decontam.SIZE}) AS m, list_slice(w, s + 1, s + least(len(w), {decontam.SIZE})) AS phrase
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - {decontam.SIZE}, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
l AS (SELECT DISTINCT m FROM p),
x AS (SELECT r, m, s, list_slice(w, s + 1, s + m) AS phrase FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS s FROM d, l WHERE len(w) >= m)),
f AS (SELECT r, x.m, s, item FROM x JOIN p USING (m, phrase)),
h AS (SELECT r, count(DISTINCT s + k) AS n FROM (SELECT r, s, unnest(range(0, m)) AS k FROM f) GROUP BY r),
i AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)""")
def op11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    found = decontam.decontaminate(d, table(spark, sf, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@register("op12_conversation_trie", f"""WITH RECURSIVE bits AS (SELECT range AS i, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT c, n, c - c % {trie.GROUP} AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % {trie.HEADS} AS h FROM (SELECT c, count(*) AS n FROM t GROUP BY c), tab),
r AS (SELECT c.c, t.pos, role, text FROM c JOIN t ON t.c = c.base WHERE t.pos < h
  UNION ALL SELECT c.c, t.pos - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM c JOIN t ON t.c = c.c LEFT JOIN c b ON b.c = c.base WHERE t.pos >= c.h),
s AS (SELECT c.c, coalesce(list([role, text] ORDER BY pos) FILTER (pos IS NOT NULL), []) AS seq FROM c LEFT JOIN r ON r.c = c.c GROUP BY c.c),
p AS (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS depth FROM s),
m AS (SELECT c, depth, sha256(to_json(list_slice(seq, 1, depth))::VARCHAR) AS node, CASE WHEN depth > 0 THEN sha256(to_json(list_slice(seq, 1, depth - 1))::VARCHAR) END AS up,
  CASE WHEN depth > 0 THEN octet_length(encode(seq[depth][2])) ELSE 0 END AS nb, depth = len(seq) AS at_end FROM p),
n AS (SELECT node, depth, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, max(nb) AS nb,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (at_end), '')) AS ends_sha256 FROM m GROUP BY node, depth),
k AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT m.node, x.node AS sub FROM m JOIN m x ON x.c = m.c AND x.depth >= m.depth),
g AS (SELECT b.node, count(*) FILTER (k.up IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.nb)::BIGINT AS saved FROM below b JOIN n ON n.node = b.sub LEFT JOIN k ON k.up = b.sub GROUP BY b.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved AS saved_tokens, n.ends_sha256
FROM n JOIN g USING (node) LEFT JOIN k ON k.up = n.node LEFT JOIN n q ON q.node = n.up""")
def op12(spark, sf):
    return trie.prefix_trie(*trie.rebuilt(trie.turns(table(spark, sf, "conversations"))))


@register("op13_token_alignment")
def op13(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return align.align_tokens(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
