"""One query per training-data operator over the driver tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public vocabulary: $MURMURA_TOKENIZERS/name, else the
    installed public_tokenizers package."""
    root = os.environ.get("MURMURA_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_html_line_blocks")
def q_op1(spark, sf):
    from murmura.llm.html_blocks import extract_main_text
    p = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract_main_text(p).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@register("op4_hypergeometric_shards")
def q_op4(spark, sf):
    from murmura.llm.sharding import shuffle_to_shards
    d = table(spark, sf, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    return shuffle_to_shards(d, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                           F.lit(None).cast("int").alias("grown_shard"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT d.*, o.k IS NOT NULL AND d.doc_id <> o.last AS gone
  FROM keyed d LEFT JOIN often o ON d.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@register("op6_line_dedup", OP6_SQL)
def q_op6(spark, sf):
    from murmura.llm.line_dedup import dedup_lines
    d = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@register("op7_fertility_rules")
def q_op7(spark, sf):
    from murmura.llm.quality import quality
    d = quality(table(spark, sf, "documents").select("doc_id", "text", "lang"), vocabulary(), keep_text=False)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "n_tokens", "chars_per_token", "byte_share", "entropy")


@register("op9_pivotal_mix")
def q_op9(spark, sf):
    from murmura.llm.mixing import mix, word_count
    d = table(spark, sf, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_text_words"))
    return mix(d, size=F.col("n_text_words")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@register("op10_token_counts", None)
def q_op10(spark, sf):
    from murmura.llm.token_counts import token_counts
    d = token_counts(table(spark, sf, "documents").select("doc_id", "text"), vocabulary())
    return d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens",
                    (F.col("n_tokens") > 4096).alias("over_limit"))


@register("op2_zstd_toxicity")
def q_op2(spark, sf):
    from murmura.llm.toxicity import fit, score
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    d = table(spark, sf, "documents").select("doc_id", "text")
    model = fit(d, table(spark, sf, "labels").where(~held_out).select("doc_id", "toxic"))
    return score(d, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@register("op8_cgk_decontamination")
def q_op8(spark, sf):
    from murmura.llm.decontam import contamination
    return contamination(table(spark, sf, "documents").select("doc_id", "text"),
                         table(spark, sf, "benchmark").select("item_id", "text"))


@register("op3_ngram_jaccard_rtree")
def q_op3(spark, sf):
    from murmura.llm.ngram_join import jaccard_components
    return jaccard_components(table(spark, sf, "documents").select("doc_id", "text"))


@register("op5_suffix_dedup")
def q_op5(spark, sf):
    from murmura.llm.suffix_dedup import dedup_substrings
    d = dedup_substrings(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::HUGEINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5"""


@register("op11_hard_negatives", OP11_SQL)
def q_op11(spark, sf):
    from murmura.llm.hard_negatives import hard_negatives, scaled
    rows = scaled(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"))
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", turned), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS j FROM d),
w AS (SELECT lang, id, j, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
t AS (SELECT lang, id, j, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM w),
s AS (
  SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY id, j ORDER BY i)),
f AS (
  SELECT lang, w1 AS x, count(*) AS c, NULL AS y, NULL AS z FROM s GROUP BY ALL
  UNION ALL SELECT lang, w1, count(*), w2, NULL FROM s WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10
  UNION ALL SELECT lang, w1, count(*), w2, w3 FROM s WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
g AS (SELECT *, concat_ws(' ', x, y, z) AS phrase, lang || chr(10) || concat_ws(' ', x, y, z) AS key FROM f),
cuts AS (
  SELECT lang, phrase, c AS a, 1 AS k, lang || chr(10) || x AS lk, lang || chr(10) || concat_ws(' ', y, z) AS rk
  FROM g WHERE y IS NOT NULL
  UNION ALL SELECT lang, phrase, c, 2, lang || chr(10) || x || ' ' || y, lang || chr(10) || z FROM g WHERE z IS NOT NULL),
scored AS (
  SELECT u.lang, u.phrase, u.a, u.k, l.c AS l, r.c AS r, (1000000::HUGEINT * u.a * u.a) // (l.c::HUGEINT * r.c) AS score
  FROM cuts u JOIN (SELECT key, c FROM g) l ON l.key = u.lk JOIN (SELECT key, c FROM g) r ON r.key = u.rk
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, u.k) = 1),
wider AS (
  SELECT sub, max(c) AS c FROM (
    SELECT lang || chr(10) || x || ' ' || y AS sub, c FROM g WHERE z IS NOT NULL
    UNION ALL SELECT lang || chr(10) || y || ' ' || z, c FROM g WHERE z IS NOT NULL) GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang)
SELECT c.lang, (row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, phrase))::INTEGER AS rank, phrase, a, l, r, n,
       score::BIGINT AS score
FROM scored c JOIN n ON n.lang = c.lang LEFT JOIN wider v ON v.sub = c.lang || chr(10) || c.phrase
WHERE v.c IS NULL OR 100 * v.c < 50 * a
QUALIFY rank <= 2000"""


@register("op12_collocations", OP12_SQL)
def q_op12(spark, sf):
    from murmura.llm.collocations import collocations
    return collocations(table(spark, sf, "documents").select("text", "lang"))


@register("op13_gru_likelihood")
def q_op13(spark, sf):
    from murmura.llm.language_model import document_scores
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return document_scores(table(spark, sf, "documents").select("doc_id", "text"), held_out)
