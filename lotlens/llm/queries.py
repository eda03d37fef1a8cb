"""Queries of the training-data operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, exact_dedup, filter_audit, kn_quality, merkle, mixing, nbest, simhash_bk, sql_bpe, substring_dedup, suffix_array, token_counts, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode(read(spark, sf_dir, "documents"), piece_model(), n=4, digests=True)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_duplicates(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return mixed.select("doc_id", "source", F.col("__copy").cast("int").alias("copy"), F.col("__copies").cast("int").alias("n_copies"), F.col("__order").alias("shuffle_key"), F.round("__rate", 6).alias("rate"), F.sha2(text, 256).alias("text_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.quality(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "logppl", "low", "high")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.simhash_groups(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.byte_duplicates(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), piece_model())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = sql_bpe.decode(sql_bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_array": op9_suffix_array,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size, row_number() OVER g AS place
  FROM d WINDOW g AS (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha AS text_sha256 FROM w""",
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, text, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
t AS (SELECT sum(chars) AS all_chars, count(*) FILTER (chars > 0) AS n FROM s),
r AS (SELECT source, CASE WHEN chars > 0 THEN all_chars / n / chars ELSE 0.0 END AS rate FROM s, t),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r WHERE rate > 0),
c AS (SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
a AS (SELECT source, rate, list(cdf) AS cdfs FROM c GROUP BY source, rate),
n AS (SELECT d.*, rate, len(list_filter(cdfs, lambda x: x <= u)) AS n_copies FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n)
SELECT doc_id, source, copy::INT AS copy, n_copies::INT AS n_copies, ('0x' || substr(md5('mix-1-order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy::VARCHAR), 1, 13))::BIGINT AS shuffle_key,
  round(rate, 6) AS rate, sha256(coalesce(text, '')) AS text_sha256 FROM e""",
    "op11_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, mask),
s AS (SELECT part, subset::INT AS subset, coalesce(sum(n) FILTER (mask & subset = 0), 0)::BIGINT AS n, coalesce(sum(good) FILTER (mask & subset = 0), 0)::BIGINT AS good, coalesce(sum(toxic) FILTER (mask & subset = 0), 0)::BIGINT AS toxic FROM m, range(32) r(subset) GROUP BY part, subset),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
p AS (SELECT filter_order, step::INT AS step, bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE strpos(filter_order, g.letter) < step)::INT AS before FROM o, range(1, 6) r(step), f WHERE filter_order[step] = letter),
x AS (SELECT a.part, p.*, z.n AS kept, a.n - z.n AS removed, a.good - z.good AS good_lost, a.toxic - z.toxic AS toxic_lost, e.n - own.n AS fails, others.n - every.n AS unique_fails
  FROM p JOIN s a ON a.subset = before JOIN s z ON z.subset = before + bit AND z.part = a.part JOIN s e ON e.subset = 0 AND e.part = a.part JOIN s own ON own.subset = bit AND own.part = a.part
  JOIN s others ON others.subset = 31 - bit AND others.part = a.part JOIN s every ON every.subset = 31 AND every.part = a.part)
SELECT part, filter_order, step, kept, removed, fails - removed AS redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 3 = 0 AS chosen, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents),
h AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lower, chosen FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
up(tree, level, nodes) AS (SELECT tree, 0, list(leaf ORDER BY pos) FROM p GROUP BY tree
  UNION ALL SELECT tree, level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], ''))) FROM up WHERE len(nodes) > 1),
sub AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM up WHERE len(nodes) = 1),
over(level, nodes) AS (SELECT 0, list(subroot ORDER BY place) FROM sub UNION ALL SELECT level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], ''))) FROM over WHERE len(nodes) > 1),
steps AS (SELECT tree, level, nodes FROM up WHERE len(nodes) > 1 UNION ALL SELECT tree, (SELECT max(level) FROM up u WHERE u.tree = sub.tree) + level, nodes FROM sub, over WHERE len(nodes) > 1),
fold(doc_id, tree, level, pos, place, node, proof) AS (SELECT doc_id, p.tree, 0, pos, place, CASE WHEN chosen THEN lower ELSE leaf END, '' FROM p JOIN sub USING (tree)
  UNION ALL SELECT doc_id, f.tree, f.level + 1, here // 8, place, sha256(lft || node || rgt), proof || lft || rgt FROM (SELECT f.*, array_to_string(nodes[here - here % 8 + 1 : here], '') AS lft, array_to_string(nodes[here + 2 : here - here % 8 + 8], '') AS rgt
    FROM (SELECT f.*, CASE WHEN f.level = (SELECT max(level) FROM up u WHERE u.tree = f.tree) THEN place ELSE pos END AS here FROM fold f) f JOIN steps s ON s.tree = f.tree AND s.level = f.level) f),
last AS (SELECT doc_id, arg_max(node, level) AS folded_root, arg_max(proof, level) AS proof FROM fold GROUP BY doc_id)
SELECT p.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM p JOIN sub USING (tree) JOIN last USING (doc_id), (SELECT nodes[1] AS root FROM over WHERE len(nodes) = 1) r""",
}
