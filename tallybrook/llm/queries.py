"""The queries of the corpus operators and, where SQL can express them, their SQL.

Some operators' results are in part beyond SQL. The queries named `check_` are what is left of those results: the columns
that SQL can compute from the tables, so that the operators' counts, links and sums are compared with another engine's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import bpe_transducer, brown_lm, license_scan, line_dedup, near_dup, packing, quality_classifier, quality_rules, token_counts, topk_search


def check_quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check_language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = brown_lm.op10_brown_lm(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_minhash_near_dedup": near_dup.op6_minhash_near_dedup,
    "op7_bpe_round_trip": bpe_transducer.op7_bpe_round_trip,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_top_k_search": topk_search.op9_top_k_search,
    "op10_brown_lm": brown_lm.op10_brown_lm,
    "check_quality_rule_counts": check_quality_rule_counts,
    "check_language_model_base": check_language_model_base,
}

_words = lambda text: f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
_lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# the polynomial of CRC-32, a bit at a time
_crc32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

_RULE_COUNTS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS t(k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted"""

_LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
split AS (SELECT r, doc_id, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS t FROM d WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, line, t, len({_words("t")}) AS n, row_number() OVER (PARTITION BY r ORDER BY line) AS p FROM split WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
s AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY p) AS upto FROM l),
whole AS (SELECT r, list(t ORDER BY p) AS ts FROM l GROUP BY r),
runs AS (SELECT a.r, a.doc_id, a.line, a.p AS first, b.p AS last FROM s a JOIN s b ON a.r = b.r AND b.p >= a.p AND b.upto - a.upto + a.n >= 50
  WHERE b.upto - b.n - a.upto + a.n < 50 OR b.upto - a.upto < 50),
marked AS (SELECT runs.*, md5(array_to_string(list_slice(ts, first, last), chr(10))) AS m, last - first AS k FROM runs JOIN whole USING (r)),
copies AS (SELECT r, first, last FROM (SELECT *, row_number() OVER (PARTITION BY m, k ORDER BY doc_id NULLS FIRST, r, line) AS c,
  min({{'a': coalesce(doc_id, -9223372036854775808), 'r': r, 'l': line}}) OVER (PARTITION BY m, k) AS f FROM marked) WHERE f.r <> r OR f.l <> line),
gone AS (SELECT DISTINCT s.r, s.line FROM s JOIN copies ON s.r = copies.r AND s.p BETWEEN first AND last),
kept AS (SELECT r, string_agg(t, chr(10) ORDER BY line) AS t FROM split WHERE (r, line) NOT IN (SELECT (r, line) FROM gone) GROUP BY r),
n_gone AS (SELECT r, count(*) AS n FROM gone GROUP BY r), n_all AS (SELECT r, count(*) AS n FROM l GROUP BY r)
SELECT doc_id, coalesce(n_all.n, 0)::BIGINT AS n_lines, coalesce(n_gone.n, 0)::BIGINT AS n_removed_lines,
  CASE WHEN n_gone.n IS NULL THEN text WHEN regexp_matches(kept.t, '[^\x20\x09-\x0D]') THEN kept.t ELSE '' END AS text
FROM d LEFT JOIN n_all USING (r) LEFT JOIN n_gone USING (r) LEFT JOIN kept USING (r)"""

_NEAR = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_lower)} AS w FROM documents),
shingles AS (SELECT DISTINCT r, list_slice(w, i, i + 2) AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
marks AS (SELECT r, n, md5(string_agg(array_to_string(s, ' '), chr(10) ORDER BY array_to_string(s, ' '))) AS m FROM shingles JOIN sizes USING (r) GROUP BY r, n),
reps AS (SELECT m, min(r) AS rep FROM marks GROUP BY m),
own AS (SELECT shingles.r, s, n FROM shingles JOIN reps ON rep = shingles.r JOIN sizes ON sizes.r = shingles.r),
pairs AS (SELECT a.r AS a, b.r AS b FROM own a JOIN own b ON a.s = b.s AND a.r < b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
placed AS (SELECT d.r, doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, d.r) AS root FROM d LEFT JOIN marks ON marks.r = d.r LEFT JOIN reps ON reps.m = marks.m LEFT JOIN root ON root.a = reps.rep),
named AS (SELECT root, min(doc_id) AS component_id FROM placed GROUP BY root)
SELECT doc_id, n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept FROM placed JOIN named USING (root)"""

_BASE_SCORES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_crc32} % 7 = 2, false) AS held_out, list_append({_words(_lower)}, chr(10)) AS w FROM documents),
tokens AS (SELECT r, held_out, unnest(w) AS word FROM d),
counts AS (SELECT word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY word),
totals AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM counts),
scored AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))) AS base_score FROM tokens LEFT JOIN counts USING (word), totals GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base_score, 4) AS base_score FROM d JOIN scored USING (r), totals"""

ORACLE_SQL = {
    "op5_line_dedup": _LINES,
    "op6_minhash_near_dedup": _NEAR,
    "op9_top_k_search": topk_search.ORACLE,
    "check_quality_rule_counts": _RULE_COUNTS,
    "check_language_model_base": _BASE_SCORES,
}
