"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .chat import Template, digests, format_conversations
from .common import table
from .exact_dedup import exact_dedup
from .merkle import FIELDS, WIDTH, merkle_manifest, proof_digest
from .mixing import mixture
from .packing import pack
from .quality_classifier import quality_classifier
from .quality_rules import HOST_LIMIT, quality_rules
from .secrets import DISTINCT, LEAST_ASSIGNED, LEAST_CANDIDATE, MAX_OWNERS, PATTERNS, TOKEN, listed, secrets
from .simhash import near_dedup
from .substring_dedup import WINDOW, substring_dedup
from .token_counts import token_counts
from .toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The words of each document, the documents numbered as rows.
_WORDS = r"SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents"
OP5_SQL = rf"""
WITH d AS ({_WORDS}),
starts AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 4], ' ')) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) x) y WHERE n > 1),
covered AS (SELECT r, sum(least(5, coalesce(after - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM starts) z GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
m AS (SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN lines USING (r) LEFT JOIN covered c ON c.r = d.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, sum(CAST(base_failed AS INTEGER)) AS bad FROM f GROUP BY source),
s AS (SELECT CAST(sum(bad) AS DOUBLE) AS f, CAST(sum(docs) AS DOUBLE) AS n, count(*) AS k, sum(bad * bad / CAST(docs AS DOUBLE)) AS ff, sum(CAST(docs AS DOUBLE) * docs) AS nn FROM h),
q AS (SELECT f / n AS mean, f / n * (1 - f / n) AS within, CASE WHEN k > 1 THEN (ff - f * f / n - (k - 1) * f / n * (1 - f / n)) / (n - nn / n) ELSE 0 END AS spread FROM s),
rates AS (SELECT source, CASE WHEN spread <= 0 THEN mean ELSE (bad + mean * greatest(within / spread - 1, 1)) / (docs + greatest(within / spread - 1, 1)) END AS rate FROM h CROSS JOIN q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {HOST_LIMIT} AS kept FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source
"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], conversations.schema)
    return digests(format_conversations(conversations.unionByName(own)))


def _marks(template: Template, role: str) -> int:
    """Characters of the marks around a turn's text."""
    opening, closing, _ = template.roles[role]
    return len(opening) + len(closing)


_TEMPLATE = Template()
_SPECIAL = "|".join(re.escape(c) for c in (_TEMPLATE.escape, *_TEMPLATE.controls()))
_AFTER = " ".join(f"WHEN '{state}' THEN role IN ({', '.join(repr(r) for r in roles)})" for state, roles in _TEMPLATE.follows.items() if state)
OP6_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c),
t AS (SELECT *, CASE WHEN before IS NULL THEN role IN ({', '.join(repr(r) for r in _TEMPLATE.follows[''])}) ELSE coalesce(CASE before {_AFTER} END, false) END AS fits,
  length(text) + len(regexp_extract_all(text, '{_SPECIAL}')) + CASE role {' '.join(f"WHEN '{r}' THEN {_marks(_TEMPLATE, r)}" for r in _TEMPLATE.roles)}
    ELSE {sum(map(len, _TEMPLATE.other))} + length(role) + len(regexp_extract_all(role, '{_SPECIAL}')) END AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({len(_TEMPLATE.begin)} + sum(chars) AS BIGINT) AS formatted_chars, bool_and(fits) AS valid FROM t GROUP BY conv_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = rf"""
WITH d AS ({_WORDS}),
p AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM d),
k AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS least FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}) x),
c AS (SELECT p.r, p.i, word, coalesce(max(CASE WHEN least < k.doc_id THEN k.i END) OVER (PARTITION BY p.r ORDER BY p.i) > p.i - {WINDOW}, false) AS gone FROM p LEFT JOIN k ON k.r = p.r AND k.i = p.i),
o AS (SELECT r, sum(CAST(gone AS INTEGER)) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.r = d.r
"""

def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle_manifest(table(spark, sf_dir, "documents"), presented={"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def _leaf_sql(text: str) -> str:
    fields = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _tree_sql(n: str, leaves: str) -> str:
    """Levels of a tree per s over ``leaves`` (s, i, h, k of k leaves), and their runs."""
    return f"""{n} AS (SELECT s, 0 AS lvl, i, h, k FROM {leaves} UNION ALL
  SELECT s, any_value(lvl) + 1, i // {WIDTH}, sha256(string_agg(h, '' ORDER BY i)), any_value((k + {WIDTH - 1}) // {WIDTH}) FROM {n} WHERE k > 1 GROUP BY s, i // {WIDTH}),
{n}_runs AS (SELECT s, lvl, i // {WIDTH} AS j, list(h ORDER BY i) AS hs FROM {n} WHERE k > 1 GROUP BY s, lvl, i // {WIDTH})"""


def _climb_sql(name: str, n: str, begin: str) -> str:
    """``begin`` (r, s, i, proof, fold) led up the tree ``n``, a level at a time."""
    at = f"u.i % {WIDTH}"
    return f"""{name} AS (SELECT r, s, 0 AS lvl, i, proof, fold FROM {begin} UNION ALL
  SELECT r, u.s, u.lvl + 1, u.i // {WIDTH}, u.proof || array_to_string(hs[:{at}] || hs[{at} + 2:], ''), sha256(array_to_string(hs[:{at}], '') || u.fold || array_to_string(hs[{at} + 2:], '')) FROM {name} u JOIN {n}_runs t ON t.s = u.s AND t.lvl = u.lvl AND t.j = u.i // {WIDTH})"""


#: Bit by bit over the bytes of the decimal text (the polynomial is CRC-32's).
_CRC32_SQL = "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: CASE b WHEN 0 THEN ascii(c) ELSE 0 END)))), lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)))"
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS r, coalesce('+' || source, '') AS s, {_leaf_sql('text')} AS h,
  CASE WHEN doc_id IS NOT NULL AND {_CRC32_SQL} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown FROM documents),
f AS (SELECT r, s, doc_id, h, {_leaf_sql('shown')} AS fold FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h, fold) - 1 AS i, count(*) OVER (PARTITION BY s) AS k FROM f),
{_tree_sql('n', 'l')},
{_climb_sql('u', 'n', "(SELECT r, s, i, '' AS proof, fold FROM l) x")},
sub AS (SELECT s AS g, h FROM n WHERE k = 1),
g AS (SELECT g, '' AS s, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS k FROM sub),
{_tree_sql('m', 'g')},
b AS (SELECT u.r, '' AS s, g.i, u.proof, u.fold FROM u JOIN g ON g.g = u.s JOIN (SELECT r, max(lvl) AS lvl FROM u GROUP BY r) t ON t.r = u.r AND t.lvl = u.lvl),
{_climb_sql('v', 'm', 'b')},
done AS (SELECT v.* FROM v JOIN (SELECT r, max(lvl) AS lvl FROM v GROUP BY r) t ON t.r = v.r AND t.lvl = v.lvl)
SELECT l.doc_id, l.h AS leaf, sub.h AS subroot, m.h AS root, sha256(proof) AS proof_sha256, done.fold AS folded_root, done.fold = m.h AS verified
FROM l JOIN done ON done.r = l.r JOIN sub ON sub.g = l.s JOIN m ON m.k = 1
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents")).documents.drop("groups")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    base = F.sha2(listed(F.filter("found", lambda s: s["base"])), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _matches_sql(kind: str, pattern: str) -> str:
    """A row per match of a pattern, with what lies before it since the match before."""
    pattern, group = pattern.replace("'", "''"), 2 if kind == "assign" else 0
    lists = f"regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS p"
    return f"SELECT r, '{kind}' AS kind, k, m[k] AS m, v[k] AS v, length(p[k]) AS gap FROM (SELECT r, m, v, p, unnest(range(1, len(m) + 1)) AS k FROM (SELECT r, {lists} FROM d) x) y"


_BASE_FIRST = "PARTITION BY r ORDER BY a, base DESC ROWS BETWEEN"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_matches_sql(k, p) for k, p in (PATTERNS | {'token': TOKEN}).items())}),
g AS (SELECT *, kind IN ('access', 'hex') OR (kind = 'assign' AND length(v) >= {LEAST_ASSIGNED}) AS base, CAST(sum(gap + length(m)) OVER (PARTITION BY r, kind ORDER BY k) AS BIGINT) AS z FROM f),
c AS (SELECT *, z - length(m) AS a FROM g WHERE base OR (kind = 'assign' AND length(v) BETWEEN {LEAST_CANDIDATE} AND {LEAST_ASSIGNED - 1} AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]'))
  OR (kind = 'token' AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9].*[0-9]') AND len(list_distinct(string_split(v, ''))) >= {DISTINCT})),
o AS (SELECT *, coalesce(max(CASE WHEN base THEN z END) OVER ({_BASE_FIRST} UNBOUNDED PRECEDING AND CURRENT ROW) > a, false) OR coalesce(min(CASE WHEN base THEN a END) OVER ({_BASE_FIRST} CURRENT ROW AND UNBOUNDED FOLLOWING) < z, false) AS touches FROM c),
s AS (SELECT o.r, doc_id, source, CASE WHEN base THEN kind ELSE 'owned' END AS kind, base, a, z, v FROM o JOIN d USING (r) WHERE base OR NOT touches),
w AS (SELECT v, count(*) AS owners FROM (SELECT DISTINCT v, source FROM s) x GROUP BY v),
l AS (SELECT s.*, kind || ':' || a || ':' || z AS said, list_position(['assign', 'access', 'hex', 'owned'], kind) AS nth FROM s JOIN w USING (v) WHERE base OR owners <= {MAX_OWNERS}),
p AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(said, ',' ORDER BY a, nth) FILTER (WHERE base) AS b, string_agg(said, ',' ORDER BY a, nth) AS spans FROM l GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN p ON p.r = d.r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat": op6_chat,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_merkle": op11_merkle,
    "op12_alignment": op12_alignment,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_chat": OP6_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_merkle": OP11_SQL,
    "op13_secrets": OP13_SQL,
}
