"""One query for each operator over its whole table, and DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runfield.llm import decontaminate, exact_dedup, extendible_sharding, fill_in_middle, language_id, license_scan, minhash_dedup, packing, quality_classifier, quality_rules, source_divergence, token_counts, wavelet_shards
from runfield.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_shards.round_trip(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(license_scan.documents_with_paths(table(spark, sf_dir, "documents")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_sharding.shards(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergences(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digested(fill_in_middle.transformed(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_wavelet_shards": op2_wavelet_shards,
    "op3_language_id": op3_language_id,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_source_divergence": op11_source_divergence,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP5_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT item, least(len(w), {decontaminate.N}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {decontaminate.N}) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {decontaminate.N} + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)
),
hits AS (SELECT DISTINCT d.doc_id, d.i, d.n, k.item FROM dwin d JOIN win k ON d.n = k.n AND d.g = k.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""

#: Depths up to 24 stand for all: a deeper shard would need thousands of documents that share 24 bits of their hash.
OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
    CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
  FROM documents
),
tried AS (SELECT doc_id, n_bytes, d, h >> CAST({extendible_sharding.BITS} - d AS INTEGER) AS p FROM sized, (SELECT unnest(range(0, 25)) AS d)),
sums AS (SELECT d, p, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM tried GROUP BY d, p),
fit AS (
  SELECT t.doc_id, t.n_bytes, t.d, t.p, s.shard_bytes, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.d) AS k
  FROM tried t JOIN sums s ON t.d = s.d AND t.p = s.p WHERE s.shard_bytes <= {extendible_sharding.LIMIT}
)
SELECT doc_id, n_bytes, CAST(d AS INTEGER) AS depth, p AS prefix, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), CAST(d AS INTEGER), '0') END AS shard, shard_bytes, false AS oversize
FROM fit WHERE k = 1
"""

_L = license_scan
_quoted = lambda text: text.replace("'", "''")
_VALUES = ", ".join(f"({i}, '{name}', {_L.needs(name)!r}::VARCHAR[], {_L.bans(name)!r}::VARCHAR[], '{_quoted(text.lower())}')" for i, (name, text) in enumerate(_L.TEMPLATES))

OP6_SQL = f"""
WITH template(i, license, needs, bans, body) AS (VALUES {_VALUES}),
tterm AS (SELECT i, term, count(*) AS n FROM (SELECT i, unnest(regexp_extract_all(body, '[a-z0-9]+')) AS term FROM template) GROUP BY i, term),
idf AS (SELECT term, ln((1 + {len(_L.TEMPLATES)}) / (1.0 + count(*))) + 1 AS w FROM tterm GROUP BY term),
tvec AS (SELECT i, term, n * w AS w FROM tterm JOIN idf USING (term)),
tnorm AS (SELECT i, sqrt(sum(w * w)) AS norm FROM tvec GROUP BY i),
doc AS (
  SELECT doc_id, concat_ws('/', coalesce(source, 'unknown'), CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR), CAST(doc_id AS VARCHAR) || '.txt') AS path,
    concat_ws('/', coalesce(source, 'unknown'), CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR)) AS dir,
    translate(text, '{_L.UPPER}', '{_L.SMALL}') AS low
  FROM documents
),
cued AS (SELECT doc_id, low, list_filter(string_split(low, chr(10)), lambda x: regexp_matches(x, '{_L.CUES}')) AS lines FROM doc WHERE regexp_matches(low, '{_L.CUES}')),
stated AS (SELECT doc_id, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, array_to_string(lines, ' ')) ELSE lines END) AS body FROM cued),
worded AS (SELECT doc_id, body, regexp_extract_all(body, '[a-z0-9]+') AS terms FROM stated WHERE NOT regexp_matches(body, '{_L.NEGATED}')),
numbered AS (SELECT row_number() OVER () AS s, doc_id, body, terms FROM worded WHERE len(list_intersect(list_distinct(terms), {_L.FAMILIES!r})) < 2),
sterm AS (SELECT s, term, count(*) AS n FROM (SELECT s, unnest(terms) AS term FROM numbered) GROUP BY s, term),
snorm AS (SELECT s, sqrt(sum(CASE WHEN w IS NULL THEN n * power(ln(1 + {len(_L.TEMPLATES)}) + 1, 2) ELSE power(n * w, 2) END)) AS norm FROM sterm LEFT JOIN idf USING (term) GROUP BY s),
dots AS (SELECT s, v.i, sum(t.n * f.w * v.w) AS dot FROM sterm t JOIN idf f USING (term) JOIN tvec v USING (term) GROUP BY s, v.i),
scored AS (
  SELECT n.doc_id, s, d.i, round(d.dot / (a.norm * b.norm), 6) AS cosine, p.license, len(n.terms) AS words
  FROM dots d JOIN snorm a USING (s) JOIN tnorm b ON b.i = d.i JOIN template p ON p.i = d.i JOIN numbered n USING (s)
  WHERE list_has_all(n.terms, p.needs) AND NOT list_has_any(n.terms, p.bans) AND (p.license <> 'Proprietary' OR regexp_matches(n.body, '{_L.SIGNED}'))
),
best AS (SELECT s, license, max(cosine) AS c FROM scored GROUP BY s, license),
rivals AS (SELECT a.s, a.license, coalesce(max(b.c), 0.0) AS rival FROM best a LEFT JOIN best b ON a.s = b.s AND a.license <> b.license GROUP BY a.s, a.license),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, i, license DESC, words DESC, rival DESC) AS k FROM scored JOIN rivals USING (s, license)
),
spdx AS (SELECT doc_id, coalesce(m.name, w) AS name FROM (SELECT doc_id, regexp_extract(text, '{_L.IDENTIFIER}', 1) AS w FROM documents WHERE regexp_matches(text, '{_L.IDENTIFIER}'))
  LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in sorted(_L.SPDX.items()))}) m(id, name) ON m.id = lower(w)),
own AS (
  SELECT *, coalesce(own_license IS NOT NULL AND 2 * words >= n_terms, false) AS license_file FROM (
  SELECT d.doc_id, d.path, d.dir, CASE WHEN x.name IS NOT NULL THEN 1.0 ELSE coalesce(r.cosine, 0.0) END AS cosine,
    coalesce(x.name, CASE WHEN r.cosine >= {_L.LEAST_COSINE} AND r.rival <= r.cosine - {_L.MARGIN} THEN r.license END) AS own_license, r.words, len(regexp_extract_all(d.low, '[a-z0-9]+')) AS n_terms
  FROM doc d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND r.k = 1 LEFT JOIN spdx x ON x.doc_id = d.doc_id)
),
licensed AS (SELECT dir AS above, own_license AS dir_license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) AS k FROM own WHERE license_file) WHERE k = 1),
climb AS (SELECT dir, dir AS above, 3 AS depth FROM (SELECT DISTINCT dir FROM own)
  UNION ALL SELECT dir, regexp_replace(dir, '/[^/]*$', ''), 2 FROM (SELECT DISTINCT dir FROM own)
  UNION ALL SELECT dir, regexp_replace(dir, '/[^/]*/[^/]*$', ''), 1 FROM (SELECT DISTINCT dir FROM own)
  UNION ALL SELECT dir, '', 0 FROM (SELECT DISTINCT dir FROM own)),
nearest AS (SELECT dir, above, dir_license FROM (SELECT c.dir, c.above, l.dir_license, row_number() OVER (PARTITION BY c.dir ORDER BY c.depth DESC) AS k FROM climb c JOIN licensed l USING (above)) WHERE k = 1)
SELECT o.doc_id, o.path, o.own_license, o.cosine, o.license_file, coalesce(o.own_license, n.dir_license) AS license,
  CASE WHEN o.own_license IS NOT NULL THEN 'own' WHEN n.dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.own_license IS NULL AND n.dir_license IS NOT NULL THEN n.above END AS license_dir
FROM own o LEFT JOIN nearest n USING (dir)
"""

#: All pairs of documents that share a shingle, and the components of those that are alike enough.
OP4_SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {minhash_dedup.SHINGLE - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {minhash_dedup.SHINGLE - 1}, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM pair p JOIN size m ON m.doc_id = p.a JOIN size n ON n.doc_id = p.b WHERE CAST(c AS DOUBLE) / (m.n + n.n - c) >= {minhash_dedup.SIMILARITY}),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(d, l) AS (SELECT DISTINCT doc_id, doc_id FROM doc UNION SELECT e.a, r.l FROM reach r JOIN e ON e.b = r.d WHERE r.l < e.a)
SELECT d AS doc_id, min(l) AS class_id FROM reach GROUP BY d
"""

_R = quality_rules
_PHRASES = "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in _R.PHRASES)
_SPACE = r"[ \t\n\v\f\r]"
_AFTER = _R.AFTER.replace("'", "''").replace("]", r"\]")

OP9_SQL = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM doc),
counted AS (SELECT doc_id, l, pos, len(list_filter(regexp_split_to_array(l, '{_SPACE}+'), lambda x: x <> '')) AS k FROM line),
told AS (SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY pos) > 1 AS seen FROM counted WHERE k > 0),
judged AS (
  SELECT doc_id, k, seen, 10 * length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > k
    OR length(regexp_replace(l, '[^|»·]', '', 'g')) >= 2
    OR (length(regexp_replace(l, '[^A-Z]', '', 'g')) >= 3 AND length(regexp_replace(l, '[^A-Z]', '', 'g')) > length(regexp_replace(l, '[^a-z]', '', 'g')))
    OR regexp_matches(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES}')
    OR seen OR NOT regexp_matches(l, '[{_R.CLOSING}][{_AFTER}]*{_SPACE}*$') AS fails
  FROM told
),
lines AS (SELECT doc_id, count(*) AS n_lines, count(CASE WHEN seen THEN 1 END) AS dup, count(CASE WHEN fails THEN 1 END) AS failed, coalesce(sum(CASE WHEN fails THEN k END), 0) AS lost FROM judged GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(d.w) < {_R.LEAST_WORDS} OR 100 * coalesce(r.n, 0) > {_R.MOST_REPEATED} * len(d.w) AS base_failed,
    CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(l.failed, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(l.lost, 0) AS BIGINT) AS lost_words
  FROM doc d LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)
)
SELECT *, NOT base_failed AND 100 * lost_words <= {_R.MOST_LOST} * n_words AS kept FROM base
"""

_D = source_divergence
_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_P = f"CAST(1 + (CAST({_D.SCALE} AS HUGEINT) * ({{n}} + 1)) // ({{total}} + terms) AS BIGINT)"

OP11_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS in_lang FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= {_D.LEAST_DOCS}),
n AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
whole AS (SELECT lang, count(*) AS terms, sum(in_lang) AS lang_total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
total AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, {_P.format(n="coalesce(n.n, 0)", total="coalesce(t.total, 0)")} AS p, {_P.format(n="k.in_lang", total="lang_total")} AS q
  FROM grp g JOIN kept k USING (lang) JOIN whole w USING (lang) LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
rows AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows) WHERE part = 'pair' OR rank <= {_D.TOP}
"""

OP12_SQL = r"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM doc WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

_F = fill_in_middle

OP13_SQL = rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{_F.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM doc),
formed AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '{_F.PREFIX}') OR contains(text, '{_F.SUFFIX}') OR contains(text, '{_F.MIDDLE}') OR h3 % 100 >= {_F.RATE} THEN 'plain' WHEN h4 % 100 < {_F.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn
),
cut AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{_F.PREFIX}' || prefix || '{_F.SUFFIX}' || suffix || '{_F.MIDDLE}' || middle WHEN 'spm' THEN '{_F.SUFFIX}' || suffix || '{_F.PREFIX}' || prefix || '{_F.MIDDLE}' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""

ORACLE_SQL: dict[str, str] = {
    "op4_minhash_dedup": OP4_SQL, "op5_decontamination": OP5_SQL, "op6_license_scan": OP6_SQL, "op9_quality_rules": OP9_SQL, "op10_sharding": OP10_SQL,
    "op11_source_divergence": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_fill_in_middle": OP13_SQL,
}
