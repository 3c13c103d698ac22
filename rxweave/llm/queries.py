"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave.llm.ann import search
from rxweave.llm.clustering import cluster_vectors
from rxweave.llm.common import crc_of_id, table
from rxweave.llm.decontaminate import overlaps
from rxweave.llm.language_id import identify
from rxweave.llm.license_scan import scan_licenses
from rxweave.llm.line_dedup import dedup_lines
from rxweave.llm.packing import pack
from rxweave.llm.quality import score_quality
from rxweave.llm.secret_scan import BASE_RULES, scan_secrets
from rxweave.llm.simhash import near_duplicates
from rxweave.llm.spelling import spelling_groups
from rxweave.llm.substrings import dedup_substrings
from rxweave.llm.url_filter import PatternRule, SiteRule, filter_urls

#: The site rules of the URL query.
SITE_RULES = (
    SiteRule("allow", "com", "/"),
    SiteRule("block", "example.com", "/en/"),
    SiteRule("allow", "www.example.com", "/en/"),
    SiteRule("block", "net", "/es/"),
    SiteRule("block", "net", "/fr/"),
)
#: The method's own patterns, for URLs that no site rule fits.
PATTERN_RULES = (
    PatternRule("block", r"/(?i:ads)/", ("ads",)),
    PatternRule("block", r"/(?i:adserver)/", ("adserver",)),
    PatternRule("block", r"^(?:[^/]*\.)?doubleclick\.", ("doubleclick",)),
    PatternRule("block", r"/(?i:banners)/", ("banners",)),
    PatternRule("block", r"(?i)/wp-login\.php$", ("wp", "login", "php")),
    PatternRule("block", r"(?i)\.exe$", ("exe",)),
)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


OP1_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
extra(label, words) AS (VALUES ('apache-2.0', ['licensed', 'under', 'apache', 'license', 'version', '2', '0']),
  ('bsd', ['redistribution', 'source', 'binary', 'forms', 'modification', 'permitted', 'provided', 'conditions', 'met']), ('cc-by-nc', ['licensed', 'cc', 'by', 'nc']),
  ('gpl-notice', ['free', 'software', 'redistribute', 'modify', 'terms', 'gnu', 'general', 'public', 'license']), ('mit', ['released', 'under', 'mit', 'license']),
  ('mit-text', ['permission', 'hereby', 'granted', 'free', 'charge', 'person', 'obtaining', 'copy', 'software']),
  ('mpl', ['source', 'code', 'form', 'subject', 'terms', 'mozilla', 'public', 'license'])),
flat AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
phrases AS (SELECT r, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM flat WINDOW p AS (PARTITION BY r ORDER BY i)),
places AS (SELECT r, i, 'cc-by' AS label FROM phrases WHERE w = 'cc' AND w1 = 'by' UNION ALL SELECT r, i, 'gpl' FROM phrases WHERE w = 'general' AND w1 = 'public' AND w2 = 'license'
  UNION ALL SELECT r, i, 'reserved' FROM phrases WHERE w = 'all' AND w1 = 'rights' AND w2 = 'reserved'),
based AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
words AS (SELECT label, len(words) AS n, unnest(words) AS w FROM extra),
windows AS (SELECT r, label, n, count(DISTINCT w) OVER (PARTITION BY r, label ORDER BY i RANGE BETWEEN CURRENT ROW AND 63 FOLLOWING) AS c FROM flat JOIN words USING (w)),
met AS (SELECT r, label, max(c) / any_value(n) AS share FROM windows GROUP BY r, label HAVING max(c) >= ceil(0.8 * any_value(n) - 1e-9)),
added AS (SELECT r, max(share) AS share FROM met GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM met) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM docs LEFT JOIN based USING (r) LEFT JOIN added USING (r) LEFT JOIN named USING (r)
"""


#: A score from here on is label 1.
QUALITY_CUT = 0.3


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_of_id() % 5 == 0
    found = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")

    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(text(F.filter("found", lambda x: x.kind.isin(kinds))), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )


OP5_SQL = r"""
WITH rules(kind, ord, pattern, grp, least) AS (VALUES
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 16), ('hex', 2, '[0-9a-f]+', 0, 32),
  ('github', 3, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 1), ('slack', 4, 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 1),
  ('pem', 5, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1), ('jwt', 6, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}', 0, 1)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS (SELECT r, kind, ord, least,
    CASE kind WHEN 'assign' THEN regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') WHEN 'hex' THEN regexp_extract_all(text, '[0-9a-f]+')
      WHEN 'github' THEN regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}') WHEN 'slack' THEN regexp_extract_all(text, 'xox[abprs]-[A-Za-z0-9-]{10,}')
      WHEN 'pem' THEN regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') ELSE regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}') END AS hit,
    CASE kind WHEN 'assign' THEN regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE NULL END AS part,
    CASE kind WHEN 'assign' THEN string_split_regex(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 'access' THEN string_split_regex(text, 'AKIA[A-Z0-9]+') WHEN 'hex' THEN string_split_regex(text, '[0-9a-f]+')
      WHEN 'github' THEN string_split_regex(text, 'gh[pousr]_[A-Za-z0-9]{36,}') WHEN 'slack' THEN string_split_regex(text, 'xox[abprs]-[A-Za-z0-9-]{10,}')
      WHEN 'pem' THEN string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') ELSE string_split_regex(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}') END AS gap
  FROM docs, rules),
each AS (SELECT r, kind, ord, least, unnest(hit) AS hit, unnest(coalesce(part, hit)) AS part, unnest(gap[1:len(hit)]) AS gap, unnest(range(len(hit))) AS i FROM hits WHERE len(hit) > 0),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM each),
kept AS (SELECT r, kind, ord, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE length(part) >= least),
per AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (r)
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_of_id() % 4 == 2
    found = identify(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH docs AS (SELECT dense_rank() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, text, coalesce(string_split(text, chr(10)), []) AS ls FROM documents),
each AS (SELECT DISTINCT r, ls FROM docs),
lines AS (SELECT r, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM each),
filled AS (SELECT r, l, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM lines WHERE regexp_matches(l, '[^\t\n\x0B\f\r ]')),
chunks AS (SELECT r, i AS a, j + 1 AS b, array_to_string(ls[i + 1 : j + 1], chr(10)) AS chunk FROM filled JOIN each USING (r) WHERE j IS NOT NULL
  UNION ALL SELECT r, i, i + 1, l FROM filled WHERE len(regexp_extract_all(l, '[^\t\n\x0B\f\r ]+')) > 50),
placed AS (SELECT *, first_value(r) OVER p AS fr, first_value(b) OVER p AS fb, row_number() OVER p AS n FROM chunks WINDOW p AS (PARTITION BY chunk ORDER BY r, a, b)),
gone AS (SELECT DISTINCT r, unnest(range(a, b)) AS i FROM placed WHERE n > 1 AND (r <> fr OR a >= fb)),
spans AS (SELECT r, string_agg(a || '-' || b, ',' ORDER BY a) AS removed, CAST(sum(b - a + 1) AS BIGINT) AS n_removed FROM (SELECT r, min(i) AS a, max(i) AS b FROM (SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS g FROM gone) GROUP BY r, g) GROUP BY r),
kept AS (SELECT r, string_agg(l, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CASE WHEN docs.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM docs LEFT JOIN kept USING (r) LEFT JOIN spans USING (r)
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), SITE_RULES + PATTERN_RULES)


OP8_SQL = r"""
WITH rules(host_rule, path_rule, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT r, host_rule || path_rule AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(host_rule || path_rule) DESC) AS n
  FROM split, rules WHERE (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict
  WHEN regexp_matches(host || path, '/(?i:ads|adserver|banners)/|^([^/]*\.)?doubleclick\.|(?i:/wp-login\.php)$|(?i:\.exe)$') THEN 'block' ELSE 'allow' END AS verdict
FROM split LEFT JOIN (SELECT * FROM best WHERE n = 1) USING (r)
"""

def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP9_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
items AS (SELECT row_number() OVER () AS b, item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
places AS (SELECT r, b, d.j - i.i AS shift, i.i AS i, size FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM docs) d
  JOIN (SELECT b, least(len(ws), 13) AS size, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM items) i USING (w)),
numbered AS (SELECT *, CAST(ceil(0.8 * size - 1e-9) AS INT) AS need, row_number() OVER p AS n, count(*) OVER (PARTITION BY r, b, shift) AS total FROM places WINDOW p AS (PARTITION BY r, b, shift ORDER BY i)),
ends AS (SELECT a.r, a.b, a.shift, greatest(z.i - a.size + 1, 0) AS low, least(a.i, len(t.ws) - a.size) AS high FROM (SELECT * FROM numbered WHERE total >= need) a JOIN numbered z ON a.r = z.r AND a.b = z.b AND a.shift = z.shift AND z.n = a.n + a.need - 1 AND z.i - a.i < a.size JOIN items t ON t.b = a.b),
starts AS (SELECT DISTINCT r, b, shift, unnest(range(low, high + 1)) AS s FROM ends),
runs AS (SELECT r, b, shift, min(s) AS first, max(s) AS last FROM (SELECT *, s - row_number() OVER (PARTITION BY r, b, shift ORDER BY s) AS g FROM starts) GROUP BY r, b, shift, g),
spans AS (SELECT u.r, u.b, u.shift, u.first, count(*) AS n_equal, min(n.i) AS i0, max(n.i) AS i1 FROM runs u JOIN numbered n ON u.r = n.r AND u.b = n.b AND u.shift = n.shift AND n.i BETWEEN u.first AND u.last + n.size - 1 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY r, b ORDER BY n_equal DESC, shift + i0, i1 - i0 DESC) AS o FROM spans)
SELECT doc_id, item_id, CAST(i1 + 1 - i0 AS BIGINT) AS n_words, n_equal, CAST(shift + i0 AS BIGINT) AS first_word, CAST(shift + i1 AS BIGINT) AS last_word
FROM best JOIN docs USING (r) JOIN items USING (b) WHERE o = 1
"""


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
met AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM met QUALIFY rank <= 10
"""


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


#: DuckDB's levenshtein compares bytes, so letters beyond ASCII are written as ASCII characters that no word has; CRC-32 is worked out bit by bit.
_WIDE = "".join(chr(c) for c in range(0xC0, 0x100))
_NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_{|}~"[: len(_WIDE)]
OP11_SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda c: ord(c)) AS cs FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
bytes AS (SELECT w, n, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(cs, lambda c: CASE WHEN c < 128 THEN [CAST(c AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(c - 64 AS BIGINT)] END))) AS bs FROM each),
hashed AS (SELECT w, n, xor(list_reduce(bs, lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) AS h FROM bytes),
typed AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed),
words AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n, translate(w, '{_WIDE}', '{_NARROW.replace("'", "''")}') AS a FROM typed WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
near AS (SELECT x.w, y.w AS form, y.n AS form_n FROM words x JOIN words y ON x.w <> y.w AND abs(length(x.w) - length(y.w)) <= 1 AND levenshtein(x.a, y.a) = 1),
best AS (SELECT w, count(*) OVER (PARTITION BY w) AS n_near, form, form_n FROM near QUALIFY row_number() OVER (PARTITION BY w ORDER BY form_n DESC, encode(form)) = 1),
formed AS MATERIALIZED (SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (w)),
chain AS (SELECT w, w AS root, 0 AS step FROM formed UNION ALL SELECT c.w, f.form, step + 1 FROM chain c JOIN formed f ON f.w = c.root WHERE f.form IS NOT NULL)
SELECT f.w AS word, form, root, n, n_near, form_n FROM formed f JOIN (SELECT w, arg_max(root, step) AS root FROM chain GROUP BY w) USING (w)
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _op12_round(n: int) -> str:
    """Assignment to the centroids of round ``n``, and the centroids of the next."""
    assign = f"a{n} AS MATERIALIZED (SELECT r, x, min(d * 16 + j) % 16 AS j, min(d * 16 + j) // 16 AS d FROM (SELECT r, x, j, list_sum(list_transform(list_zip(x, c), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT))) AS d FROM x, c{n}) GROUP BY r, x)"
    means = (
        f"s{n} AS (SELECT j, list(CAST((s - ((s % m) + m) % m) / m AS BIGINT) ORDER BY i) AS c FROM (SELECT j, i, sum(y) AS s, CAST(count(*) AS HUGEINT) AS m FROM (SELECT j, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY j, i) GROUP BY j), "
        f"c{n + 1} AS MATERIALIZED (SELECT j, coalesce(s{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN s{n} USING (j))"
    )
    return f"{assign}, {means}" if n < 3 else assign


OP12_SQL = f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: CAST(floor(64 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS j, x AS c FROM x QUALIFY j < 16),
{", ".join(_op12_round(n) for n in range(4))}
SELECT vec_id, CAST(j AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN x USING (r) JOIN c3 USING (j)
"""


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")


OP13_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT r, unnest(range(0, greatest(length(x) // 2 - 399, 0), 1000)) AS b, x FROM docs),
cut AS (SELECT r, b, substring(x, CAST(2 * b + 1 AS BIGINT), 2798) AS x FROM blocks),
places AS (SELECT r, b + i AS p, md5_number(substring(x, CAST(2 * i + 1 AS BIGINT), 800)) AS h FROM (SELECT r, b, x, unnest(range(0, least(1000, length(x) // 2 - 399))) AS i FROM cut)),
twice AS (SELECT h FROM places GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, p FROM places SEMI JOIN twice USING (h)),
begun AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS s FROM hit),
runs AS (SELECT r, g, min(p) AS a, max(p) + 400 AS b FROM (SELECT r, p, sum(s) OVER (PARTITION BY r ORDER BY p) AS g FROM begun) GROUP BY r, g),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT r, string_agg(substring(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substring(any_value(x), CAST(2 * max(b) + 1 AS BIGINT)) AS x, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, CAST(length(docs.x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, docs.x))) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality": op2_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash": op4_simhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_ann": op10_ann,
    "op11_spelling": op11_spelling,
    "op12_clusters": op12_clusters,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES: dict[str, str] = {"op1_license_scan": OP1_SQL, "op5_secret_scan": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_url_filter": OP8_SQL, "op9_decontamination": OP9_SQL, "op10_ann": OP10_SQL, "op11_spelling": OP11_SQL, "op12_clusters": OP12_SQL, "op13_suffix_dedup": OP13_SQL}
