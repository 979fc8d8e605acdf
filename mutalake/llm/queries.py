"""The registered queries of the thirteen operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutalake.llm.chunk_codec import piece_digests
from mutalake.llm.common import table
from mutalake.llm.main_text import main_text
from mutalake.llm.ngram_join import ngram_components
from mutalake.llm.packing import pack_documents
from mutalake.llm.passages import repeated_passages
from mutalake.llm.personal_data import redact
from mutalake.llm.quality_rules import ALPHA, DELTA, FIGURES, PATH, judge
from mutalake.llm.quality_votes import vote_quality
from mutalake.llm.spelling_variants import variant_groups
from mutalake.llm.suffix_tree_lm import score_documents
from mutalake.llm.url_filter import judge_urls
from mutalake.llm.vector_codes import encode_vectors
from mutalake.llm.vector_search import nearest_vectors


def remainder(n: int) -> Column:
    """crc32 of the document's number as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), remainder(7) != 2)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *FIGURES, "base_failed", "kept")


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(5) != 0)


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_main_text, op2_vector_search, op3_passage_dedup, op4_suffix_tree_lm, op5_packing, op6_ngram_join, op7_url_filter, op8_quality_rules, op9_quality_votes, op10_piece_codec, op11_personal_data, op12_spelling_variants, op13_vector_codes)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_PATH = ", ".join("(" + ", ".join(map(str, (i, *step))) + ")" for i, step in enumerate(PATH))
_REJECTED = "(symbol_ratio > c1 OR dup_line_ratio > c2 OR repeat_ratio > c3 OR upper_ratio > c4 OR mean_word > c5)"

_NEAREST = """
near{k} AS (SELECT r, p, any_value(y) AS y, arg_min(e, (far, e)) AS e, min(far) AS far FROM (SELECT r, p, e, y, list_sum(list_transform(range(1, len(y) + 1), lambda i: (y[i] - c[i]) * (y[i] - c[i]))) AS far FROM parts JOIN books{k} USING (p)) GROUP BY r, p)"""
_MEANS = """
means{n} AS (SELECT p, e, list((s - ((s % m) + m) % m) // m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(sum(y[i]) AS BIGINT) AS s, count(*) AS m FROM near{k}, unnest(range(1, len(y) + 1)) AS t(i) GROUP BY p, e, i) GROUP BY p, e),
books{n} AS (SELECT p, e, coalesce(means{n}.c, books{k}.c) AS c FROM books{k} LEFT JOIN means{n} USING (p, e))"""

ORACLES: dict[str, str] = {
    "op8_quality_rules": f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
triples AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS times FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM triples WHERE times > 1) GROUP BY r),
figures AS (
  SELECT texts.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper FROM texts JOIN lines USING (r) LEFT JOIN covered USING (r)),
measured AS (
  SELECT *, coalesce(CAST(n_symbols AS DOUBLE) / nullif(word_chars, 0), 0) AS symbol_ratio, coalesce(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(CAST(n_repeat_words AS DOUBLE) / nullif(n_words, 0), 0) AS repeat_ratio,
    coalesce(CAST(n_upper AS DOUBLE) / nullif(word_chars, 0), 0) AS upper_ratio, coalesce(CAST(word_chars AS DOUBLE) / nullif(n_words, 0), 0) AS mean_word FROM figures),
path(step, c1, c2, c3, c4, c5) AS (VALUES {_PATH}),
marked AS (SELECT m.*, quality = 1 AS good FROM measured m JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
counts AS (SELECT stratum, step, count(*) FILTER (good) AS n, count(*) FILTER (good AND {_REJECTED}) AS k, count(*) FILTER (NOT good AND {_REJECTED}) AS caught FROM marked, path GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k > n * {ALPHA} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) END AS p FROM counts),
tested AS (SELECT *, p <= {DELTA} / (SELECT count(DISTINCT stratum) FROM marked) AS passes FROM tails),
stops AS (SELECT stratum, coalesce(min(step) FILTER (NOT passes), {len(PATH)}) AS stop FROM tested GROUP BY stratum),
chosen AS (SELECT stratum, arg_max(step, (caught, -step)) AS step FROM tested JOIN stops USING (stratum) WHERE step < stop AND caught > 0 GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce({_REJECTED}, false) AS kept
FROM measured LEFT JOIN chosen USING (stratum) LEFT JOIN path USING (step)
""",
    "op6_ngram_join": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op7_url_filter": f"""
WITH rests AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
rules(rule, rule_host, rule_path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crcs FROM unnest(range(256)) AS t(b)),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY id, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(id || ':' || run), 2), lambda i: CAST(('0x' || substr(hex(id || ':' || run), i, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1]))) AS h FROM counted, crc_table),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = head || tail
  UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = head || tail),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM pairs JOIN words ON words.word = b GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
way(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.root WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM forms f JOIN way USING (word) JOIN forms last ON last.word = way.root WHERE last.form IS NULL
""",
    "op13_vector_codes": f"""
WITH whole AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS y FROM whole, unnest(range(16)) AS t(p)),
seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole ORDER BY vec_id LIMIT 64),
books0 AS (SELECT p, e, y AS c FROM parts JOIN seeds USING (r)),{_NEAREST.format(k=0)},{_MEANS.format(n=1, k=0)},{_NEAREST.format(k=1)},{_MEANS.format(n=2, k=1)},{_NEAREST.format(k=2)},
coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near2 GROUP BY r),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN whole USING (r) GROUP BY label),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books2)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM coded JOIN whole USING (r) JOIN sums ON sums.label IS NOT DISTINCT FROM whole.label, books
""",
}
