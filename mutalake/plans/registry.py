"""The registered queries and their SQL twins, written apart from each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutalake.functions import catalog
from mutalake.functions.rewrites import rewrite_targets
from mutalake.functions.session import discard, shared_folder
from mutalake.operators import discovery, edits, outcomes, scoring, selection
from mutalake.plans import adapters as A
from mutalake.plans import cases, programs, reports
from mutalake.plans.rewrite_queries import REWRITES, REWRITES_SQL
from mutalake.sources.files import excluded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(REWRITES)
ORACLES: dict[str, str] = dict(REWRITES_SQL)


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_MERGED = "lines AS (SELECT file, line, sum(hits) AS hits FROM raw_lines GROUP BY file, line)"
_COVERED = """spans AS (
  SELECT f.file, f.function, f.cyclomatic, f.scan_seq, count(l.line) AS executable, count(l.line) FILTER (l.hits > 0) AS hit FROM functions f LEFT JOIN lines l ON l.file = f.file AND l.line BETWEEN f.start_line AND f.end_line GROUP BY ALL),
scored AS (
  SELECT *, CASE WHEN file NOT IN (SELECT file FROM lines) THEN CAST(0.0 AS DOUBLE) WHEN executable = 0 THEN CAST(100.0 AS DOUBLE) ELSE CAST(hit AS DOUBLE) / executable * 100 END AS coverage FROM spans),
crap AS (
  SELECT *, CAST(cyclomatic AS DOUBLE) * cyclomatic * ((1 - coverage / CAST(100 AS DOUBLE)) * (1 - coverage / CAST(100 AS DOUBLE)) * (1 - coverage / CAST(100 AS DOUBLE))) + cyclomatic AS crap FROM scored)"""
_CRAP = f"WITH {A.FUNCTIONS_SQL}, {A.LINES_SQL}, {_MERGED}, {_COVERED}"


@query(f"{_CRAP} SELECT file, function, cyclomatic, coverage, crap FROM crap")
def crap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = A.item_tasks(spark, sf_dir)
    lines = scoring.merge_hits(A.raw_lines(spark, sf_dir, tasks), tasks=tasks)
    scores = scoring.score_functions(A.functions(spark, sf_dir, tasks), lines, tasks=tasks)
    return scoring.by_risk(scores.select("file", "function", "cyclomatic", "coverage", "crap"), tasks)


@query(f"WITH {A.FUNCTIONS_SQL} SELECT file, function, CAST(0 AS DOUBLE) AS coverage, CAST(cyclomatic * cyclomatic + cyclomatic AS DOUBLE) AS crap FROM functions")
def crap_without_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_functions(A.functions(spark, sf_dir, A.item_tasks(spark, sf_dir))).select("file", "function", "coverage", "crap")


for _how, _sql in (("sum", "CAST(sum(hits) AS BIGINT)"), ("max", "max(hits)"), ("last", "arg_max(hits, seq)")):

    def _merge(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        tasks = A.item_tasks(spark, sf_dir)
        return scoring.merge_hits(A.raw_lines(spark, sf_dir, tasks), how, tasks)

    QUERIES[f"coverage_merge_{_how}"] = _merge
    ORACLES[f"coverage_merge_{_how}"] = f"WITH {A.LINES_SQL} SELECT file, line, {_sql} AS hits FROM raw_lines GROUP BY file, line"


@query("SELECT p_brand AS file, line, max(p_partkey) AS hits FROM part, (SELECT unnest(range(0, 80)) AS line) WHERE line BETWEEN p_size AND CAST(p_partkey % 60 AS INT) GROUP BY p_brand, line")
def block_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = A.load(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_size").cast("long").alias("first"), (F.col("p_partkey") % 60).alias("last"), F.col("p_partkey").alias("count"))
    return scoring.expand_blocks(blocks)


_MATCHED = f"""WITH {A.URL_FILES_SQL}, pairs AS (
  SELECT s.file, c.file AS coverage_file, least(len(string_split(s.file, '/')), len(string_split(c.file, '/'))) AS n FROM sources s JOIN covered c ON s.file = c.file OR ends_with(s.file, '/' || c.file) OR ends_with(c.file, '/' || s.file)),
best AS (SELECT file, coverage_file FROM pairs QUALIFY row_number() OVER (PARTITION BY file ORDER BY (file = coverage_file) DESC, n DESC, coverage_file) = 1)"""


@query(f"{_MATCHED} SELECT file, coverage_file FROM best")
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.match_files(*A.url_files(spark, sf_dir))


@query(f"""{_MATCHED} SELECT (SELECT count(*) FROM best) AS matched_sources, (SELECT count(*) FROM sources WHERE file NOT IN (SELECT file FROM best)) AS unmatched_sources,
  (SELECT count(*) FROM covered WHERE file IN (SELECT coverage_file FROM best)) AS matched_coverage, (SELECT count(*) FROM covered WHERE file NOT IN (SELECT coverage_file FROM best)) AS unmatched_coverage""")
def coverage_match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.match_report(*A.url_files(spark, sf_dir))


_RANGES = """ranges AS (SELECT p_brand AS file, CAST(p_size * 100 AS BIGINT) AS start_byte, CAST(p_size * 100 + p_partkey % 7 * 60 + 20 AS BIGINT) AS end_byte FROM part),
points AS (SELECT DISTINCT p_brand AS file, CAST(p_partkey * 37 % 5400 AS BIGINT) AS at FROM part)"""


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = A.load(spark, sf_dir, "part")
    start = (F.col("p_size") * 100).cast("long")
    ranges = p.select(F.col("p_brand").alias("file"), start.alias("start_byte"), (start + F.col("p_partkey") % 7 * 60 + 20).alias("end_byte")).distinct()
    return ranges, p.select(F.col("p_brand").alias("file"), (F.col("p_partkey") * 37 % 5400).alias("at")).distinct()


@query(f"""WITH {_RANGES}, d AS (SELECT DISTINCT * FROM ranges)
SELECT f.file, f.start_byte, f.end_byte, 1 + (SELECT count(*) FROM points p WHERE p.file = f.file AND p.at >= f.start_byte AND p.at < f.end_byte AND NOT EXISTS (
  SELECT 1 FROM d n WHERE n.file = f.file AND n.start_byte >= f.start_byte AND n.end_byte <= f.end_byte AND (n.start_byte, n.end_byte) <> (f.start_byte, f.end_byte) AND p.at >= n.start_byte AND p.at < n.end_byte)) AS cyclomatic FROM d f""")
def nested_range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.attribute_branches(*_ranges(spark, sf_dir)).select("file", "start_byte", "end_byte", "cyclomatic")


@query(f"""WITH {_RANGES}, d AS (SELECT DISTINCT *, 'r' || start_byte || '-' || end_byte AS name FROM ranges)
SELECT p.file, p.at, arg_min(d.name, (d.end_byte - d.start_byte, d.start_byte, d.name)) AS name FROM points p JOIN d ON d.file = p.file AND p.at >= d.start_byte AND p.at < d.end_byte GROUP BY p.file, p.at""")
def innermost_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges, points = _ranges(spark, sf_dir)
    return scoring.innermost(points, ranges.select("file", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"), F.concat(F.lit("r"), "start_byte", F.lit("-"), "end_byte").alias("name")))


_TOTALS = ", ".join(["count(*) AS total", *(f"count(*) FILTER (status = '{s}') AS {s}" for s in outcomes.STATUSES)])
_RATE = "CASE WHEN killed + survived > 0 THEN CAST(killed AS DOUBLE) / (killed + survived) * 100 END AS mutation_score"


@query(programs.SCAN_SQL)
def scan_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.scan_programs(programs.program_sources(spark, sf_dir)).select("file", "language", "function", "start_line", "end_line", "cyclomatic")


@query(programs.CYCLOMATIC_SQL)
def cyclomatic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discovery.scan_programs(programs.program_sources(spark, sf_dir))
    return found.groupBy("language").agg(F.count("*").alias("functions"), F.sum("cyclomatic").alias("cyclomatic"), F.max("cyclomatic").alias("highest"))


@query(programs.DISCOVER_SQL)
def discover_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discovery.discover(programs.program_sources(spark, sf_dir))
    return found.select("id", "file", "language", "function", "operator", "implementation", "line", "column", "original", "replacement")


@query(cases.CASES_SQL)
def implementation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of all implementations in files of their own, each beside texts that only look like one."""
    found = discovery.candidate_sites(cases.case_sources(spark, sf_dir)).where(F.col("implementation") == F.substring_index("file", "/", 1))
    return edits.widen_deletions(rewrite_targets(found.where("scan_seq is not null"))).select("file", "implementation", "line", "column", "original", "replacement")


@query(cases.COMPLEXITY_SQL)
def complexity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and complexities in all 23 languages."""
    found = discovery.scan_programs(cases.complexity_sources(spark, sf_dir)).withColumn("function", F.regexp_replace("function", "^(<anonymous>):.*", "$1"))
    return found.groupBy("file", "function", "cyclomatic").agg(F.count("*").alias("n"))


@query(f"WITH {A.OUTCOMES_SQL}, t AS (SELECT {_TOTALS} FROM outcomes) SELECT *, {_RATE} FROM t")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.run_totals(A.outcomes(spark, sf_dir))


_ORDINALS = "ordinals(operator, ordinal) AS (VALUES " + ", ".join(f"('{name}', {i})" for i, (name, *_) in enumerate(catalog.OPERATORS)) + ")"


@query(f"WITH {A.OUTCOMES_SQL}, {_ORDINALS}, t AS (SELECT operator, {_TOTALS} FROM outcomes GROUP BY operator) SELECT t.*, {_RATE}, row_number() OVER (ORDER BY total DESC, ordinal) AS position FROM t JOIN ordinals USING (operator)")
def operator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.operator_order(outcomes.operator_summary(A.outcomes(spark, sf_dir)))


_ENTRY = "one AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY file, function ORDER BY crap, scan_seq DESC) = 1)"
_FUNCTION = f"""WITH {A.OUTCOMES_SQL}, {A.ENTRIES_SQL}, {_ENTRY}, t AS (SELECT file, function, {_TOTALS} FROM outcomes GROUP BY file, function), r AS (SELECT *, {_RATE} FROM t),
summary AS (SELECT r.*, cyclomatic, coverage, crap, coalesce(crap, 0) + coalesce(100 - mutation_score, 0) + (100 - coalesce(coverage, 0)) * CAST(0.25 AS DOUBLE) AS priority_score FROM r LEFT JOIN one USING (file, function))"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.function_summary(A.outcomes(spark, sf_dir), A.entries(spark, sf_dir))


@query(f"{_FUNCTION} SELECT * FROM summary")
def function_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)


@query(f"""WITH {A.OUTCOMES_SQL}, t AS (SELECT 'run' AS level, NULL AS operator, NULL AS file, NULL AS function, {_TOTALS} FROM outcomes
UNION ALL SELECT 'operator', operator, NULL, NULL, {_TOTALS} FROM outcomes GROUP BY operator UNION ALL SELECT 'function', NULL, file, function, {_TOTALS} FROM outcomes GROUP BY file, function) SELECT *, {_RATE} FROM t""")
def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.all_summaries(A.outcomes(spark, sf_dir))


@query(f"""{_FUNCTION}, p AS (SELECT file, function, priority_score, row_number() OVER (ORDER BY priority_score DESC, string_split(file, '/'), function) AS position, count(*) OVER () AS n FROM summary),
h AS (SELECT *, least(greatest(n // 3, 1), n) AS high FROM p) SELECT file, function, priority_score, position, CASE WHEN position <= high THEN 'high' WHEN position <= least(greatest(2 * n // 3, high + 1), n) THEN 'medium' ELSE 'low' END AS priority_group FROM h""")
def priority_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.priority_groups(_summary(spark, sf_dir)).select("file", "function", "priority_score", "position", "priority_group")


@query(f"{_FUNCTION} SELECT file, function, priority_score FROM summary WHERE survived > 0 OR timeout > 0 OR error > 0 ORDER BY priority_score DESC, string_split(file, '/'), function LIMIT 10")
def weak_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.weak_functions(_summary(spark, sf_dir)).select("file", "function", "priority_score")


@query(f"WITH {A.OUTCOMES_SQL} SELECT file, count(*) AS survivors FROM outcomes WHERE status = 'survived' GROUP BY file ORDER BY survivors DESC, file LIMIT 5")
def files_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.affected_files(A.outcomes(spark, sf_dir))


@query(f"WITH {A.OUTCOMES_SQL} SELECT CASE WHEN bool_or(status IN ('timeout', 'error')) THEN 3 WHEN bool_or(status = 'survived') THEN 1 ELSE 0 END AS exit_code FROM outcomes")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.exit_code(A.outcomes(spark, sf_dir))


@query(f"""WITH {A.OUTCOMES_SQL}, t AS (SELECT *, CAST(function % 17 AS DOUBLE) AS priority, description AS mutation FROM outcomes)
SELECT file, line, "column", operator, mutation, seq, priority, count(*) OVER (PARTITION BY file, line, "column", operator, mutation) AS duplicates FROM t QUALIFY row_number() OVER (PARTITION BY file, line, "column", operator, mutation ORDER BY priority DESC, seq) = 1""")
def site_dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = A.outcomes(spark, sf_dir).withColumn("priority", (F.col("function") % 17).cast("double")).withColumnRenamed("description", "mutation")
    return outcomes.best_of_site(tasks)


_KNOWN = f"WITH {A.OUTCOMES_SQL}, {A.ENTRIES_SQL}, {_ENTRY}, known AS (SELECT o.id, o.seq, cyclomatic, coverage, crap FROM outcomes o LEFT JOIN one USING (file, function))"
_POINTS = """CASE WHEN crap IS NULL THEN -80 ELSE CASE WHEN crap >= 15 AND crap <= 40 THEN 100 ELSE 0 END + CASE WHEN cyclomatic BETWEEN 5 AND 15 THEN 50 ELSE 0 END
  + CASE WHEN coverage BETWEEN 60 AND 90 THEN 50 ELSE 0 END - CASE WHEN coverage <= 0 THEN 80 ELSE 0 END - CASE WHEN crap > 80 THEN 50 ELSE 0 END END"""


def _plan(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    candidates = A.outcomes(spark, sf_dir).withColumn("discovery_seq", F.col("seq"))
    return selection.plan(candidates, A.entries(spark, sf_dir), **options)


@query(f"{_KNOWN} SELECT id, 0 AS selection_score, row_number() OVER (ORDER BY seq) - 1 AS plan_index FROM known")
def strategy_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("id", "selection_score", "plan_index")


@query(f"{_KNOWN}, s AS (SELECT id, CAST({_POINTS} AS INT) AS selection_score FROM known) SELECT id, selection_score, row_number() OVER (ORDER BY selection_score DESC, id) - 1 AS plan_index FROM s")
def strategy_actionable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, strategy="actionable").select("id", "selection_score", "plan_index")


@query(f"{_KNOWN} SELECT id, CASE WHEN crap IS NULL THEN -2147483648 ELSE CAST(round(crap) AS INT) END AS selection_score, row_number() OVER (ORDER BY coalesce(crap, -1) DESC, id) - 1 AS plan_index FROM known")
def strategy_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, strategy="highest-crap").select("id", "selection_score", "plan_index")


@query(f"{_KNOWN}, s AS (SELECT id, CAST({_POINTS} AS INT) AS selection_score FROM known) SELECT id, row_number() OVER (ORDER BY selection_score DESC, id) - 1 AS plan_index FROM s QUALIFY plan_index < 100")
def plan_index_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, strategy="actionable", limit=100).select("id", "plan_index")


@query(f"""{_KNOWN}, r AS (SELECT id, CASE WHEN crap IS NULL THEN 'function has no entry' ELSE concat_ws('; ', CASE WHEN crap BETWEEN 15 AND 40 THEN 'crap ' || printf('%.1f', crap) || ' lies in [15,40]' END, CASE WHEN cyclomatic BETWEEN 5 AND 15 THEN 'complexity ' || cyclomatic || ' lies in [5,15]' END,
  CASE WHEN coverage BETWEEN 60 AND 90 THEN 'coverage ' || printf('%.1f', coverage) || '% lies in [60,90]' END, CASE WHEN coverage <= 0 THEN 'function isn''t covered' END, CASE WHEN crap > 80 THEN 'crap ' || printf('%.1f', crap) || ' exceeds 80' END) END AS x FROM known) SELECT id, CASE WHEN x = '' THEN 'no scoring rules matched' ELSE x END AS reasons FROM r""")
def explain_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = selection.with_entries(A.outcomes(spark, sf_dir), A.entries(spark, sf_dir))
    return known.select("id", F.array_join(selection.reasons("actionable"), "; ").alias("reasons"))


@query(f"WITH {A.ENTRIES_SQL}, {_ENTRY} SELECT file, function, crap, scan_seq FROM one")
def duplicate_key_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.one_entry(A.entries(spark, sf_dir)).select("file", "function", "crap", "scan_seq")


@query(None)
def seeded_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.edits(spark, sf_dir).withColumn("end_byte", F.col("start_byte") + F.octet_length("original"))
    return selection.seeded(rows, "seed", "commit").select("discovery_seq", "stable_id", "ranking_key")


_P = "list_min(list_concat(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[i] <> {b}[i]), [least(length({a}), length({b})) + 1])) - 1"
_EDIT = f"""WITH {A.EDITS_SQL}, p AS (SELECT *, {_P.format(a="original", b="replacement")} AS p FROM edits), ab AS (SELECT *, substr(original, p + 1) AS a, substr(replacement, p + 1) AS b FROM p),
s AS (SELECT *, {_P.format(a="reverse(a)", b="reverse(b)")} AS s FROM ab), e AS (SELECT *, start_byte + strlen(left(original, p)) AS edit_start, start_byte + strlen(left(original, length(original) - s)) AS edit_end, left(b, length(b) - s) AS edit_text FROM s)"""


@query(f"{_EDIT} SELECT discovery_seq, edit_start, edit_end, edit_text FROM e")
def canonical_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.canonical_edit(A.edits(spark, sf_dir)).select("discovery_seq", "edit_start", "edit_end", "edit_text")


@query(f"{_EDIT} SELECT file, operator, discovery_seq, edit_start, edit_end, edit_text FROM e QUALIFY row_number() OVER (PARTITION BY file, edit_start, edit_end, edit_text ORDER BY operator = 'swap_boolean', discovery_seq) = 1")
def dedupe_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.dedupe_overlapping(A.edits(spark, sf_dir)).select("file", "operator", "discovery_seq", "edit_start", "edit_end", "edit_text")


@query(f"WITH {A.EDITS_SQL}, t AS (SELECT discovery_seq, 'xx' || original || 'é' AS text, 2 AS a, 2 + strlen(original) AS b, replacement FROM edits) SELECT discovery_seq, 'xx' || replacement || 'é' AS mutated_text FROM t")
def splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.edits(spark, sf_dir).withColumn("text", F.concat(F.lit("xx"), "original", F.lit("é"))).withColumn("start_byte", F.lit(2)).withColumn("end_byte", 2 + F.octet_length("original"))
    return edits.splice(rows).select("discovery_seq", "mutated_text")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def changed_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = A.load(spark, sf_dir, "orders").where("o_orderdate >= timestamp'1998-01-01'").select(F.col("o_orderkey").alias("l_orderkey"))
    return A.load(spark, sf_dir, "lineitem").join(changed, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '/en/[^/]*[.]html$') AND NOT contains(url || '/', '/blog/')")
def exclude_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.load(spark, sf_dir, "pages").where(~excluded(F.col("url"), ["**/en/*.html", "blog"])).select("page_id", "url")


@query("""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages), n AS (SELECT page_id, p, regexp_replace(split_part(p, '/', -1), '(.)[.][^.]*$', '\\1') AS stem FROM t)
SELECT page_id, list_has_any(string_split(p, '/'), ['tests', '__tests__', 'spec', 'specs']) OR regexp_matches(stem, '^tests$|(_test|_tests|_spec|_specs|[.]test|[.]spec)$|^(test_|spec_)') OR split_part(p, '/', -1) = 'conftest.py' AS is_test FROM n""")
def skip_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return A.load(spark, sf_dir, "pages").select("page_id", edits.is_test_file(path).alias("is_test"))


@query("SELECT p_partkey, path, row_number() OVER (ORDER BY string_split(path, '/'), p_partkey) AS position FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '/' || p_size ELSE p_brand || '-' || p_size END AS path FROM part)")
def path_component_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("p_partkey") % 2 == 0, "/").otherwise("-")
    rows = A.load(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", sign, "p_size").alias("path"))
    return outcomes.ranked(rows, [scoring.path_parts("path"), F.col("p_partkey")])


_ESCAPED = "replace(replace(replace({x}, '%', '%25'), ':', '%3A'), ',', '%2C')"


@query(f"""WITH {A.OUTCOMES_SQL} SELECT id, '::warning file=' || {_ESCAPED.format(x="file")} || ',line=' || line || ',col=' || ("column" + 1) || ',title=Survived mutant::' || {_ESCAPED.format(x="operator || ' ' || original || ' -> ' || replacement || ' survived in ' || function")} AS annotation FROM outcomes WHERE status = 'survived'""")
def annotation_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annotations(A.outcomes(spark, sf_dir))


@query(f"WITH {A.OUTCOMES_SQL} SELECT operator AS rule_id, arg_min(description, seq) AS help, count(*) AS results FROM outcomes WHERE status = 'survived' GROUP BY operator")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rules(A.outcomes(spark, sf_dir))


@query(f"""{_FUNCTION}, s AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM outcomes WHERE status = 'survived')
SELECT id, file, function, crap, priority_score, CASE WHEN n < 1000 THEN printf('test-task-%03d', n) ELSE 'test-task-' || n END AS task_id FROM s LEFT JOIN summary USING (file, function)""")
def agent_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.agent_tasks(A.outcomes(spark, sf_dir), _summary(spark, sf_dir)).select("id", "file", "function", "crap", "priority_score", "task_id")


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.outcomes(spark, sf_dir).select("id", "status", F.col("description").alias("diff"), F.col("original").alias("stdout"), F.col("replacement").alias("stderr"))


@query(f"WITH {A.OUTCOMES_SQL} SELECT id, status, description AS diff, '' AS stdout, '' AS stderr FROM outcomes")
def detail_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.trim(_printed(spark, sf_dir))


@query(f"WITH {A.OUTCOMES_SQL} SELECT id, status, '' AS diff, '' AS stdout, '' AS stderr FROM outcomes WHERE status = 'survived'")
def detail_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.trim(_printed(spark, sf_dir), "compact")


@query(f"WITH {A.OUTCOMES_SQL} SELECT id, status, description AS diff, original AS stdout, replacement AS stderr FROM outcomes")
def detail_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.trim(_printed(spark, sf_dir), "full")


@query("""WITH n AS (SELECT doc_id, string_split(text, chr(10)) AS l, CAST(doc_id % 5 + 1 AS INT) AS line FROM documents WHERE length(text) > 0)
SELECT doc_id, greatest(line - 2, 1) AS start_line, CAST(least(line + 2, len(l)) AS INT) AS end_line, array_to_string(list_transform(range(greatest(line - 2, 1), least(line + 2, len(l)) + 1), lambda i: CASE WHEN i = line THEN '> ' ELSE '  ' END || lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || l[i] || chr(10)), '') AS snippet FROM n""")
def survivors_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.load(spark, sf_dir, "documents").select("doc_id", reports.context(F.col("text"), (F.col("doc_id") % 5 + 1).cast("int"), 2).alias("context")).where("context is not null").select("doc_id", "context.*")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


_CATALOG = f"operators(name, category, enabled, langs) AS (VALUES {_values([(n, c, int(on), x) for n, c, on, x in catalog.OPERATORS])})"


def _outcomes_of(spark: SparkSession, sf_dir: str, operators: DataFrame) -> DataFrame:
    return A.outcomes(spark, sf_dir).join(F.broadcast(operators.select("operator").distinct()), "operator").groupBy("operator").agg(F.count("*").alias("n"))  # a fixed table


@query(f"WITH {A.OUTCOMES_SQL}, {_CATALOG} SELECT operator, count(*) AS n FROM outcomes JOIN operators ON name = operator WHERE enabled = 1 AND name <> 'swap_boolean' GROUP BY operator")
def operator_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the operators that are on by default, one of them excluded."""
    return _outcomes_of(spark, sf_dir, catalog.enabled_operators(spark, exclude=["swap_boolean"]))


@query(f"WITH {A.OUTCOMES_SQL}, {_CATALOG} SELECT operator, count(*) AS n FROM outcomes JOIN operators ON name = operator WHERE category IN ('nullability', 'logical', 'equality') GROUP BY operator")
def category_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the operators of three categories, on by default or not."""
    return _outcomes_of(spark, sf_dir, catalog.enabled_operators(spark, categories=["nullability", "logical", "equality"]))


@query(f"WITH {A.OUTCOMES_SQL}, {_CATALOG} SELECT operator, count(*) AS n, any_value(len(string_split(langs, ' '))) AS languages FROM outcomes JOIN operators ON name = operator GROUP BY operator")
def operator_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each operator, and the number of its languages."""
    languages = catalog.implementation_catalog(spark).groupBy("operator").agg(F.count_distinct("language").alias("languages"))
    return _outcomes_of(spark, sf_dir, languages).join(F.broadcast(languages), "operator")  # a fixed table


@query(f"WITH {A.OUTCOMES_SQL} SELECT status, count(*) AS n FROM outcomes GROUP BY status")
def stream_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes written as event lines, read back as a stream to its end."""
    import uuid

    from mutalake.streaming.events import count_available

    folder, name = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}", f"counts_{uuid.uuid4().hex}"
    rows = A.outcomes(spark, sf_dir).select(F.lit("mutant_finished").alias("event"), F.lit("r1").alias("run_id"), "id", "status")
    rows.write.json(f"{folder}/in")
    count_available(spark, f"{folder}/in", name, f"{folder}/state").awaitTermination()
    discard(spark, folder)
    return spark.table(name)
