"""Report sinks: annotations, SARIF, agent tasks, JSON, markdown and text, and the run ledger.

What grows with the run stays a DataFrame: documents are rows (place, text) that a text sink writes in
order. Only totals, operators and the ten weakest functions come to the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mutalake.operators.outcomes import affected_files, best_of_site, function_summary, operator_order, operator_summary, ranked, run_totals, weak_functions
from mutalake.operators.rank import with_place
from mutalake.operators.scoring import path_parts
from mutalake.plans.documents import write_document

#: Versions of the report formats.
REPORT_VERSION, SARIF_VERSION = 1, "2.1.0"


def escaped(c: Column) -> Column:
    """For workflow annotations; the percent sign goes first."""
    for sign, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def survivors(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'survived'")


def mutation() -> Column:
    return F.concat("original", F.lit(" -> "), "replacement")


#: What a test should look at, by operator, in our own words.
HINTS = {
    "comparison_boundary": "Use the bound itself and its neighbours as inputs.", "comparison_negation": "Take one input on each side of the comparison.", "negate_equality": "Take one case where both sides are equal and one where they differ.", "swap_logical": "Let each operand decide alone, with the other one fixed.",
    "swap_boolean": "Assert what follows from the flag in both states.", "remove_not": "Assert the path that the negation chooses.", "integer_zero_one": "Assert the exact result that this number leads to, with none and with one.", "range_inclusive_exclusive": "Assert what happens to the last element of the range.",
    "swap_predicate_method": "Take a value for which the two methods answer differently.", "negate_predicate_method": "Take one value that has the property and one that hasn't.", "return_boolean": "Assert the returned flag itself.", "is_none_negation": "Call it with None and with a value.",
    "in_negation": "Use a member and a stranger.", "truthiness_negation": "Take both branches of the condition.", "len_zero_boundary": "Use an empty collection and one with elements.", "dict_get_default_removal": "Look up a key that is missing and assert the default.",
    "comprehension_filter_removal": "Include an element that the filter drops.", "none_return": "Assert the returned value, not only that the call ends.", "empty_collection_literal": "Assert the elements of the collection.", "iterator_any_all": "Use elements of which some but not all fulfil the condition.",
    "match_bool_pattern": "Match with both true and false.", "ok_err_boolean": "Assert the flag inside the result.", "some_boolean": "Assert the flag inside the option.", "option_some_none": "Assert that there is a value, and which.",
    "remove_try": "Let the inner call fail and assert the error.", "unwrap_to_unwrap_or_default": "Reach the missing value and assert that it isn't hidden.", "min_max_swap": "Use two different numbers and assert which one comes back.", "match_wildcard_to_panic": "Reach the arm that takes all other values.",
    "empty_vec_macro": "Assert the elements of the vector.", "saturating_checked_swap": "Go beyond the number's range and assert what happens.", "expect_to_unwrap_or_default": "Reach the missing value and assert the failure.", "string_boundary_method_swap": "Use a text that begins but doesn't end with the part.",
    "includes_negation": "Use one text or list with the part and one without.", "sorted_reverse_flip": "Assert the order of at least two elements.", "dict_get_to_index": "Look up a key that is missing.", "nullish_coalescing_removal": "Pass a missing value and assert the fallback.",
    "optional_chaining_removal": "Pass a missing object.", "ternary_arm_swap": "Assert the value of each arm.", "array_empty_literal": "Assert the array's elements.", "object_empty_literal": "Assert the object's members.",
    "string_empty_literal": "Assert the text itself.", "await_removal": "Assert the awaited value rather than a promise.", "swap_arithmetic": "Use operands for which the two operations differ.", "swap_assignment": "Assert the variable's value afterwards.",
    "remove_unary_minus": "Assert the sign of the result.", "plus_to_minus": "Assert the sign of the result.", "null_forgiving_removal": "Pass null and assert what happens.", "nullable_access_to_member_access": "Pass a null object.",
    "is_pattern_negation": "Use one value that fits the pattern and one that doesn't.", "as_expression_to_direct_cast": "Pass an object of another type.", "checked_unchecked_swap": "Let the arithmetic overflow.", "throw_expression_to_null": "Reach the throw and assert the exception.",
    "default_literal_to_null": "Assert the default value.", "ternary_condition_negation": "Assert which arm is taken for both outcomes of the condition.",
}


def with_suggestion(rows: DataFrame) -> DataFrame:
    """rows(operator, function, original, replacement, file, line, column) with focus, operator_hint and prompt; columns are shown from one."""
    hints = F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair))
    hint = F.coalesce(F.try_element_at(hints, F.col("operator")), F.lit("Assert the behaviour that this edit changes."))
    name = F.coalesce(F.col("function").cast("string"), F.lit("the code"))
    place = [F.lit(" ("), F.col("file"), F.lit(", line "), F.col("line").cast("string"), F.lit(", column "), (F.col("column") + 1).cast("string"), F.lit(")")] if {"file", "line", "column"} <= set(rows.columns) else []
    prompt = F.concat(F.lit("Add a test of "), name, *place, F.lit(" that fails when "), F.col("original"), F.lit(" becomes "), F.when(F.col("replacement") == "", "nothing").otherwise(F.col("replacement")), F.lit(". "), hint)
    return rows.withColumns({"focus": F.concat(F.lit("Function "), name), "operator_hint": hint, "prompt": prompt})


def annotations(outcomes: DataFrame) -> DataFrame:
    """(id, annotation) of each survivor, with 1-based columns; with a prompt, if there is one, behind the message."""
    body = F.concat(F.col("operator"), F.lit(" "), mutation(), F.lit(" survived in "), F.col("function").cast("string"))
    if "prompt" in outcomes.columns:
        body = F.concat(body, F.coalesce(F.concat(F.lit(". "), "prompt"), F.lit("")))
    text = F.concat(F.lit("::warning file="), escaped(F.col("file")), F.lit(",line="), F.col("line"), F.lit(",col="), F.col("column") + 1, F.lit(",title="), escaped(F.lit("Survived mutant")), F.lit("::"), escaped(body))
    return survivors(outcomes).select("id", text.alias("annotation"))


def sarif_rules(outcomes: DataFrame) -> DataFrame:
    """(rule_id, help, results) for each operator with survivors; the help of the first found."""
    return survivors(outcomes).groupBy(F.col("operator").alias("rule_id")).agg(F.min_by("description", "seq").alias("help"), F.count("*").alias("results"))


def sarif_results(outcomes: DataFrame) -> DataFrame:
    """(id, seq, result) with each survivor's SARIF result object as JSON."""
    region = F.struct(F.col("line").alias("startLine"), (F.col("column") + 1).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("operator").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"))
    return survivors(outcomes).select("id", "seq", F.to_json(result).alias("result"))


def lines_in_order(rows: DataFrame) -> DataFrame:
    """rows(part, place, text) as text in order of part and place."""
    return rows.orderBy("part", "place").select("text")


def sarif_document(outcomes: DataFrame) -> DataFrame:
    """(part, place, text): the lines of a whole SARIF document, one a rule and one a result."""
    spark = outcomes.sparkSession
    said = lambda text: F.struct(text.alias("text"))
    hints = F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair))
    hint = F.coalesce(F.try_element_at(hints, F.col("rule_id")), F.col("help"))
    rule = F.to_json(F.struct(
        F.col("rule_id").alias("id"), F.concat(F.lit("Survived mutant: "), "rule_id").alias("name"), said(F.col("help")).alias("shortDescription"), said(F.concat(F.col("help"), F.lit(" No test failed when this was changed."))).alias("fullDescription"),
        said(hint).alias("help"), F.struct(F.lit("warning").alias("level")).alias("defaultConfiguration")))
    rules = with_place(sarif_rules(outcomes), [F.asc("rule_id")], "place").select(F.lit(1).alias("part"), F.col("place"), F.concat(F.when(F.col("place") > 1, ","), rule).alias("text"), rule.alias("first"))
    results = with_place(sarif_results(outcomes), [F.asc("seq")], "place").select(F.lit(3).alias("part"), F.col("place"), F.concat(F.when(F.col("place") > 1, ","), "result").alias("text"), F.col("result").alias("first"))
    body = rules.union(results).select("part", "place", F.coalesce("text", "first").alias("text"))
    head = f'{{"version":"{SARIF_VERSION}","$schema":"https://json.schemastore.org/sarif-{SARIF_VERSION}.json","runs":[{{"tool":{{"driver":{{"name":"mutalake","informationUri":"urn:mutalake","rules":['
    frame = spark.createDataFrame([(0, 0, head), (2, 0, ']}},"results":['), (4, 0, "]}]}")], "part int, place long, text string")
    return frame.union(body)


def agent_tasks(outcomes: DataFrame, functions: DataFrame) -> DataFrame:
    """One task a survivor, test-task-001 and so on in outcome order: where, what, a suggestion and its function's summary."""
    numbered = with_place(with_suggestion(survivors(outcomes)), [F.col("seq")], "task")
    summary = functions.select("file", "function", "cyclomatic", "coverage", "crap", "mutation_score", "priority_score")
    joined = numbered.withColumn("mutation", mutation()).withColumn("column", F.col("column") + 1).join(summary, ["file", "function"], "left")
    context = ["source_context"] if "source_context" in outcomes.columns else []
    return joined.select(
        F.format_string("test-task-%03d", "task").alias("task_id"), "id", "file", "function", "line", "column", "operator", "mutation", "focus", "operator_hint", "prompt",
        "cyclomatic", "coverage", "crap", "mutation_score", F.coalesce("priority_score", F.lit(0.0)).alias("priority_score"), "seq", *context)


def context(text: Column, line: Column, radius: int) -> Column:
    """(start_line, end_line, snippet): lines around a 1-based line, numbered, the line itself marked; null for radius 0 or no line."""
    kind = "struct<start_line: int, end_line: int, snippet: string>"
    if not radius:
        return F.lit(None).cast(kind)
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    line = F.greatest(line, F.lit(1))
    first, last = F.greatest(line - radius, F.lit(1)), F.least(line + radius, F.size(lines))
    part = F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))
    shown = F.transform(part, lambda x, i: F.concat(F.when(first + i == line, "> ").otherwise("  "), F.lpad((first + i).cast("string"), 4, " "), F.lit(" | "), x, F.lit("\n")))
    return F.when(F.length(text) > 0, F.struct(first.cast("int").alias("start_line"), last.cast("int").alias("end_line"), F.array_join(shown, "").alias("snippet"))).cast(kind)


def _shown(value: float | None, unit: str = "") -> str:
    return "n/a" if value is None else f"{value:.1f}{unit}"


def human_text(totals: Row, operators: list[Row], weak: list[Row]) -> str:
    """The text report from run totals, the operators in order and the weakest functions, each with a list survivors."""
    out = [f"Score {_shown(totals.mutation_score, '%')}: {totals.killed} killed, {totals.survived} survived, {totals.timeout} timed out, {totals.error} failed", ""]
    if operators:
        out.append("By operator:")
        out += [f"  {r.operator:<28} {r.total:>5} mutants {r.killed:>5} killed {r.survived:>5} survived  {_shown(r.mutation_score, '%')}" for r in operators]
        out.append("")
    if not weak:
        return "\n".join([*out, "No weakly tested functions.", ""])
    out += ["Functions to test first:", ""]
    for i, f in enumerate(weak, 1):
        out += [f"{i}. {f.file}::{f.function}", f"   crap {_shown(f.crap)}, complexity {'n/a' if f.cyclomatic is None else f.cyclomatic}, coverage {_shown(f.coverage, '%')}, score {_shown(f.mutation_score, '%')}, priority {f.priority_score:.1f}"]
        out += [f"   - {s.operator} at {s.line}:{s.column + 1}: {s.mutation}" for s in f.survivors]
        out.append("")
    return "\n".join(out)


def text_report(outcomes: DataFrame, scores: DataFrame, top: int = 10) -> str:
    """human_text of a run; a top-k report, so only so many functions and their survivors come to the driver."""
    functions = function_summary(outcomes, scores)
    found = survivors(outcomes).groupBy("file", "function").agg(F.sort_array(F.collect_list(F.struct("seq", "operator", "line", "column", mutation().alias("mutation")))).alias("survivors"))
    weak = weak_functions(functions, top).join(found, ["file", "function"], "left").orderBy(F.desc("priority_score"), path_parts("file"), "function").withColumn("survivors", F.coalesce("survivors", F.array()))
    return human_text(run_totals(outcomes).first(), operator_order(operator_summary(outcomes)).orderBy("position").collect(), weak.collect())


def tasks_markdown(tasks: DataFrame) -> DataFrame:
    """(part, place, text): the markdown report of tasks, duplicates of a site once, thirds by priority, context for the first third."""
    spark = tasks.sparkSession
    distinct = best_of_site(tasks.withColumn("priority", F.col("priority_score")))
    rest = [c for c in tasks.columns if c not in ("file", "line", "column", "operator", "mutation", "priority")]
    rows = distinct.select("file", "line", "column", "operator", "mutation", "seq", "duplicates").join(tasks.select(*rest), "seq")
    n = distinct.count()
    placed = ranked(rows, [F.desc("priority_score"), F.asc("seq")])
    high = max(1, n // 3) if n else 0
    medium = max(min(2 * n // 3, n), min(high + 1, n))
    group = F.when(F.col("position") <= high, "High").when(F.col("position") <= medium, "Medium").otherwise("Low")
    number = lambda c, unit="": F.coalesce(F.concat(F.expr(f"format_number({c}, '0.0')"), F.lit(unit)), F.lit("n/a"))
    body = F.concat(
        F.lit("### "), "task_id", F.lit(": "), "file", F.lit(":"), "line", F.lit(" "), F.col("function").cast("string"), F.lit("\n\n- edit: `"), "mutation", F.lit("` ("), "operator", F.lit(")"), F.when(F.col("duplicates") > 1, F.concat(F.lit(", found "), "duplicates", F.lit(" times"))).otherwise(""),
        F.lit("\n- priority "), number("priority_score"), F.lit(", crap "), number("crap"), F.lit(", coverage "), number("coverage", "%"), F.lit("\n- "), "prompt", F.lit("\n"))
    if "source_context" in tasks.columns:
        body = F.concat(body, F.when((group == "High") & F.col("source_context").isNotNull(), F.concat(F.lit("\n```\n"), "source_context.snippet", F.lit("```\n"))).otherwise(""))
    heading = F.when(F.col("position").isin(1, high + 1, medium + 1), F.concat(F.lit("## "), group, F.lit(" priority\n\n"))).otherwise("")
    parts = placed.select(F.lit(2).alias("part"), F.col("position").alias("place"), F.concat(heading, body).alias("text"))
    files = affected_files(tasks.withColumn("status", F.lit("survived"))).collect()
    targets = placed.groupBy("file", "function").agg(F.min("position").alias("position")).orderBy("position").limit(10).collect()
    counts = distinct.agg(F.count("*").alias("n"), F.count_distinct("file", "line").alias("places"), F.sum("duplicates").alias("all")).first()
    head = ["# Survived mutants", "", f"{counts.all or 0} survivors, {counts.n} distinct, at {counts.places} places.", "", *(f"- {r.file}: {r.survivors}" for r in files), "", "Test first:", "", *(f"{i}. {r.file}::{r.function}" for i, r in enumerate(targets, 1)), ""]
    return spark.createDataFrame([(0, 0, "\n".join(head))], "part int, place long, text string").union(parts)


def json_report(outcomes: DataFrame, scores: DataFrame) -> DataFrame:
    """(part, place, text): the lines of one JSON object with totals, operators, functions and outcomes, one row a line."""
    spark = outcomes.sparkSession

    def rows(part: int, df: DataFrame, order: list[Column]) -> DataFrame:
        placed = with_place(df, order, "place_")
        text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        return placed.select(F.lit(part).alias("part"), F.col("place_").alias("place"), F.concat(F.when(F.col("place_") > 1, ",").otherwise(""), text).alias("text"))

    functions = function_summary(outcomes, scores)
    ordered = operator_order(operator_summary(outcomes)).drop("position")
    shown = with_suggestion(outcomes)  # survivors alone keep what a test should look at
    outcomes = shown.select(*outcomes.columns, F.when(F.col("status") == "survived", F.struct("focus", "operator_hint", "prompt")).alias("suggestion"))
    out = rows(1, run_totals(outcomes), [F.asc("total")]).union(rows(3, ordered, [F.desc("total"), F.asc("operator")]))
    out = out.union(rows(5, functions, [F.desc("priority_score"), path_parts("file"), F.asc("function")])).union(rows(7, outcomes, [F.asc("seq")]))
    frame = [(0, f'{{"version":{REPORT_VERSION},"totals":'), (2, ',"operators":['), (4, '],"functions":['), (6, '],"outcomes":['), (8, "]}")]
    return spark.createDataFrame([(part, 0, text) for part, text in frame], "part int, place long, text string").union(out)


def operators_text(operators: DataFrame, implementations: DataFrame) -> str:
    """A line an operator, with its category, whether it is on, and its languages; a fixed table."""
    langs = implementations.groupBy("operator").agg(F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"))
    return "\n".join(f"{r.operator:<34} {r.category:<20} {'on' if r.default_enabled else 'off':<4} {r.languages}" for r in operators.join(langs, "operator").orderBy("ordinal").collect())


def languages_text(languages: DataFrame) -> str:
    """A line a language, with its support and extensions; a fixed table."""
    return "\n".join(f"{r.language:<12} {r.support:<20} {', '.join(r.extensions)}" for r in languages.orderBy("ordinal").collect())


def plan_document(planned: DataFrame, skipped: DataFrame, commit: str | None = None) -> DataFrame:
    """(part, place, text): the lines of one JSON object with a plan's candidates in their order and the skipped ones with their rules."""
    spark = planned.sparkSession

    def rows(part: int, df: DataFrame, name: str) -> DataFrame:
        text = F.to_json(F.struct(*(c for c in df.columns if c != "place_")), {"ignoreNullFields": "false"})
        return df.select(F.lit(part).alias("part"), F.col(name).cast("long").alias("place"), F.concat(F.when(F.col(name) > 0, ",").otherwise(""), text).alias("text"))

    left_out = with_place(skipped, [path_parts("file"), F.asc("line"), F.asc("column"), F.asc("implementation")], "place_").withColumn("place_", F.col("place_") - 1)
    frame = [(0, f'{{"version":{REPORT_VERSION},"commit":{json.dumps(commit)},"candidates":['), (2, '],"skipped":['), (4, "]}")]
    return spark.createDataFrame([(part, 0, text) for part, text in frame], "part int, place long, text string").union(rows(1, planned, "plan_index")).union(rows(3, left_out, "place_"))


def scan_document(functions: DataFrame) -> DataFrame:
    """(part, place, text): a JSON array of the functions of a scan, in the order of paths and lines."""
    return _array(functions, [path_parts("file"), F.asc("start_line"), F.asc("function")])


def crap_document(scores: DataFrame) -> DataFrame:
    """(part, place, text): a JSON array of scored functions, the riskiest first."""
    return _array(scores, [F.desc("crap"), path_parts("file"), F.asc("function")])


def candidates_document(candidates: DataFrame) -> DataFrame:
    """(part, place, text): a JSON array of candidates in the order of paths, lines, columns and implementations."""
    return _array(candidates, [path_parts("file"), F.asc("line"), F.asc("column"), F.asc("implementation")])


def _array(df: DataFrame, order: list[Column]) -> DataFrame:
    placed = with_place(df, order, "place_")
    text = F.concat(F.when(F.col("place_") > 1, ",").otherwise(""), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return df.sparkSession.createDataFrame([(0, 0, "["), (2, 0, "]")], "part int, place long, text string").union(placed.select(F.lit(1), "place_", text))


def write_ledger(folder: str, run: str, metadata: dict, plan: DataFrame, events: DataFrame, report: DataFrame) -> str:
    """A run's documents below folder/run: metadata.json, plan.json, events.jsonl and report.json; the path of the run.

    plan and report: documents as (part, place, text); events: (place, event). FileExistsError if the run has a ledger.
    """
    spark = plan.sparkSession
    at = f"{folder.rstrip('/')}/{run}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileExistsError(at)
    write_document(spark.createDataFrame([(0, 0, json.dumps({"run_id": run, **metadata}))], "part int, place long, text string"), f"{at}/metadata.json")
    write_document(plan, f"{at}/plan.json")
    write_document(events, f"{at}/events.jsonl", ["place"], "event")
    write_document(report, f"{at}/report.json")
    return at
