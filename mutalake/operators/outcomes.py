"""Outcome classification, summaries, scores and rankings of mutation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutalake.functions.catalog import operator_catalog
from mutalake.operators.scoring import path_parts

STATUSES = ("killed", "survived", "timeout", "error")


def classify(timed_out: Column, exit_code: Column, failed: Column) -> Column:
    """error for trouble of the harness, timeout, survived for exit 0, else killed (a signal, without a code, too)."""
    return F.when(failed, "error").when(timed_out, "timeout").when(exit_code == 0, "survived").otherwise("killed")


def status_counts() -> list[Column]:
    return [F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES)]


def mutation_score(killed: Column, survived: Column) -> Column:
    """Percent killed of killed and survived; null if neither occurs."""
    return F.try_divide(killed.cast("double"), killed + survived) * 100.0


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("mutation_score", mutation_score(F.col("killed"), F.col("survived")))


def run_totals(outcomes: DataFrame) -> DataFrame:
    return _scored(outcomes.agg(*status_counts()))


def operator_summary(outcomes: DataFrame) -> DataFrame:
    return _scored(outcomes.groupBy("operator").agg(*status_counts()))


def operator_order(summary: DataFrame) -> DataFrame:
    """summary with position: most mutants first, then as the catalog lists them; unknown operators last, by name."""
    known = operator_catalog(summary.sparkSession).select("operator", "ordinal")
    return ranked(summary.join(F.broadcast(known), "operator", "left"), [F.desc("total"), F.asc_nulls_last("ordinal"), F.asc("operator")]).drop("ordinal")  # a fixed table


def one_entry(scores: DataFrame) -> DataFrame:
    """One score row a (file, function): of duplicates the lowest crap, then the latest scan_seq."""
    order = Window.partitionBy("file", "function").orderBy("crap", F.desc("scan_seq"))
    return scores.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def priority(crap: Column, score: Column, coverage: Column) -> Column:
    """crap + missing score + a quarter of missing coverage; unknown crap and coverage count 0, an unknown score adds nothing."""
    return F.coalesce(crap, F.lit(0.0)) + F.coalesce(100.0 - score, F.lit(0.0)) + (100.0 - F.coalesce(coverage, F.lit(0.0))) * 0.25


def function_summary(outcomes: DataFrame, scores: DataFrame) -> DataFrame:
    """Counts, score and priority by (file, function), with the function's entry if it has one."""
    counted = _scored(outcomes.groupBy("file", "function").agg(*status_counts()))
    entry = one_entry(scores).select("file", "function", "cyclomatic", "coverage", "crap")
    return counted.join(entry, ["file", "function"], "left").withColumn("priority_score", priority(F.col("crap"), F.col("mutation_score"), F.col("coverage")))


def all_summaries(outcomes: DataFrame) -> DataFrame:
    """Run, operator and function totals in one pass over grouping sets; level says which."""
    level = F.when(F.grouping_id() == 7, "run").when(F.grouping_id() == 3, "operator").otherwise("function")
    sets = outcomes.groupingSets([[], ["operator"], ["file", "function"]], "operator", "file", "function")
    return _scored(sets.agg(level.alias("level"), *status_counts()))


def _thirds(r: Column, n: Column) -> Column:
    high = F.least(F.greatest(F.floor(n / 3), F.lit(1)), n)
    medium = F.least(F.greatest(F.floor(n * 2 / 3), high + 1), n)
    return F.when(r <= high, "high").when(r <= medium, "medium").otherwise("low")


def ranked(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with its 1-based place in a total order, without gathering it in one task.

    Rows are range-partitioned and sorted; counts of the partitions, a number each, give every
    partition its first place.
    """
    from mutalake.operators.rank import with_place

    return with_place(df, order, name)


def priority_groups(functions: DataFrame) -> DataFrame:
    """Functions with their place by priority and the third it falls in."""
    order = [F.desc("priority_score"), path_parts("file"), F.asc("function")]
    n = functions.count()
    return ranked(functions, order).withColumn("priority_group", _thirds(F.col("position"), F.lit(n)))


def weak_functions(functions: DataFrame, n: int = 10) -> DataFrame:
    """The n functions of highest priority with a survivor, a timeout or an error: a top-k report."""
    weak = functions.where("survived > 0 or timeout > 0 or error > 0")
    return weak.orderBy(F.desc("priority_score"), path_parts("file"), "function").limit(n)


def affected_files(outcomes: DataFrame, n: int = 5) -> DataFrame:
    """The n files with most survivors: a top-k report."""
    return outcomes.where("status = 'survived'").groupBy("file").agg(F.count("*").alias("survivors")).orderBy(F.desc("survivors"), "file").limit(n)


def exit_code(outcomes: DataFrame, allow_survivors: bool = False, allow_errors: bool = False) -> DataFrame:
    """One row: 3 for timeouts or errors, 1 for survivors, unless allowed; else 0."""
    totals = outcomes.agg(*status_counts())
    trouble = (F.col("timeout") + F.col("error") > 0) & F.lit(not allow_errors)
    alive = (F.col("survived") > 0) & F.lit(not allow_survivors)
    return totals.select(F.when(trouble, 3).when(alive, 1).otherwise(0).alias("exit_code"))


def best_of_site(tasks: DataFrame) -> DataFrame:
    """One task a (file, line, column, operator, mutation): the highest priority, the first of equals, with the number found."""
    site = ["file", "line", "column", "operator", "mutation"]
    kept = tasks.groupBy(*site).agg(F.max_by(F.struct("seq", "priority"), F.struct("priority", -F.col("seq"))).alias("best"), F.count("*").alias("duplicates"))
    return kept.select(*site, "best.seq", "best.priority", "duplicates")


def trim(outcomes: DataFrame, detail: str = "normal", only_survivors: bool | None = None, diff: bool | None = None, stdout: bool | None = None, stderr: bool | None = None, context: bool = True) -> DataFrame:
    """Outcomes for a report. full keeps all, normal drops what probes printed, compact keeps survivors alone and drops diffs too.

    The other arguments override a detail's choice; context has a switch of its own. Totals are taken before.
    """
    if detail not in ("compact", "normal", "full"):
        raise ValueError(detail)
    keep = {"diff": detail != "compact" if diff is None else diff, "stdout": detail == "full" if stdout is None else stdout, "stderr": detail == "full" if stderr is None else stderr}
    kept = outcomes.where("status = 'survived'") if (detail == "compact" if only_survivors is None else only_survivors) else outcomes
    for column in (x for x, stays in keep.items() if not stays and x in kept.columns):
        kept = kept.withColumn(column, F.lit(""))
    return kept if context or "source_context" not in kept.columns else kept.withColumn("source_context", F.lit(None).cast(kept.schema["source_context"].dataType))
