"""The plan of a run as one call: sources, excludes, operators, skips, changed files, coverage, order and limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from mutalake.config import Settings
from mutalake.functions.catalog import OPERATORS, enabled_operators
from mutalake.functions.patterns import Pattern, pattern_catalog
from mutalake.functions.session import settled
from mutalake.operators import discovery, edits, scoring, selection
from mutalake.operators.rank import with_place
from mutalake.plans.parsed import parsed_by_content
from mutalake.plans.probes import pre_run
from mutalake.sources.coverage import read_coverage
from mutalake.sources.files import read_sources, root_excludes
from mutalake.sources.git import changed_files, head_commit, only_changed


@dataclass
class Plan:
    """Candidates in plan order, those that were skipped with their rule, and the functions with their scores."""

    candidates: DataFrame
    skipped: DataFrame
    functions: DataFrame
    sources: DataFrame
    commit: str | None

    def summary(self) -> Row:
        """Counts of the plan in one row."""
        kept, skipped = self.candidates.agg(F.count("*").alias("candidates"), F.count_distinct("file").alias("files")), self.skipped.agg(F.count("*").alias("skipped"))
        return kept.crossJoin(skipped).first()  # one row each

    def skipped_by_rule(self) -> DataFrame:
        return self.skipped.groupBy("skip_rule").agg(F.count("*").alias("n"))

    def scanned_files(self) -> DataFrame:
        return self.functions.select("file").distinct()

    def unreadable(self) -> DataFrame:
        """(file, error) of the files that have no text, so no candidates either."""
        return self.sources.where("error is not null").select("file", "error")

    def candidate(self, id_: str) -> Row:
        """The first candidate with an id; LookupError without one."""
        found = self.candidates.where(F.col("id") == id_).orderBy("plan_index").limit(1).collect()
        if not found:
            raise LookupError(f"no candidate {id_}")
        return found[0]


def chosen_operators(spark: SparkSession, settings: Settings) -> DataFrame:
    """Operators by the settings: named ones and categories, else the defaults, minus the excluded."""
    excluded = [*(settings["mutation.exclude_operators"] or [])]
    excluded += [name for name, category, *_ in OPERATORS if category in (settings["mutation.exclude_categories"] or [])]
    return enabled_operators(spark, settings["mutation.operators"], sorted(set(excluded)), settings["mutation.categories"] or [])


def plan_sources(sources: DataFrame, settings: Settings, coverage: DataFrame | None = None, changed: DataFrame | None = None, commit: str | None = None, catalog: dict[str, list[Pattern]] | None = None, overrides: dict[str, bool] | None = None, store: str | None = None) -> Plan:
    """The plan over sources (file, language, text).

    Excludes are the sources' business. Skipped candidates and those kept are both limited to changed
    files; order and limit apply to those kept. Each text is parsed once; with a store, only if no plan
    before has left it there.
    """
    spark = sources.sparkSession
    operators = chosen_operators(spark, settings)
    catalog = pattern_catalog() if catalog is None else catalog
    parsed = settled(discovery.parse_sources(sources, catalog) if store is None else parsed_by_content(sources, catalog, store))
    found = discovery.candidates_of(parsed, operators, overrides)
    if changed is not None:
        found = only_changed(found, changed)
    ruled = edits.skip_rules(found, sources, edits.macro_table(sources.where("language = 'rust'"))) if settings["mutation.static_skips"] else found.withColumn("skip_rule", F.lit(None).cast("string"))
    functions = scoring.score_functions(discovery.functions_of(parsed), *([coverage] if coverage is not None else []))
    kept = with_place(ruled.where("skip_rule is null").drop("skip_rule", "discovery_seq"), selection.discovery_order(), "discovery_seq")
    planned = selection.plan(kept, functions, settings["mutation.strategy"] or "discovery", settings["mutation.limit"], settings["mutation.seed"], commit or "")
    return Plan(planned, ruled.where("skip_rule is not null"), functions, sources, commit)


def build_plan(spark: SparkSession, root: str, settings: Settings, ignore: list[str] = (), **options) -> Plan:
    """The plan of a folder: its sources without excluded paths, coverage reports and git's changes as the settings say.

    Excluded are the defaults, the lines of the root's ignore file, ignore and the settings' globs.
    """
    sources = read_sources(spark, root, [*root_excludes(root), *ignore, *(settings["scope.exclude"] or [])])
    specs = [*(settings["mutation.coverage"] or []), *([f"lcov:{settings['mutation.lcov']}"] if settings["mutation.lcov"] else [])]
    coverage = read_coverage(spark, *specs) if specs else None
    if coverage is not None:  # scores meet coverage by the file names of the sources
        pairs = scoring.match_files(sources, coverage)
        coverage = coverage.withColumnRenamed("file", "coverage_file").join(pairs, "coverage_file").select("file", "line", "hits")
    base = settings["scope.changed_only"]
    changed = changed_files(spark, root, base) if base else None
    return plan_sources(sources, settings, coverage, changed, head_commit(root), **options)


def prepare_run(spark: SparkSession, root: str, settings: Settings, ignore: list[str] = (), **options) -> Plan:
    """build_plan for a run: the settings' pre_run command first, whose failure is a PreRunError and leaves nothing planned."""
    pre_run(root, settings["runner.pre_run"])
    return build_plan(spark, root, settings, ignore, **options)
