"""Synthetic relations of the engine's shapes from the driver's tables, each as a DataFrame and as SQL.

They only exercise the kernels: orders play functions, line items coverage, events outcomes. The SQL
form is plain SQL for DuckDB; both are projections without any of the kernels' logic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutalake.functions.catalog import OPERATORS
from mutalake.functions.session import dealt, tasks_for

_NAMES = [name for name, *_ in OPERATORS]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small table dealt to all tasks: what is made of a row takes longer than reading it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def item_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for rows of line items and orders; see tasks_for."""
    return tasks_for(load(spark, sf_dir, "lineitem"))


def functions(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """An order is a function of its customer's file; ten lines from ten times its key; its items are its branches."""
    n = dealt(load(spark, sf_dir, "lineitem").select("l_orderkey"), tasks, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = dealt(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), tasks, "o_orderkey")
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select(
        F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("function"), (F.col("o_orderkey") * 10).alias("start_line"), (F.col("o_orderkey") * 10 + 9).alias("end_line"),
        (1 + F.coalesce("n", F.lit(0))).alias("cyclomatic"), F.col("o_orderkey").alias("scan_seq"))


FUNCTIONS_SQL = """functions AS (
  SELECT CAST(o_custkey AS VARCHAR) AS file, o_orderkey AS function, o_orderkey * 10 AS start_line, o_orderkey * 10 + 9 AS end_line, 1 + (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS cyclomatic, o_orderkey AS scan_seq FROM orders)"""


def raw_lines(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """(file, line, hits, seq) with repeated lines; returned items were never hit."""
    o, i = dealt(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), tasks, "o_orderkey"), dealt(load(spark, sf_dir, "lineitem"), tasks, "l_orderkey")
    hits = F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.col("l_quantity").cast("long")).cast("long")
    seq = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_quantity", "l_returnflag")
    return i.join(o, i.l_orderkey == o.o_orderkey).select(F.col("o_custkey").cast("string").alias("file"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("line"), hits.alias("hits"), seq.alias("seq"))


LINES_SQL = """raw_lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS file, o_orderkey * 10 + l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) END AS hits,
    (l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_shipdate, l_quantity, l_returnflag) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a mutant's outcome; its user is a function, its user's last digit a file, k of props an operator."""
    status = F.create_map(*(F.lit(x) for pair in (("view", "survived"), ("click", "killed"), ("purchase", "killed"), ("signup", "timeout"), ("error", "error")) for x in pair))
    operator = F.element_at(F.array(*map(F.lit, _NAMES)), (F.get_json_object("props", "$.k").cast("long") % len(_NAMES) + 1).cast("int"))
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("m"), "event_id").alias("id"), F.concat(F.lit("src/f:"), F.col("user_id") % 10, F.lit(",%.rs")).alias("file"), F.col("user_id").alias("function"), operator.alias("operator"),
        F.element_at(status, F.col("event_type")).alias("status"), (F.col("event_id") % 97 + 1).alias("line"), (F.col("event_id") % 13).alias("column"), F.concat(F.lit("edit "), "event_type", F.lit(" "), F.col("event_id") % 7).alias("description"),
        F.concat("event_type", F.lit(", 100%")).alias("original"), F.concat(F.lit("x:"), F.col("event_id") % 7).alias("replacement"))


OUTCOMES_SQL = """outcomes AS (
  SELECT event_id AS seq, 'm' || event_id AS id, 'src/f:' || (user_id % 10) || ',%.rs' AS file, user_id AS function, [{names}][CAST(json_extract_string(props, '$.k') AS BIGINT) % {n} + 1] AS operator,
    CASE event_type WHEN 'view' THEN 'survived' WHEN 'click' THEN 'killed' WHEN 'purchase' THEN 'killed' WHEN 'signup' THEN 'timeout' ELSE 'error' END AS status,
    event_id % 97 + 1 AS line, event_id % 13 AS "column", 'edit ' || event_type || ' ' || (event_id % 7) AS description, event_type || ', 100%' AS original, 'x:' || (event_id % 7) AS replacement FROM events)""".format(names=", ".join(f"'{x}'" for x in _NAMES), n=len(_NAMES))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score entries for most of the functions of outcomes; some keys occur twice."""
    c = load(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.when(F.col("c_custkey") % 5 == 0, "other/f:").otherwise("src/f:"), F.col("c_custkey") % 10, F.lit(",%.rs")).alias("file"), (F.col("c_custkey") - F.col("c_custkey") % 20 + F.col("c_custkey") % 10).alias("function"), (F.col("c_nationkey") + 1).cast("long").alias("cyclomatic"),
        (F.col("c_custkey") * 7 % 101).cast("double").alias("coverage"), (F.col("c_custkey") * 11 % 120).cast("double").alias("crap"), F.col("c_custkey").alias("scan_seq"))


ENTRIES_SQL = """entries AS (
  SELECT CASE WHEN c_custkey % 5 = 0 THEN 'other/f:' ELSE 'src/f:' END || (c_custkey % 10) || ',%.rs' AS file, c_custkey - c_custkey % 20 + c_custkey % 10 AS function, CAST(c_nationkey + 1 AS BIGINT) AS cyclomatic, CAST(c_custkey * 7 % 101 AS DOUBLE) AS coverage, CAST(c_custkey * 11 % 120 AS DOUBLE) AS crap, c_custkey AS scan_seq
  FROM customer)"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, operator, discovery_seq, start_byte, original, replacement) from part names and types."""
    return load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("file"), F.when(F.col("p_partkey") % 3 == 0, "swap_boolean").otherwise("integer_zero_one").alias("operator"), F.col("p_partkey").alias("discovery_seq"), (F.col("p_size") * 10).cast("long").alias("start_byte"),
        F.concat(F.lit("é"), F.col("p_size"), F.lit(" "), "p_type").alias("original"), F.concat(F.lit("é"), F.col("p_size") % 10, F.lit("x "), "p_type").alias("replacement"))


EDITS_SQL = """edits AS (
  SELECT p_brand AS file, CASE WHEN p_partkey % 3 = 0 THEN 'swap_boolean' ELSE 'integer_zero_one' END AS operator, p_partkey AS discovery_seq, CAST(p_size * 10 AS BIGINT) AS start_byte,
    'é' || p_size || ' ' || p_type AS original, 'é' || (p_size % 10) || 'x ' || p_type AS replacement FROM part)"""


def url_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sources, covered): the last two steps of a page's path as a scanned file, the whole path as a coverage key."""
    rest = F.regexp_replace("url", r"^[a-z]+://|[?#].*$|/$", "")
    pages = load(spark, sf_dir, "pages").select("page_id", rest.alias("p"))
    parts = F.split("p", "/")
    last = F.concat(F.get(parts, F.size(parts) - 1), F.when(F.col("page_id") % 3 == 0, "~").otherwise(""))
    return pages.select(F.concat_ws("/", F.get(parts, F.size(parts) - 2), last).alias("file")), pages.select(F.concat("p", F.when(F.col("page_id") % 4 == 0, "+").otherwise("")).alias("file"))


URL_FILES_SQL = """paths AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$|/$', '', 'g') AS p FROM pages),
sources AS (SELECT DISTINCT concat_ws('/', split_part(p, '/', -2), split_part(p, '/', -1) || CASE WHEN page_id % 3 = 0 THEN '~' ELSE '' END) AS file FROM paths),
covered AS (SELECT DISTINCT p || CASE WHEN page_id % 4 = 0 THEN '+' ELSE '' END AS file FROM paths)"""
