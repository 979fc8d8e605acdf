"""Program sources made from the driver's tables, and what their scan must give as plain SQL.

An order is a function of its customer's file; each of its items is one line with one decision, of a
form that its return flag picks. The SQL counts rows and looks up constants; it never reads the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutalake.plans.adapters import load

# Language: extension, first line, function head, first line of a body, lines for the flags A, N and R, last line of a function, last line.
FORMS = {
    "rust": ("rs", "// orders", "fn o_{}() {", "    b();", "    if a < 1 { b(); }", "    while c(0) { b(); }", "    let z = p == q && true;", "}", "// end"),
    "python": ("py", "# orders", "def o_{}():", "    b()", "    if a < 1: b()", "    while c(0): b()", "    z = p == q and True", "", "# end"),
    "javascript": ("js", "// orders", "function o_{}() {", "    b();", "    if (a < 1) { b(); }", "    while (c(0)) { b(); }", "    let z = p == q && true;", "}", "// end"),
    "typescript": ("ts", "// orders", "function o_{}(): void {", "    b();", "    if (a < 1) { b(); }", "    while (c(0)) { b(); }", "    let z: boolean = p == q && true;", "}", "// end"),
    "go": ("go", "package orders", "func o_{}() {", "    b()", "    if a < 1 { b() }", "    for c(0) { b() }", "    z := p == q && true", "}", "// end"),
    "c_sharp": ("cs", "class Orders {", "    static void o_{}() {", "    b();", "    if (a < 1) { b(); }", "    while (c(0)) { b(); }", "    var z = p == q && true;", "    }", "}"),
    "java": ("java", "class Orders {", "    static void o_{}() {", "    b();", "    if (a < 1) { b(); }", "    while (c(0)) { b(); }", "    boolean z = p == q && true;", "    }", "}"),
    "c": ("c", "/* orders */", "void o_{}(void) {", "    b();", "    if (a < 1) { b(); }", "    while (c(0)) { b(); }", "    int z = p == q && 1;", "}", "/* end */"),
    "ruby": ("rb", "# orders", "def o_{}", "    b()", "    b() if a < 1", "    c(0) while d", "    z = p == q && true", "end", "# end"),
    "lua": ("lua", "-- orders", "function o_{}()", "    b()", "    if a < 1 then b() end", "    while c(0) do b() end", "    local z = p == q and true", "end", "-- end"),
}
_LANGUAGES = [*FORMS]
_FLAGS = "ANR"
# What a line of a form has to offer: flag, operator, original, replacement.
_EDITS = [("A", "comparison_boundary", "<", "<="), ("A", "comparison_negation", "<", ">="), ("A", "integer_zero_one", "1", "0"), ("N", "integer_zero_one", "0", "1"), ("R", "negate_equality", "==", "!="), ("R", "swap_logical", "&&", "||"), ("R", "swap_boolean", "true", "false")]
_PYTHON = [("R", "swap_logical", "and", "or"), ("R", "swap_boolean", "True", "False"), ("A", "truthiness_negation", "a < 1", "not (a < 1)"), ("N", "truthiness_negation", "c(0)", "not (c(0))")]


def program_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, language, text), a file a customer with orders."""
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, name in enumerate(_LANGUAGES) for x in (k, FORMS[name][i]))), (F.col("o_custkey") % len(_LANGUAGES)).cast("int"))
    o, i = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), load(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", "\1").when(F.col("l_returnflag") == "N", "\2").otherwise("\3")  # signs that no form holds
    items = i.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", flag.alias("sign")))).alias("items"))  # of one order
    items = items.select("l_orderkey", F.array_join("items.sign", "").alias("signs"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number of our own, else small texts meet in few tasks, and parsing is what takes time
    named = o.join(items, o.o_orderkey == items.l_orderkey, "left").select("o_custkey", "o_orderkey", F.coalesce("signs", F.lit("")).alias("body")).repartition(tasks, "o_custkey")
    per_file = named.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "body"))).alias("orders"))  # of one customer
    end = F.lit("\n")
    head, opening, last = (F.concat(pick(n), end) for n in (2, 3, 7))
    block = lambda x: F.concat(F.replace(head, F.lit("{}"), x["o_orderkey"].cast("string")), opening, x["body"], last)
    text = F.array_join(F.transform("orders", block), "")
    for n, sign in ((4, "\1"), (5, "\2"), (6, "\3")):
        text = F.replace(text, F.lit(sign), F.concat(pick(n), end))
    language = F.element_at(F.array(*map(F.lit, _LANGUAGES)), (F.col("o_custkey") % len(_LANGUAGES) + 1).cast("int"))
    return per_file.select(F.concat(F.lit("src/c"), "o_custkey", F.lit("."), pick(0)).alias("file"), language.alias("language"), F.concat(pick(1), end, text, pick(8)).alias("text"))


def _values(rows: list[tuple]) -> str:
    shown = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


_NUMBERED = f"""forms(k, language, extension) AS (VALUES {_values([(k, name, FORMS[name][0]) for k, name in enumerate(_LANGUAGES)])}),
sizes AS (SELECT o_orderkey, o_custkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders),
functions AS (
  SELECT o_orderkey, 'src/c' || o_custkey || '.' || extension AS file, language, 'o_' || o_orderkey AS function, n,
    2 + coalesce(sum(n + 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_line
  FROM sizes JOIN forms ON k = o_custkey % {len(_LANGUAGES)})"""

SCAN_SQL = f"WITH {_NUMBERED} SELECT file, language, function, CAST(start_line AS INT) AS start_line, CAST(start_line + n + CASE WHEN language = 'python' THEN 1 ELSE 2 END AS INT) AS end_line, 1 + n AS cyclomatic FROM functions"

CYCLOMATIC_SQL = f"WITH {_NUMBERED} SELECT language, count(*) AS functions, CAST(sum(1 + n) AS BIGINT) AS cyclomatic, CAST(max(1 + n) AS BIGINT) AS highest FROM functions GROUP BY language"


def _offers() -> list[tuple]:
    """(language, flag, operator, column, original, replacement), places found in the forms' texts."""
    from mutalake.functions.catalog import implementations

    known = {x for x, _, _ in implementations()}
    out = []
    for language, form in FORMS.items():
        for flag, operator, original, replacement in _EDITS + (_PYTHON if language == "python" else []):
            text = form[4 + _FLAGS.index(flag)]
            if f"{language}.{operator}" in known and original in text:
                out.append((language, flag, operator, text.index(original), original, replacement))
    return out


DISCOVER_SQL = f"""WITH {_NUMBERED}, offers(language, flag, operator, col, original, replacement) AS (VALUES {_values(_offers())}),
items AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS r FROM lineitem)
SELECT file || ':' || CAST(start_line + 1 + r AS INT) || ':' || col || ':' || language || '.' || operator AS id, file, language, function, operator, language || '.' || operator AS implementation, CAST(start_line + 1 + r AS INT) AS line, col AS "column", original, replacement
FROM items JOIN functions ON l_orderkey = o_orderkey JOIN offers USING (language) WHERE flag = l_returnflag"""
