"""Cases of every implementation and language, and programs of them made from the driver's tables.

What a case must give is written here by hand; the SQL twins place it by counting lines, so nothing
that parses or matches takes part in them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutalake.functions.catalog import LANGUAGES, implementations
from mutalake.plans.adapters import load, spread

# Language: (text, {function: complexity}, complexities of functions without a name).
COMPLEXITY = {
    "rust": ("// fn no() { if a {} }\nfn a(x: Vec<Vec<u8>>) -> Option<u8> {\n if x.len() > 1 && y { return None; }\n while let Some(z) = it.next() { g(z)?; }\n match x { 1 => 2, _ if k => 3, _ => 4 }\n}\nfn b() { let f = |v: u8| if v > 1 { 2 } else { 3 }; loop { break; } }\nfn c() { if let Some(q) = r && q > 1 { s() } }\ntrait T { fn d(&self); }", {"a": 8, "b": 1, "c": 3}, [2]),
    "python": ("def a(x, y=1):\n    '''if not counted'''\n    if x and y or z:\n        pass\n    elif x:\n        return 1 if y else 2\n    else:\n        x = [k for k in x if k]\n    for i in x:\n        while i: i -= 1\n    try:\n        f()\n    except E:\n        pass\n    match x:\n        case 1 if y: pass\n        case _: pass\n\nclass C:\n    async def b(self):\n        def inner():\n            if x: pass\n        return inner\n", {"a": 13, "b": 1, "inner": 2}, []),
    "javascript": ("function a(x) { if (x) {} else if (y) {} for (;;) {} for (const k of x) {} do {} while (x); switch (x) { case 1: case 2: break; default: } try {} catch (e) {} return x ? y : z ?? w; }\nclass C { get b() { return 1 && 2; } #c() {} }\nconst d = (x) => x || 1;\nconst e = { f() { while (1) {} } };", {"a": 12, "b": 2, "f": 2}, [2]),
    "typescript": ("interface I { m(a: string): void; k: number }\nexport function a<T extends I>(x?: T, y: Map<string, T[]> = new Map<string, T[]>()): x is T { return x!.k > 1 ? true : false; }\nconst b = async (z: number): Promise<void> => { if (z) { await f<T>(z); } };", {"m": 1, "a": 2}, [2]),
    "go": ("package p\nfunc (r *T) a(x []int) (int, error) {\n\tfor i := 0; i < 3; i++ {\n\t\tif x, ok := m[i]; ok && !x {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch y := x.(type) {\n\tcase int:\n\tdefault:\n\t}\n\tselect {\n\tcase <-c:\n\t}\n\tf := func() { if x {} }\n\treturn T{1}, nil\n}\nfunc b() {}\n", {"a": 7, "b": 1}, [2]),
    "c_sharp": ("namespace N { class C<T> : B where T : class {\n [A(true)] public C(int x) : base(x) { if (x > 1 && y) { } }\n public static async Task<List<int>> M(Dictionary<string, int> d) { foreach (var k in d) { while (k) { } } switch (d) { case 1 when z: case 2: break; default: break; } try { } catch (E e) when (e.X) { } return d is int i ? 1 : 2; }\n int P => a ?? b;\n int L() => x switch { 1 => 2, _ => 3 };\n void O() { int Local(int q) { return q; } Func<int, int> f = v => v > 1 ? v : 0; }\n} }", {"C": 3, "M": 9, "L": 3, "O": 1, "Local": 1}, [2]),
    "java": ("class C { C() { if (a) {} }\n @Override public <T> int m(List<T> x) throws E { for (T t : x) { do { } while (y && z); } switch (x) { case 1: case 2: f(); break; default: } return a ? 1 : 2; }\n abstract int n(); void o() { r = s -> { if (s) { } }; } }", {"C": 2, "m": 7, "o": 1}, [2]),
    "cpp": ("#define X if\nint a(int x) {\n#ifdef Q\n if (x) { }\n#elif R\n#endif\n for (auto y : z) while (x || y) { }\n switch (x) { case 1: break; default: break; }\n try { } catch (...) { }\n return x ? 1 : 2;\n}\nint C::b() { auto f = [&](int q) { if (q) { } }; return 1; }\nclass D { int e() { return 1; } };", {"a": 11, "C::b": 1}, [2]),
    "c": ("static int a(char *s) { if (s[0] == '\"' && 1) { } do { } while (0); /* if */ return 0; }", {"a": 4}, []),
    "bash": ("f() {\n  if [[ $a && $b ]]; then x; elif y; then z; fi\n  for i in 1 2; do echo if; done\n  while true; do break; done\n  case $1 in\n    a) x;;\n    *) y;;\n  esac\n}\nfunction g { echo; }\n", {"f": 8, "g": 1}, []),
    "dart": ("int a(int x) { if (x > 1 && y) { } for (var i in z) { } switch (x) { case 1: break; default: } return x ?? 1; }\nclass C { C(this.x); int m() => x > 0 ? 1 : 2; }", {"a": 7, "C": 1, "m": 2}, []),
    "elixir": ("defmodule M do\n  def a do\n    case x do\n      1 -> 2\n      _ -> if y && z do 3 end\n    end\n  end\n  f = fn q -> q end\nend\n", {"a": 4}, [2]),
    "erlang": ("a(X) when X > 1 ->\n  case X of\n    1 -> ok;\n    _ -> if X > 2 andalso Y -> 1; true -> 2 end\n  end;\na(_) -> fun(Z) -> Z end.\n", {"a": 1}, [1]),
    "gleam": ("pub fn a(x) {\n  case x {\n    1 -> 2\n    _ if y || z -> 3\n  }\n}\n", {"a": 4}, []),
    "haskell": ("module M where\na x y | x > 1 && y = 1\n      | otherwise = 2\nb z = if z then case z of\n    1 -> 2\n    _ -> 3\n  else \\q -> q\n", {"a": 4, "b": 4}, [1]),
    "julia": ("function a(x)\n  if x\n  elseif y\n  end\n  for i in x[1:end]\n    while x ? true : false; end\n  end\nend\nmacro m(x) end\n", {"a": 6, "m": 1}, []),
    "lua": ("local function a(x)\n  if x and y then elseif z then end\n  for i = 1, 2 do end\n  repeat until x\n  return function() while x do end end\nend\n", {"a": 6}, [2]),
    "ocaml": ("let rec a x =\n  if x && y then match x with\n    | 1 -> 2\n    | _ -> 3\n  else 4\nlet v = 1\n", {"a": 5}, []),
    "ruby": ("def a(x)\n  return 1 if x && y\n  case x\n  when 1 then 2\n  end\n  until z do q end\n  begin; rescue E; end\nend\ndef self.b = 1\n", {"a": 6, "b": 1}, []),
    "php": ("<?php\nfunction a($x) { if ($x) {} elseif ($y) {} foreach ($x as $k => $v) {} return match($x) { 1 => 2, default => 3 } ?? 4; }\nclass C { public function m() { return fn($q) => $q ? 1 : 2; } }", {"a": 7, "m": 1}, [2]),
    "scala": ("object O {\n  def a(x: Int): Int = {\n    if (x > 1 && y) 1 else 2\n    x match {\n      case 1 => 2\n      case _ => 3\n    }\n  }\n}\n", {"a": 5}, []),
    "swift": ("func a(_ x: Int) -> Int {\n  guard x > 1 else { return 1 }\n  switch x {\n  case 1: break\n  default: break\n  }\n  return y ?? (x > 2 ? 1 : 2)\n}\n", {"a": 6}, []),
    "zig": ("pub fn a(x: u8) !u8 {\n  if (x > 1 and y) return try f();\n  return switch (x) { 1 => 2, else => 3 };\n}\n", {"a": 6}, []),
}

# Implementations by language and operator: a body with a site, its original and replacement, and a body without.
_BOTH = {
    "comparison_boundary": ("x = a <= b;", "<=", "<", "x = a == b;"), "comparison_negation": ("x = a > b;", ">", "<=", "x = a != b;"), "negate_equality": ("x = a != b;", "!=", "==", "x = a < b;"),
    "swap_logical": ("x = a || b;", "||", "&&", "x = a | b;"), "swap_boolean": ("x = false;", "false", "true", 'x = "true";'), "integer_zero_one": ("x = 0;", "0", "1", "x = 10;"),
    "remove_not": ("x = !a.b(c);", "!a.b(c)", "a.b(c)", "x = a != b;"), "return_boolean": ("return true;", "true", "false", "x = true;"), "ternary_arm_swap": ("x = a ? b : c;", "a ? b : c", "a ? c : b", "x = a ?? b;"),
    "nullish_coalescing_removal": ("x = a ?? b;", "a ?? b", "a", "x = a || b;"), "string_empty_literal": ('x = "ab";', '"ab"', '""', 'x = "";'), "await_removal": ("x = await a();", "await a()", "a()", "x = a();"),
}
_OWN = {
    "rust": {
        "range_inclusive_exclusive": ("let x = 0..n;", "..", "..=", "let x = 0..;"), "swap_predicate_method": ("a.is_some();", "is_some", "is_none", "is_some(a);"), "negate_predicate_method": ("a.is_empty();", "a.is_empty()", "!a.is_empty()", "a.len();"),
        "iterator_any_all": ("a.any(f);", "any", "all", "any(a);"), "match_bool_pattern": ("match a { true => b, _ => c }", "true", "false", "match a { Some(true) => b, _ => c }"), "ok_err_boolean": ("Err(false)", "false", "true", "Some(false)"),
        "some_boolean": ("Some(true)", "true", "false", "Ok(true)"), "option_some_none": ("Some(a)", "Some(a)", "None", "Some()"), "remove_try": ("a.b()?;", "a.b()?", "a.b()", "a.b();"), "unwrap_to_unwrap_or_default": ("a.unwrap();", "unwrap", "unwrap_or_default", "a.unwrap_or(b);"),
        "min_max_swap": ("min(a, b);", "min", "max", "let min = a;"), "match_wildcard_to_panic": ("match a { 1 => b, _ => c }", "c", 'panic!("mutated wildcard arm")', "match a { 1 => b, d => c }"), "empty_vec_macro": ("vec![a, b];", "vec![a, b]", "vec![]", "my![a];"),
        "saturating_checked_swap": ("a.checked_add(b);", "checked_add", "saturating_add", "a.wrapping_add(b);"), "expect_to_unwrap_or_default": ('a.expect("m");', 'a.expect("m")', "a.unwrap_or_default()", "a.unwrap();"),
    },
    "python": {
        "comparison_boundary": ("x = a <= b", "<=", "<", "x = a == b"), "comparison_negation": ("x = a > b", ">", "<=", "x = a != b"), "negate_equality": ("x = a != b", "!=", "==", "x = a < b"), "swap_logical": ("x = a or b", "or", "and", "x = a | b"),
        "swap_boolean": ("x = False", "False", "True", "x = 'True'"), "integer_zero_one": ("x = 0", "0", "1", "x = 10"), "return_boolean": ("return True", "True", "False", "x = True"), "negate_predicate_method": ("x = a.isdigit()", "a.isdigit()", "not (a.isdigit())", "x = a.lower()"),
        "is_none_negation": ("x = a is None", "is", "is not", "x = a is b"), "in_negation": ("x = a not in b", "not in", "in", "for x in a: pass"), "truthiness_negation": ("if a: pass", "a", "not (a)", "x = a"), "len_zero_boundary": ("x = len(a) > 0", "len(a) > 0", "len(a) == 0", "x = size(a) > 0"),
        "dict_get_default_removal": ("x = a.get(b, c)", "a.get(b, c)", "a.get(b)", "x = a.get(b)"), "comprehension_filter_removal": ("x = [a for a in b if a]", " if a", "", "x = [a for a in b]"), "none_return": ("return a", "a", "None", "return"),
        "empty_collection_literal": ("x = {1, a}", "{1, a}", "set()", "x = {}"), "iterator_any_all": ("x = any(a for a in b)", "any", "all", "x = b.any(a)"), "min_max_swap": ("x = max(a, b)", "max", "min", "x = max()"), "sorted_reverse_flip": ("x = sorted(a)", "sorted(a)", "sorted(a, reverse=True)", "x = a.sorted()"),
        "dict_get_to_index": ("x = a.get(b)", "a.get(b)", "a[b]", "x = a.get(b, c)"),
    },
    "javascript": {
        "iterator_any_all": ("x = a.some(f);", "some", "every", "x = some(a);"), "string_boundary_method_swap": ("x = a.startsWith(b);", "startsWith", "endsWith", "x = a.startsWith();"), "includes_negation": ("x = a.includes(b);", "a.includes(b)", "!(a.includes(b))", "x = a.has(b);"),
        "optional_chaining_removal": ("x = a?.b;", "a?.b", "a.b", "x = a ? .5 : b;"), "array_empty_literal": ("x = [a, b];", "[a, b]", "[]", "x = a[b];"), "object_empty_literal": ("x = { a: 1 };", "{ a: 1 }", "{}", "if (a) { b(); }"),
    },
    "go": {"return_boolean": None},
    "c_sharp": {
        "ternary_condition_negation": ("x = a ? b : c;", "a", "!(a)", "int? x = c;"), "swap_arithmetic": ("x = a * b;", "*", "/", "x = -b;"), "swap_assignment": ("x += a;", "+=", "-=", "x = a;"), "remove_unary_minus": ("x = -a;", "-a", "a", "x = b - a;"),
        "plus_to_minus": ("x = +a;", "+", "-", "x = b + a;"), "null_forgiving_removal": ("x = a!;", "a!", "a", "x = !a;"), "nullable_access_to_member_access": ("x = a?.B;", "a?.B", "a.B", "x = a.B;"), "is_pattern_negation": ("x = a is string;", "a is string", "a is not string", "x = a == b;"),
        "as_expression_to_direct_cast": ("x = a as T;", "a as T", "(T)a", "x = (T)a;"), "checked_unchecked_swap": ("x = checked(a + b);", "checked", "unchecked", "x = a + b;"), "throw_expression_to_null": ("x = a ?? throw new E();", "throw new E()", "null", "throw new E();"),
        "default_literal_to_null": ("x = default;", "default", "null", "x = default(int);"),
    },
}
_OWN["typescript"] = _OWN["javascript"]
WRAP = {"rust": "fn f() { %s }", "python": "def f():\n    %s\n", "javascript": "async function f() { %s }", "typescript": "async function f(): Promise<T> { %s }", "go": "package p\n\nfunc f() {\n\t%s\n}\n", "c_sharp": "class C { void F() { %s } }"}
CASES = {impl: found for impl, operator, language in implementations() if (found := _OWN[language].get(operator) or _BOTH.get(operator))}

_NAMES = sorted(CASES)
_EXTENSION = {language: extensions.split()[0] for language, _, extensions in LANGUAGES}
#: Lines before the first function of a file.
_HEADS = {"go": "package p\n\n"}


def _function(language: str, body: str) -> str:
    return (WRAP[language].removeprefix(_HEADS.get(language, "")) % body).rstrip("\n")


def _expected() -> list[tuple]:
    """(k, implementation, extension, lines before, lines of a function, line and column of the site, original, replacement) of each case."""
    out = []
    for k, name in enumerate(_NAMES):
        language = name.partition(".")[0]
        body, original, replacement, _ = CASES[name]
        word = re.search(r"(?<!\w)" + re.escape(original) + r"(?!\w)", body) if re.fullmatch(r"\w.*\w|\w", original) else None
        at = word.start() if word else body.index(original)
        before = _function(language, "%s").partition("%s")[0]
        column = len(before.rpartition("\n")[2]) + at
        out.append((k, name, _EXTENSION[language], _HEADS.get(language, "").count("\n"), _function(language, body).count("\n") + 1, before.count("\n"), column, original, replacement))
    return out


def case_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, language, text), a file a part: up to four functions, each with a site of the file's implementation or one that only looks like it."""
    texts = {k: (_HEADS.get(lang := name.partition(".")[0], ""), _function(lang, CASES[name][0]), _function(lang, CASES[name][3])) for k, name in enumerate(_NAMES)}
    table = spark.createDataFrame([(k, name.partition(".")[0], f"{name}/", _EXTENSION[name.partition(".")[0]], *texts[k]) for k, name in enumerate(_NAMES)], "k long, language string, folder string, extension string, head string, hit string, miss string")
    part = spread(load(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % len(_NAMES)).alias("k")), "p_partkey")
    bodies = F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda j: F.when((F.col("p_partkey") + j) % 3 != 0, F.col("hit")).otherwise(F.col("miss")))
    rows = part.join(F.broadcast(table), "k")  # a row an implementation
    return rows.select(F.concat("folder", "p_partkey", F.lit("."), "extension").alias("file"), "language", F.concat("head", F.array_join(bodies, "\n"), F.lit("\n")).alias("text"))


def _values(rows: list[tuple]) -> str:
    shown = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


CASES_SQL = f"""WITH cases(k, implementation, extension, head, height, line0, col, original, replacement) AS (VALUES {_values(_expected())})
SELECT implementation || '/' || p_partkey || '.' || extension AS file, implementation, CAST(head + j * height + line0 + 1 AS INT) AS line, col AS "column", original, replacement
FROM part JOIN cases ON k = p_partkey % {len(_NAMES)}, unnest(range(0, p_size % 4 + 1)) AS t(j) WHERE (p_partkey + j) % 3 <> 0"""

_SCANNED = sorted(COMPLEXITY)


def complexity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, language, text), a file a customer, in all languages that are scanned."""
    table = spark.createDataFrame([(k, language, _EXTENSION[language], COMPLEXITY[language][0]) for k, language in enumerate(_SCANNED)], "k long, language string, extension string, text string")
    customer = spread(load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(_SCANNED)).alias("k")), "c_custkey")
    return customer.join(F.broadcast(table), "k").select(F.concat(F.lit("c"), "c_custkey", F.lit("."), "extension").alias("file"), "language", "text")  # a row a language


def _complexities() -> list[tuple]:
    """(k, extension, function, complexity, how many) of each language's case; functions without a name are called so."""
    out = []
    for k, language in enumerate(_SCANNED):
        _, named, anonymous = COMPLEXITY[language]
        found = [("a", 1), ("a", 8)] if language == "erlang" else [*named.items()]  # clauses of one name are functions of their own
        found += [("<anonymous>", n) for n in anonymous]
        out += [(k, _EXTENSION[language], name, n, found.count((name, n))) for name, n in sorted(set(found))]
    return out


COMPLEXITY_SQL = f"""WITH cases(k, extension, function, cyclomatic, n) AS (VALUES {_values(_complexities())})
SELECT 'c' || c_custkey || '.' || extension AS file, function, CAST(cyclomatic AS BIGINT) AS cyclomatic, CAST(n AS BIGINT) AS n FROM customer JOIN cases ON k = c_custkey % {len(_SCANNED)}"""
