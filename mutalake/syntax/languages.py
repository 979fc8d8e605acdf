"""How the languages are written: comments, strings, operators and their precedence. Fixed values of the languages."""

from __future__ import annotations

from mutalake.syntax.lexer import Rules

_COMMON = "( ) [ ] { } , ; : . ? ! ~ + - * / % & | ^ < > = == != <= >= && || << += -= *= /= %= &= |= ^= <<= -> => ... @ # $ \\".split()
_C_NUMBERS = r"0[xXbBoO][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[a-zA-Z\d_]*|\.\d[\d_]*(?:[eE][+-]?\d+)?[a-zA-Z]*"
_RAW_TRIPLE = ('"""', '"""', "raw")

RULES = {
    "rust": Rules(nested_comments=True, strings=((r'b?c?r#*"', "#", "raw"), (r'[bc]?"', '"', "lines")), numbers=r"0[xbo][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iuf]\w+)?",
                  special=((r"b?'(?:\\[^\n]+?|[^\\'\n])'", "string"), (r"'[A-Za-z_]\w*", "life")), operators=(*_COMMON, "::", "..", "..=", ">>=")),
    "c_sharp": Rules(strings=((r'\$+"""', '"""', "raw"), _RAW_TRIPLE, (r'(?:\$@|@\$|@)"', '"', "raw"), (r'\$?"', '"', "line"), ("'", "'", "line")), names=r"@?[^\W\d]\w*", numbers=_C_NUMBERS, line_comments=("//", r"(?m:^[ \t]*\#(?:region|endregion|pragma|nullable|if|else|elif|endif|define|undef|line|error|warning)\b)"),
                     operators=(*_COMMON, "::", "..", "?.", "??", "??=", "++", "--")),
    "python": Rules(line_comments=("#",), block_comments=(), strings=((r"(?i:[rbuft]{0,2})(?:\"\"\"|''')", "same", "lines"), (r"(?i:[rbuft]{0,2})\"", '"', "line"), (r"(?i:[rbuft]{0,2})'", "'", "line")),
                    numbers=r"0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?[jJ]?|\.\d[\d_]*(?:[eE][+-]?\d+)?[jJ]?", operators=(*_COMMON, "**", "//", ">>", "**=", "//=", ">>=", ":=", "<>"), lines=True, special=((r"\\\n", "joined"),)),
    "javascript": Rules(names=r"[#]?[^\W\d][\w$]*|\$[\w$]*", numbers=_C_NUMBERS, strings=(('"', '"', "line"), ("'", "'", "line"), ("`", "`", "lines")), regexes=True, operators=(*_COMMON, "===", "!==", "**", "**=", "??", "??=", "&&=", "||=", "?.", "++", "--", ">>>")),
    "go": Rules(strings=(('"', '"', "line"), ("'", "'", "line"), ("`", "`", "raw")), numbers=_C_NUMBERS, operators=(*_COMMON, ":=", "<-", "&^", "&^=", "++", "--", ">>", ">>=")),
}
RULES["typescript"] = RULES["javascript"]

# Precedence of binary operators, loosest first: fixed values.
_BINARY = {
    "rust": [".. ..=", "||", "&&", "== != < > <= >=", "|", "^", "&", "<< >>", "+ -", "* / %"],
    "c_sharp": ["??", "||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >> >>>", "+ -", "* / %", ".."],
    "python": ["or", "and", "not", "in is < > <= >= == != <>", "|", "^", "&", "<< >>", "+ -", "* / // % @"],
    "javascript": ["??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= in instanceof", "<< >> >>>", "+ -", "* / %", "**"],
    "go": ["||", "&&", "== != < > <= >=", "+ - | ^", "* / % << >> & &^"],
}
_BINARY["typescript"] = _BINARY["javascript"]
BINARY = {language: {op: level + 10 for level, ops in enumerate(levels) for op in ops.split()} for language, levels in _BINARY.items()}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= //= := ??= &&= ||= &^= @=".split())
PREFIX = {
    "rust": frozenset("! - *".split()),
    "c_sharp": frozenset("! - + ~ ++ -- & * ^".split()),
    "python": frozenset("- + ~".split()),
    "javascript": frozenset("! - + ~ typeof void delete".split()),
    "go": frozenset("! - + ^ * & <-".split()),
}
PREFIX["typescript"] = PREFIX["javascript"]
# Kinds of leaves and of composed expressions by language: fixed values.
WORDS = {
    "rust": {"true": "boolean_literal", "false": "boolean_literal", "self": "self"},
    "c_sharp": {"true": "boolean_literal", "false": "boolean_literal", "null": "null_literal"},
    "python": {"True": "true", "False": "false", "None": "none"},
    "javascript": {"true": "true", "false": "false", "null": "null", "undefined": "undefined", "this": "this"},
    "go": {"true": "true", "false": "false", "nil": "nil"},
}
WORDS["typescript"] = WORDS["javascript"]
