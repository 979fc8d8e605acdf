"""Functions and decision points of the languages that are only scanned, found in text without comments and strings.

Each language says how it writes function heads, where a body ends, and what counts as a decision.
The tree has two levels: functions and decisions under the file.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from mutalake.syntax.lexer import STRING, Rules, tokens
from mutalake.syntax.nodes import Node

_C_LIKE = Rules()
_CHAR = (r"'(?:\\[^\n]+?|[^\\'\n])'", "string")
# How the scanned languages write comments and strings: fixed values.
RULES = {
    "bash": Rules(line_comments=(r"(?<![^\s;])\#",), block_comments=(), strings=(('"', '"', "lines"), ("'", "'", "raw"))),
    "java": Rules(strings=(('"""', '"""', "lines"), ('"', '"', "line"), ("'", "'", "line"))),
    "cpp": Rules(strings=(('"', '"', "line"),), special=(_CHAR,)), "c": Rules(strings=(('"', '"', "line"),), special=(_CHAR,)),
    "dart": Rules(nested_comments=True, strings=((r"r?(?:\"\"\"|''')", "same", "lines"), (r'r?"', '"', "line"), (r"r?'", "'", "line"))),
    "elixir": Rules(line_comments=("#",), block_comments=(), strings=(('"""', '"""', "lines"), ('"', '"', "lines"), ("'", "'", "lines")), special=((r"\?\\?[^\s]", "char"),)),
    "erlang": Rules(line_comments=("%",), block_comments=(), strings=(('"', '"', "lines"), ("'", "'", "line")), special=((r"\$\\?[^\s]", "char"),)),
    "gleam": Rules(block_comments=(), strings=(('"', '"', "lines"),)),
    "haskell": Rules(line_comments=(r"--+(?![!\#$%&*+./<=>?@\\^|~:])",), block_comments=(("{-", "-}"),), nested_comments=True, strings=(('"', '"', "lines"),), names=r"[^\W\d][\w']*", special=(_CHAR,)),
    "julia": Rules(line_comments=("#",), block_comments=(("#=", "=#"),), nested_comments=True, strings=(('"""', '"""', "lines"), ('"', '"', "lines")), special=(_CHAR,)),
    "lua": Rules(line_comments=(r"--(?!\[\[)",), block_comments=(("--[[", "]]"),), strings=((r"\[\[", "]]", "raw"), ('"', '"', "line"), ("'", "'", "line"))),
    "ocaml": Rules(line_comments=(), block_comments=(("(*", "*)"),), nested_comments=True, strings=(('"', '"', "lines"),), names=r"[^\W\d][\w']*", special=(_CHAR,)),
    "ruby": Rules(line_comments=("#",), block_comments=(("\n=begin", "\n=end"),), strings=(('"', '"', "lines"), ("'", "'", "lines")), names=r"[^\W\d]\w*[?!]?"),
    "php": Rules(line_comments=("//", r"\#(?!\[)"), strings=(('"', '"', "lines"), ("'", "'", "lines")), names=r"\$?[^\W\d]\w*"),
    "scala": Rules(nested_comments=True, strings=(('"""', '"""', "raw"), ('"', '"', "line")), special=(_CHAR,)),
    "swift": Rules(nested_comments=True, strings=(('"""', '"""', "lines"), ('"', '"', "line"))),
    "zig": Rules(block_comments=(), strings=(('"', '"', "line"), (r"\\\\", "\n", "raw")), special=(_CHAR,)),
}
_OPENS = {"(": ")", "[": "]", "{": "}"}


class Masked:
    """A text whose comments are blank and whose strings are underscores in quotes, with its brackets matched."""

    def __init__(self, text: str, rules: Rules):
        out, at = [], 0
        blank = re.compile(r"[^\n]").sub
        for t in tokens(text, rules):
            gap = text[at : t.start]
            out.append(blank(" ", gap) if gap.strip(" \n") else gap)
            out.append('"' + blank("_", text[t.start + 1 : t.end - 1]) + '"' if t.kind == STRING and t.end - t.start > 1 else blank("_", t.text) if t.kind == "char" else t.text)
            at = t.end
        out.append(blank(" ", text[at:]))
        self.text = "".join(out)
        self._places, self._nests, self._starts, self._dedents = {}, {}, {}, {}
        self.partner: dict[int, int] = {}
        self.opener: dict[int, int] = {}
        # At each bracket the innermost one open behind it, and around each opening one the next.
        self.events, self.inner, self.outer = [-1], [-1], {}
        stack: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", self.text):
            at = m.start()
            if m.group() in _OPENS:
                self.outer[at] = stack[-1] if stack else -1
                stack.append(at)
            elif stack and _OPENS[self.text[stack[-1]]] == m.group():
                self.opener[at] = stack[-1]
                self.partner[stack.pop()] = at
            self.events.append(at)
            self.inner.append(stack[-1] if stack else -1)

    def innermost(self, at: int) -> int:
        """The innermost bracket that is open at a place, itself included; -1 for none."""
        return self.inner[bisect_right(self.events, at) - 1]

    def find(self, pattern: str, flags: int = 0) -> Iterator[re.Match]:
        return re.compile(pattern, re.M | flags).finditer(self.text)

    def end(self, opening: int) -> int:
        """Behind the bracket that closes the one at opening."""
        return self.partner.get(opening, len(self.text) - 1) + 1

    def after(self, pattern: str, at: int) -> re.Match | None:
        return re.compile(pattern, re.M).match(self.text, at)

    def _stops(self, signs: str) -> tuple[list[int], dict[int, int]]:
        """The places of some signs, and what is known of where ways from them end."""
        if signs not in self._places:
            self._places[signs] = [x.start() for x in re.finditer(f"[{re.escape(signs)}]", self.text)], {}
        return self._places[signs]

    def next(self, at: int, signs: str) -> int | None:
        """The first place of any of some signs from a place on."""
        places, _ = self._stops(signs)
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None

    def expression_end(self, at: int, stops: str = ";,)]}") -> int:
        """Behind an expression: the first stop outside brackets."""
        places, ends = self._stops("".join(sorted({*stops, *_OPENS})))
        k, way = bisect_left(places, at), []
        while k < len(places) and (known := ends.get((stops, k))) is None:
            if self.text[places[k]] in stops:
                known = places[k]
                break
            way.append(k)
            k = bisect_left(places, self.end(places[k]))
        else:
            known = len(self.text) if k == len(places) else known
        for x in way:
            ends[stops, x] = known
        return max(known, at)

    def begin(self, at: int, stops: str = ";{}") -> int:
        """The first word of the declaration that holds a place."""
        places, firsts = self._stops(stops)
        k = bisect_left(places, at)
        k = places[k - 1] + 1 if k else 0
        blank = re.compile(r"(?:\s|#[^\n]*\n)*+")
        if k not in firsts:
            firsts[k] = blank.match(self.text, k).end()
        return firsts[k] if firsts[k] <= at else blank.match(self.text, k, at).end()

    def before(self, begin: int, at: int, most: int = 2000) -> str:
        """The end of what stands between two places, without the space around it."""
        return self.text[max(begin, at - most) : at].strip()

    def line_before(self, at: int, most: int = 400) -> str:
        """The end of what stands before a place in its line; one that is cut begins with a sign."""
        start = self.text.rfind("\n", max(0, at - most), at) + 1
        return self.text[start:at] if start or at <= most else "." + self.text[at - most : at]

    def inside(self, spans: list[tuple[int, int]], at: int) -> tuple[int, int] | None:
        """The smallest of the spans around a place; spans nest."""
        if id(spans) not in self._nests:
            events, inner, stack = [-1], [None], []
            for a, b in sorted({x for x in spans if x[1] > x[0]}, key=lambda x: (x[0], -x[1])):
                while stack and stack[-1][1] <= a:
                    events.append(stack.pop()[1])
                    inner.append(stack[-1] if stack else None)
                stack.append((a, b))
                events.append(a)
                inner.append((a, b))
            while stack:
                events.append(stack.pop()[1])
                inner.append(stack[-1] if stack else None)
            self._nests[id(spans)] = events, inner, spans
        events, inner, _ = self._nests[id(spans)]
        return inner[bisect_right(events, at) - 1]

    def starts(self, spans: list[tuple[int, int]]) -> set[int]:
        if id(spans) not in self._starts:
            self._starts[id(spans)] = {a for a, _ in spans}, spans
        return self._starts[id(spans)][0]

    def indented_end(self, line_start: int, column: int) -> int:
        """Behind the line and all lines that are indented more than the column."""
        if (line_start, column) not in self._dedents:
            at = self.text.find("\n", line_start)
            last = len(self.text) if at < 0 else at
            while at >= 0:
                nxt = self.text.find("\n", at + 1)
                line = self.text[at + 1 : nxt if nxt >= 0 else len(self.text)]
                if line.strip():
                    if len(line) - len(line.lstrip()) <= column:
                        break
                    last = nxt if nxt >= 0 else len(self.text)
                at = nxt
            self._dedents[line_start, column] = last
        return self._dedents[line_start, column]


@dataclass
class Found:
    """Functions as (kind, name or None, start, end), decisions as (kind, place)."""

    functions: list[tuple[str, str | None, int, int]]
    branches: list[tuple[str, int]]


_CONTROL = frozenset("if for while switch catch return new throw else do synchronized try sizeof when match foreach using lock elseif guard repeat until unless case in await assert super this".split())


def _called_heads(m: Masked, names: str, tail: str, kind: str, control=_CONTROL, accept: Callable[[re.Match], bool] | None = None) -> Iterator[tuple[str, str, int, int]]:
    """name(…) followed by a tail that ends with the body's brace, or with => for a body that is an expression."""
    for h in m.find(rf"({names})\s*(?:<[\w\s,.?&]*>\s*)?\("):
        opening = h.end() - 1
        if h.group(1) in control or opening not in m.partner or (accept and not accept(h)):
            continue
        if (t := m.after(tail, m.end(opening))) is None:
            continue
        end = m.end(t.end() - 1) if m.text[t.end() - 1] == "{" else m.expression_end(t.end()) + 1
        yield kind, h.group(1), m.begin(h.start()), min(end, len(m.text))


def _words(m: Masked, kinds: dict[str, str]) -> list[tuple[str, int]]:
    """Decisions that are words: word to kind."""
    return [(kinds[x.group()], x.start()) for x in m.find(r"(?<![\w.$@])(?:" + "|".join(kinds) + r")(?![\w?!]|\s*:(?!:))")]


def _signs(m: Masked, kinds: dict[str, str]) -> list[tuple[str, int]]:
    return [(kinds[x.group()], x.start()) for x in m.find("|".join(map(re.escape, sorted(kinds, key=len, reverse=True))))]


_AND_OR = {"&&": "binary_expression", "||": "binary_expression"}


def _ternaries(m: Masked, kind: str, avoid: str = r"[?.:\]\[,>)]") -> list[tuple[str, int]]:
    """A question mark with a colon behind it at its own depth."""
    out = []
    for q in m.find(r"(?<![?<\w])\?(?![?.])|(?<=\w)\s*\?(?![?.:])"):
        at = q.end() - 1
        k = m.expression_end(at + 1, ":;,)]}")
        if k < len(m.text) and m.text[k] == ":" and re.compile(r"\S").search(m.text, at + 1, k):
            out.append((kind, at))
    return out


def _without_do_tails(m: Masked, found: list[tuple[str, int]], loop: str, word: str = "while") -> list[tuple[str, int]]:
    """Drops the while that ends a do … while."""
    tails = set()
    for d in m.find(r"(?<!\w)(?:do|repeat)\s*\{"):
        if t := m.after(rf"\s*{word}\b", m.end(d.end() - 1)):
            tails.add(t.end() - len(word))
    for d in m.find(r"(?<!\w)do\s+(?!\{)"):
        k = m.next(d.end(), ";{}")
        if k is not None and m.text[k] == ";" and (t := m.after(r"\s*while\b", k + 1)):
            tails.add(t.end() - 5)
    return [(k, p) for k, p in found if not (k == loop and p in tails)]


def _switch_spans(m: Masked, head: str) -> list[tuple[int, int]]:
    """The braces of each switch or match."""
    out = []
    for s in m.find(head):
        opening = s.end() - 1
        if m.text[opening] == "(":
            t = m.after(r"\s*\{", m.end(opening))
            if t is None:
                continue
            opening = t.end() - 1
        elif m.text[opening] != "{":
            opening = m.expression_end(s.end(), "{;}")
        if opening in m.partner:
            out.append((opening, m.partner[opening]))
    return out


def _direct(m: Masked, spans: list[tuple[int, int]], at: int) -> bool:
    """Whether the innermost bracket around a place is one of the spans."""
    own = m.innermost(at)
    return own >= 0 and own in m.starts(spans)


def _groups(places: list[int], m: Masked) -> list[int]:
    """The first of labels that follow each other without a statement between."""
    out, last = [], None
    for p in sorted(places):
        end = m.expression_end(p, ":}") + 1
        if last is None or m.text[last:p].strip():
            out.append(p)
        last = end
    return out


def _java(m: Masked) -> Found:
    classes = {c.group(1) for c in m.find(r"\b(?:class|record|enum)\s+(\w+)")}
    functions = []
    for kind, name, a, b in _called_heads(m, r"(?<![\w.])\w+", r"\s*(?:throws\s+[\w.,\s]+)?\{", "method_declaration"):
        at = m.text.find(name, a)
        before = m.before(a, at)
        if re.search(r"(?:^|\s)new$|[=(,.]$|->$", before):
            continue
        if name in classes and not re.search(r"(?:[\w>\]])$", re.sub(r"\b(?:public|private|protected)\b|@\w+(?:\([^)]*\))?", "", before).strip()):
            kind = "constructor_declaration"
        elif not before:
            continue
        functions.append((kind, name, a, b))
    switches = _switch_spans(m, r"\bswitch\s*\(")
    for x in m.find(r"->"):
        if re.compile(r"(?:case|default)\b").match(m.text, m.begin(x.start()), x.start()) and _direct(m, switches, x.start() - 1):
            continue
        functions.append(("lambda_expression", None, _parameters_begin(m, x.start()), _body_end(m, x.end())))
    branches = _without_do_tails(m, _words(m, {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "catch": "catch_clause"}), "while_statement")
    labels = [x for x in m.find(r"\b(?:case|default)\b") if _direct(m, switches, x.start() - 1)]
    rules = [x.start() for x in labels if m.text[(k := m.expression_end(x.end(), ":-;}")) : k + 2] == "->"]
    branches += [("switch_rule", p) for p in rules] + [("switch_block_statement_group", p) for p in _groups([x.start() for x in labels if x.start() not in rules], m)]
    return Found(functions, branches + _ternaries(m, "ternary_expression") + _signs(m, _AND_OR))


def _parameters_begin(m: Masked, arrow: int) -> int:
    """The start of the name or the parentheses before an arrow."""
    k = arrow
    while k and m.text[k - 1].isspace():
        k -= 1
    if k and m.text[k - 1] == ")":
        return m.opener.get(k - 1, k - 1)
    while k and (m.text[k - 1].isalnum() or m.text[k - 1] == "_"):
        k -= 1
    return k


def _body_end(m: Masked, at: int) -> int:
    """Behind a body: braces, or an expression."""
    t = m.after(r"\s*", at)
    return m.end(t.end()) if t.end() < len(m.text) and m.text[t.end()] == "{" else m.expression_end(t.end())


def _c(m: Masked, plus: bool = False) -> Found:
    classes = [(x.end(), m.end(x.end())) for x in m.find(r"\b(?:class|struct|union)\s[\w:<>,\s]*+") if m.text.startswith("{", x.end())] if plus else []
    functions = []
    tail = r"\s*(?:(?:const|noexcept|override|final|volatile|&|&&)\s*)*(?:->\s*[\w:<>*&\s]+)?(?::\s*\w[^{;]*)?\{" if plus else r"\s*\{"
    for kind, name, a, b in _called_heads(m, r"(?<![\w.>:~])(?:\w+::)*~?\w+" if plus else r"(?<![\w.>])\w+", tail, "function_definition"):
        before = m.before(a, m.text.find(name, a))
        if not before and "::" not in name or re.search(r"[=(,\]]$|\belse$|\breturn$", before) or re.match(r"(?:struct|enum|union|class)\s+\w*\s*\{", before):
            continue
        own = m.inside(classes, a)
        if "::" not in name and own and _direct(m, [own], a - 1):
            continue  # a method inside its class has no plain name in the grammar
        functions.append((kind, name, a, b))
    if plus:
        for x in m.find(r"(?<![\w\])])\[[^\[\];{}]*\]\s*(?=[({])"):
            at = x.end()
            if m.text[at] == "(":
                t = m.after(r"\s*(?:mutable|noexcept)?\s*(?:->\s*[\w:<>*&\s]+)?\{", m.end(at))
                if t is None:
                    continue
                at = t.end() - 1
            functions.append(("lambda_expression", None, x.start(), m.end(at)))
    kinds = {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement"} | ({"catch": "catch_clause"} if plus else {})
    branches = [(k, p) for k, p in _without_do_tails(m, _words(m, kinds), "while_statement") if not re.search(r"#[ \t]*$", m.text[max(0, p - 20) : p])]
    branches += [("case_statement", x.start()) for x in m.find(r"\bcase\b|\bdefault(?=\s*+:(?!:))") if x.group() == "default" or (k := m.next(x.end(), ":;{}")) is not None and m.text[k] == ":" and not m.text.startswith(":", k + 1)]
    branches += [({"if": "preproc_if", "ifdef": "preproc_ifdef", "ifndef": "preproc_ifdef", "elif": "preproc_elif", "elifdef": "preproc_elifdef", "elifndef": "preproc_elifdef"}[x.group(1)], x.start()) for x in m.find(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|elifdef|elifndef)\b")]
    return Found(functions, branches + _ternaries(m, "conditional_expression") + _signs(m, _AND_OR))


def _bash(m: Masked) -> Found:
    functions = [("function_definition", x.group(1) or x.group(2), x.start(1) if x.group(1) and not x.group(0).lstrip().startswith("function") else x.start() + len(x.group(0)) - len(x.group(0).lstrip()), m.end(x.end() - 1)) for x in m.find(r"^[ \t]*(?:function\s+)?([\w:-]+)\s*\(\s*\)\s*\{|^[ \t]*function\s+([\w:-]+)\s*\{")]
    command = r"(?:^|[;&|({]|\bthen\b|\bdo\b|\belse\b|!)[ \t]*"
    kinds = {"if": "if_statement", "elif": "elif_clause", "for": "for_statement", "select": "for_statement", "while": "while_statement", "until": "while_statement"}
    branches = [(kinds[x.group(1)], x.start(1)) for x in m.find(command + r"(if|elif|for|select|while|until)\b")]
    esacs, until = [x.start() for x in m.find(r"\besac\b")], 0
    for line in m.find(r"^.*\bcase\b.*$"):  # from the last in of a line on to the next esac
        first = re.compile(r"\bcase\b").search(line.group()).end()
        places = [x.start() for x in re.compile(r"\bin\b").finditer(line.group(), first)]
        if not places:
            continue
        k = bisect_left(esacs, line.start() + places[-1])
        body, end = max(until, line.start() + places[-1] + 2), esacs[k] if k < len(esacs) else len(m.text)
        branches += [("case_item", x.start(1)) for x in re.compile(r"(?:^|;;&?|;&|(?<=in))\s*(\(?[^\s();&|][^()\n;]*\))", re.M).finditer(m.text, body, end)]
        until = max(until, end)
    tests = _tests(m)
    in_test = lambda p: (k := bisect_right(tests, (p, 0)) - 1) >= 0 and tests[k][0] < p < tests[k][1]
    branches += [("binary_expression", p) for _, p in _signs(m, _AND_OR) if in_test(p)]
    branches += [("ternary_expression", x.start()) for x in m.find(r"(?<=\s)\?(?=\s)") if in_test(x.start())]
    return Found(functions, branches)


def _tests(m: Masked) -> list[tuple[int, int]]:
    """[[ … ]] and (( … )) within a line, from left to right."""
    closers = {"[[": [x.start() for x in m.find(r"\](?=\])")], "((": [x.start() for x in m.find(r"\)(?=\))")]}
    lines, out, at = [x.start() for x in m.find("\n")] + [len(m.text)], [], 0
    for x in m.find(r"\[(?=\[)|\((?=\()"):
        if x.start() < at:
            continue
        own = closers[x.group() * 2]
        k = bisect_left(own, x.start() + 2)
        if k < len(own) and own[k] < lines[bisect_left(lines, x.start())]:
            at = own[k] + 2
            out.append((x.start(), at))
    return out


def _dart(m: Masked) -> Found:
    classes = {x.group(1): (m.text.index("{", x.start()), m.end(m.text.index("{", x.start()))) for x in m.find(r"\b(?:class|mixin|enum|extension)\s+(\w+)[^{;]*\{")}
    spans = [*classes.values()]
    functions, heads = [], set()
    for h in m.find(r"(?<![\w.])(\w+(?:\.\w+)?)\s*(?:<[\w\s,.?]*>\s*)?\("):
        name, opening = h.group(1), h.end() - 1
        if name in _CONTROL or name == "Function" or opening not in m.partner:
            continue
        t = m.after(r"\s*(?:async\*?|sync\*)?\s*(\{|=>)", m.end(opening))
        a = m.begin(h.start())
        own = m.inside(spans, a)
        in_class = own is not None and _direct(m, [own], a - 1)
        before = m.before(a, h.start())
        if in_class and name.split(".")[0] in classes and classes[name.split(".")[0]] == own and not before.replace("const", "").replace("factory", "").strip():
            functions.append(("constructor_signature", name, a, m.end(opening)))
            continue
        if t is None or "." in name or re.search(r"[=(,:]$|=>$", before):
            continue
        outer = in_class or not _enclosed(m, a)
        if not before and not outer:
            continue
        heads.add(opening)
        end = m.end(t.end() - 1) if t.group(1) == "{" else m.expression_end(t.end()) + 1
        functions.append(("method_declaration" if in_class else "function_declaration" if outer else "local_function_declaration", name if outer else None, a, min(end, len(m.text))))
    for x in m.find(r"(?<![\w)>\]])\((?=[^()]*\)\s*(?:async\*?|sync\*)?\s*(?:\{|=>))"):
        if x.start() not in heads and not re.search(r"\b(?:if|for|while|switch|catch)\s*$", m.text[max(0, x.start() - 12) : x.start()]):
            t = m.after(r"\s*(?:async\*?|sync\*)?\s*(?:\{|=>)", m.end(x.start()))
            functions.append(("function_expression", None, x.start(), m.end(t.end() - 1) if m.text[t.end() - 1] == "{" else m.expression_end(t.end())))
    switches = _switch_spans(m, r"\bswitch\s*\(")
    branches = _without_do_tails(m, _words(m, {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "catch": "catch_clause"}), "while_statement")
    branches = [(k, p) for k, p in branches if not (k == "if_statement" and _in_list(m, p))]
    branches += [("switch_statement_case" if x.group().startswith("case") else "switch_statement_default", x.start()) for x in m.find(r"\bcase\b|\bdefault\s*:") if _direct(m, switches, x.start() - 1)]
    branches += [("switch_expression_case", x.start()) for x in m.find(r"=>") if _direct(m, switches, x.start() - 1)]
    return Found(functions, branches + _ternaries(m, "conditional_expression") + _signs(m, {"??": "if_null_expression", "&&": "logical_and_expression", "||": "logical_or_expression"}))


def _in_list(m: Masked, at: int) -> bool:
    """Whether the innermost bracket around a place is square or round."""
    own = m.innermost(at - 1)
    return own >= 0 and m.text[own] != "{"


def _enclosed(m: Masked, at: int) -> bool:
    """Whether a brace is open around a place."""
    own = m.innermost(at - 1)
    while own >= 0 and m.text[own] != "{":
        own = m.outer[own]
    return own >= 0


def _ended(m: Masked, opens: str, closes: str = r"\bend\b") -> dict[int, int]:
    """Opening word's place to the place behind its end word."""
    out, stack = {}, []
    for x in m.find(rf"(?P<open>{opens})|(?P<close>{closes})"):
        if x.group("open") is not None:
            stack.append(x.start("open"))
        elif stack:
            out[stack.pop()] = x.end()
    return out


def _elixir(m: Masked) -> Found:
    ends = _ended(m, r"(?<![\w:.])(?:do(?!\s*:)|fn)\b", r"(?<![\w:.])end\b")
    functions = []
    for x in m.find(r"^[ \t]*(defp?)\s+([a-z_]\w*[?!]?)\s+do\b"):
        at = x.end() - 2
        functions.append(("call", x.group(2), x.start(1), ends.get(at, len(m.text))))
    functions += [("anonymous_function", None, x.start(), ends.get(x.start(), len(m.text))) for x in m.find(r"(?<![\w:.])fn\b")]
    branches = _words(m, {"catch": "catch_block", "rescue": "rescue_block", "or": "binary_operator", "and": "binary_operator"})
    return Found(functions, branches + _signs(m, {"->": "stab_clause"}) + _signs(m, {"&&": "binary_operator", "||": "binary_operator"}))


def _erlang(m: Masked) -> Found:
    functions = []
    ends = _ended(m, r"\b(?:begin|case|if|receive|try|maybe)\b|\bfun\b(?=\s*\()", r"\bend\b")
    for x in m.find(r"^([a-z]\w*)\s*\("):
        t = m.after(r"[^;.]*?->", m.end(x.end() - 1))
        if t:
            functions.append(("function_clause", x.group(1), x.start(), _erlang_end(m, t.end(), ends)))
    functions += [("anonymous_fun", None, x.start(), ends.get(x.start(), len(m.text))) for x in m.find(r"\bfun\b(?=\s*\()")]
    kinds = {"if": "if_expr", "case": "case_expr", "try": "try_expr", "maybe": "maybe_expr", "receive": "receive_expr", "after": "receive_after", "andalso": "binary_op_expr", "orelse": "binary_op_expr"}
    branches = _words(m, kinds)
    words = {a: m.after(r"\S*", a).group() for a in ends}
    blocks = list(ends.items())
    catches = [x.start() for x in m.find(r"\bcatch\b")]
    for x in m.find(r"->"):
        if (own := m.inside(blocks, x.start())) is not None:
            a, word = own[0], words[own[0]]
            if word.startswith("try") and (k := bisect_right(catches, a)) < len(catches) and catches[k] < x.start():
                branches.append(("catch_clause", x.start()))
            elif word.startswith("if"):
                branches.append(("if_clause", x.start()))
            elif re.match(r"case|receive|try", word) and not re.search(r"\bafter\b[^>]*$", m.before(a, x.start()).rsplit("->", 1)[-1]):
                branches.append(("cr_clause", x.start()))
    tries = [(a, b) for a, b in blocks if words[a].startswith("try")]
    branches += [("catch_expr", p) for p in catches if m.inside(tries, p) is None]
    return Found(functions, branches)


def _erlang_end(m: Masked, at: int, ends: dict[int, int]) -> int:
    """Behind a clause: the ; or . outside brackets and blocks."""
    while at < len(m.text):
        if at in ends:
            at = ends[at]
        elif m.text[at] in _OPENS:
            at = m.end(at)
        elif m.text[at] == ";" or (m.text[at] == "." and (at + 1 >= len(m.text) or m.text[at + 1].isspace())):
            return at
        else:
            at += 1
    return at


def _gleam(m: Masked) -> Found:
    functions = []
    for x in m.find(r"(?:\bpub\s+)?\bfn\s+(\w+)\s*\("):
        if t := m.after(r"\s*(?:->[^{]*)?\{", m.end(x.end() - 1)):
            functions.append(("function", x.group(1), x.start(), m.end(t.end() - 1)))
    for x in m.find(r"\bfn\s*\("):
        if t := m.after(r"\s*(?:->[^{]*)?\{", m.end(x.end() - 1)):
            functions.append(("anonymous_function", None, x.start(), m.end(t.end() - 1)))
    cases = _switch_spans(m, r"\bcase\b")
    branches = [("case_clause", x.start()) for x in m.find(r"->") if _direct(m, cases, x.start() - 1)]
    branches += [("let_assert" if x.group().startswith("let") else "assert", x.start()) for x in m.find(r"\blet\s+assert\b|(?<!let )\bassert\b")]
    return Found(functions, branches + _signs(m, _AND_OR))


def _haskell(m: Masked) -> Found:
    functions, branches = [], []
    for x in m.find(r"^([ \t]*)([a-z_][\w']*)((?:[ \t]+[^\s=|:][^\n=|]*)?)[ \t]*(?:\n[ \t]+)?(=(?!=)|\|(?!\|))"):
        name, column = x.group(2), len(x.group(1))
        if not x.group(3).strip() or name in ("where", "let", "in", "if", "then", "else", "case", "of", "do", "data", "type", "newtype", "class", "instance", "import", "module", "deriving") or "<-" in x.group(3) or "->" in x.group(3) or "::" in x.group(3):
            continue
        functions.append(("function", name, x.start() + column, m.indented_end(x.start(), column)))
    for x in m.find(r"\\(?=[\w(\[{_~!])"):
        functions.append(("lambda", None, x.start(), min(m.expression_end(x.end(), ",)]}"), m.indented_end(x.start(), x.start() - m.text.rfind("\n", 0, x.start()) - 1))))
    multi = [x.start() for x in m.find(r"\bif\s*\|")]
    branches += [("multi_way_if", p) for p in multi] + [("conditional", x.start()) for x in m.find(r"(?<![\w'])if(?![\w'])") if x.start() not in multi]
    branches += [("guard", x.start(1)) for x in m.find(r"(?:^[ \t]+|\bif\s*|(?<=\S)[ \t]+)(\|)(?![|])[^\n|]*?(?:=(?![=>])|->)") if not re.search(r"^\s*(?:data|newtype)\b|[\[]", m.line_before(x.start(1)))]
    for x in m.find(r"(?<![\w'])of(?![\w'])|\\case\b"):
        line = m.text.rfind("\n", 0, x.start()) + 1
        first = m.after(r"\s*", x.end()).end()
        column = first - m.text.rfind("\n", 0, first) - 1
        end = m.indented_end(line, len(m.text[line:]) - len(m.text[line:].lstrip()))
        for a in re.compile(r"->").finditer(m.text, x.end(), max(end, x.end())):
            begin = m.text.rfind("\n", 0, a.start()) + 1
            start = max(begin, first)
            text = m.text[start : a.start()]
            if (start == first or len(text) - len(text.lstrip()) == column) and "->" not in text and "\\" not in text and not text.lstrip().startswith("|"):
                branches.append(("alternative", start + len(text) - len(text.lstrip())))
    branches += [("list_comprehension", x.start()) for x in m.find(r"\[[^\[\]|]*\|(?!\|)[^\]]*<-")]
    return Found(functions, branches + _signs(m, {"&&": "infix", "||": "infix"}))


def _julia(m: Masked) -> Found:
    ends = _ended(m, r"(?<![\w.:@])(?:function|macro|if|for|while|try|let|begin|do|struct|module|quote)\b(?!\s*[=,)])", r"(?<![\w.:@\[])end\b(?!\s*\])")
    around = [(a, b) for a, b in m.partner.items() if m.text[a] in "(["]
    inside = lambda at: m.inside(around, at) is not None
    functions = [("macro_definition" if x.group(1) == "macro" else "function_definition", x.group(2), x.start(), ends.get(x.start(), len(m.text))) for x in m.find(r"\b(function|macro)\s+([\w!]+)\s*(?=[({\n;]|$)")]
    functions += [("arrow_function_expression", None, _parameters_begin(m, x.start()), min(m.expression_end(x.end(), ",;)]}\n"), len(m.text))) for x in m.find(r"->")]
    branches = [(k, p) for k, p in _words(m, {"if": "if_statement", "elseif": "elseif_clause", "for": "for_statement", "while": "while_statement", "catch": "catch_clause", "finally": "finally_clause"}) if not (k in ("for_statement", "if_statement") and inside(p))]
    return Found(functions, branches + [(k, p) for k, p in _ternaries(m, "ternary_expression")])


def _lua(m: Masked) -> Found:
    ends = _ended(m, r"\b(?:function|if|do)\b|\brepeat\b", r"\bend\b|\buntil\b")
    functions = []
    for x in m.find(r"(\blocal\s+)?\bfunction\b\s*([\w.:]*)\s*\("):
        at = x.start() + x.group().index("function")
        name = x.group(2)
        if name and re.search(r"[.:]", name):
            continue
        functions.append(("function_declaration" if name else "function_definition", name or None, x.start() if name else at, ends.get(at, len(m.text))))
    return Found(functions, _words(m, {"if": "if_statement", "elseif": "elseif_statement", "for": "for_statement", "while": "while_statement", "repeat": "repeat_statement", "and": "binary_expression", "or": "binary_expression"}))


def _ocaml(m: Masked) -> Found:
    functions = []
    for x in m.find(r"^([ \t]*)(let|and)\s+(?:rec\s+)?([a-z_][\w']*)((?:\s+(?!=)(?:[~?]?[\w']+(?::[^\s=]+)?|\([^()]*\)|\(\)))+)(?:\s*:\s*[^=]+)?\s*=(?!=)"):
        column = len(x.group(1))
        functions.append(("value_definition", x.group(3), x.start() + column, m.indented_end(x.start(), column)))
    functions += [("function_expression" if x.group().startswith("function") else "fun_expression", None, x.start(), min(m.expression_end(x.end(), ")]}"), m.indented_end(m.text.rfind("\n", 0, x.start()) + 1, x.start() - m.text.rfind("\n", 0, x.start()) - 1))) for x in m.find(r"(?<![\w'])(?:function|fun)(?![\w'])")]
    branches = [b for b in _words(m, {"if": "if_expression", "while": "while_expression", "for": "for_expression", "try": "try_expression"})]
    arms = [x.end() for x in m.find(r"(?<![\w'])(?:with|function)(?![\w'])")]
    first = [p for p in arms if not m.after(r"\s*\|", p)]
    types = [(x.start(), (n.start() if (n := re.compile(r"^\S", re.M).search(m.text, x.end())) else len(m.text))) for x in m.find(r"^type\b")]
    branches += [("match_case", p) for p in first] + [("match_case", x.start()) for x in m.find(r"(?<!\|)\|(?![|\]])") if m.inside(types, x.start()) is None and re.compile(r"[^|\n]*?(?:->|when\b)").match(m.text, x.end())]
    return Found(functions, branches + _signs(m, {"&&": "infix_expression", "||": "infix_expression"}))


def _ruby(m: Masked) -> Found:
    line = r"(?:^|;|=|\(|\bthen\b|\bdo\b|\belse\b|&&|\|\|)[ \t]*"
    ends, stack = {}, []
    loops_do = set()
    for x in m.find(r"(?P<close>\bend\b(?![?!:]))|(?P<def>(?<![.:])\bdef\b)|(?P<other>(?<![.:@])\b(?:class|module|begin|case)\b(?!:))|(?P<do>\bdo\b)|(?:" + line + r")(?P<head>(?:if|unless|while|until|for)\b)"):
        if x.group("close"):
            if stack:
                ends[stack.pop()] = x.end()
        elif x.group("def"):
            if not re.compile(r"def\s+[\w.?!=]+(?:\([^)]*\))?\s*=\s").match(m.text, x.start()):
                stack.append(x.start())
        elif x.group("do"):
            row = m.text.rfind("\n", 0, x.start()) + 1
            if row in loops_do:
                loops_do.discard(row)
            else:
                stack.append(x.start())
        else:
            at = x.start("other") if x.group("other") else x.start("head")
            if x.group("head") in ("while", "until", "for"):
                loops_do.add(m.text.rfind("\n", 0, at) + 1)
            stack.append(at)
    functions = []
    for x in m.find(r"(?<![.:])\bdef\s+(self\.)?([\w]+[?!=]?|[+\-*/<>=!\[\]%&|^~]+)"):
        end = ends.get(x.start(), m.text.find("\n", x.end()) if m.text.find("\n", x.end()) >= 0 else len(m.text))
        functions.append(("singleton_method" if x.group(1) else "method", x.group(2), x.start(), end))
    kinds = {"if": "if", "elsif": "elsif", "unless": "unless", "when": "when", "while": "while", "until": "until", "for": "for", "rescue": "rescue", "and": "binary", "or": "binary"}
    branches = [(k + "_modifier" if k in ("if", "unless", "while", "until") and not re.search(r"(?:^|[;=(]|\bthen|\bdo|\belse)\s*$", m.line_before(p)) else k, p) for k, p in _words(m, kinds)]
    branches += [("in_clause", x.start(1)) for x in m.find(r"^[ \t]*(in)\b")]
    return Found(functions, branches + _ternaries(m, "conditional") + _signs(m, {"&&": "binary", "||": "binary"}))


def _php(m: Masked) -> Found:
    classes = [(m.text.index("{", x.start()), m.end(m.text.index("{", x.start()))) for x in m.find(r"\b(?:class|interface|trait|enum)\s+\w+[^{;]*\{")]
    functions = []
    for x in m.find(r"\bfunction\s+&?\s*(\w+)\s*\("):
        if t := m.after(r"\s*(?::\s*[?\w|\\]+)?\s*\{", m.end(x.end() - 1)):
            own = m.inside(classes, x.start())
            inside = own is not None and _direct(m, [own], x.start() - 1)
            functions.append(("method_declaration" if inside else "function_definition", x.group(1), m.begin(x.start()) if inside else x.start(), m.end(t.end() - 1)))
    for x in m.find(r"(?:\bstatic\s+)?\bfunction\s*&?\s*\("):
        if t := m.after(r"\s*(?:use\s*\([^)]*\))?\s*(?::\s*[?\w|\\]+)?\s*\{", m.end(x.end() - 1)):
            functions.append(("anonymous_function", None, x.start(), m.end(t.end() - 1)))
    for x in m.find(r"(?:\bstatic\s+)?\bfn\s*&?\s*\("):
        if t := m.after(r"\s*(?::\s*[?\w|\\]+)?\s*=>", m.end(x.end() - 1)):
            functions.append(("arrow_function", None, x.start(), m.expression_end(t.end())))
    kinds = {"if": "if_statement", "elseif": "else_if_clause", "for": "for_statement", "foreach": "foreach_statement", "while": "while_statement", "do": "do_statement", "catch": "catch_clause"}
    branches = _without_do_tails(m, _words(m, kinds), "while_statement")
    matches, switches = _switch_spans(m, r"\bmatch\s*\("), _switch_spans(m, r"\bswitch\s*\(")
    branches += [("case_statement" if x.group().startswith("case") else "default_statement", x.start()) for x in m.find(r"\bcase\b|\bdefault\s*:") if _direct(m, switches, x.start() - 1)]
    branches += [("match_default_expression" if re.search(r"\bdefault$", m.before(0, x.start(), 80)) else "match_conditional_expression", x.start()) for x in m.find(r"=>") if _direct(m, matches, x.start() - 1)]
    return Found(functions, branches + _ternaries(m, "conditional_expression") + _signs(m, _AND_OR | {"??": "binary_expression"}))


def _scala(m: Masked) -> Found:
    functions = []
    for x in m.find(r"^([ \t]*)(?:[\w@]+[ \t]+)*?def[ \t]+(\w+)(?:\[[^\]]*\])?(?:[ \t]*\([^()]*(?:\([^()]*\)[^()]*)*\))*[ \t]*(?::[^=\n{]+)?=[ \t]*(\{)?"):
        column = len(x.group(1))
        functions.append(("function_definition", x.group(2), x.start() + column, m.end(x.start(3)) if x.group(3) else m.indented_end(x.start(), column)))
    for x in m.find(r"=>"):
        head = m.line_before(x.start())
        at = _parameters_begin(m, x.start())
        if re.search(r"\bcase\b[^=]*$", head) or re.search(r":\s*$", m.text[max(0, at - 3) : at]) or at >= x.start():
            continue
        line = m.text.rfind("\n", 0, x.start()) + 1
        block = m.indented_end(line, m.after(r"[ \t]*", line).end() - line)
        functions.append(("lambda_expression", None, at, _body_end(m, x.end()) if m.after(r"\s*\{", x.end()) else min(m.expression_end(x.end(), ",;)]}"), block)))
    kinds = {"if": "if_expression", "while": "while_expression", "for": "for_expression", "case": "case_clause", "catch": "catch_clause", "finally": "finally_clause", "try": "try_expression", "do": "do_while_expression"}
    branches = [(k, p) for k, p in _without_do_tails(m, _words(m, kinds), "while_expression") if not (k == "case_clause" and m.after(r"case\s+(?:class|object)\b", p)) and not (k == "do_while_expression" and not m.after(r"do\s*\{", p)) and not (k == "if_expression" and re.search(r"(?:<-[^;{}]*|\bcase\b[^=\n]*)$", m.text[max(0, p - 80) : p].rsplit("\n", 1)[-1]))]
    return Found(functions, branches + _signs(m, {"&&": "infix_expression", "||": "infix_expression"}))


def _swift(m: Masked) -> Found:
    functions, bodies = [], set()
    for x in m.find(r"\b(?:func[ \t]+([^\s(<]+)(?:<[^>]*>)?|(init)[?!]?(?:<[^>]*>)?|(subscript))\s*\("):
        t = m.after(r"\s*(?:async\b)?\s*(?:throws|rethrows)?\s*(?:->\s*[^{\n;]+?)?\s*(?:where[^{]*)?\{", m.end(x.end() - 1))
        if t and not re.search(r"\.\s*$", m.text[max(0, x.start() - 2) : x.start()]):
            kind = "function_declaration" if x.group(1) else "init_declaration" if x.group(2) else "subscript_declaration"
            functions.append((kind, x.group(1), m.begin(x.start(), ";{}\n"), m.end(t.end() - 1)))
            bodies.add(t.end() - 1)
    for x in m.find(r"\bdeinit\s*\{"):
        functions.append(("deinit_declaration", None, x.start(), m.end(x.end() - 1)))
        bodies.add(x.end() - 1)
    for x in m.find(r"\{"):
        line = m.line_before(x.start())
        if x.start() in bodies or x.start() not in m.partner:
            continue
        if m.after(r"\{\s*(?:\[[^\]]*\]\s*)?(?:\([^()]*\)|[\w, ]+)\s*(?:->\s*[\w?.]+\s*)?\bin\b", x.start()) or re.search(r"(?:[=(,:]|\breturn)\s*$", line) or (re.search(r"[\w)]\s*$", line) and not re.search(r"\b(?:if|guard|for|while|switch|else|do|catch|repeat|class|struct|enum|protocol|extension|func|init|var|let\s+\w+\s*:|get|set|didSet|willSet|defer|case|default|actor)\b", line)):
            functions.append(("lambda_literal", None, x.start(), m.end(x.start())))
    branches = _without_do_tails(m, _words(m, {"if": "if_statement", "guard": "guard_statement", "for": "for_statement", "while": "while_statement", "repeat": "repeat_while_statement", "catch": "catch_block"}), "while_statement")
    switches = _switch_spans(m, r"\bswitch\b")
    branches += [("switch_entry", x.start()) for x in m.find(r"\bcase\b|\bdefault\s*:") if _direct(m, switches, x.start() - 1)]
    return Found(functions, branches + _ternaries(m, "ternary_expression") + _signs(m, {"??": "nil_coalescing_expression", "&&": "conjunction_expression", "||": "disjunction_expression"}))


def _zig(m: Masked) -> Found:
    functions = []
    for x in m.find(r"\bfn\s+(\w+)\s*\("):
        opening = m.expression_end(m.end(x.end() - 1), "{;")
        if opening < len(m.text) and m.text[opening] == "{":
            start = k = x.start()
            while k and m.text[k - 1].isspace():
                end = len(m.text[max(0, k - 400) : k].rstrip()) + max(0, k - 400)
                word = re.search(r"\b(?:pub|export|inline|extern)$", m.text[max(0, end - 7) : end])
                if word is None:
                    break
                start = k = end - len(word.group())
            functions.append(("function_declaration", x.group(1), start, m.end(opening)))
    functions += [("test_declaration", x.group(1), x.start(), m.end(x.end() - 1)) for x in m.find(r"^[ \t]*test\s+(\w+)\s*\{")]
    kinds = {"if": "if_expression", "while": "while_expression", "for": "for_expression", "try": "try_expression", "catch": "catch_expression", "and": "binary_expression", "or": "binary_expression"}
    switches = _switch_spans(m, r"\bswitch\s*\(")
    return Found(functions, _words(m, kinds) + [("switch_case", x.start()) for x in m.find(r"=>") if _direct(m, switches, x.start() - 1)])


SCANNERS: dict[str, Callable[[Masked], Found]] = {
    "bash": _bash, "java": _java, "cpp": lambda m: _c(m, True), "c": _c, "dart": _dart, "elixir": _elixir, "erlang": _erlang, "gleam": _gleam, "haskell": _haskell, "julia": _julia, "lua": _lua, "ocaml": _ocaml, "ruby": _ruby, "php": _php, "scala": _scala, "swift": _swift, "zig": _zig,
}


def scan(language: str, text: str) -> Node:
    """The outline of a text as a tree: a function has its name as a child, a decision is a leaf."""
    found = SCANNERS[language](Masked(text, RULES[language]))
    root = Node("source_file", 0, len(text), [])
    for kind, name, a, b in found.functions:
        node = Node(kind, a, max(b, a))
        if name is not None:
            at = max(text.find(name, a), a)
            node.children.append(Node("identifier", at, at + len(name), field="name"))
        root.children.append(node)
    root.children += [Node(kind, p, p + 1) for kind, p in found.branches]
    root.children.sort(key=lambda n: (n.start, -n.end))
    return root
