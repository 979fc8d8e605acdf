"""Tokens of program text: one scanner, set up by a language's comment, string and operator rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

#: Kinds of tokens; LINE ends a line where the language cares, its number is the next line's indentation.
NAME, NUMBER, STRING, OP, LINE = "name", "number", "string", "op", "line"


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    #: White space before it, and the position where its line began, if it is the first there.
    apart: bool = False
    indent: int = -1


@dataclass
class Rules:
    """How a language writes what isn't syntax.

    Strings: (opening pattern, closing text, style). Style "line" has backslash escapes and ends with its
    line, "lines" has escapes, "raw" has none. The closing "#" is a quote and as many signs as the opening
    has, "same" the opening's last three characters.
    """

    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    nested_comments: bool = False
    strings: tuple[tuple[str, str, str], ...] = (('"', '"', "line"), ("'", "'", "line"))
    names: str = r"[^\W\d][\w]*"
    numbers: str = r"0[xXbBoO][\w]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?\w*|\.\d[\d_]*(?:[eE][+-]?\d+)?\w*"
    operators: tuple[str, ...] = ()
    lines: bool = False
    regexes: bool = False
    #: Text that a rule of its own takes as one token: (pattern, kind).
    special: tuple[tuple[str, str], ...] = field(default=())

    @cached_property
    def pattern(self) -> re.Pattern:
        parts = [r"(?P<newline>\n)"]
        if self.special:
            parts += [f"(?P<special{k}>{x})" for k, (x, _) in enumerate(self.special)]
        if self.line_comments:
            parts.append("(?P<comment>(?:" + "|".join(self.line_comments_patterns) + r")[^\n]*)")
        parts += [f"(?P<block{k}>{re.escape(a)})" for k, (a, _) in enumerate(self.block_comments)]
        parts += [f"(?P<string{k}>{a})" for k, (a, _, _) in enumerate(self.strings)]
        parts += [f"(?P<number>{self.numbers})", f"(?P<name>{self.names})"]
        if self.operators:
            parts.append("(?P<op>" + "|".join(map(re.escape, sorted(self.operators, key=len, reverse=True))) + ")")
        return re.compile(r"[^\S\n]*+(?:" + "|".join([*parts, "(?P<other>.)"]) + ")", re.S)  # white space goes before a token

    @property
    def line_comments_patterns(self) -> list[str]:
        """Comment openings; those that look like patterns are taken as such."""
        return [x if "(?" in x else re.escape(x) for x in self.line_comments]


def _block_end(text: str, at: int, opening: str, closing: str, nested: bool) -> int:
    if not nested:
        end = text.find(closing, at + len(opening))
        return len(text) if end < 0 else end + len(closing)
    step, depth, at = re.compile(f"{re.escape(opening)}|{re.escape(closing)}"), 1, at + len(opening)
    while depth and (m := step.search(text, at)):
        depth += 1 if m.group() == opening else -1
        at = m.end()
    return at if not depth else len(text)


def _string_end(text: str, at: int, closing: str, style: str) -> int:
    """Behind the closing text; an unclosed one-line string ends with its line."""
    escapes = style != "raw"
    stop = re.compile((r"\\.|" if escapes else "") + re.escape(closing) + (r"|\n" if style == "line" else ""), re.S)
    while m := stop.search(text, at):
        if m.group() == "\n":
            return m.start()
        at = m.end()
        if m.group() == closing:
            return at
    return len(text)


_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


def _regex_may_begin(before: Token | None) -> bool:
    if before is None or before.kind == LINE:
        return True
    return before.text not in (")", "]", "}", "++", "--") if before.kind == OP else before.text in ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "else", "do", "await")


def tokens(text: str, rules: Rules) -> list[Token]:
    """All tokens in order, in time linear in the text. Comments and white space have none."""
    out: list[Token] = []
    at, apart, depth, begun = 0, True, 0, 0
    first, lines, slashes = True, rules.lines, rules.regexes
    match, append = rules.pattern.match, out.append
    while m := match(text, at):  # none behind the last token
        kind, word, end = m.lastgroup, m[m.lastindex], m.end()
        start = end - len(word)
        if start > at:
            apart = True
        if kind == "name" or kind == "number":
            append(Token(kind, word, start, end, apart, start - begun if first else -1))
            apart = first = False
        elif (kind == "op" or kind == "other") and not (slashes and word[0] == "/"):
            if lines:
                depth += (word in "([{") - (word in ")]}")
            append(Token(OP, word, start, end, apart, start - begun if first else -1))
            apart = first = False
        elif kind == "newline":
            if lines and out and out[-1].kind != LINE and depth <= 0:
                append(Token(LINE, "\n", start, end))
            apart, begun, first = True, end, True
        elif kind == "comment":
            apart = True
        elif kind.startswith("block"):
            opening, closing = rules.block_comments[int(kind[5:])]
            end = _block_end(text, start, opening, closing, rules.nested_comments)
            apart = True
        else:
            if kind.startswith("string"):
                _, closing, style = rules.strings[int(kind[6:])]
                closing = '"' + "#" * word.count("#") if closing == "#" else word[-3:] if closing == "same" else closing
                end, kind = _string_end(text, end, closing, style), STRING
            elif slashes and word[0] == "/" and _regex_may_begin(out[-1] if out else None) and (r := _REGEX.match(text, start)):
                end, kind = r.end(), STRING
            elif kind.startswith("special"):
                kind = rules.special[int(kind[7:])][1]
            else:
                kind = OP
                if lines:
                    depth += (word in "([{") - (word in ")]}")
            append(Token(kind, text[start:end], start, end, apart, start - begun if first else -1))
            apart = first = False
        at = end
    if rules.lines and out and out[-1].kind != LINE:
        out.append(Token(LINE, "\n", len(text), len(text)))
    return out


def partners(found: list[Token]) -> dict[int, int]:
    """Opening to closing bracket, by token number; a bracket without partner has none."""
    out, stack = {}, []
    closes = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(found):
        if t.kind == OP:
            if t.text in ("(", "[", "{"):
                stack.append(i)
            elif t.text in closes:
                for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                    if found[stack[k]].text == closes[t.text]:
                        out[stack[k]] = i
                        del stack[k:]
                        break
    return out
