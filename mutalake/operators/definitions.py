"""Files of plain definitions, one after the other: a line that was parsed in such a file is not parsed again.

A plain file is a comment, package or class line, functions whose head is one line and whose body holds
statements of one line each, and what closes it. Its lines hold no quotes, comments or line ends of
another kind, every bracket closes in its line, and no line goes on with the one before, so the parser
comes to each statement in the same state and leaves it at the line's end. What a statement yields
then follows from its text, and a file's result is that of its lines, moved. Each new line is parsed in
small files of its own, once and twice a function; where these don't bear that out, and in all other
files, the text is parsed whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field

from mutalake.syntax.automaton import Automaton
from mutalake.syntax.expressions import _NO_OPERAND
from mutalake.syntax.languages import BINARY
from mutalake.syntax.nodes import Node

#: Frames, and lines of a frame, that a task remembers.
FRAMES, LINES = 1_000, 5_000
_SAFE = r"[A-Za-z0-9_ (){}\[\]=!&|+\-;:,.<>*%^]*"
_COMMENT = r"(?:{}[A-Za-z0-9_ ]*\n)?"
_REST = r"\([A-Za-z0-9_ ,:&]*\)(?:(?: ->|:)? [A-Za-z0-9_]+)? \{\n"
# Language: what opens a file, what begins a head before its name, the rest of it, what a line begins with, what closes a function, what closes the file.
_FORMS = {
    "rust": (_COMMENT.format("//"), "fn ", _REST, " *", r" *\}\n", r"(?://[A-Za-z0-9_ ]*)?\n?"),
    "javascript": (_COMMENT.format("//"), "function ", _REST, " *", r" *\}\n", r"(?://[A-Za-z0-9_ ]*)?\n?"),
    "go": (r"(?:package [A-Za-z_]+\n)?", "func ", _REST, " *", r" *\}\n", r"(?://[A-Za-z0-9_ ]*)?\n?"),
    "c_sharp": (r"class [A-Za-z_]+ \{\n", " *static [A-Za-z]+ ", _REST, " *", r" *\}\n", r"\}\n?"),
    "python": (_COMMENT.format("#"), "def ", r"\([A-Za-z0-9_ ,:]*\)(?: -> [A-Za-z0-9_]+)?:\n", "    ", r"\n*", r"(?:#[A-Za-z0-9_ ]*)?\n?"),
}
_FORMS["typescript"] = _FORMS["javascript"]
#: Names that end in a digit, as no word of a language does that could stand there.
_NAME, _ANY_NAME = r"[A-Za-z_][A-Za-z0-9_]*[0-9]", "f0"
_OPENING = {language: re.compile(form[0]) for language, form in _FORMS.items()}
_DEFINITION = {language: re.compile(f"({head})({_NAME})({rest})((?:{indent}[A-Za-z_]{_SAFE}\\n)+)({end})") for language, (_, head, rest, indent, end, _) in _FORMS.items()}
_CLOSING = {language: re.compile(form[5]) for language, form in _FORMS.items()}
_GOES_ON = frozenset("else elif except finally catch do case default match switch try with async get set".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Line:
    """What a line yields: its nodes, its decisions, its sites with places from its beginning."""

    nodes: int
    points: int
    sites: list[tuple]


@dataclass
class Frame:
    """What stands around the lines of a function: nodes of its head and its end, where its own node begins and ends."""

    shape: tuple[int, int, int, int, int] | None = None
    opening: int = 0
    lines: dict[str, Line | None] = field(default_factory=dict)


def closed(language: str, line: str) -> bool:
    """Whether a line can be a statement that ends with it and doesn't go on with the line before."""
    line = line.strip(" ")
    word = re.match(r"[A-Za-z0-9_]*", line).group()
    if word in _GOES_ON or word in BINARY[language] or word in _NO_OPERAND[language] - {"if", "for", "while", "return"}:
        return False
    if line[-1:] not in (";", "}") if language not in ("python", "go") else not re.search(r"[A-Za-z0-9_)\]}]$", line):
        return False
    stack = []
    for c in line:
        if c in "([{":
            stack.append(c)
        elif c in _PAIRS and (not stack or stack.pop() != _PAIRS[c]):
            return False
        elif c == "<" and language == "typescript" and "(" not in stack and line[-1] != ";":
            return False  # it could open type arguments that a later line closes
    return not stack


class Definitions:
    """Results of plain files in one task; parse(language, text) gives functions, sites and the nodes in order."""

    def __init__(self, parse: Callable[[str, str], tuple[list[tuple], list[tuple], list[Node]]], automata: dict[str, Automaton]):
        self.parse, self.automata = parse, automata
        self.frames: dict[tuple, Frame] = {}

    def parsed(self, language: str, text: str) -> tuple[list[tuple], list[tuple]] | None:
        """The functions and sites of a plain file, as a parse of the whole gives them; None for any other."""
        if language not in _FORMS:
            return None
        opening = _OPENING[language].match(text)
        match, at, found = _DEFINITION[language].match, opening.end() if opening else 0, []
        while m := match(text, at) if opening else None:
            found.append(m)
            at = m.end()
        if not found or not _CLOSING[language].fullmatch(text, at):
            return None
        functions, sites = [], []
        first, closing = opening.group(), text[at:]
        node, line = -1, first.count("\n") + 1
        for m in found:
            head, name, rest, body, end = m.groups()
            frame = self.frame(language, first, closing, head, rest, end)
            lines = body.split("\n")
            lines.pop()
            held = []
            for x in lines:
                known = frame.lines.get(x, self)
                if known is self:
                    known = self.learn(frame, language, x, first, closing, head, rest, end)
                if known is None:
                    return None
                held.append(known)
            own, before, behind, ends, end_line = frame.shape
            node = frame.opening if node < 0 else node
            me, node, points = node + own, node + before, 1
            place, at_line = m.start(4), line + 1
            for x, known in zip(lines, held, strict=True):
                points += known.points
                for name_, a, b, n, s, e, column, original, sign in known.sites:
                    sites.append((name_, place + a, place + b, node + n, place + s, place + e, at_line, column, me, name, original, sign))
                node += known.nodes
                place += len(x) + 1
                at_line += 1
            functions.append((name, line, at_line + end_line, m.start() + len(head) - len(head.lstrip(" ")), place + ends, me, points))
            node += behind
            line = at_line + end.count("\n")
        return functions, sites

    def frame(self, *key: str) -> Frame:
        found = self.frames.get(key)
        if found is None:
            if len(self.frames) >= FRAMES:
                self.frames.clear()
            found = self.frames[key] = Frame()
        return found

    def learn(self, frame: Frame, language: str, line: str, *around: str) -> Line | None:
        """Parse a line in small files and remember what it yields; None if that doesn't follow from the line."""
        once, twice = (self._measured(language, line, n, *around) for n in (1, 2)) if closed(language, line) else (None, None)
        out = None
        if once and twice and once[:3] == twice[:3] and (frame.shape is None or (once[0], once[1]) == (frame.shape, frame.opening)):
            points = twice[3] - once[3]
            if once[3] == 1 + points:
                frame.shape, frame.opening = once[0], once[1]
                out = Line(once[2][0], points, once[2][1])
        if len(frame.lines) >= LINES:
            frame.lines.clear()
        frame.lines[line] = out
        return out

    def _measured(self, language: str, line: str, times: int, first: str, closing: str, head: str, rest: str, end: str) -> tuple | None:
        """(shape, nodes before, (nodes, sites) of the line, complexity) from a file of two functions that hold the line so many times; None if they differ."""
        body = f"{line}\n" * times
        one = head + _ANY_NAME + rest + body + end
        functions, sites, order = self.parse(language, first + one + one + closing)
        starts = [len(first), len(first) + len(one)]
        if len(functions) != 2:
            return None
        places = [k + len(head + _ANY_NAME + rest) + i * (len(line) + 1) for k in starts for i in range(times)]
        begins = [-1, *(n.start for n in order[1:])]  # the root's own comes before all
        for k in places[::times] if language == "python" else ():  # a block without braces begins with its first line, but is none of the line's nodes
            at = bisect_left(begins, k)
            if at == len(order) or order[at].kind != "block":
                return None
            begins[at] = k - 1
        if any(a > b for a, b in zip(begins, begins[1:], strict=False)) or not self._apart(language, order, begins, places, len(line)):
            return None
        number = lambda place: bisect_left(begins, place)
        seen, kept = set(), 0
        for k in places:
            own = [(s[0], s[1] - k, s[2] - k, s[3] - number(k), s[4] - k, s[5] - k, s[7], s[10], s[11]) for s in sites if k <= s[1] and s[2] <= k + len(line) and k <= s[4] and s[5] <= k + len(line)]
            kept += len(own)
            seen.add((number(k + len(line) + 1) - number(k), tuple(own)))
        shapes = set()
        for k, (name, at_line, last, begin, stop, me, _) in zip(starts, functions, strict=True):
            lines, behind = k + len(head + _ANY_NAME + rest), k + len(one) - len(end)
            if name != _ANY_NAME or begin != k + len(head) - len(head.lstrip(" ")) or at_line != first.count("\n") + 1 + (k != starts[0]) * one.count("\n"):
                return None
            # A function's last line is told from the line behind its lines.
            shapes.add((me - number(k), number(lines) - number(k), number(k + len(one)) - number(behind) if k == starts[0] else None, stop - behind, last - (at_line + 1 + times)))
        shape = next(x for x in shapes if x[2] is not None)
        if len(seen) != 1 or kept != len(sites) or len({(*x[:2], *x[3:]) for x in shapes}) != 1 or functions[0][6] != functions[1][6]:
            return None
        if any(s[8] != f[5] for s in sites for f in functions if f[3] <= s[1] < f[4]):
            return None
        nodes, own = seen.pop()
        return shape, number(starts[0]), (nodes, list(own)), functions[0][6]

    def _apart(self, language: str, order: list[Node], begins: list[int], places: list[int], size: int) -> bool:
        """Whether nodes that begin in a line end there, and no pattern begins at a node around lines."""
        automaton = self.automata.get(language)
        for n, begin in zip(order, begins, strict=True):
            k = next((k for k in places if k <= begin < k + size), None)
            if k is not None:
                if n.end > k + size:
                    return False
            elif automaton is not None and any(s.bit & automaton.root_bits for s in automaton.of_kind.get((n.named, n.kind), []) + automaton.of_any[n.named]):
                return False
        return True
