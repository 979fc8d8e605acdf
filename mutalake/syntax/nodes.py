"""Nodes of a syntax tree and their rows."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np


class Node:
    """A piece of text with a kind; tokens without a name of their own have named = False and their text as kind."""

    __slots__ = ("kind", "field", "named", "start", "end", "children", "states")

    def __init__(self, kind: str, start: int, end: int, children: list[Node] | None = None, named: bool = True, field: str | None = None):
        self.kind, self.start, self.end, self.named, self.field = kind, start, end, named, field
        self.children = children or []

    def at(self, field: str) -> Node:
        self.field = field
        return self


_KID = "index: int, kind: string, field: string, named: boolean, last_named: boolean, start_byte: int, end_byte: int, line: int, column: int, leaf_text: string"
#: Columns of the node table; positions are bytes, lines count from one, columns are bytes from zero. A row
#: carries its children, so that looking at them needs no join; leaf_text is null for nodes with children.
SCHEMA = f"file string, language string, node int, parent int, depth int, kind string, field string, named boolean, start_byte int, end_byte int, line int, end_line int, column int, leaf_text string, kids array<struct<{_KID}>>"
COLUMNS = ["file", "language", "node", "parent", "depth", "kind", "field", "named", "start_byte", "end_byte", "line", "end_line", "column", "leaf_text", "kids"]


class Rows:
    """The rows of one tree, in pre-order, and where its places lie in bytes and lines."""

    def __init__(self, file: str, language: str, text: str, root: Node):
        self.file, self.language, self.text = file, language, text
        if text.isascii():
            self.byte = lambda i: i
        else:
            widths = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in text)])
            self.byte = lambda i: int(widths[i])
        self.lines = [0]
        k = text.find("\n")
        while k >= 0:
            self.lines.append(k + 1)
            k = text.find("\n", k + 1)
        self.root = root

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at)
        return line, self.byte(at) - self.byte(self.lines[line - 1])

    def kids(self, node: Node) -> list[dict]:
        final = max((i for i, c in enumerate(node.children) if c.named), default=-1)
        out = []
        for i, c in enumerate(node.children):
            line, column = self.place(c.start)
            out.append({"index": i, "kind": c.kind, "field": c.field, "named": c.named, "last_named": i == final, "start_byte": self.byte(c.start), "end_byte": self.byte(c.end), "line": line, "column": column, "leaf_text": None if c.children else self.text[c.start : c.end]})
        return out

    def all(self) -> Iterator[tuple]:
        stack, me = [(self.root, -1, 0)], -1
        while stack:
            node, parent, depth = stack.pop()
            me += 1
            stack.extend((c, me, depth + 1) for c in reversed(node.children))
            line, column = self.place(node.start)
            yield (self.file, self.language, me, parent, depth, node.kind, node.field, node.named, self.byte(node.start), self.byte(node.end), line, bisect_right(self.lines, node.end), column, None if node.children else self.text[node.start : node.end], self.kids(node))


def in_order(root: Node) -> list[Node]:
    """The nodes of a tree in pre-order; a node's place is its number."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        if node.children:
            stack.extend(node.children[::-1])
    return out
