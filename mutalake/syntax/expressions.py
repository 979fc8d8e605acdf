"""Expressions by operator precedence, shared by the languages that are parsed in full.

What is no expression (types, modifiers, declarations) is read as a loose run of expressions and
tokens, so that odd text costs a few nodes and never the file.
"""

from __future__ import annotations

from mutalake.syntax.languages import ASSIGN, BINARY, PREFIX, RULES, WORDS
from mutalake.syntax.lexer import LINE, NAME, NUMBER, OP, STRING, Token, partners, tokens
from mutalake.syntax.nodes import Node

#: Words that no operand begins with.
_NO_OPERAND = {
    "python": frozenset("and or in is if else for as elif except finally from import with while return class def del pass raise try global nonlocal assert break continue".split()),
    "javascript": frozenset("in of instanceof else case default extends implements as satisfies".split()),
    "rust": frozenset("else as in where".split()),
    "go": frozenset("else case default range".split()),
    "c_sharp": frozenset("else case is as in out ref when where and or".split()),
}
_NO_OPERAND["typescript"] = _NO_OPERAND["javascript"]
_TERNARY, _ASSIGN, _UNARY = 8, 5, 60
#: Expressions, prefixes and brackets inside each other; what lies deeper is read as loose tokens.
DEEP = 1500
_CLOSERS = frozenset(") ] } ; ,".split())
_TYPE_TOKENS = frozenset(", . :: ? & [ ] ( ) | * : ; { } => ->".split())
_TYPE_WORDS = frozenset("extends is keyof typeof readonly infer unique asserts mut dyn impl".split())
#: Kinds that differ in name only: expression, language to kind.
KINDS = {
    "binary": {"python": "binary_operator"}, "unary": {"c_sharp": "prefix_unary_expression", "python": "unary_operator"}, "member": {"rust": "field_expression", "python": "attribute", "go": "selector_expression", "c_sharp": "member_access_expression", None: "member_expression"},
    "name": {"rust": "field_identifier", "javascript": "property_identifier", "typescript": "property_identifier", "go": "field_identifier", None: "identifier"}, "field": {"rust": "field", "python": "attribute", "go": "field", "c_sharp": "name", None: "property"},
    "object": {"rust": "value", "go": "operand", "c_sharp": "expression", None: "object"}, "call": {"python": "call", "c_sharp": "invocation_expression", None: "call_expression"}, "arguments": {"python": "argument_list", "go": "argument_list", "c_sharp": "argument_list", None: "arguments"},
    "index": {"rust": "index_expression", "python": "subscript", "go": "index_expression", "c_sharp": "element_access_expression", None: "subscript_expression"}, "array": {"rust": "array_expression", "python": "list", "c_sharp": "collection_expression", "go": "literal_value", None: "array"},
    "ternary": {"c_sharp": "conditional_expression", None: "ternary_expression"}, "function": {"rust": "closure_expression", "c_sharp": "lambda_expression", "go": "func_literal", "python": "lambda", None: "arrow_function"},
    "number": {"rust": "integer_literal", "go": "int_literal", "c_sharp": "integer_literal", "python": "integer", None: "number"}, "real": {"rust": "float_literal", "go": "float_literal", "c_sharp": "real_literal", "python": "float", None: "number"},
    "string": {"rust": "string_literal", "go": "interpreted_string_literal", "c_sharp": "string_literal", None: "string"}, "await": {"python": "await", None: "await_expression"},
}


class Expressions:
    """A cursor over tokens. Methods return nodes and never read beyond a closing bracket that they did not open."""

    def __init__(self, language: str, text: str, found: list[Token] | None = None):
        self.language, self.text = language, text
        self.tokens = tokens(text, RULES[language]) if found is None else found
        self.closing = partners(self.tokens)
        self.i = 0
        self.binary, self.prefixes, self.words = BINARY[language], PREFIX[language], WORDS[language]
        self.no_operand = _NO_OPERAND[language]
        self.js = language in ("javascript", "typescript")
        #: A brace after a name opens a block, as in conditions of Rust and Go.
        self.braces_are_blocks = False
        self.depth = 0
        self._ends: dict[int, int] | None = None
        self._colons: set[int] | None = None
        #: Tokens at which a prefix or a condition was tried and led nowhere, and where lookahead from a token ends.
        self._barren: set[tuple] = set()
        self._ways: dict[str, dict[int, tuple[int, int]]] = {}

    # Cursor.

    def kind(self, of: str) -> str:
        own = KINDS[of]
        return own.get(self.language) or own.get(None) or f"{of}_expression"

    def peek(self, k: int = 0) -> Token | None:
        try:
            return self.tokens[self.i + k]
        except IndexError:
            return None

    def at(self, *texts: str, k: int = 0) -> bool:
        try:
            t = self.tokens[self.i + k]
        except IndexError:
            return False
        return t.text in texts and t.kind != STRING

    def take(self, field: str | None = None) -> Node:
        t = self.tokens[self.i]
        self.i += 1
        return Node(t.text, t.start, t.end, named=False, field=field)

    def leaf(self, kind: str) -> Node:
        node = self.take()
        node.kind, node.named = kind, True
        return node

    def over(self, kind: str, parts: list[Node]) -> Node:
        return Node(kind, parts[0].start, max([p.end for p in parts]), parts)

    def group(self, kind: str, inner=None) -> Node:
        """A bracketed run of what inner reads, by default loose."""
        end = self.closing.get(self.i, len(self.tokens))
        if self.depth >= DEEP:
            return self.tokens_to(end + 1, kind)
        parts, was = [self.take()], self.braces_are_blocks
        self.braces_are_blocks = False
        self.depth += 1
        while self.i < end:
            before = self.i
            parts += inner() if inner else self.loose()
            if self.i == before:
                parts.append(self.take())
        self.braces_are_blocks = was
        self.depth -= 1
        if self.i < len(self.tokens):
            parts.append(self.take())
        return self.over(kind, parts)

    def loose(self) -> list[Node]:
        """One expression, or one token where none begins."""
        node = self.expression()
        return [node] if node else [self.take()]

    # Types.

    def generic_end(self, i: int) -> int | None:
        """The token behind the > that closes type arguments opened at i; None if < compares there."""
        if self._ends is None:
            self._ends = self._generic_ends()
        return self._ends.get(i)

    def _generic_ends(self) -> dict[int, int]:
        """All < that open type arguments, with what generic_end says of them, from one pass over the tokens.

        A < waits for its > within its brackets; what no type holds takes all that wait there.
        """
        typed, out = self.language in ("typescript", "rust"), {}
        extra = {"rust": ("=", "+", "!"), "typescript": ("=",)}.get(self.language, ())
        waiting: list[int] = []
        outer: list[tuple[int, list[int]]] = []
        for k, t in enumerate(self.tokens):
            if t.kind == OP:
                if t.text == "<":
                    waiting.append(k)
                elif t.text == ">":
                    if waiting:
                        out[waiting.pop()] = k + 1
                elif t.text in ("(", "[", "{"):
                    if k not in self.closing or t.text == "{" and self.language != "typescript":
                        waiting.clear()
                    if k in self.closing:
                        outer.append((self.closing[k], waiting))
                        waiting = []
                elif outer and k == outer[-1][0]:
                    waiting = outer.pop()[1]
                elif t.text in (";", ")", "]", "}") or t.text not in _TYPE_TOKENS and t.text not in extra:
                    waiting.clear()
            elif t.kind == LINE or t.kind in (NUMBER, STRING) and not typed:
                waiting.clear()
        return out

    def colon_ahead(self, i: int) -> bool:
        """Whether a colon comes behind token i within its brackets and its statement."""
        if self._colons is None:
            self._colons, ahead, outer = set(), False, []
            opening = {end: k for k, end in self.closing.items()}
            for k in range(len(self.tokens) - 1, -1, -1):
                t = self.tokens[k]
                if t.kind != OP:
                    continue
                if t.text in (")", "]", "}"):
                    if k in opening:
                        outer.append(ahead)
                    ahead = False
                elif t.text in ("(", "[", "{"):
                    ahead = outer.pop() if k in self.closing else False  # an open bracket takes all behind it
                elif t.text == ";":
                    ahead = False
                elif t.text == ":":
                    ahead = True
                elif ahead and t.text == "?":
                    self._colons.add(k)
        return i in self._colons

    def follow(self, way: str, k: int, step) -> tuple[int, int]:
        """Where the steps of a way end that begin at token k, and how many of them counted.

        step(k) is the next token and whether this one counts, or None at the end. A token is stepped
        over once, however often a way is asked for.
        """
        known = self._ways.setdefault(way, {})
        seen = []
        while (found := known.get(k)) is None:
            taken = step(k) if k < len(self.tokens) else None
            if taken is None:
                found = (k, 0)
                break
            seen.append((k, taken[1]))
            k = taken[0]
        end, n = found
        for at, counts in reversed(seen):
            n += counts
            known[at] = (end, n)
        return end, n

    def generic(self) -> bool:
        """Whether type arguments open here: no space before, only types inside, and something fitting behind."""
        if self.language in ("python", "go", "javascript") or not self.at("<") or self.peek().apart:
            return False
        end = self.generic_end(self.i)
        if end is None:
            return False
        after = self.tokens[end] if end < len(self.tokens) else None
        return after is None or after.kind in (NAME, LINE, "life") or after.text in ("(", ")", "{", "}", "[", "]", ">", ",", ";", ":", "::", ".", "?.", "?", "=", "==", "!=", "=>", "->", "&", "|", "&&", "||", "...", "!")

    def skip_type(self) -> list[Node]:
        """A type, as loose tokens."""
        parts: list[Node] = []
        while (t := self.peek()) is not None and t.kind not in (LINE,):
            if t.kind == OP and t.text in ("(", "[") and self.i in self.closing:
                parts.append(self.tokens_to(self.closing[self.i] + 1, "type_part"))
            elif t.kind == OP and t.text == "{" and self.language == "typescript" and (not parts or parts[-1].kind in ("|", "&", "=>")):
                parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part"))
            elif t.kind == OP and t.text == "<" and (end := self.generic_end(self.i)):
                parts.append(self.tokens_to(end, "type_arguments"))
            elif t.kind in (NAME, "life", NUMBER) or (t.kind == STRING and self.language == "typescript") or (t.kind == OP and t.text in (".", "::", "|", "&", "*", "?") or (t.text == "=>" and self.language == "typescript" and parts and parts[-1].kind == "type_part")):
                if t.kind == NAME and parts and parts[-1].named and not {t.text, self.tokens[self.i - 1].text} & _TYPE_WORDS:
                    break
                parts.append(self.leaf("type_identifier") if t.kind == NAME else self.take())
            else:
                break
        return parts

    def tokens_to(self, end: int, kind: str) -> Node:
        """Tokens as leaves under one node; literals keep their kinds."""
        parts = []
        while self.i < min(end, len(self.tokens)):
            t = self.peek()
            parts.append(self.literal() if t.kind in (NUMBER, STRING) or t.text in self.words else self.leaf("identifier") if t.kind == NAME else self.take())
        return self.over(kind, parts) if parts else Node(kind, self.tokens[min(self.i, len(self.tokens) - 1)].start, self.tokens[min(self.i, len(self.tokens) - 1)].start)

    # Operands.

    def literal(self) -> Node:
        t = self.peek()
        if t.kind == NUMBER:
            plain = t.text[:2].lower() in ("0x", "0b", "0o") or not any(c in t.text for c in ".eEfFdDmM" if not t.text.startswith("0x"))
            return self.leaf(self.kind("number") if plain else self.kind("real"))
        if t.kind == STRING:
            return self.string()
        return self.leaf(self.words[t.text])

    def string(self) -> Node:
        t = self.peek()
        kind = self.kind("string")
        if self.language == "c_sharp":
            kind = "character_literal" if t.text[0] == "'" else "string_literal" if t.text[0] == '"' and not t.text.startswith('"""') else "interpolated_string_expression" if "$" in t.text[:3] else "raw_string_literal" if t.text.startswith('"""') else "verbatim_string_literal"
        elif self.language == "rust":
            kind = "char_literal" if "'" in t.text[:2] else "raw_string_literal" if "r" in t.text[: t.text.index('"')] else kind
        elif self.language == "go":
            kind = {"`": "raw_string_literal", "'": "rune_literal"}.get(t.text[0], kind)
        elif self.js:
            kind = {"`": "template_string", "/": "regex"}.get(t.text[0], kind)
        node = self.leaf(kind)
        if kind in ("template_string", "interpolated_string_expression") or (self.language == "python" and "f" in t.text[: min(t.text.find('"') % 9, t.text.find("'") % 9)].lower()):
            node.children = self.interpolations(t, "${" if kind == "template_string" else "{")
        return node

    def interpolations(self, t: Token, opening: str) -> list[Node]:
        """Expressions inside a string."""
        out, k, body = [], t.text.find(opening), t.text
        while k >= 0:
            if opening == "{" and body[k : k + 2] == "{{":
                k = body.find(opening, k + 2)
                continue
            begin, depth, end = k + len(opening), 1, k + len(opening)
            while end < len(body) and depth:
                depth += (body[end] == "{") - (body[end] == "}")
                end += 1
            if depth:
                break
            inner = type(self)(self.language, body[begin : end - 1])
            inner.tokens = [x for x in inner.tokens if x.kind != LINE]
            inner.closing = partners(inner.tokens)
            for x in inner.tokens:
                x.start, x.end = x.start + t.start + begin, x.end + t.start + begin
            parts = []
            while inner.i < len(inner.tokens):
                if inner.at(":") and opening == "{":
                    break
                parts += inner.loose()
            out.append(Node("interpolation", t.start + k, t.start + end, parts))
            k = body.find(opening, end)
        return out

    def operand(self) -> Node | None:
        t = self.peek()
        if t is None or t.kind == LINE:
            return None
        if t.kind in (NUMBER, STRING):
            return self.literal()
        if t.kind == NAME:
            if (node := self.keyword()) is not None:
                return node
            if t.text in self.no_operand:
                return None
            if t.text in self.words:
                return self.literal()
            return self.leaf("identifier")
        if t.text == "(":
            return self.parens()
        if t.text == "[":
            return self.brackets()
        if t.text == "{":
            return self.braces()
        return None

    def keyword(self) -> Node | None:
        """What a word begins that isn't a plain name; languages add theirs."""
        return None

    def parens(self) -> Node:
        return self.group("parenthesized_expression")

    def brackets(self) -> Node:
        return self.group(self.kind("array"))

    def braces(self) -> Node | None:
        return None

    # Postfix, prefix and infix.

    def postfix(self, node: Node) -> Node:
        while (t := self.peek()) is not None and t.kind != LINE:
            new = self.suffix(node, t)
            if new is None:
                return node
            node = new
        return node

    def suffix(self, node: Node, t: Token) -> Node | None:
        """One step behind an operand: member, call, index, and what a language adds."""
        if t.kind == STRING and self.js and t.text[0] == "`" and not t.apart:
            return self.over(self.kind("call"), [node.at("function"), self.string().at("arguments")])
        if t.kind != OP:
            return None
        if t.text == "." and (n := self.peek(1)) is not None and n.kind in (NAME, NUMBER):
            if self.language == "rust" and n.text == "await":
                return self.over("await_expression", [node, self.take(), self.take()])
            return self.over(self.kind("member"), [node.at(self.kind("object")), self.take(), self.leaf(self.kind("name")).at(self.kind("field"))])
        if t.text == "(":
            return self.over(self.kind("call"), [node.at("function"), self.arguments().at("arguments")])
        if t.text == "[" and not (t.apart and t.indent >= 0):
            return self.over(self.kind("index"), [node, self.group("index_arguments") if self.language == "c_sharp" else self.group("index")])
        if t.text == "<" and self.generic():
            arguments = self.tokens_to(self.generic_end(self.i), "type_arguments")
            return self.over("generic_name", [node, arguments])
        if t.text in ("++", "--"):
            if t.indent >= 0:
                return None
            return self.over("postfix_unary_expression" if self.language == "c_sharp" else "update_expression", [node, self.take()])
        return None

    def arguments(self) -> Node:
        return self.group(self.kind("arguments"))

    def unary(self) -> Node | None:
        t = self.peek()
        if t is not None and t.kind in (OP, NAME) and t.text in self.prefixes:
            start = self.i
            if self.depth >= DEEP or ("unary", start) in self._barren:
                return None
            self.depth += 1
            sign = self.take("operator")
            node = self.unary()
            self.depth -= 1
            if node is None:
                self.i = start
                self._barren.add(("unary", start))
                return None
            return self.over(self.kind("unary"), [sign, node.at("argument")])
        node = self.operand()
        return self.postfix(node) if node else None

    def operator(self) -> tuple[str, int] | None:
        """The infix operator here and its number of tokens."""
        t = self.peek()
        if t is None or t.kind not in (OP, NAME) or (t.kind == NAME and t.text not in self.binary):
            return None
        if t.text == ">" and self.language not in ("python", "go"):
            n, text = 1, ">"
            while (x := self.peek(n)) is not None and x.kind == OP and x.start == self.peek(n - 1).end and x.text in (">", ">=") and self.peek(n - 1).text == ">":
                text, n = text + x.text, n + 1
            return text, n
        return t.text, 1

    def infix_token(self, n: int) -> Node:
        first, last = self.peek(), self.peek(n - 1)
        self.i += n
        text = " ".join(self.text[first.start : last.end].split()) if first.kind == NAME and n > 1 else self.text[first.start : last.end]
        return Node(text, first.start, last.end, named=False, field="operator")

    def expression(self, least: int = 0) -> Node | None:
        if self.depth >= DEEP:
            return None
        self.depth += 1
        node = self._expression(least)
        self.depth -= 1
        return node

    def _expression(self, least: int) -> Node | None:
        left = self.unary()
        if left is None:
            return None
        while (found := self.operator()) is not None:
            op, n = found
            if (special := self.infix(left, op, least)) is not None:
                left = special
                continue
            level = self.binary.get(op)
            if level is None or level < least:
                break
            start = self.i
            sign = self.infix_token(n)
            right = self.expression(level + (op != "**"))
            if right is None:
                self.i = start
                break
            left = self.binary_node(left, sign, right)
        return left

    def binary_node(self, left: Node, sign: Node, right: Node) -> Node:
        return self.over(self.kind("binary"), [left.at("left"), sign, right.at("right")])

    def infix(self, left: Node, op: str, least: int) -> Node | None:
        """Assignment and the conditional expression; languages add theirs."""
        if op in ASSIGN and least <= _ASSIGN:
            start = self.i
            sign = self.infix_token(1)
            right = self.expression(_ASSIGN)
            if right is None:
                self.i = start
                return None
            kind = "assignment_expression" if op == "=" or not self.js else "augmented_assignment_expression"
            return self.over(kind, [left.at("left"), sign, right.at("right")])
        if op == "?" and least <= _TERNARY and (self.js or self.language == "c_sharp"):
            start = self.i
            if ("?", start, self.braces_are_blocks) in self._barren or not self.colon_ahead(start):
                return None
            sign = self.take()
            then = self.expression(_ASSIGN)
            if then is not None and self.at(":"):
                colon = self.take()
                other = self.expression(_ASSIGN)
                if other is not None:
                    return self.over(self.kind("ternary"), [left.at("condition"), sign, then.at("consequence"), colon, other.at("alternative")])
            self.i = start
            self._barren.add(("?", start, self.braces_are_blocks))
        return None
