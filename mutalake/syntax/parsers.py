"""Statements and definitions of the languages that are parsed in full: Rust, C#, JavaScript, TypeScript, Go and Python."""

from __future__ import annotations

import sys

from mutalake.syntax.expressions import _ASSIGN, _TERNARY, Expressions
from mutalake.syntax.lexer import LINE, NAME, OP, STRING, Token
from mutalake.syntax.nodes import Node


class Braced(Expressions):
    """Languages whose blocks have braces."""

    block_kind = "block"

    def statements(self) -> list[Node]:
        return self.loose()

    def block(self, kind: str | None = None, inner=None) -> Node:
        return self.group(kind or self.block_kind, inner or self.statements)

    def head(self, *stops: str) -> list[Node]:
        """Loose parts up to one of the stops."""
        parts, was = [], self.braces_are_blocks
        self.braces_are_blocks = True
        while self.peek() is not None and not self.at(*stops) and not self.at(")", "]", "}"):
            before = self.i
            parts += self.loose()
            if self.i == before:
                parts.append(self.take())
        self.braces_are_blocks = was
        return parts

    def file(self) -> Node:
        parts = []
        while self.i < len(self.tokens):
            before = self.i
            parts += self.statements()
            if self.i == before:
                parts.append(self.take())
        return Node("source_file", 0, len(self.text), parts)

    def body(self) -> Node | None:
        """A block or one statement."""
        if self.at("{"):
            return self.block()
        parts = []
        while self.peek() is not None and not parts and not self.at("}", ")", "]"):
            parts = self.statements()
            if parts and not any(p.named for p in parts) and not self.at("}"):
                continue
        return self.over("statement", parts) if parts else None

    def add(self, parts: list[Node], node: Node | None, field: str) -> None:
        if node is not None:
            parts.append(node.at(field))


class Script(Braced):
    """JavaScript and TypeScript."""

    block_kind = "statement_block"

    @property
    def typed(self) -> bool:
        return self.language == "typescript"

    def statements(self) -> list[Node]:
        t = self.peek()
        if t.kind == OP and t.text == "{":
            return [self.block()]
        if t.kind == NAME:
            found = getattr(self, f"_{t.text}_statement", None)
            if found is not None and not self.at(".", "=", ":", ",", ")", k=1) and (node := found()) is not None:
                return [node]
            if self.typed and t.text in ("interface", "type", "declare", "enum", "namespace", "module", "abstract") and (n := self.peek(1)) is not None and n.kind == NAME and n.indent < 0:
                if t.text == "interface":
                    return [self.interface()]
                if t.text == "type":
                    return [self.type_alias()]
        return self.loose()

    def loose(self) -> list[Node]:
        node = self.expression()
        if node is None:
            if self.typed and self.at(":") and self.i and self.tokens[self.i - 1].text not in ("case", "default"):
                return [self.take(), *self.annotation()]
            return [self.take()]
        if self.typed and self.at("?") and self.at(":", ",", ")", ";", "=", k=1):
            return [node, self.take()]
        return [node]

    def annotation(self) -> list[Node]:
        if self.at("{"):
            first = self.tokens_to(self.closing.get(self.i, self.i) + 1, "object_type")
            return [first, *(self.skip_type() if self.at("|", "&", "[") else [])]
        return self.skip_type()

    def interface(self) -> Node:
        parts = self.head("{")
        if self.at("{"):
            end = self.closing.get(self.i, len(self.tokens))
            inner = [self.take()]
            while self.i < end:
                if self.peek().kind == NAME and (self.at("(", k=1) or (self.at("<", k=1) and self.generic_end(self.i + 1))):
                    name = self.leaf("property_identifier").at("name")
                    sign = [name]
                    if self.at("<"):
                        sign.append(self.tokens_to(self.generic_end(self.i), "type_parameters"))
                    if self.at("("):
                        sign.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "formal_parameters").at("parameters"))
                    if self.at(":"):
                        sign += [self.take(), *self.annotation()]
                    inner.append(self.over("method_signature", sign))
                else:
                    inner.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part") if self.at("{", "(", "[") else self.leaf("identifier") if self.peek().kind == NAME else self.take())
            if self.i < len(self.tokens):
                inner.append(self.take())
            parts.append(self.over("interface_body", inner))
        return self.over("interface_declaration", parts)

    def type_alias(self) -> Node:
        parts = [self.take(), self.leaf("type_identifier")]
        while self.peek() is not None and not self.at(";") and not (self.peek().indent >= 0 and self.peek().kind == NAME and self.tokens[self.i - 1].text not in ("|", "&", "=", "=>", ",")):
            if self.at("{", "(", "["):
                parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part"))
            elif self.at("}", ")", "]"):
                break
            else:
                parts.append(self.take())
        return self.over("type_alias_declaration", parts)

    # Statements by their first word.

    def _condition(self, parts: list[Node]) -> None:
        if self.at("("):
            self.add(parts, self.group("parenthesized_expression"), "condition")

    def _if_statement(self) -> Node:
        parts = [self.take()]
        self._condition(parts)
        self.add(parts, self.body(), "consequence")
        if self.at(";") and self.at("else", k=1):
            parts.append(self.take())
        if self.at("else"):
            clause = [self.take()]
            self.add(clause, self.body(), "body")
            parts.append(self.over("else_clause", clause).at("alternative"))
        return self.over("if_statement", parts)

    def _for_statement(self) -> Node:
        parts = [self.take()]
        if self.at("await"):
            parts.append(self.take())
        kind = "for_statement"
        if self.at("("):
            end = self.closing.get(self.i, self.i)
            depth = [k for k in range(self.i + 1, end) if self.tokens[k].text in ("of", "in") and self.tokens[k].kind == NAME]
            if depth and not any(self.tokens[k].text == ";" for k in range(self.i, end)):
                kind = "for_in_statement"
                head = [self.take()]
                while self.i < depth[0]:
                    head.append(self.leaf("identifier") if self.peek().kind == NAME else self.take())
                head.append(self.take())
                while self.i < end:
                    head += self.loose()
                head.append(self.take())
                parts.append(self.over("for_head", head))
            else:
                parts.append(self.group("for_head"))
        self.add(parts, self.body(), "body")
        return self.over(kind, parts)

    def _while_statement(self) -> Node:
        parts = [self.take()]
        self._condition(parts)
        self.add(parts, self.body(), "body")
        return self.over("while_statement", parts)

    def _do_statement(self) -> Node:
        parts = [self.take()]
        self.add(parts, self.body(), "body")
        if self.at("while"):
            parts.append(self.take())
            self._condition(parts)
        return self.over("do_statement", parts)

    def _switch_statement(self) -> Node:
        parts = [self.take()]
        self._condition(parts)
        if self.at("{"):
            parts.append(self.block("switch_body", self._case))
        return self.over("switch_statement", parts)

    def _case(self) -> list[Node]:
        if not self.at("case", "default"):
            return self.statements()
        kind = "switch_case" if self.at("case") else "switch_default"
        parts = [self.take()]
        if kind == "switch_case" and (value := self.expression()) is not None:
            parts.append(value.at("value"))
        while self.peek() is not None and not self.at("case", "default", "}"):
            parts += self.statements() if not self.at(":") else [self.take()]
        return [self.over(kind, parts)]

    def _try_statement(self) -> Node:
        parts = [self.take()]
        self.add(parts, self.body(), "body")
        if self.at("catch"):
            clause = [self.take()]
            if self.at("("):
                clause.append(self.group("catch_parameter"))
            self.add(clause, self.body(), "body")
            parts.append(self.over("catch_clause", clause).at("handler"))
        if self.at("finally"):
            clause = [self.take()]
            self.add(clause, self.body(), "body")
            parts.append(self.over("finally_clause", clause))
        return self.over("try_statement", parts)

    def _valued(self, kind: str) -> Node:
        parts = [self.take()]
        t = self.peek()
        if t is not None and t.indent < 0 and (value := self.sequence()) is not None:
            parts.append(value)
        return self.over(kind, parts)

    def sequence(self) -> Node | None:
        node = self.expression()
        if node is None or not self.at(","):
            return node
        parts = [node]
        while self.at(","):
            parts.append(self.take())
            if (more := self.expression()) is None:
                break
            parts.append(more)
        return self.over("sequence_expression", parts)

    def _return_statement(self) -> Node:
        return self._valued("return_statement")

    def _throw_statement(self) -> Node:
        return self._valued("throw_statement")

    def _function_statement(self) -> Node | None:
        node = self.function()
        if node is not None and any(c.field == "name" for c in node.children):
            node.kind = "function_declaration" if node.kind == "function_expression" else node.kind
        return node

    def _async_statement(self) -> Node | None:
        return self._function_statement() if self.at("function", k=1) else None

    def _class_statement(self) -> Node:
        return self.class_node()

    # Functions and classes.

    def function(self) -> Node | None:
        parts = []
        if self.at("async"):
            parts.append(self.take())
        parts.append(self.take())
        generator = self.at("*")
        if generator:
            parts.append(self.take())
        if (t := self.peek()) is not None and t.kind == NAME:
            parts.append(self.leaf("identifier").at("name"))
        self.signature(parts)
        if not self.at("{"):
            return self.over("function_signature", parts)
        parts.append(self.block().at("body"))
        return self.over("generator_function" if generator else "function_expression", parts)

    def signature(self, parts: list[Node]) -> None:
        if self.at("<") and (end := self.generic_end(self.i)):
            parts.append(self.tokens_to(end, "type_parameters"))
        if self.at("("):
            parts.append(self.group("formal_parameters").at("parameters"))
        if self.typed and self.at(":"):
            parts += [self.take(), *self.annotation()]

    def class_node(self) -> Node:
        parts = [self.take(), *self.head("{")]
        if self.at("{"):
            parts.append(self.block("class_body", self._member).at("body"))
        return self.over("class_declaration", parts)

    def _member(self) -> list[Node]:
        """A method, or the loose parts of a field."""
        k, names = self.i, 0
        while k < len(self.tokens) and (self.tokens[k].kind == NAME and self.tokens[k].text in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor") or self.tokens[k].text == "*"):
            k, names = k + 1, names + 1
        if k < len(self.tokens) and (self.tokens[k].text in ("(", "=", ";", ":", "?", "<")) and names:
            k -= 1  # a member named like a modifier
        t = self.tokens[k] if k < len(self.tokens) else None
        if t is not None and (t.kind in (NAME, STRING) or t.kind == "number" or t.text == "["):
            end = self.closing.get(k, k) + 1 if t.text == "[" else k + 1
            if end < len(self.tokens) and self.tokens[end].text == "?":
                end += 1
            if end < len(self.tokens) and self.tokens[end].text == "<" and self.tokens[end].kind == OP:
                end = self.generic_end(end) or end
            if end < len(self.tokens) and self.tokens[end].text == "(" and self.tokens[end].kind == OP:
                parts = []
                while self.i < k:
                    parts.append(self.take())
                if t.text == "[":
                    parts.append(self.group("computed_property_name").at("name"))
                else:
                    parts.append(self.leaf("private_property_identifier" if t.text[0] == "#" else "property_identifier" if t.kind == NAME else "string").at("name"))
                if self.at("?"):
                    parts.append(self.take())
                self.signature(parts)
                if self.at("{"):
                    parts.append(self.block().at("body"))
                    return [self.over("method_definition", parts)]
                return [self.over("method_signature" if "abstract" not in [p.kind for p in parts] else "abstract_method_signature", parts)]
        return self.statements()

    def keyword(self) -> Node | None:
        t = self.peek()
        if t.text in ("function",) or (t.text == "async" and self.at("function", k=1)):
            return self.function()
        if t.text == "class":
            return self.class_node()
        if t.text == "await" and not self.at(")", ",", ";", "=", ".", k=1):
            sign = self.take()
            node = self.unary()
            return self.over("await_expression", [sign, *([node] if node else [])])
        if t.text == "new":
            parts = [self.take()]
            if (callee := self.operand()) is not None:
                while self.at(".") or self.generic():
                    callee = self.suffix(callee, self.peek()) or callee
                parts.append(callee.at("constructor"))
            if self.at("("):
                parts.append(self.arguments().at("arguments"))
            return self.over("new_expression", parts)
        if t.text == "yield":
            parts = [self.take()]
            if self.at("*"):
                parts.append(self.take())
            if (t := self.peek()) is not None and t.indent < 0 and (value := self.expression(_ASSIGN)) is not None:
                parts.append(value)
            return self.over("yield_expression", parts)
        k = self.i + (t.text == "async" and self.peek(1) is not None and self.peek(1).indent < 0)
        if k < len(self.tokens) and self.tokens[k].kind == NAME and k + 1 < len(self.tokens) and self.tokens[k + 1].text == "=>":
            return self.arrow(k)
        if t.text == "async" and self.at("(", k=1) and self.arrow_after(self.i + 1):
            return self.arrow(self.i + 1)
        return None

    def arrow_after(self, i: int) -> bool:
        """Whether the parentheses at i are parameters."""
        k = self.closing.get(i, len(self.tokens)) + 1
        if k < len(self.tokens) and self.typed and self.tokens[k].text == ":":
            was, self.i = self.i, k + 1
            self.annotation()
            k, self.i = self.i, was
        return k < len(self.tokens) and self.tokens[k].kind == OP and self.tokens[k].text == "=>"

    def arrow(self, at: int) -> Node:
        parts = []
        while self.i < at:
            parts.append(self.take())
        if self.at("("):
            self.signature(parts)
        else:
            parts.append(self.leaf("identifier").at("parameter"))
        parts.append(self.take())
        body = self.block() if self.at("{") else self.expression(_ASSIGN)
        self.add(parts, body, "body")
        return self.over("arrow_function", parts)

    def parens(self) -> Node:
        return self.arrow(self.i) if self.arrow_after(self.i) else self.group("parenthesized_expression")

    def braces(self) -> Node | None:
        return None if self.braces_are_blocks else self.group("object", self._property)

    def _property(self) -> list[Node]:
        """A member of an object, as one named node."""
        if self.at(","):
            return [self.take()]
        t = self.peek()
        k = self.i
        if t.kind == NAME and t.text in ("async", "get", "set") and k + 1 < len(self.tokens) and self.tokens[k + 1].text not in (":", ",", "}", "(", "="):
            k += 1
        if self.tokens[k].kind == OP and self.tokens[k].text == "*" and k + 1 < len(self.tokens):
            k += 1
        end = (self.closing.get(k, k) if self.tokens[k].kind == OP and self.tokens[k].text == "[" else k) + 1
        if end < len(self.tokens) and self.tokens[end].kind == OP and self.tokens[end].text == "(" and (k := self.closing.get(end)) and k + 1 < len(self.tokens) and self.tokens[k + 1].text in ("{", ":") and t.text != "...":
            found = self._member()
            if found and found[0].kind == "method_definition":
                return found
            return [self.over("pair", found)]
        if end < len(self.tokens) and self.tokens[end].text == ":" and t.text != "...":
            parts = [self.group("computed_property_name")] if t.text == "[" else [self.leaf("property_identifier" if t.kind == NAME else "string") if t.kind in (NAME, STRING) else self.literal()]
            parts += [self.take()]
            if (value := self.expression(_ASSIGN)) is not None:
                parts.append(value.at("value"))
            return [self.over("pair", parts)]
        if t.text == "...":
            parts = [self.take()]
            if (value := self.expression(_ASSIGN)) is not None:
                parts.append(value)
            return [self.over("spread_element", parts)]
        if t.kind == NAME and self.at(",", "}", k=1):
            return [self.leaf("shorthand_property_identifier")]
        return self.loose()

    def brackets(self) -> Node:
        return self.group("array", self._element)

    def _element(self) -> list[Node]:
        if self.at("..."):
            parts = [self.take()]
            if (value := self.expression(_ASSIGN)) is not None:
                parts.append(value)
            return [self.over("spread_element", parts)]
        return self.loose()

    def suffix(self, node: Node, t: Token) -> Node | None:
        if t.kind == OP and t.text == "?." and self.peek(1) is not None:
            call = self.at("(", k=1)
            chain = self.take() if self.typed and call else self.leaf("optional_chain")
            if call:
                return self.over("call_expression", [node.at("function"), chain, self.arguments().at("arguments")])
            if self.at("["):
                return self.over("subscript_expression", [node.at("object"), chain, self.group("index")])
            return self.over("member_expression", [node.at("object"), chain, self.leaf("property_identifier").at("property")])
        if t.kind == OP and t.text == "!" and self.typed and not t.apart and t.indent < 0:
            return self.over("non_null_expression", [node, self.take()])
        if t.kind == OP and t.text == "(" and t.indent >= 0 and not self.js:
            return None
        return super().suffix(node, t)

    def infix(self, left: Node, op: str, least: int) -> Node | None:
        if self.typed and op in ("as", "satisfies") and self.peek().indent < 0:
            return self.over(f"{op}_expression", [left, self.take(), *self.annotation()])
        return super().infix(left, op, least)

    def operator(self):
        t = self.peek()
        if self.typed and t is not None and t.kind == NAME and t.text in ("as", "satisfies"):
            return t.text, 1
        return super().operator()


class Go(Braced):
    def __init__(self, language: str, text: str, found: list[Token] | None = None):
        super().__init__(language, text, found)
        if found is None:
            self._semicolons()

    def _semicolons(self) -> None:
        """A line that can end a statement ends it."""
        from mutalake.syntax.lexer import partners

        out: list[Token] = []
        for t in self.tokens:
            last = out[-1] if out else None
            if t.indent >= 0 and last is not None and (last.kind in ("number", STRING) or (last.kind == NAME and last.text not in ("func", "if", "for", "switch", "case", "else", "range", "go", "defer", "var", "const", "type", "import", "package", "select", "struct", "interface", "map", "chan", "default", "goto")) or last.text in (")", "]", "}", "++", "--")):
                out.append(Token(OP, ";", last.end, last.end))
            out.append(t)
        self.tokens, self.closing = out, partners(out)

    def statements(self) -> list[Node]:
        t = self.peek()
        if t.kind == NAME:
            if t.text == "if":
                return [self._if()]
            if t.text == "for":
                parts = [self.take(), *self.head("{")]
                self.add(parts, self.block() if self.at("{") else None, "body")
                return [self.over("for_statement", parts)]
            if t.text in ("switch", "select"):
                return [self._switch()]
            if t.text == "return":
                parts = [self.take()]
                while self.peek() is not None and not self.at(";", "}"):
                    parts += self.loose()
                return [self.over("return_statement", parts)]
            if t.text == "func" and not (self.at("(", k=1) and (k := self.closing.get(self.i + 1)) and not (k + 1 < len(self.tokens) and self.tokens[k + 1].kind == NAME and k + 2 < len(self.tokens) and self.tokens[k + 2].text in ("(", "["))):
                return [self._func()]
            if t.text == "type" and self.peek(1) is not None:
                parts = [self.take(), self.leaf("type_identifier")]
                while self.peek() is not None and not self.at(";"):
                    parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part") if self.at("{", "(", "[") else self.take())
                return [self.over("type_declaration", parts)]
        if t.kind == OP and t.text == "{":
            return [self.block()]
        return self.loose()

    def _if(self) -> Node:
        parts = [self.take(), *self.head("{")]
        self.add(parts, self.block() if self.at("{") else None, "consequence")
        if self.at("else"):
            parts.append(self.take())
            self.add(parts, self._if() if self.at("if") else self.block() if self.at("{") else None, "alternative")
        return self.over("if_statement", parts)

    def _switch(self) -> Node:
        kind = self.peek().text
        start = self.i
        parts = [self.take(), *self.head("{")]
        typed = any(x.text == "type" and x.kind == NAME and self.tokens[k + start - 1].text == "(" for k, x in enumerate(self.tokens[start : self.i]))
        case = {"select": "communication_case"}.get(kind, "type_case" if typed else "expression_case")
        if self.at("{"):
            parts.append(self.block("cases", lambda: self._case(case)))
        return self.over("type_switch_statement" if typed else f"{kind}_statement", parts)

    def _case(self, kind: str) -> list[Node]:
        if not self.at("case", "default"):
            return self.statements()
        kind = kind if self.at("case") else "default_case"
        parts = [self.take()]
        while self.peek() is not None and not self.at(":", "}"):
            parts += self.loose()
        while self.peek() is not None and not self.at("case", "default", "}"):
            parts += self.statements()
        return [self.over(kind, parts)]

    def _func(self) -> Node:
        parts, kind = [self.take()], "function_declaration"
        if self.at("("):
            parts.append(self.group("parameter_list").at("receiver"))
            kind = "method_declaration"
        if self.peek() is not None and self.peek().kind == NAME:
            parts.append(self.leaf("identifier" if kind == "function_declaration" else "field_identifier").at("name"))
        if self.at("["):
            parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_parameters"))
        self._signature(parts)
        self.add(parts, self.block() if self.at("{") else None, "body")
        return self.over(kind, parts)

    def _signature(self, parts: list[Node]) -> None:
        if self.at("("):
            parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "parameter_list").at("parameters"))
        while self.peek() is not None and not self.at("{", ";", ")", "]", "}", ",", ":=", "="):
            parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part") if self.at("(", "[") or (self.at("{") and self.tokens[self.i - 1].text in ("struct", "interface")) else self.take())
            if self.at("{") and self.tokens[self.i - 1].text in ("struct", "interface"):
                parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part"))

    def keyword(self) -> Node | None:
        if self.at("func"):
            parts = [self.take()]
            self._signature(parts)
            if not self.at("{"):
                return self.over("function_type", parts)
            was, self.braces_are_blocks = self.braces_are_blocks, False
            parts.append(self.block().at("body"))
            self.braces_are_blocks = was
            return self.over("func_literal", parts)
        if self.at("map") and self.at("[", k=1):
            parts = [self.take(), self.group("type_part")]
            return self.over("map_type", parts)
        if self.at("struct", "interface") and self.at("{", k=1):
            parts = [self.take()]
            parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part"))
            return self.over("struct_type", parts)
        return None

    def brackets(self) -> Node:
        node = self.group("type_part")
        t = self.peek()
        if t is not None and (t.kind == NAME or t.text in ("*", "[")) and not t.apart and (inner := self.unary()) is not None:
            return self.over("slice_type", [node, inner])
        return node

    def suffix(self, node: Node, t: Token) -> Node | None:
        if t.text == "{" and t.kind == OP and not t.apart and (not self.braces_are_blocks or node.kind in ("map_type", "slice_type")) and node.kind in ("identifier", "selector_expression", "slice_type", "map_type", "type_part", "struct_type", "index_expression"):
            return self.over("composite_literal", [node, self.group("literal_value")])
        return super().suffix(node, t)

    def braces(self) -> Node | None:
        return None if self.braces_are_blocks else self.group("literal_value")


class Rust(Braced):
    _BLOCK_LIKE = frozenset("if match for while loop unsafe async".split())
    _BEFORE_FN = frozenset("fn pub default const async unsafe extern".split())

    def _fn_at(self) -> int | None:
        """The fn of a named function whose visibility and modifiers begin here; a word of each kind at most."""
        k = self.i
        if self.at("pub"):
            k += 1
            if k < len(self.tokens) and self.tokens[k].text == "(" and self.tokens[k].kind == OP:
                k = self.closing.get(k, k) + 1
        for word in ("default", "const", "async", "unsafe", "extern"):
            if k < len(self.tokens) and self.tokens[k].kind == NAME and self.tokens[k].text == word:
                k += 1
                if word == "extern" and k < len(self.tokens) and self.tokens[k].kind == STRING:
                    k += 1
        named = k + 1 < len(self.tokens) and self.tokens[k].kind == NAME and self.tokens[k].text == "fn" and self.tokens[k + 1].kind == NAME
        return k if named else None

    def statements(self) -> list[Node]:
        t = self.peek()
        if t.kind == OP and t.text == "#" and (self.at("[", k=1) or (self.at("!", k=1) and self.at("[", k=2))):
            k = self.i + 1 + self.at("!", k=1)
            return [self.tokens_to(self.closing.get(k, k) + 1, "attribute_item")]
        if t.kind == OP and t.text == "{":
            return [self.block()]
        if t.kind == NAME:
            if t.text in self._BEFORE_FN and (k := self._fn_at()) is not None:
                return [self._fn(k)]
            if t.text in ("struct", "enum", "union", "trait", "impl", "mod", "extern") and self.peek(1) is not None:
                parts = [self.take()]
                while self.peek() is not None and not self.at("{", ";", "}"):
                    parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part") if self.at("(", "[") else self.leaf("type_identifier") if self.peek().kind == NAME else self.take())
                if self.at("{"):
                    parts.append(self.block("declaration_list") if t.text in ("trait", "impl", "mod", "extern") else self.tokens_to(self.closing.get(self.i, self.i) + 1, "field_declaration_list"))
                return [self.over(f"{t.text}_item", parts)]
            if t.text == "macro_rules" and self.at("!", k=1):
                parts = [self.take(), self.take(), self.take()]
                if self.at("{", "(", "["):
                    parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "token_tree"))
                return [self.over("macro_definition", parts)]
            if t.text in ("use", "type") and self.peek(1) is not None and self.peek(1).text not in (".", "(", "="):
                parts = []
                while self.peek() is not None and not self.at(";"):
                    parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part") if self.at("{", "(", "[") else self.take())
                return [self.over("use_declaration", parts)]
            if t.text in self._BLOCK_LIKE and (node := self.keyword()) is not None:
                if self.at(".", "?"):
                    node = self.postfix(node)
                return [node]
            if t.text in ("let", "const", "static") and self.peek(1) is not None:
                return [self._let()]
        return self.loose()

    def _let(self) -> Node:
        parts = [self.take()]
        self._pattern(parts, "=", ";", ":", "else")
        if self.at(":"):
            parts += [self.take(), *self._type("=", ";")]
        if self.at("="):
            parts.append(self.take())
            if (value := self.expression()) is not None:
                parts.append(value.at("value"))
        if self.at("else"):
            parts.append(self.take())
            self.add(parts, self.block() if self.at("{") else None, "alternative")
        return self.over("let_declaration", parts)

    def _type(self, *stops: str) -> list[Node]:
        parts = []
        while self.peek() is not None and not self.at(*stops) and not self.at(")", "]", "}"):
            parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part") if self.at("(", "[", "{") else self.tokens_to(end, "type_arguments") if self.at("<") and (end := self.generic_end(self.i)) else self.leaf("type_identifier") if self.peek().kind == NAME else self.take())
        return parts

    def _pattern(self, parts: list[Node], *stops: str) -> None:
        """A pattern's tokens: one stays as it is, more get a node; literals keep their kinds."""
        found = []
        while self.peek() is not None and not self.at(*stops):
            t = self.peek()
            if self.at("(", "[", "{") and self.i in self.closing:
                found.append(self.tokens_to(self.closing[self.i] + 1, "pattern_part"))
            elif self.at(")", "]", "}"):
                break
            else:
                found.append(self.literal() if t.kind in ("number", STRING) or t.text in ("true", "false") else self.leaf("identifier") if t.kind == NAME and t.text != "_" else self.take())
        if len(found) == 1:
            parts.append(found[0])
        elif found:
            parts.append(self.over("or_pattern" if any(x.kind == "|" for x in found) else "composed_pattern", found))

    def _fn(self, at: int) -> Node:
        parts = []
        if self.at("pub"):
            parts.append(self.tokens_to(self.closing.get(self.i + 1, self.i + 1) + 1 if self.at("(", k=1) else self.i + 1, "visibility_modifier"))
        if self.i < at:
            parts.append(self.tokens_to(at, "function_modifiers"))
        parts += [self.take(), self.leaf("identifier").at("name")]
        if self.at("<") and (end := self.generic_end(self.i)):
            parts.append(self.tokens_to(end, "type_parameters"))
        if self.at("("):
            parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "parameters").at("parameters"))
        parts += self._type("{", ";")
        if not self.at("{"):
            return self.over("function_signature_item", parts)
        parts.append(self.block().at("body"))
        return self.over("function_item", parts)

    def keyword(self) -> Node | None:
        t = self.peek()
        word = t.text
        if word == "if":
            parts = [self.take()]
            self.add(parts, self._condition(), "condition")
            self.add(parts, self.block() if self.at("{") else None, "consequence")
            if self.at("else"):
                clause = [self.take()]
                self.add(clause, self.keyword() if self.at("if") else self.block() if self.at("{") else None, "body")
                parts.append(self.over("else_clause", clause).at("alternative"))
            return self.over("if_expression", parts)
        if word == "while":
            parts = [self.take()]
            self.add(parts, self._condition(), "condition")
            self.add(parts, self.block() if self.at("{") else None, "body")
            return self.over("while_expression", parts)
        if word == "for" and not self.at("<", k=1):
            parts = [self.take()]
            self._pattern(parts, "in", "{")
            parts += [*([self.take()] if self.at("in") else []), *self.head("{")]
            self.add(parts, self.block() if self.at("{") else None, "body")
            return self.over("for_expression", parts)
        if word in ("loop", "unsafe", "async", "const") and (self.at("{", k=1) or (self.at("move", k=1) and self.at("{", k=2))):
            parts = [self.take()]
            while not self.at("{"):
                parts.append(self.take())
            parts.append(self.block().at("body"))
            return self.over(f"{word}_expression" if word == "loop" else f"{word}_block", parts)
        if word == "match":
            parts = [self.take()]
            value = self.head("{")
            if value:
                parts.append((value[0] if len(value) == 1 else self.over("value", value)).at("value"))
            if self.at("{"):
                parts.append(self.block("match_block", self._arm).at("body"))
            return self.over("match_expression", parts)
        if word in ("return", "break", "continue"):
            parts = [self.take()]
            if (nxt := self.peek()) is not None and nxt.kind == "life":
                parts.append(self.leaf("label"))
            if word != "continue" and not (self.braces_are_blocks and self.at("{")) and (value := self.expression()) is not None:
                parts.append(value)
            return self.over(f"{word}_expression", parts)
        if word in ("move", "async", "static") and (self.at("|", "||", k=1) or self.at("move", k=1)):
            return self.closure()
        if word == "let":
            return None
        if word in ("mut", "ref", "dyn", "pub", "where", "crate") and not self.at("::", ".", k=1):
            return None
        return None

    def _condition(self) -> Node | None:
        """An expression, a let condition, or a chain of them."""
        was, self.braces_are_blocks = self.braces_are_blocks, True
        parts, chain = [], False
        while True:
            if self.at("let"):
                own = [self.take()]
                self._pattern(own, "=", "{")
                if self.at("="):
                    own.append(self.take())
                    if (value := self.expression(12)) is not None:  # binds tighter than && and ||
                        own.append(value.at("value"))
                parts.append(self.over("let_condition", own))
            else:
                node = self.expression(12 if parts or self._let_until_block() else 0)
                if node is None:
                    break
                parts.append(node)
            if not self.at("&&"):
                break
            chain = True
            parts.append(self.take())
        self.braces_are_blocks = was
        if not parts:
            return None
        return self.over("let_chain", parts) if chain else parts[0]

    def _let_until_block(self) -> bool:
        """Whether a let condition comes before the block."""

        def step(k: int) -> tuple[int, int] | None:
            t = self.tokens[k]
            return None if t.text in ("{", ";") else ((self.closing.get(k, k) if t.text in ("(", "[") else k) + 1, t.text == "let" and t.kind == NAME)

        return self.follow("block", self.i, step)[1] > 0

    def _arm(self) -> list[Node]:
        if self.at(","):
            return [self.take()]
        if self.at("#"):
            return self.statements()
        pattern: list[Node] = []
        if self.at("|"):
            pattern.append(self.take())
        self._pattern(pattern, "=>", "if")
        if self.at("if"):
            pattern.append(self.take())
            self.add(pattern, self._condition(), "condition")
        if not pattern or not self.at("=>"):
            return [*pattern, *([] if self.peek() is None or self.at("}") else [self.take()])]
        parts = [self.over("match_pattern", pattern).at("pattern"), self.take()]
        value = None
        if self.at("{"):
            value = self.block()
            if self.at(".", "?"):
                value = self.postfix(value)
        else:
            value = self.expression()
        self.add(parts, value, "value")
        if self.at(","):
            parts.append(self.take())
        return [self.over("match_arm", parts)]

    def closure(self) -> Node:
        parts = []
        while self.at("move", "async", "static"):
            parts.append(self.take())
        if self.at("||"):
            parts.append(self.take())
        else:
            own = [self.take()]
            while self.peek() is not None and not self.at("|"):
                own.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part") if self.at("(", "[", "{") else self.take())
            if self.peek() is not None:
                own.append(self.take())
            parts.append(self.over("closure_parameters", own).at("parameters"))
        if self.at("->"):
            parts += [self.take(), *self._type("{")]
        was, self.braces_are_blocks = self.braces_are_blocks, False
        self.add(parts, self.block() if self.at("{") else self.expression(), "body")
        self.braces_are_blocks = was
        return self.over("closure_expression", parts)

    def operand(self) -> Node | None:
        t = self.peek()
        if t is None:
            return None
        if t.kind == "life":
            return None
        if t.kind == OP:
            if t.text in ("|", "||"):
                return self.closure()
            if t.text == "{" and not self.braces_are_blocks:
                return self.block()
            if t.text in ("&", "&&"):
                parts = [self.take()]
                while self.at("mut"):
                    parts.append(self.take())
                if (node := self.unary()) is None:
                    return self.over("reference", parts)
                return self.over("reference_expression", [*parts, node])
            if t.text in ("..", "..="):
                parts = [self.take()]
                if not (self.braces_are_blocks and self.at("{")) and (node := self.expression(11)) is not None:
                    parts.append(node)
                return self.over("range_expression", parts)
            if t.text == "<" and not t.apart and (end := self.generic_end(self.i)) and end < len(self.tokens) and self.tokens[end].text == "::":
                return self.tokens_to(end, "bracketed_type")
        return super().operand()

    def infix(self, left: Node, op: str, least: int) -> Node | None:
        if op in ("..", "..="):
            if least > 10:
                return None
            parts = [left, self.take()]
            if not (self.braces_are_blocks and self.at("{")) and (node := self.expression(11)) is not None:
                parts.append(node)
            return self.over("range_expression", parts)
        if op == "as":
            return self.over("type_cast_expression", [left.at("value"), self.take(), *self._cast_type()])
        return super().infix(left, op, least)

    def _cast_type(self) -> list[Node]:
        parts = []
        while (t := self.peek()) is not None and (t.kind == NAME or t.text in ("::", "*", "&") or (t.text == "<" and not t.apart and self.generic_end(self.i)) or (t.text in ("(", "[") and not parts)):
            if t.text == "*" and parts:
                break
            if t.text == "&" and parts:
                break
            if t.kind == NAME and parts and parts[-1].named:
                break
            parts.append(self.tokens_to(self.generic_end(self.i), "type_arguments") if t.text == "<" else self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part") if t.text in ("(", "[") else self.leaf("type_identifier") if t.kind == NAME and t.text not in ("mut", "const", "dyn") else self.take())
        return parts

    def operator(self):
        t = self.peek()
        if t is not None and t.kind == NAME and t.text == "as":
            return "as", 1
        return super().operator()

    def suffix(self, node: Node, t: Token) -> Node | None:
        if t.kind != OP:
            return None
        if t.text == "?":
            return self.over("try_expression", [node, self.take()])
        if t.text == "::":
            parts = [node, self.take()]
            if self.at("<") and (end := self.generic_end(self.i)):
                parts.append(self.tokens_to(end, "type_arguments"))
                return self.over("generic_function", parts)
            if self.peek() is not None and self.peek().kind == NAME:
                parts.append(self.leaf("identifier").at("name"))
            return self.over("scoped_identifier", parts)
        if t.text == "!" and node.kind in ("identifier", "scoped_identifier") and not t.apart and self.at("(", "[", "{", k=1):
            parts = [node.at("macro"), self.take()]
            parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "token_tree"))
            return self.over("macro_invocation", parts)
        if t.text == "{" and not self.braces_are_blocks and node.kind in ("identifier", "scoped_identifier", "generic_name") and self.text[node.start : node.end].rsplit("::", 1)[-1][:1].isupper():
            return self.over("struct_expression", [node, self.group("field_initializer_list")])
        if t.text in ("(", "[") and node.kind in ("if_expression", "match_expression", "block", "while_expression", "for_expression", "loop_expression", "unsafe_block") and t.indent >= 0:
            return None
        if t.text in ("++", "--"):
            return None
        return super().suffix(node, t)


class CSharp(Braced):
    _NO_TYPE = frozenset("return await throw new yield else in is as case when typeof default from select operator var".split())
    _starts: dict[int, int] | None = None
    _TYPES = frozenset("class struct interface record enum".split())
    _MODIFIERS = frozenset("public private protected internal static abstract sealed virtual override readonly async partial extern unsafe new volatile const required file ref".split())

    def statements(self) -> list[Node]:
        t = self.peek()
        if t.kind == OP and t.text == "{":
            return [self.block()]
        if t.kind == NAME:
            found = getattr(self, f"_{t.text}_statement", None)
            if found is not None and not self.at(".", "=", k=1) and (node := found()) is not None:
                return [node]
            if (node := self._declared()) is not None:
                return [node]
        return self.loose()

    def _declared(self) -> Node | None:
        """A type or a local function, with its modifiers."""
        k = self._past_modifiers()
        if k < len(self.tokens) and self.tokens[k].kind == NAME and self.tokens[k].text in self._TYPES and k + 1 < len(self.tokens) and self.tokens[k + 1].kind == NAME:
            return self._type_declaration(k)
        return self._method(None)

    def _type_declaration(self, k: int) -> Node:
        word = self.tokens[k].text
        parts = []
        while self.i <= k:
            parts.append(self.take())
        name = self.peek().text
        while self.peek() is not None and not self.at("{", ";", "}"):
            parts.append(self.group("parameter_list") if self.at("(") else self.leaf("identifier") if self.peek().kind == NAME else self.take())
        if self.at("{"):
            parts.append(self.block("enum_member_declaration_list" if word == "enum" else "declaration_list", self.loose if word == "enum" else lambda: self._member(name)).at("body"))
        return self.over(f"{word}_declaration", parts)

    def _member(self, owner: str) -> list[Node]:
        t = self.peek()
        if t.kind == OP and t.text == "[":
            return [self.group("attribute_list")]
        if t.kind == NAME:
            k = self._past_modifiers()
            if k < len(self.tokens) and self.tokens[k].kind == NAME and self.tokens[k].text in self._TYPES and k + 1 < len(self.tokens) and self.tokens[k + 1].kind == NAME:
                return [self._type_declaration(k)]
            if (node := self._method(owner)) is not None:
                return [node]
            if (node := self._operator(k)) is not None:
                return [node]
            if (k := self._property_end()) is not None:
                return [self.tokens_to(k, "property_declaration")]
        if t.kind == OP and t.text == "{":
            return [self.block("accessor_list", self._accessor)]
        if t.kind == OP and t.text == "=>":
            parts = [self.take()]
            self.add(parts, self.expression(), "body")
            return [self.over("arrow_expression_clause", parts)]
        return self.loose()

    def _property_end(self) -> int | None:
        """The token at which a property's => or accessors begin."""

        def step(k: int) -> tuple[int, int] | None:
            t = self.tokens[k]
            if t.kind == NAME:
                return k + 1, 1
            if t.kind == OP and t.text == "<" and (end := self.generic_end(k)):
                return end, 0
            return (k + 1, 0) if t.kind == OP and t.text in (".", "?", "[", "]") else None

        k, names = self.follow("property", self.i, step)
        return k if names > 1 and k < len(self.tokens) and self.tokens[k].text in ("=>", "{") else None

    def _past_modifiers(self) -> int:
        is_modifier = lambda k: self.tokens[k].kind == NAME and self.tokens[k].text in self._MODIFIERS
        return self.follow("modifiers", self.i, lambda k: (k + 1, 0) if is_modifier(k) else None)[0]

    def _body_at(self, k: int) -> int:
        """The body, arrow or end of a declaration whose constraints or initializer begin at k."""

        def step(k: int) -> tuple[int, int] | None:
            t = self.tokens[k]
            return None if t.text in ("{", "=>", ";") else ((self.closing.get(k, k) if t.text == "(" else k) + 1, 0)

        return self.follow("body", k, step)[0]

    def _typed_name(self, begin: int) -> tuple[int, int]:
        """Where "type name" that begins at a token ends, and the number of its names; no tokens if nothing like it stands there."""

        def is_name(k: int) -> bool:
            return self.tokens[k].kind == NAME and self.tokens[k].text not in self._NO_TYPE

        def step(k: int) -> tuple[int, int] | None:
            t = self.tokens[k]
            if is_name(k):
                return k + 1, self.tokens[k - 1].text not in (".", "::")
            if t.kind == OP and t.text in (".", "::", "?", "*"):
                return k + 1, 0
            if t.kind == OP and t.text == "[" and all(self.tokens[x].text == "," for x in range(k + 1, self.closing.get(k, k))):
                return self.closing.get(k, k) + 1, 0
            return (end, 0) if t.kind == OP and t.text == "<" and (end := self.generic_end(k)) else None

        if begin >= len(self.tokens):
            return begin, 0
        t = self.tokens[begin]
        if is_name(begin):
            after = begin + 1
        elif t.kind == OP and t.text == "(" and begin in self.closing and self.closing[begin] + 1 < len(self.tokens) and self.tokens[self.closing[begin] + 1].kind == NAME:
            after = self.closing[begin] + 1
        else:
            return begin, 0
        end, names = self.follow("typed", after, step)
        return end, names + 1

    def _operator(self, begin: int) -> Node | None:
        """An operator or a conversion: [modifiers] [type] operator sign(…) body."""
        at, _ = self._typed_name(begin)
        if at >= len(self.tokens) or self.tokens[at].kind != NAME or self.tokens[at].text != "operator":
            return None
        k = at + 1
        while k < min(at + 5, len(self.tokens)) and self.tokens[k].text != "(":
            k += 1
        if k == at + 1 or k >= len(self.tokens) or self.tokens[k].text != "(" or k not in self.closing:
            return None
        parts = []
        while self.i < k:
            parts.append(self.leaf("identifier") if self.peek().kind == NAME and self.peek().text not in self._MODIFIERS else self.take())
        parts.append(self.group("parameter_list").at("parameters"))
        self._add_body(parts)
        return self.over("operator_declaration" if self.tokens[at + 1].kind == OP else "conversion_operator_declaration", parts)

    def _add_body(self, parts: list[Node]) -> None:
        if self.at("{"):
            parts.append(self.block().at("body"))
        elif self.at("=>"):
            clause = [self.take()]
            self.add(clause, self.expression(), "body")
            parts.append(self.over("arrow_expression_clause", clause).at("body"))

    def _accessor(self) -> list[Node]:
        if self.peek().kind == NAME and self.at("=>", k=1):
            parts = [self.leaf("accessor"), self.take()]
            self.add(parts, self.expression(), "body")
            return [self.over("accessor_declaration", parts)]
        return self.statements()

    def _method(self, owner: str | None) -> Node | None:
        """[modifiers] type name(…) body, or a constructor of the owner; None if something else stands here."""
        begin = self._past_modifiers()
        k, named = self._typed_name(begin)
        if k >= len(self.tokens) or self.tokens[k].text != "(" or k not in self.closing or k == begin:
            return None
        last = self._generic_start(k) - 1
        while last > begin and self.tokens[last].kind != NAME:
            last -= 1
        constructor = owner is not None and named == 1 and self.tokens[last].text == owner
        if named < 2 and not constructor:
            return None
        after = self.closing[k] + 1
        if constructor and after < len(self.tokens) and self.tokens[after].text == ":":
            after = self._body_at(after)
        if after < len(self.tokens) and self.tokens[after].kind == NAME and self.tokens[after].text == "where":
            after = self._body_at(after)
        if after >= len(self.tokens) or self.tokens[after].text not in ("{", "=>"):
            if owner is None or after >= len(self.tokens) or self.tokens[after].text != ";":
                return None
        parts = []
        while self.i < k:
            parts.append(self.leaf("identifier").at("name") if self.i == last else self.leaf("identifier") if self.peek().kind == NAME and self.peek().text not in self._MODIFIERS else self.take())
        parts.append(self.group("parameter_list").at("parameters"))
        while self.i < after and self.peek() is not None:
            parts.append(self.arguments() if self.at("(") else self.leaf("identifier") if self.peek().kind == NAME else self.take())
        self._add_body(parts)
        return self.over("constructor_declaration" if constructor else "method_declaration" if owner is not None else "local_function_statement", parts)

    def _generic_start(self, end: int) -> int:
        """The < of type arguments that end right before a token; the token itself if none do."""
        if self._starts is None:
            self.generic_end(0)
            self._starts = {stop: a for a, stop in self._ends.items()}
        return self._starts.get(end, end)

    # Statements by their first word.

    def _namespace_statement(self) -> Node:
        parts = [self.take()]
        while self.peek() is not None and not self.at("{", ";"):
            parts.append(self.take())
        if self.at("{"):
            parts.append(self.block("declaration_list"))
        return self.over("namespace_declaration", parts)

    def _if_statement(self) -> Node:
        parts = [self.take()]
        self._condition(parts)
        self.add(parts, self.body(), "consequence")
        if self.at(";") and self.at("else", k=1):
            parts.append(self.take())
        if self.at("else"):
            parts.append(self.take())
            self.add(parts, self.body(), "alternative")
        return self.over("if_statement", parts)

    def _condition(self, parts: list[Node]) -> None:
        if self.at("("):
            self.add(parts, self.group("parenthesized_expression"), "condition")

    def _headed(self, kind: str) -> Node:
        parts = [self.take()]
        if self.at("("):
            parts.append(self.group("head"))
        self.add(parts, self.body(), "body")
        return self.over(kind, parts)

    def _for_statement(self) -> Node:
        return self._headed("for_statement")

    def _foreach_statement(self) -> Node:
        return self._headed("foreach_statement")

    def _while_statement(self) -> Node:
        return self._headed("while_statement")

    def _lock_statement(self) -> Node:
        return self._headed("lock_statement")

    def _using_statement(self) -> Node | None:
        return self._headed("using_statement") if self.at("(", k=1) else None

    def _do_statement(self) -> Node:
        parts = [self.take()]
        self.add(parts, self.body(), "body")
        if self.at("while"):
            parts.append(self.take())
            self._condition(parts)
        return self.over("do_statement", parts)

    def _switch_statement(self) -> Node:
        parts = [self.take()]
        self._condition(parts)
        if self.at("{"):
            parts.append(self.block("switch_body", self._section))
        return self.over("switch_statement", parts)

    def _section(self) -> list[Node]:
        """Labels that follow each other, and their statements."""
        parts = []
        while self.at("case", "default"):
            parts.append(self.take())
            if parts[-1].kind == "case":
                parts += self._pattern_parts(":", "when")
                if self.at("when"):
                    clause = [self.take()]
                    self.add(clause, self.expression(9), "condition")
                    parts.append(self.over("when_clause", clause))
            if self.at(":"):
                parts.append(self.take())
        if not parts:
            return self.statements()
        while self.peek() is not None and not self.at("case", "}") and not (self.at("default") and self.at(":", k=1)):
            parts += self.statements()
        return [self.over("switch_section", parts)]

    def _try_statement(self) -> Node:
        parts = [self.take()]
        self.add(parts, self.body(), "body")
        while self.at("catch"):
            clause = [self.take()]
            if self.at("("):
                clause.append(self.group("catch_declaration"))
            if self.at("when"):
                own = [self.take()]
                if self.at("("):
                    own.append(self.group("parenthesized_expression"))
                clause.append(self.over("catch_filter_clause", own))
            self.add(clause, self.body(), "body")
            parts.append(self.over("catch_clause", clause))
        if self.at("finally"):
            clause = [self.take()]
            self.add(clause, self.body(), "body")
            parts.append(self.over("finally_clause", clause))
        return self.over("try_statement", parts)

    def _return_statement(self) -> Node:
        parts = [self.take()]
        if (value := self.expression()) is not None:
            parts.append(value)
        return self.over("return_statement", parts)

    def _throw_statement(self) -> Node:
        node = self._return_statement()
        node.kind = "throw_statement"
        return node

    def _yield_statement(self) -> Node | None:
        if not self.at("return", "break", k=1):
            return None
        parts = [self.take(), self.take()]
        if (value := self.expression()) is not None:
            parts.append(value)
        return self.over("yield_statement", parts)

    def _checked_statement(self) -> Node | None:
        if not self.at("{", k=1):
            return None
        parts = [self.take()]
        parts.append(self.block())
        return self.over("checked_statement", parts)

    _unchecked_statement = _checked_statement

    # Expressions.

    def keyword(self) -> Node | None:
        t = self.peek()
        word = t.text
        if word == "throw":
            parts = [self.take()]
            if (value := self.expression(_ASSIGN)) is not None:
                parts.append(value)
            return self.over("throw_expression", parts)
        if word in ("checked", "unchecked") and self.at("(", k=1):
            sign = self.take()
            return self.over("checked_expression", [sign, self.group("parenthesized_expression")])
        if word == "default" and not self.at(":", k=1):
            parts = [self.take()]
            if self.at("("):
                parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part"))
            return self.over("default_expression", parts)
        if word in ("typeof", "sizeof", "nameof") and self.at("(", k=1):
            parts = [self.take()]
            parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "type_part"))
            return self.over(f"{word}_expression", parts)
        if word == "await" and not self.at(")", ",", ";", "=", ".", k=1):
            sign = self.take()
            node = self.unary()
            return self.over("await_expression", [sign, *([node] if node else [])])
        if word == "new":
            return self._new()
        k = self.i + (word in ("async", "static"))
        if k < len(self.tokens) and self.tokens[k].kind == NAME and k + 1 < len(self.tokens) and self.tokens[k + 1].text == "=>":
            return self._lambda(k)
        if k > self.i and k in self.closing and self._arrow_after(k):
            return self._lambda(k)
        if word == "delegate" and self.at("(", "{", k=1):
            parts = [self.take()]
            if self.at("("):
                parts.append(self.group("parameter_list"))
            self.add(parts, self.block() if self.at("{") else None, "body")
            return self.over("anonymous_method_expression", parts)
        return None

    def _new(self) -> Node:
        parts = [self.take(), *self.skip_type()] if not self.at("(", "[", "{", k=1) else [self.take()]
        while self.at("[") or self.at("("):
            parts.append(self.arguments().at("arguments") if self.at("(") else self.group("rank"))
        if self.at("{"):
            parts.append(self.group("initializer_expression"))
        return self.over("object_creation_expression", parts)

    def skip_type(self) -> list[Node]:
        parts = []
        while (t := self.peek()) is not None and (t.kind == NAME or t.text in (".", "::") or (t.text == "?" and parts) or (t.text == "<" and self.generic_end(self.i))):
            if t.kind == NAME and parts and parts[-1].named:
                break
            parts.append(self.tokens_to(self.generic_end(self.i), "type_argument_list") if t.text == "<" else self.leaf("identifier") if t.kind == NAME else self.take())
        return parts

    def _arrow_after(self, i: int) -> bool:
        k = self.closing.get(i, len(self.tokens)) + 1
        return k < len(self.tokens) and self.tokens[k].kind == OP and self.tokens[k].text == "=>"

    def _lambda(self, at: int) -> Node:
        parts = []
        while self.i < at:
            parts.append(self.take())
        parts.append(self.group("parameter_list").at("parameters") if self.at("(") else self.leaf("identifier").at("parameters"))
        parts.append(self.take())
        self.add(parts, self.block() if self.at("{") else self.expression(_ASSIGN), "body")
        return self.over("lambda_expression", parts)

    def parens(self) -> Node:
        if self._arrow_after(self.i):
            return self._lambda(self.i)
        end = self.closing.get(self.i, len(self.tokens))
        inner = range(self.i + 1, end)
        after = self.tokens[end + 1] if end + 1 < len(self.tokens) else None
        cast = after is not None and (after.kind in (STRING, "number") or (after.kind == NAME and after.text not in ("is", "as", "switch", "with", "when", "and", "or")) or after.text in ("(", "!", "~"))
        typed = cast and inner and all((x.kind == NAME and x.text not in self.words) or (x.kind == OP and x.text in (".", "::", "?", "[", "]", "<", ">", ",", "*")) for x in map(self.tokens.__getitem__, inner))
        if typed and not (self.tokens[end - 1].text == "," or len(inner) > 1 and all(self.tokens[k].kind == NAME for k in inner)):
            parts = [self.tokens_to(end + 1, "cast_type")]
            if (value := self.unary()) is not None:
                return self.over("cast_expression", [*parts, value.at("value")])
            return parts[0]
        return self.group("parenthesized_expression")

    def braces(self) -> Node | None:
        return None if self.braces_are_blocks else self.group("initializer_expression")

    def suffix(self, node: Node, t: Token) -> Node | None:
        if t.kind == OP and (t.text == "?." or (t.text == "?" and self.at("[", k=1) and not t.apart and not self.peek(1).apart and self._indexes())):
            sign = self.take()
            if sign.kind == "?.":
                binding = self.leaf("identifier") if self.peek() is not None and self.peek().kind == NAME else Node("missing", sign.end, sign.end)
                rest: Node = Node("member_binding_expression", sign.start + 1, binding.end, [binding.at("name")])
            else:
                rest = self.over("element_binding_expression", [self.group("index_arguments")])
            return self.over("conditional_access_expression", [node.at("condition"), rest])
        if t.kind == OP and t.text == "!" and not t.apart:
            return self.over("postfix_unary_expression", [node, self.take()])
        if t.kind == NAME and t.text == "switch" and self.at("{", k=1):
            return self.over("switch_expression", [node, self.take(), self.group("switch_arms", self._switch_arm)])
        if t.kind == NAME and t.text == "with" and self.at("{", k=1):
            return self.over("with_expression", [node, self.take(), self.group("initializer_expression")])
        return super().suffix(node, t)

    def _indexes(self) -> bool:
        """x?[i] is an access unless a colon makes it a condition's branch."""
        k = self.closing.get(self.i + 1, self.i) + 1
        return not (k < len(self.tokens) and self.tokens[k].text == ":")

    def _switch_arm(self) -> list[Node]:
        if self.at(","):
            return [self.take()]
        parts = self._pattern_parts("=>", "when")
        if self.at("when"):
            clause = [self.take()]
            self.add(clause, self.expression(_TERNARY + 1), "condition")
            parts.append(self.over("when_clause", clause))
        if not self.at("=>"):
            return parts or self.loose()
        parts.append(self.take())
        self.add(parts, self.expression(_ASSIGN), "value")
        return [self.over("switch_expression_arm", parts)]

    def _pattern_parts(self, *stops: str) -> list[Node]:
        """A pattern's parts; literals keep their kinds."""
        parts = []
        while (t := self.peek()) is not None and not self.at(*stops) and not self.at(")", "]", "}", ",", ";", "&&", "||", "?", ":", "=>", "??", "==", "!="):
            if self.at("(", "[", "{"):
                parts.append(self.tokens_to(self.closing.get(self.i, self.i) + 1, "pattern_part"))
            elif t.text == "<" and (end := self.generic_end(self.i)) and not t.apart and parts:
                parts.append(self.tokens_to(end, "type_argument_list"))
            else:
                parts.append(self.literal() if t.kind in ("number", STRING) or t.text in self.words else self.leaf("identifier") if t.kind == NAME and t.text not in ("not", "and", "or") else self.take())
        return parts

    def infix(self, left: Node, op: str, least: int) -> Node | None:
        if op == "is" and least <= self.binary["<"]:
            parts = [left, self.take()]
            found = self._pattern_parts()
            plain = all(p.kind in ("identifier", ".", "type_argument_list", "type_part") for p in found) and sum(p.kind == "identifier" for p in found) <= 1 + sum(p.kind == "." for p in found)
            return self.over("is_expression" if plain else "is_pattern_expression", [*parts, *found])
        if op == "as" and least <= self.binary["<"]:
            return self.over("as_expression", [left.at("left"), self.take(), *self.skip_type()])
        return super().infix(left, op, least)

    def operator(self):
        t = self.peek()
        if t is not None and t.kind == NAME and t.text in ("is", "as"):
            return t.text, 1
        return super().operator()


class Python(Expressions):
    """Blocks by indentation."""

    def file(self) -> Node:
        return Node("module", 0, len(self.text), self.lines(-1))

    def lines(self, above: int) -> list[Node]:
        """Statements indented more than the block above."""
        parts = []
        while (t := self.peek()) is not None:
            if t.kind == LINE:
                self.i += 1
                continue
            if t.indent >= 0 and t.indent <= above and parts is not None and above >= 0:
                break
            before = self.i
            parts += self.statement()
            if self.i == before:
                parts.append(self.take())
        return parts

    def block(self, indent: int) -> Node | None:
        """What follows a colon: the rest of the line, or the indented lines."""
        if self.at(":"):
            self.i += 1
        if (t := self.peek()) is not None and t.kind != LINE:
            parts = self.rest()
        else:
            parts = self.lines(indent)
        return self.over("block", parts) if parts else None

    def rest(self) -> list[Node]:
        """Simple statements to the end of the line."""
        parts = []
        while (t := self.peek()) is not None and t.kind != LINE:
            parts += self.simple()
        return parts

    def simple(self) -> list[Node]:
        t = self.peek()
        if t.kind == NAME and t.text == "return":
            parts = [self.take()]
            if (value := self.listed()) is not None:
                parts.append(value)
            return [self.over("return_statement", parts)]
        return self.loose()

    def listed(self) -> Node | None:
        node = self.expression()
        if node is None or not self.at(","):
            return node
        parts = [node]
        while self.at(","):
            parts.append(self.take())
            if (more := self.expression()) is not None:
                parts.append(more)
        return self.over("expression_list", parts)

    def headed(self, kind: str, indent: int, field: str = "body", condition: bool = False) -> Node:
        parts = [self.take()]
        while (t := self.peek()) is not None and t.kind != LINE and not self.at(":"):
            if condition and len(parts) == 1 and (node := self.expression()) is not None:
                parts.append(node.at("condition"))
            else:
                parts += self.loose()
        if (body := self.block(indent)) is not None:
            parts.append(body.at(field))
        return self.over(kind, parts)

    def clauses(self, parts: list[Node], indent: int, kinds: dict[str, str]) -> None:
        """Clauses at the statement's own indentation."""
        while True:
            k = self.i
            while k < len(self.tokens) and self.tokens[k].kind == LINE:
                k += 1
            t = self.tokens[k] if k < len(self.tokens) else None
            if t is None or t.kind != NAME or t.text not in kinds or t.indent != indent:
                return
            self.i = k
            parts.append(self.headed(kinds[t.text], indent, condition=t.text == "elif"))

    def statement(self) -> list[Node]:
        t = self.peek()
        indent = t.indent if t.indent >= 0 else 0
        word = t.text if t.kind == NAME else ""
        if word == "async" and self.at("def", "for", "with", k=1):
            sign = self.take()
            found = self.compound(self.peek().text, indent)
            found.children.insert(0, sign)
            found.start = sign.start
            return [found]
        if t.kind == OP and t.text == "@":
            parts = [self.take(), *self.rest()]
            return [self.over("decorator", parts)]
        if word and (found := self.compound(word, indent)) is not None:
            return [found]
        return self.rest()

    def compound(self, word: str, indent: int) -> Node | None:
        if word in ("if", "while"):
            node = self.headed(f"{word}_statement", indent, "consequence" if word == "if" else "body", True)
            self.clauses(node.children, indent, {"elif": "elif_clause", "else": "else_clause"} if word == "if" else {"else": "else_clause"})
        elif word in ("with", "class"):
            node = self.headed(f"{word}_statement" if word == "with" else "class_definition", indent)
        elif word == "for":
            parts = [self.take(), *self.targets()]
            if self.at("in"):
                parts.append(self.take())
            while (t := self.peek()) is not None and t.kind != LINE and not self.at(":"):
                parts += self.loose()
            if (body := self.block(indent)) is not None:
                parts.append(body.at("body"))
            node = self.over("for_statement", parts)
            self.clauses(node.children, indent, {"else": "else_clause"})
        elif word == "try":
            node = self.headed("try_statement", indent)
            self.clauses(node.children, indent, {"except": "except_clause", "else": "else_clause", "finally": "finally_clause"})
        elif word == "def":
            parts = [self.take()]
            if self.peek() is not None and self.peek().kind == NAME:
                parts.append(self.leaf("identifier").at("name"))
            if self.at("["):
                parts.append(self.group("type_parameters"))
            if self.at("("):
                parts.append(self.group("parameters", self.parameter).at("parameters"))
            while (t := self.peek()) is not None and t.kind != LINE and not self.at(":"):
                parts += self.loose()
            if (body := self.block(indent)) is not None:
                parts.append(body.at("body"))
            node = self.over("function_definition", parts)
        elif word in ("match", "case") and self.soft():
            if word == "match":
                node = self.headed("match_statement", indent)
            else:
                parts = [self.take()]
                while (t := self.peek()) is not None and t.kind != LINE and not self.at(":"):
                    if self.at("if"):
                        own = [self.take()]
                        if (value := self.expression()) is not None:
                            own.append(value)
                        parts.append(self.over("if_clause", own))
                    else:
                        parts += self.loose()
                if (body := self.block(indent)) is not None:
                    parts.append(body.at("consequence"))
                node = self.over("case_clause", parts)
        else:
            return None
        node.end = max(node.end, *(c.end for c in node.children))
        return node

    def soft(self) -> bool:
        """match and case are words of their own only before a subject and a colon at the line's end."""
        t = self.peek(1)
        if t is None or t.kind == LINE or (t.kind == OP and t.text in ("=", ".", ",", ")", ":", "]", "+=")):
            return False
        k = self.i
        while k < len(self.tokens) and self.tokens[k].kind != LINE:
            if self.tokens[k].kind == OP and self.tokens[k].text == ":":
                return True
            k = self.closing.get(k, k) + 1
        return False

    def parameter(self) -> list[Node]:
        if self.at(":"):
            return [self.take()]
        return self.loose()

    def targets(self) -> list[Node]:
        """What stands before the in of a for."""
        parts = []
        while (t := self.peek()) is not None and t.kind != LINE and not self.at("in", ":", ")", "]", "}"):
            parts += [node] if (node := self.expression(14)) is not None else [self.take()]
        return parts

    def keyword(self) -> Node | None:
        if self.at("lambda"):
            parts = [self.take()]
            while (t := self.peek()) is not None and not self.at(":") and t.kind != LINE:
                parts += self.loose()
            if self.at(":"):
                parts.append(self.take())
            if (body := self.expression()) is not None:
                parts.append(body.at("body"))
            return self.over("lambda", parts)
        if self.at("await"):
            sign = self.take()
            node = self.unary()
            return self.over("await", [sign, *([node] if node else [])])
        if self.at("yield"):
            parts = [self.take()]
            if self.at("from"):
                parts.append(self.take())
            if (value := self.listed()) is not None:
                parts.append(value)
            return self.over("yield", parts)
        return None

    def unary(self) -> Node | None:
        if self.at("not"):
            sign = self.take()
            node = self.expression(12)
            return self.over("not_operator", [sign, node.at("argument")]) if node else self.over("not_operator", [sign])
        if self.at("*", "**"):
            sign = self.take()
            node = self.expression(14)
            return self.over("list_splat", [sign, *([node] if node else [])])
        node = super().unary()
        if node is not None and self.at("**"):
            sign = self.take("operator")
            if (right := self.unary()) is not None:
                return self.over("binary_operator", [node.at("left"), sign, right.at("right")])
        return node

    def operator(self):
        t = self.peek()
        if t is not None and t.kind == NAME and t.text == "not" and self.at("in", k=1):
            return "in", 2
        if t is not None and t.kind == NAME and t.text == "is" and self.at("not", k=1):
            return "is", 2
        if t is not None and t.kind == NAME and t.text == "if":
            return "if", 1
        return super().operator()

    def infix(self, left: Node, op: str, least: int) -> Node | None:
        if op == "if" and least <= _TERNARY and not self.filtering:
            start = self.i
            sign = self.take()
            condition = self.expression(10)
            if condition is not None and self.at("else"):
                other = self.take()
                value = self.expression(_TERNARY)
                if value is not None:
                    return self.over("conditional_expression", [left, sign, condition, other, value])
            self.i = start
            return None
        if self.binary.get(op) == 13 and least <= 13:
            parts = [left]
            while (found := self.operator()) is not None and self.binary.get(found[0]) == 13:
                start = self.i
                sign = self.infix_token(found[1])
                sign.field = "operators"
                right = self.expression(14)
                if right is None:
                    self.i = start
                    break
                parts += [sign, right]
            return self.over("comparison_operator", parts) if len(parts) > 1 else None
        return super().infix(left, op, least)

    def binary_node(self, left: Node, sign: Node, right: Node) -> Node:
        kind = "boolean_operator" if sign.kind in ("and", "or") else "binary_operator"
        return self.over(kind, [left.at("left"), sign, right.at("right")])

    #: Inside a comprehension's clauses an if begins a filter.
    filtering = False

    def contents(self, kind: str, of: str) -> Node:
        """A bracketed display or comprehension."""
        end = self.closing.get(self.i, len(self.tokens))
        parts, was = [self.take()], self.filtering
        self.filtering = False
        colon = comma = clause = False
        while self.i < end:
            before = self.i
            if self.at("for") or (self.at("async") and self.at("for", k=1)):
                clause, self.filtering = True, True
                own = [self.take()]
                if self.at("for"):
                    own.append(self.take())
                own += self.targets()
                if self.at("in"):
                    own.append(self.take())
                if (value := self.expression()) is not None:
                    own.append(value)
                parts.append(self.over("for_in_clause", own))
            elif clause and self.at("if"):
                own = [self.take()]
                if (value := self.expression()) is not None:
                    own.append(value)
                parts.append(self.over("if_clause", own))
            else:
                colon |= self.at(":")
                comma |= self.at(",")
                parts += self.loose()
            if self.i == before:
                parts.append(self.take())
        self.filtering = was
        if self.i < len(self.tokens):
            parts.append(self.take())
        empty = len(parts) <= 2
        if of == "[":
            kind = "list_comprehension" if clause else "list"
        elif of == "{":
            splat = any(p.kind == "list_splat" and p.children and p.children[0].kind == "**" for p in parts)
            kind = ("dictionary_comprehension" if colon else "set_comprehension") if clause else "dictionary" if colon or empty or splat else "set"
        elif kind == "argument_list":
            kind = "generator_expression" if clause and not comma else kind
        else:
            kind = "generator_expression" if clause else "tuple" if comma or empty else "parenthesized_expression"
        return self.over(kind, parts)

    def parens(self) -> Node:
        return self.contents("", "(")

    def brackets(self) -> Node:
        return self.contents("", "[")

    def braces(self) -> Node | None:
        return self.contents("", "{")

    def arguments(self) -> Node:
        return self.contents("argument_list", "(")


PARSERS = {"rust": Rust, "c_sharp": CSharp, "javascript": Script, "typescript": Script, "go": Go, "python": Python}


def parse(language: str, text: str) -> Node:
    """The syntax tree of a text in a language of PARSERS; odd text gives an odd tree, never an error."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1_000_000))
    try:
        return PARSERS[language](language, text).file()
    finally:
        sys.setrecursionlimit(limit)
