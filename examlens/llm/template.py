"""A small sandboxed template language, compiled to closures.

    {{ expression }}                     text of a value
    {% for name in name %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}      marks what a model is trained to write
    {# comment #}

Expressions: names, `a.b`, strings, integers, `==`, `!=`, `~` (concatenation), `not`,
`and`, `or`, parentheses, and filters `value | name`. Attributes are looked up as keys
of plain dictionaries and filters in a fixed table, so a template reaches nothing else.
Parts without names are computed once, when the template is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import Enum

TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~|().]))")
ESCAPES = {"n": "\n", "t": "\t"}


class Mark(Enum):
    """Where a generation begins and ends in the rendered stream."""

    START = "start"
    END = "end"


_NONE = object()

Scope = dict
Filters = dict[str, Callable[[str], str]]


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """A node of the tree: constants have `value`, the rest `parts`."""

    kind: str
    value: object = None
    parts: tuple = ()


def constant(value) -> Node:
    return Node("constant", value)


class _Expressions:
    """Recursive descent, lowest precedence first: or, and, not, == !=, ~, filters."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            found = TOKEN.match(text, at)
            if not found:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *expected: str) -> bool:
        if self.peek() in expected:
            self.at += 1
            return True
        return False

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", parts=(node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", parts=(node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", parts=(self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.joined()
        while (op := self.peek()) in ("==", "!="):
            self.at += 1
            node = Node(op, parts=(node, self.joined()))
        return node

    def joined(self) -> Node:
        node = self.filtered()
        while self.take("~"):
            node = Node("~", parts=(node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.single()
        while self.take("|"):
            node = Node("filter", self.word(), (node,))
        return node

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def single(self) -> Node:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return constant(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            self.at += 1
            return constant(int(text))
        node = Node("name", self.word())
        while self.take("."):
            node = Node("key", self.word(), (node,))
        return node


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    stack: list[tuple[str, list]] = [("block", [])]
    at = 0
    for tag in TAG.finditer(source):
        if tag.start() > at:
            stack[-1][1].append(constant(source[at : tag.start()]))
        at = tag.end()
        if tag[1] is not None:
            stack[-1][1].append(Node("text", parts=(_Expressions(tag[1]).whole(),)))
        elif tag[2] is not None:
            _statement(tag[2].strip(), stack)
    if at < len(source):
        stack[-1][1].append(constant(source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not closed")
    return Node("block", parts=tuple(stack[0][1]))


def _statement(text: str, stack: list[tuple[str, list]]) -> None:
    word, _, rest = text.partition(" ")
    if word == "for":
        found = re.fullmatch(r"\s*(\w+)\s+in\s+(.+)", rest, re.S)
        if not found:
            raise TemplateError(f"cannot read {text!r}")
        stack.append((f"for {found[1]}", [_Expressions(found[2]).whole()]))
    elif word == "if":
        stack.append(("if", [_Expressions(rest).whole()]))
        stack.append(("then", []))
    elif word in ("elif", "else"):
        _close(stack, "then")
        if stack[-1][0] != "if":
            raise TemplateError(f"{word!r} without 'if'")
        stack[-1][1].append(_Expressions(rest).whole() if word == "elif" else constant(True))
        stack.append(("then", []))
    elif word == "generation":
        stack.append(("generation", []))
    elif word == "endif":
        _close(stack, "then")
        branches = stack.pop()[1]
        stack[-1][1].append(Node("if", parts=tuple(branches)))
    elif word in ("endfor", "endgeneration"):
        name, parts = stack.pop()
        if word[3:] != name.split(" ")[0]:
            raise TemplateError(f"{word!r} closes {name!r}")
        if word == "endfor":
            node = Node("for", name.split(" ")[1], (parts[0], Node("block", parts=tuple(parts[1:]))))
        else:
            node = Node("generation", parts=(Node("block", parts=tuple(parts)),))
        stack[-1][1].append(node)
    else:
        raise TemplateError(f"unknown statement {word!r}")


def _close(stack: list[tuple[str, list]], name: str) -> None:
    if len(stack) < 2 or stack[-1][0] != name:
        raise TemplateError("'if' is not closed in order")
    parts = stack.pop()[1]
    stack[-1][1].append(Node("block", parts=tuple(parts)))


def text_of(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node: Node, filters: Filters) -> Node:
    """The tree with everything computed that depends on no name."""
    parts = tuple(fold(p, filters) for p in node.parts)
    node = Node(node.kind, node.value, parts)
    fixed = all(p.kind == "constant" for p in parts)
    if node.kind == "filter" and node.value not in filters:
        raise TemplateError(f"unknown filter {node.value!r}")
    if node.kind in ("or", "and", "not", "==", "!=", "~", "filter") and fixed:
        return constant(_expression(node, filters)({}))
    if node.kind == "text" and fixed:
        return constant(text_of(parts[0].value))
    if node.kind == "if":
        kept = []
        for test, block in zip(parts[::2], parts[1::2], strict=True):
            if test.kind == "constant" and not test.value:
                continue
            kept += [test, block]
            if test.kind == "constant":
                break
        if not kept:
            return constant("")
        return kept[1] if kept[0].kind == "constant" else Node("if", parts=tuple(kept))
    if node.kind == "block":
        merged: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "block" else (p,):
                if q.kind == "constant" and merged and merged[-1].kind == "constant":
                    merged[-1] = constant(merged[-1].value + q.value)
                else:
                    merged.append(q)
        return merged[0] if len(merged) == 1 and merged[0].kind == "constant" else Node("block", parts=tuple(merged))
    return node


def _expression(node: Node, filters: Filters) -> Callable[[Scope], object]:
    parts = [_expression(p, filters) for p in node.parts]
    kind, value = node.kind, node.value
    if kind == "constant":
        return lambda scope: value
    if kind == "name":
        return lambda scope: scope.get(value)
    first = parts[0]
    if kind == "key":
        return lambda scope: x.get(value) if isinstance(x := first(scope), dict) else None
    if kind == "filter":
        apply = filters[value]
        return lambda scope: apply(text_of(first(scope)))
    if kind == "not":
        return lambda scope: not first(scope)
    second = parts[1]
    return {
        "or": lambda scope: first(scope) or second(scope),
        "and": lambda scope: first(scope) and second(scope),
        "==": lambda scope: first(scope) == second(scope),
        "!=": lambda scope: first(scope) != second(scope),
        "~": lambda scope: text_of(first(scope)) + text_of(second(scope)),
    }[kind]


def _closure(node: Node, filters: Filters) -> Callable[[Scope], Iterator]:
    """A generator of texts and generation marks."""
    kind = node.kind
    if kind == "constant":
        text = text_of(node.value)

        def run(scope):
            yield text

    elif kind == "text":
        value = _expression(node.parts[0], filters)

        def run(scope):
            yield text_of(value(scope))

    elif kind == "block":
        steps = [_closure(p, filters) for p in node.parts]

        def run(scope):
            for step in steps:
                yield from step(scope)

    elif kind == "if":
        pairs = list(zip(node.parts[::2], node.parts[1::2], strict=True))
        branches = [(_expression(t, filters), _closure(b, filters)) for t, b in pairs]

        def run(scope):
            for test, block in branches:
                if test(scope):
                    yield from block(scope)
                    return

    elif kind == "generation":
        block = _closure(node.parts[0], filters)

        def run(scope):
            yield Mark.START
            yield from block(scope)
            yield Mark.END

    else:
        name, many, block = node.value, _expression(node.parts[0], filters), _closure(node.parts[1], filters)

        def run(scope):
            # One item ahead tells the last; the items themselves may be a stream.
            items = iter(many(scope) or ())
            item, number = next(items, _NONE), 0
            while item is not _NONE:
                after = next(items, _NONE)
                number += 1
                loop = {"index": number, "first": number == 1, "last": after is _NONE}
                yield from block(scope | {name: item, "loop": loop})
                item = after

    return run


BUILT_IN: Filters = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "capitalize": str.capitalize}


def compile_template(source: str, filters: Filters | None = None) -> Callable[[Scope], Iterator]:
    """A function from names to a stream of texts, with marks around generations.

    Loops take any iterable, one item ahead, so a conversation of any length renders
    with one turn in memory.
    """
    known = BUILT_IN | (filters or {})
    return _closure(fold(parse(source), known), known)
