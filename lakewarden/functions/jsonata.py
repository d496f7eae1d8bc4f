"""Expressions of the JSONata language over one JSON document.

``evaluate(text, document)`` parses an expression (operator precedence) and walks
its tree. A value is what ``json`` gives; ``NOTHING`` stands for no value, and a ``Seq`` for a
sequence: an empty one is no value, one of a single member is that member.

A path keeps, beside each item, the variables bound on the way (``@$x``, ``#$i``) and
the items it came through (``%``). Numbers in brackets choose by place, anything else by truth.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cmp_to_key


class JsonataError(ValueError):
    """The expression cannot be parsed or evaluated."""


class _Nothing:
    def __bool__(self) -> bool:
        return False

    def __repr__(self) -> str:
        return "NOTHING"


NOTHING = _Nothing()


class Seq(list):
    """A sequence: flattened into others, and undone when it has one member unless it is to stay."""

    stays = False


class Whole(list):
    """An array written as such as a step of a path, which is not flattened into the path's sequence."""


# Parsing.

_TOKEN = re.compile(
    r"""(?P<gap>(?:\s|/\*.*?\*/)+)|(?P<number>(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<quoted>`[^`]*`)|(?P<variable>\$[\w$]*)|(?P<op>\*\*|\.\.|:=|!=|<=|>=|~>|\?\?|\?:|[.\[\]{}(),@\#;:?+\-*/%|=<>^&])|(?P<name>[^\W\d]\w*)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/((?:[^/\\\[\n]|\\.|\[(?:[^\]\\]|\\.)*\])+)/([im]*)")
#: How strongly each operator binds what stands to its left (fixed values of the language).
_POWER = {
    ".": 75, "[": 80, "{": 70, "(": 80, "@": 80, "#": 80, "?": 20, "??": 40, "?:": 40, "+": 50, "-": 50, "*": 60, "/": 60, "%": 60, "=": 40, "<": 40, ">": 40,
    "^": 40, "..": 20, ":=": 10, "!=": 40, "<=": 40, ">=": 40, "~>": 40, "and": 30, "or": 25, "in": 40, "&": 50,
}


@dataclass
class Node:
    kind: str
    value: object = None
    parts: list = field(default_factory=list)
    #: Filters and place variables of a path's step, in order.
    stages: list = field(default_factory=list)
    group: list | None = None
    #: The variable an item is bound to while the context stays.
    focus: str | None = None
    keep: bool = False


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        after_value = out and (out[-1][0] in ("number", "string", "quoted", "variable") or (out[-1][0] == "name" and out[-1][1] not in ("and", "or", "in")) or out[-1][1] in (")", "]", "}"))
        if text[at] == "/" and not text.startswith("/*", at) and not after_value and (m := _REGEX.match(text, at)):
            out.append(("regex", m[0], at))
        elif m := _TOKEN.match(text, at):
            if m.lastgroup != "gap":
                out.append((m.lastgroup, m[0], at))
        else:
            raise JsonataError(f"cannot read {text[at:at + 10]!r} at {at}")
        at = m.end()
    return [*out, ("end", "", at)]


_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _string(token: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str:
        kind, value, _ = self.tokens[self.at]
        return value if kind in ("op", "end") or (kind == "name" and value in ("and", "or", "in")) else ""

    def take(self, value: str | None = None) -> tuple[str, str, int]:
        token = self.tokens[self.at]
        if value is not None and self.peek() != value:
            raise JsonataError(f"expected {value!r} before {token[1]!r} at {token[2]}")
        if token[0] == "end":
            raise JsonataError("the expression ends too soon")
        self.at += 1
        return token

    def whole(self) -> Node:
        out = self.expression(0)
        if self.tokens[self.at][0] != "end":
            raise JsonataError(f"unexpected {self.tokens[self.at][1]!r} at {self.tokens[self.at][2]}")
        return out

    def expression(self, power: int) -> Node:
        left = self.first()
        while power < _POWER.get(self.peek(), 0):
            left = self.next(left)
        return left

    def many(self, close: str, mark: str = ",") -> list[Node]:
        out = []
        while self.peek() != close:
            out.append(self.expression(0))
            if self.peek() != mark:
                break
            self.take()
        self.take(close)
        return out

    def pairs(self) -> list[tuple[Node, Node]]:
        out = []
        while self.peek() != "}":
            key = self.expression(0)
            self.take(":")
            out.append((key, self.expression(0)))
            if self.peek() != ",":
                break
            self.take()
        self.take("}")
        return out

    def first(self) -> Node:
        kind, value, at = self.take()
        if kind == "number":
            n = float(value)
            return Node("value", int(value) if value.isdigit() else n)
        if kind == "string":
            return Node("value", _string(value))
        if kind == "quoted":
            return Node("name", value[1:-1])
        if kind == "variable":
            return Node("variable", value[1:])
        if kind == "regex":
            body, _, flags = value[1:].rpartition("/")
            return Node("regex", re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", body), sum({"i": re.I, "m": re.M}[f] for f in set(flags))))
        if kind == "name":
            if value in ("function", "λ") and self.peek() == "(":
                return self.function()
            if value in ("true", "false", "null"):
                return Node("value", {"true": True, "false": False, "null": None}[value])
            return Node("name", value)
        if value == "-":
            inner = self.expression(70)
            return Node("value", -inner.value) if inner.kind == "value" and isinstance(inner.value, (int, float)) else Node("minus", parts=[inner])
        if value == "*":
            return Node("wildcard")
        if value == "**":
            return Node("descendants")
        if value == "%":
            return Node("parent")
        if value == "(":
            return Node("block", parts=self.many(")", ";"))
        if value == "[":
            return Node("array", parts=self.many("]"))
        if value == "{":
            return Node("object", parts=self.pairs())
        if value == "|":
            where = self.expression(0)
            self.take("|")
            parts = [where, self.expression(0)]
            if self.peek() == ",":
                self.take()
                parts.append(self.expression(0))
            self.take("|")
            return Node("transform", parts=parts)
        if value in ("?",):
            return Node("hole")
        raise JsonataError(f"unexpected {value!r} at {at}")

    def function(self) -> Node:
        self.take("(")
        names = []
        while self.peek() != ")":
            kind, value, at = self.take()
            if kind != "variable":
                raise JsonataError(f"a parameter is due at {at}")
            names.append(value[1:])
            if self.peek() == ",":
                self.take()
        self.take(")")
        if self.peek() == "<":  # a signature, which is not enforced
            depth = 0
            while True:
                value = self.take()[1]
                depth += (value == "<") - (value == ">")
                if depth == 0:
                    break
        self.take("{")
        body = self.expression(0)
        self.take("}")
        return Node("function", names, [body])

    def next(self, left: Node) -> Node:
        op = self.take()[1]
        if op == ".":
            return _path(left, self.expression(_POWER["."]))
        if op == "[":
            if self.peek() == "]":
                self.take()
                left = left if left.kind == "path" else _path(left)
                left.keep = True
                return left
            test = self.expression(0)
            self.take("]")
            left = _staged(left)
            left.parts[-1].stages.append(("filter", test))
            return left
        if op == "{":
            pairs = self.pairs()
            left = left if left.kind == "path" else _path(left)
            if left.group is not None:
                raise JsonataError("an expression is grouped twice")
            left.group = pairs
            return left
        if op == "(":
            return Node("call", left, self.many(")"))
        if op in "@#":
            name = self.take()[1][1:]
            left = _staged(left)
            if op == "@":
                left.parts[-1].focus = name
            else:
                left.parts[-1].stages.append(("place", name))
            return left
        if op == "^":
            self.take("(")
            terms = []
            while True:
                down = self.peek() == ">"
                if self.peek() in ("<", ">"):
                    self.take()
                terms.append((self.expression(0), down))
                if self.peek() != ",":
                    break
                self.take()
            self.take(")")
            left = left if left.kind == "path" else _path(left)
            left.parts.append(Node("sort", terms))
            return left
        if op == "?":
            then = self.expression(0)
            parts = [left, then]
            if self.peek() == ":":
                self.take()
                parts.append(self.expression(0))
            return Node("if", parts=parts)
        if op == ":=":
            if left.kind != "variable":
                raise JsonataError("only a variable can be bound")
            return Node("bind", left.value, [self.expression(_POWER[":="] - 1)])
        return Node("binary", op, [left, self.expression(_POWER[op])])


def _path(left: Node, right: Node | None = None) -> Node:
    """Steps on end; a path in brackets stays a step of its own."""
    steps, keep, group = [], False, None
    for i, n in enumerate((left, right)):
        if n is None:
            continue
        if n.kind == "value" and isinstance(n.value, str):
            n = Node("name", n.value)
        if n.kind == "path" and n.group is None:
            steps += n.parts
            keep |= n.keep
        elif n.kind == "path" and i == 1:
            steps += n.parts
            keep, group = keep | n.keep, n.group
        else:
            steps.append(n)
    return Node("path", parts=steps, keep=keep, group=group)


def _staged(node: Node) -> Node:
    """The node as a path whose last step can take stages."""
    if node.kind != "path" or node.group is not None:
        return Node("path", parts=[node])
    return node


# Values.


def _is_number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def same(a: object, b: object) -> bool:
    """Deep equality, in which a truth value is no number."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return not isinstance(a, (list, dict)) and not isinstance(b, (list, dict)) and type(a) in (type(b), int, float) and a == b


def truth(v: object) -> bool:
    if isinstance(v, list):
        return truth(v[0]) if len(v) == 1 else any(map(truth, v))
    if v is NOTHING or v is None or callable(v):
        return False
    return bool(v)


def _listed(v: object) -> list:
    return [] if v is NOTHING else v if isinstance(v, list) else [v]


def _append(a: object, b: object) -> object:
    if a is NOTHING or b is NOTHING:
        return b if a is NOTHING else a
    return [*_listed(a), *_listed(b)]


def _settled(v: object, keep: bool = False) -> object:
    """A sequence as the value it stands for."""
    if not isinstance(v, Seq):
        return v
    if keep:
        v.stays = True
    return NOTHING if not v else v[0] if len(v) == 1 and not v.stays else v


def _plain(v: object) -> object:
    """A value as JSON would hold it; numbers to fifteen digits."""
    if isinstance(v, float):
        n = float(f"{v:.15g}")
        return int(n) if n.is_integer() and abs(n) < 1e21 else n
    if isinstance(v, list):
        return [_plain(x) for x in v if x is not NOTHING]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items() if x is not NOTHING}
    return "" if callable(v) else v


def text_of(v: object, pretty: bool = False) -> str:
    if isinstance(v, str):
        return v
    if v is NOTHING or callable(v):
        return ""
    return json.dumps(_plain(v), ensure_ascii=False, **({"indent": 2} if pretty else {"separators": (",", ":")}))


class Frame:
    """Variables in scope, and the items the innermost path came through."""

    def __init__(self, outer: Frame | None, own: dict | None = None, through: tuple | None = None):
        self.outer, self.own = outer, own or {}
        self.through: tuple = through if through is not None else outer.through if outer else ()

    def find(self, name: str) -> object:
        at: Frame | None = self
        while at is not None:
            if name in at.own:
                return at.own[name]
            at = at.outer
        return NOTHING


@dataclass
class Tuple_:
    """An item on a path, the variables bound on the way, and the items before it."""

    item: object
    own: dict
    through: tuple


# Evaluation.


class _Evaluator:
    def run(self, n: Node, here: object, env: Frame) -> object:
        return _settled(getattr(self, "on_" + n.kind)(n, here, env), n.keep)

    def on_value(self, n: Node, here: object, env: Frame) -> object:
        return n.value

    on_regex = on_value

    def on_name(self, n: Node, here: object, env: Frame) -> object:
        return lookup(here, n.value)

    def on_variable(self, n: Node, here: object, env: Frame) -> object:
        return here if n.value == "" else env.find(n.value)

    def on_wildcard(self, n: Node, here: object, env: Frame) -> object:
        out = Seq()

        def flat(v: object) -> None:
            if isinstance(v, list):
                for x in v:
                    flat(x)
            else:
                out.append(v)

        for v in here.values() if isinstance(here, dict) else []:
            flat(v)
        return out

    def on_descendants(self, n: Node, here: object, env: Frame) -> object:
        out = Seq()
        stack = [here] if here is not NOTHING else []
        while stack:
            v = stack.pop()
            if isinstance(v, list):
                stack += reversed(v)
            else:
                out.append(v)
                if isinstance(v, dict):
                    stack += reversed(v.values())
        return out

    def on_parent(self, n: Node, here: object, env: Frame) -> object:
        if not env.through:
            raise JsonataError("there is no parent to go back to")
        return env.through[-1]

    def on_minus(self, n: Node, here: object, env: Frame) -> object:
        v = self.run(n.parts[0], here, env)
        if v is NOTHING:
            return v
        if not _is_number(v):
            raise JsonataError("only a number can be negated")
        return -v

    def on_block(self, n: Node, here: object, env: Frame) -> object:
        out, env = NOTHING, Frame(env)
        for part in n.parts:
            out = self.run(part, here, env)
        return out

    def on_array(self, n: Node, here: object, env: Frame) -> object:
        out: list = []
        for part in n.parts:
            v = self.run(part, here, env)
            if v is not NOTHING:
                out += [v] if part.kind == "array" or not isinstance(v, list) else v
        return out

    def on_object(self, n: Node, here: object, env: Frame) -> object:
        return self.grouped(n.parts, [Tuple_(x, {}, env.through) for x in (here if isinstance(here, list) else [here])], env)

    def grouped(self, pairs: list, rows: list[Tuple_], env: Frame) -> dict:
        found: dict[str, tuple[int, list[Tuple_]]] = {}
        for row in rows or [Tuple_(NOTHING, {}, env.through)]:
            for i, (key, _) in enumerate(pairs):
                name = self.run(key, row.item, Frame(env, row.own, row.through))
                if name is NOTHING:
                    continue
                if not isinstance(name, str):
                    raise JsonataError(f"a key must be a text, not {text_of(name)}")
                if found.setdefault(name, (i, []))[0] != i:
                    raise JsonataError(f"several values have the key {name}")
                found[name][1].append(row)
        out = {}
        for name, (i, members) in found.items():
            item = members[0].item if len(members) == 1 else [x for m in members for x in _listed(m.item)]
            own = {k: members[0].own[k] if len(members) == 1 else [m.own[k] for m in members] for k in members[0].own}
            v = self.run(pairs[i][1], item, Frame(env, own, members[0].through))
            if v is not NOTHING:
                out[name] = v
        return out

    def on_if(self, n: Node, here: object, env: Frame) -> object:
        if truth(self.run(n.parts[0], here, env)):
            return self.run(n.parts[1], here, env)
        return self.run(n.parts[2], here, env) if len(n.parts) > 2 else NOTHING

    def on_bind(self, n: Node, here: object, env: Frame) -> object:
        env.own[n.value] = out = self.run(n.parts[0], here, env)
        return out

    def on_function(self, n: Node, here: object, env: Frame) -> object:
        def call(*args: object) -> object:
            given = {name: args[i] if i < len(args) else NOTHING for i, name in enumerate(n.value)}
            return self.run(n.parts[0], here, Frame(env, given))

        call.arity = len(n.value)
        return call

    def on_hole(self, n: Node, here: object, env: Frame) -> object:
        raise JsonataError("a place holder stands outside a call")

    def on_transform(self, n: Node, here: object, env: Frame) -> object:
        def change(value: object) -> object:
            if value is NOTHING:
                return value
            if not isinstance(value, (dict, list)):
                raise JsonataError("only objects and arrays can be transformed")
            copy = json.loads(json.dumps(_plain(value)))
            for match in _listed(self.run(n.parts[0], copy, env)):
                update = self.run(n.parts[1], match, env)
                if update is not NOTHING:
                    if not isinstance(update, dict):
                        raise JsonataError("an update must be an object")
                    match.update(update)
                if len(n.parts) > 2:
                    for name in _listed(self.run(n.parts[2], match, env)):
                        if not isinstance(name, str):
                            raise JsonataError("names to delete must be texts")
                        match.pop(name, None)
            return copy

        change.arity = 1
        return change

    def on_call(self, n: Node, here: object, env: Frame, first: object = None) -> object:
        # ``first`` holds what a chain hands on.
        fn = self.run(n.value, here, env)
        if not callable(fn):
            raise JsonataError(f"{n.value.value or 'this'} is no function")
        given = list(first or ())
        holes = any(p.kind == "hole" for p in n.parts)
        args = given + [None if p.kind == "hole" else self.run(p, here, env) for p in n.parts]
        if holes:
            spots = [len(given) + i for i, p in enumerate(n.parts) if p.kind == "hole"]

            def partial(*more: object) -> object:
                filled = list(args)
                for spot, v in zip(spots, more):
                    filled[spot] = v
                return fn(*filled)

            partial.arity = len(spots)
            return partial
        return _native(fn, args, here)

    def on_binary(self, n: Node, here: object, env: Frame) -> object:
        op, (left, right) = n.value, n.parts
        if op == "~>":
            a = self.run(left, here, env)
            if right.kind == "call":
                return self.on_call(right, here, env, [a])
            fn = self.run(right, here, env)
            if not callable(fn):
                raise JsonataError("the right side of a chain must be a function")
            if callable(a):
                def both(*args: object) -> object:
                    return fn(a(*args))

                both.arity = 1
                return both
            return fn(a)
        a = self.run(left, here, env)
        if op == "and":
            return truth(a) and truth(self.run(right, here, env))
        if op == "or":
            return truth(a) or truth(self.run(right, here, env))
        if op == "??":
            return a if a is not NOTHING else self.run(right, here, env)
        if op == "?:":
            return a if truth(a) else self.run(right, here, env)
        b = self.run(right, here, env)
        if op == "&":
            return text_of(a) + text_of(b)
        if op in ("=", "!="):
            return a is not NOTHING and b is not NOTHING and same(a, b) == (op == "=")
        if op == "in":
            return a is not NOTHING and any(x is a or (not isinstance(x, (list, dict)) and same(x, a)) for x in _listed(b))
        if op == "..":
            if a is NOTHING or b is NOTHING:
                return NOTHING
            if not (_is_number(a) and _is_number(b) and a == int(a) and b == int(b)):
                raise JsonataError("a range needs whole numbers")
            return Seq(range(int(a), int(b) + 1))
        if op in ("<", ">", "<=", ">="):
            if any(x is not NOTHING and not _is_number(x) and not isinstance(x, str) for x in (a, b)):
                raise JsonataError(f"{op} compares numbers or texts")
            if a is NOTHING or b is NOTHING:
                return NOTHING
            if isinstance(a, str) != isinstance(b, str):
                raise JsonataError(f"{op} compares a number with a text")
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        if any(x is not NOTHING and not _is_number(x) for x in (a, b)):
            raise JsonataError(f"{op} needs numbers")
        if a is NOTHING or b is NOTHING:
            return NOTHING
        if op in "/%" and b == 0:
            raise JsonataError("division by zero")
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b)}[op]()
        return int(out) if isinstance(out, float) and out.is_integer() and abs(out) < 1e15 else out

    # Paths.

    def on_path(self, n: Node, here: object, env: Frame) -> object:
        begin = here if isinstance(here, list) and n.parts[0].kind not in ("variable", "block") else [here]
        rows = [Tuple_(x, {}, env.through) for x in begin]
        for i, step in enumerate(n.parts):
            last = i == len(n.parts) - 1
            if i == 0 and step.kind == "array" and not step.stages:
                found = self.run(step, begin if isinstance(here, list) else here, env)
                rows = [Tuple_(x, {}, env.through) for x in found]
                if last:
                    return self.grouped(n.group, rows, env) if n.group is not None else found
            elif step.kind == "sort":
                rows = self.sorted(step.value, rows, env)
            else:
                rows, alone = self.step(step, rows, env)
                if last and alone is not None and n.group is None:
                    return alone if not n.keep or alone else NOTHING
            if not rows:
                break
        if n.group is not None:
            return self.grouped(n.group, rows, env) if rows else NOTHING
        return Seq(r.item for r in rows)

    def step(self, step: Node, rows: list[Tuple_], env: Frame) -> tuple[list[Tuple_], list | None]:
        """The items a step leads to; and the array it gave if it gave one array and nothing else."""
        filters_first = not step.focus and all(kind == "filter" for kind, _ in step.stages)
        out: list[Tuple_] = []
        results: list = []
        for row in rows:
            frame = Frame(env, row.own, row.through)
            if step.kind == "parent":
                # A step back goes to the item before, and what lay before that one comes with it.
                if not row.through:
                    raise JsonataError("there is no parent to go back to")
                found, through = row.through[-1], row.through[:-1]
            else:
                found, through = self.run(step, row.item, frame), (*row.through, row.item)
            if found is NOTHING:
                continue
            some = [Tuple_(x, row.own, through) for x in (found if isinstance(found, list) and not (step.kind == "array") else [found])]
            if step.focus:
                some = [Tuple_(row.item, {**row.own, step.focus: t.item}, row.through) for t in some]
            elif filters_first and step.stages:
                for _, test in step.stages:
                    some = self.filtered(test, some, env)
                if not some:
                    continue
            results.append(found if not step.stages and not step.focus else some)
            out += some
        if not filters_first:
            for kind, what in step.stages:
                if kind == "filter":
                    out = self.filtered(what, out, env)
                else:
                    out = [Tuple_(t.item, {**t.own, what: i}, t.through) for i, t in enumerate(out)]
        alone = results[0] if len(results) == 1 and not step.stages and not step.focus and isinstance(results[0], list) and not isinstance(results[0], Seq) else None
        return out, alone

    def filtered(self, test: Node, rows: list[Tuple_], env: Frame) -> list[Tuple_]:
        out = []
        for i, row in enumerate(rows):
            v = test.value if test.kind == "value" else self.run(test, row.item, Frame(env, row.own, row.through))
            places = v if isinstance(v, list) else [v]
            if places and all(map(_is_number, places)):
                if any((p := math.floor(x)) == i or p + len(rows) == i for x in places):
                    out.append(row)
            elif truth(v):
                out.append(row)
        return out

    def sorted(self, terms: list[tuple[Node, bool]], rows: list[Tuple_], env: Frame) -> list[Tuple_]:
        def order(a: Tuple_, b: Tuple_) -> int:
            for term, down in terms:
                x, y = (self.run(term, t.item, Frame(env, t.own, t.through)) for t in (a, b))
                if x is NOTHING or y is NOTHING:
                    if x is y:
                        continue
                    return 1 if x is NOTHING else -1
                if not ((_is_number(x) and _is_number(y)) or (isinstance(x, str) and isinstance(y, str))):
                    raise JsonataError("an order needs numbers or texts")
                if x != y:
                    return (-1 if x < y else 1) * (-1 if down else 1)
            return 0

        return sorted(rows, key=cmp_to_key(order))


def lookup(v: object, name: str) -> object:
    if isinstance(v, list):
        out = Seq()
        for x in v:
            found = lookup(x, name)
            if found is not NOTHING:
                out += found if isinstance(found, list) else [found]
        return out
    return v.get(name, NOTHING) if isinstance(v, dict) else NOTHING


# Functions of the language.

FUNCTIONS: dict[str, Callable] = {}


def _function(name: str, least: int = 1, context: type | tuple | None = None, arity: int | None = None) -> Callable:
    """``least`` arguments; with ``context`` the item at hand stands for a first one that is missing (or not of that type)."""

    def add(fn: Callable) -> Callable:
        fn.least, fn.context, fn.arity = least, context, least if arity is None else arity
        FUNCTIONS[name] = fn
        return fn

    return add


def _native(fn: Callable, args: list, here: object) -> object:
    context = getattr(fn, "context", None)
    if context is not None and (len(args) < fn.least or (context is not object and args and args[0] is not NOTHING and not isinstance(args[0], context) and isinstance(here, context))):
        args = [here, *args]
    try:
        return fn(*args)
    except TypeError as e:
        raise JsonataError(f"wrong arguments: {e}") from e
    except RecursionError as e:
        raise JsonataError("the expression calls itself without end") from e


def _call(fn: Callable, *args: object) -> object:
    return fn(*args[: max(1, getattr(fn, "arity", len(args)))])


def _text(v: object) -> str:
    if not isinstance(v, str):
        raise JsonataError(f"a text is due, not {text_of(v)}")
    return v


def _texts(name: str, act: Callable, least: int = 1) -> None:
    """A function whose first argument is a text; no text, no result."""

    def run(s: object = NOTHING, *more: object) -> object:
        return s if s is NOTHING else act(_text(s), *more)

    _function(name, least, str)(run)


def _numbers(name: str, act: Callable) -> None:
    def run(v: object = NOTHING, *more: object) -> object:
        if v is NOTHING:
            return v
        if not _is_number(v):
            raise JsonataError(f"${name} needs a number")
        return act(v, *more)

    _function(name, 1, (int, float))(run)


def _over(name: str, act: Callable) -> None:
    """A function of an array of numbers."""

    def run(v: object = NOTHING) -> object:
        if v is NOTHING:
            return v
        if not all(map(_is_number, _listed(v))):
            raise JsonataError(f"${name} needs numbers")
        return act(_listed(v)) if _listed(v) else NOTHING

    _function(name, 1)(run)


_over("max", max)
_over("min", min)
_over("average", lambda v: sum(v) / len(v))


@_function("sum")
def _sum(v: object = NOTHING) -> object:
    return v if v is NOTHING else sum(_listed(v))


@_function("count")
def _count(v: object = NOTHING) -> int:
    return len(_listed(v))


def _slice(s: str, start: float, length: object = NOTHING) -> str:
    begin = max(0, int(start) + len(s) if start < 0 else int(start))
    return s[begin:] if length is NOTHING else s[begin : begin + max(0, int(length))]


def _round(v: float, digits: object = 0) -> object:
    from decimal import ROUND_HALF_EVEN, Decimal

    n = Decimal(repr(v)).quantize(Decimal(1).scaleb(-int(digits or 0)), ROUND_HALF_EVEN)
    return int(n) if n == n.to_integral_value() else float(n)


_texts("length", len)
_texts("uppercase", str.upper)
_texts("lowercase", str.lower)
_texts("trim", lambda s: re.sub(r"[ \t\n\r]+", " ", s).strip(" "))
_texts("substring", _slice, 2)
_texts("substringBefore", lambda s, mark: s.partition(_text(mark))[0] if mark in s else s, 2)
_texts("substringAfter", lambda s, mark: s.partition(_text(mark))[2] if mark in s else s, 2)
_texts("pad", lambda s, n, fill=" ": s + ((fill or " ") * abs(int(n)))[: max(0, int(n) - len(s))] if n > 0 else ((fill or " ") * abs(int(n)))[: max(0, -int(n) - len(s))] + s, 2)
_texts("contains", lambda s, what: bool(what.search(s)) if isinstance(what, re.Pattern) else _text(what) in s, 2)
_numbers("abs", abs)
_numbers("floor", math.floor)
_numbers("ceil", math.ceil)
_numbers("sqrt", math.sqrt)
_numbers("power", lambda v, n: v**n)
_numbers("round", _round)


def _split(s: str, mark: object, most: object = NOTHING) -> list:
    if isinstance(mark, re.Pattern):
        cuts = [m.span() for m in mark.finditer(s)]
        edges = [0, *(x for c in cuts for x in c), len(s)]
        out = [s[a:b] for a, b in zip(edges[::2], edges[1::2])]
    else:
        out = s.split(_text(mark)) if mark else list(s)
    return out if most is NOTHING else out[: int(most)]


_texts("split", _split, 2)


@_function("join", 1)
def _join(v: object = NOTHING, mark: object = "") -> object:
    return v if v is NOTHING else _text("" if mark is NOTHING else mark).join(map(_text, _listed(v)))


def _match(s: str, pattern: object, most: object = NOTHING) -> Seq:
    found = Seq({"match": m[0], "index": m.start(), "groups": [g or "" for g in m.groups()]} for m in pattern.finditer(s))
    return found if most is NOTHING else Seq(found[: int(most)])


_texts("match", _match, 2)


def _replace(s: str, pattern: object, by: object, most: object = NOTHING) -> str:
    count = 0 if most is NOTHING else int(most)
    if most is not NOTHING and count == 0:
        return s
    if not isinstance(pattern, re.Pattern):
        if not pattern:
            raise JsonataError("an empty text cannot be replaced")
        return s.replace(_text(pattern), _text(by), count or -1)

    def put(m: re.Match) -> str:
        if callable(by):
            return _text(by({"match": m[0], "index": m.start(), "groups": [g or "" for g in m.groups()]}))

        def group(g: re.Match) -> str:
            if g[1] == "$":
                return "$"
            # As many digits as name a group; the others are text.
            for n in range(len(g[1]), 0, -1):
                if int(g[1][:n]) <= m.re.groups:
                    return (m[int(g[1][:n])] or "") + g[1][n:]
            return g[1][1:]

        return re.sub(r"\$(\$|\d+)", group, by)

    return pattern.sub(put, s, count=count)


_texts("replace", _replace, 3)


@_function("string", 1, object)
def _to_string(v: object = NOTHING, pretty: object = False) -> object:
    return v if v is NOTHING else text_of(v, pretty is True)


@_function("number", 1, object)
def _to_number(v: object = NOTHING) -> object:
    if v is NOTHING or _is_number(v):
        return v
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, str) and re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?", v):
        n = float(v)
        return int(n) if n.is_integer() and abs(n) < 1e15 else n
    if isinstance(v, str) and re.fullmatch(r"0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+", v):
        return int(v, 0)
    raise JsonataError(f"{text_of(v)!r} is no number")


@_function("boolean", 1, object)
def _to_boolean(v: object = NOTHING) -> object:
    return v if v is NOTHING else truth(v)


@_function("not", 1, object)
def _not(v: object = NOTHING) -> object:
    return v if v is NOTHING else not truth(v)


@_function("exists", 1)
def _exists(v: object = NOTHING) -> bool:
    return v is not NOTHING


@_function("type", 1, object)
def _type(v: object = NOTHING) -> object:
    if v is NOTHING:
        return v
    if v is None:
        return "null"
    return "boolean" if isinstance(v, bool) else "number" if _is_number(v) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "function"


@_function("keys", 1, object)
def _keys(v: object = NOTHING) -> Seq:
    return Seq(dict.fromkeys(k for x in _listed(v) if isinstance(x, dict) for k in x))


@_function("lookup", 2, object)
def _lookup(v: object, name: object) -> object:
    return lookup(v, name) if isinstance(name, str) else NOTHING


@_function("spread", 1, object)
def _spread(v: object = NOTHING) -> object:
    if isinstance(v, list):
        return Seq(y for x in v for y in _listed(_spread(x)))
    return Seq({k: x} for k, x in v.items()) if isinstance(v, dict) else v


@_function("merge", 1)
def _merge(v: object = NOTHING) -> object:
    return v if v is NOTHING else {k: x for d in _listed(v) for k, x in d.items()}


@_function("append", 2)
def _appended(a: object = NOTHING, b: object = NOTHING) -> object:
    return _append(a, b)


@_function("reverse", 1)
def _reverse(v: object = NOTHING) -> object:
    return v[::-1] if isinstance(v, list) else v


@_function("distinct", 1)
def _distinct(v: object = NOTHING) -> object:
    if not isinstance(v, list) or len(v) < 2:
        return v
    out = Seq() if isinstance(v, Seq) else []
    for x in v:
        if not any(same(x, y) for y in out):
            out.append(x)
    return out


@_function("zip", 1)
def _zip(*arrays: object) -> list:
    return [] if any(a is NOTHING for a in arrays) else [list(t) for t in zip(*map(_listed, arrays))]


@_function("shuffle", 1)
def _shuffle(v: object = NOTHING) -> object:
    return v  # any order will do, so reruns agree


@_function("sort", 1)
def _sort(v: object = NOTHING, after: object = None) -> object:
    if not isinstance(v, list) or len(v) < 2:
        return v
    if after is None or after is NOTHING:
        if not (all(map(_is_number, v)) or all(isinstance(x, str) for x in v)):
            raise JsonataError("$sort needs numbers or texts, or a function")
        return sorted(v)
    return sorted(v, key=cmp_to_key(lambda a, b: 1 if truth(after(a, b)) else -1 if truth(after(b, a)) else 0))


@_function("map", 2)
def _map(v: object, fn: Callable) -> object:
    if v is NOTHING:
        return v
    items = _listed(v)
    return Seq(x for i, item in enumerate(items) if (x := _call(fn, item, i, items)) is not NOTHING)


@_function("filter", 2)
def _filter(v: object, fn: Callable) -> object:
    if v is NOTHING:
        return v
    items = _listed(v)
    return Seq(item for i, item in enumerate(items) if truth(_call(fn, item, i, items)))


@_function("single", 1)
def _single(v: object, fn: object = None) -> object:
    if v is NOTHING:
        return v
    items = _listed(v)
    found = [item for i, item in enumerate(items) if fn is None or truth(_call(fn, item, i, items))]
    if len(found) != 1:
        raise JsonataError(f"$single found {len(found)} members")
    return found[0]


@_function("reduce", 2)
def _reduce(v: object, fn: Callable, begin: object = NOTHING) -> object:
    if v is NOTHING:
        return v
    items = _listed(v)
    total, at = (begin, 0) if begin is not NOTHING else (items[0], 1) if items else (NOTHING, 0)
    for i in range(at, len(items)):
        total = _call(fn, total, items[i], i, items)
    return total


@_function("each", 2, dict)
def _each(v: object, fn: Callable) -> object:
    return v if v is NOTHING else Seq(x for k, item in v.items() if (x := _call(fn, item, k, v)) is not NOTHING)


@_function("sift", 2, dict)
def _sift(v: object, fn: Callable) -> object:
    return v if v is NOTHING else {k: item for k, item in v.items() if truth(_call(fn, item, k, v))} or NOTHING


@_function("error", 0)
def _error(message: object = "an error was raised") -> object:
    raise JsonataError(text_of(message))


@_function("assert", 1)
def _assert(test: object, message: object = "an assertion failed") -> object:
    if not truth(test):
        raise JsonataError(text_of(message))
    return NOTHING


@_function("toMillis", 1, str)
def _to_millis(v: object = NOTHING, picture: object = NOTHING) -> object:
    if v is NOTHING:
        return v
    if picture is not NOTHING:
        raise JsonataError("pictures of dates are not supported")
    try:
        at = datetime.fromisoformat(_text(v))
    except ValueError as e:
        raise JsonataError(f"{v!r} is no moment") from e
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


@_function("fromMillis", 1, (int, float))
def _from_millis(v: object = NOTHING, picture: object = NOTHING) -> object:
    if v is NOTHING:
        return v
    if picture is not NOTHING:
        raise JsonataError("pictures of dates are not supported")
    return datetime.fromtimestamp(v / 1000, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def parse(text: str) -> Node:
    return _Parser(text).whole()


def evaluate(expression: str | Node, document: object, **variables: object) -> object:
    """The value of an expression over a JSON value; ``NOTHING`` if it has none."""
    node = parse(expression) if isinstance(expression, str) else expression
    globals_ = Frame(None, {**FUNCTIONS, **variables, "$": document})
    try:
        return _Evaluator().run(node, document, Frame(globals_))
    except RecursionError as e:
        raise JsonataError("the expression calls itself without end") from e
