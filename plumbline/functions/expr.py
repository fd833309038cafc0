"""Integer expressions over columns: text -> tree -> Column.

Grammar, loosest first: + -, * / %, unary + -, ^ (to the right); abs(x), min(...), max(...).
All arithmetic is on 64-bit integers and overflow is an error; / cuts towards zero and %
has the sign of the dividend.  A tree is built once and emitted as plain Column operators, so
that Catalyst folds constants and code generation covers the whole of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.errors import ExpressionEvaluationError, ExpressionParseError, ValueNotFound

LOW, HIGH = -(1 << 63), (1 << 63) - 1
_TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z][A-Za-z0-9_]*)|([-+*/%^(),]))")


@dataclass(frozen=True)
class Node:
    op: str  # "int", "name", "neg", "pos", an operator, or a function
    args: tuple = ()


class Expression:
    """A parsed expression; equal if the texts are."""

    def __init__(self, text: str | int):
        self.text = str(text)
        self.root = _Parser(self.text).parse()
        self.names = tuple(sorted(_names(self.root)))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Expression) and self.text == other.text

    def __hash__(self) -> int:
        return hash(self.text)

    def __str__(self) -> str:
        return self.text

    def value(self, known: dict[str, int] | None = None) -> int:
        """On the driver, from known values."""
        return _evaluate(self.root, known or {})

    def constant(self) -> int | None:
        return None if self.names else self.value()

    def column(self, columns: dict[str, Column] | None = None) -> Column:
        """NULL where a variable is NULL; errors are raised by the row that has them."""
        return _column(self.root, columns or {})


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionParseError("Expression", text, at, "unknown character")
            self.tokens.append((m.lastindex, m.group(m.lastindex), m.start(m.lastindex)))
            at = m.end()
        self.i = 0

    def fail(self, why: str):
        at = self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)
        raise ExpressionParseError("Expression", self.text, at, why)

    def peek(self) -> str:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else ""

    def take(self, what: str) -> None:
        if self.peek() != what:
            self.fail(f"expected '{what}'")
        self.i += 1

    def parse(self) -> Node:
        out = self.sum()
        if self.i < len(self.tokens):
            self.fail("unexpected token")
        return out

    def left(self, ops: str, below) -> Node:
        out = below()
        while self.peek() and self.peek() in ops:
            op = self.peek()
            self.i += 1
            out = Node(op, (out, below()))
        return out

    def sum(self) -> Node:
        return self.left("+-", self.product)

    def product(self) -> Node:
        return self.left("*/%", self.signed)

    def signed(self) -> Node:
        sign = self.peek()
        if sign and sign in "+-":
            self.i += 1
            if self.peek() and self.peek() in "+-":
                self.fail("two signs in a row")
            return Node("neg" if sign == "-" else "pos", (self.power(),))
        return self.power()

    def power(self) -> Node:
        base = self.atom()
        if self.peek() == "^":
            self.i += 1
            return Node("^", (base, self.signed()))
        return base

    def atom(self) -> Node:
        if self.i >= len(self.tokens):
            self.fail("an operand is missing")
        kind, text, _ = self.tokens[self.i]
        if kind == 1:
            if int(text) > HIGH:
                self.fail("integer is too large")
            self.i += 1
            return Node("int", (int(text),))
        if kind == 2:
            self.i += 1
            if self.peek() != "(":
                return Node("name", (text,))
            if text not in ("abs", "min", "max"):
                self.i -= 1
                self.fail("unknown function")
            self.i += 1
            args = [self.sum()]
            while self.peek() == ",":
                self.i += 1
                args.append(self.sum())
            self.take(")")
            if text == "abs" and len(args) != 1:
                self.fail("abs takes one argument")
            return Node(text, tuple(args))
        self.take("(")
        out = self.sum()
        self.take(")")
        return out


def _names(node: Node) -> set[str]:
    if node.op == "name":
        return {node.args[0]}
    return set() if node.op == "int" else set().union(*map(_names, node.args))


def _checked(x: int) -> int:
    if not LOW <= x <= HIGH:
        raise ExpressionEvaluationError("integer overflow")
    return x


def _power(base: int, exponent: int) -> int:
    if exponent < 0 or base == exponent == 0:
        raise ExpressionEvaluationError("a power needs an exponent of 0 or more, and 0 ^ 0 is undefined")
    if base in (0, 1, -1):
        return base if base >= 0 or exponent % 2 else 1
    if exponent > 63:
        raise ExpressionEvaluationError("integer overflow")
    return base**exponent


def _evaluate(node: Node, known: dict[str, int]) -> int:
    if node.op == "int":
        return node.args[0]
    if node.op == "name":
        if known.get(node.args[0]) is None:
            raise ValueNotFound(node.args[0])
        return known[node.args[0]]
    a, *more = (_evaluate(x, known) for x in node.args)
    if node.op in ("/", "%"):
        if not more[0]:
            raise ExpressionEvaluationError("division by zero")
        q = abs(a) // abs(more[0]) * (1 if (a < 0) == (more[0] < 0) else -1)
        return _checked(q if node.op == "/" else a - q * more[0])
    b = more[0] if more else 0
    out = {
        "neg": lambda: -a, "pos": lambda: a, "abs": lambda: abs(a), "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b,
        "^": lambda: _power(a, b), "min": lambda: min(a, *more, a), "max": lambda: max(a, *more, a),
    }[node.op]()
    return _checked(out)


def power_column(base: Column, exponent: Column) -> Column:
    """Exact integer power by repeated products; POWER works on doubles."""
    bad = (exponent < 0) | ((base == 0) & (exponent == 0))
    small = F.when(base >= 0, base).otherwise(F.when(exponent % 2 == 1, F.lit(-1)).otherwise(F.lit(1))).cast("long")
    small = F.when((exponent == 0), F.lit(1).cast("long")).otherwise(small)
    steps = F.array_repeat(base, F.least(exponent, F.lit(64)).cast("int"))
    product = F.aggregate(steps, F.lit(1).cast("long"), lambda a, x: a * x)
    wrong = F.raise_error(F.lit("a power needs an exponent of 0 or more, and 0 ^ 0 is undefined")).cast("long")
    return F.when(bad, wrong).when(base.isin(-1, 0, 1), small).otherwise(product)


def _column(node: Node, columns: dict[str, Column]) -> Column:
    if node.op == "int":
        return F.lit(node.args[0]).cast("long")
    if node.op == "name":
        return columns.get(node.args[0], F.col(f"`{node.args[0]}`")).cast("long")
    args = [_column(x, columns) for x in node.args]
    a, b = args[0], args[-1]
    if node.op in ("min", "max"):
        # LEAST and GREATEST skip NULL; an unknown argument makes the result unknown.
        known = reduce(lambda x, y: x & y, (c.isNotNull() for c in args))
        return a if len(args) == 1 else F.when(known, (F.least if node.op == "min" else F.greatest)(*args))
    if node.op == "^":
        return power_column(a, b)
    if node.op == "/":
        return F.call_function("div", a, b)
    return {
        "neg": lambda: -a, "pos": lambda: a, "abs": lambda: F.abs(a), "+": lambda: a + b, "-": lambda: a - b,
        "*": lambda: a * b, "%": lambda: a % b,
    }[node.op]()

