"""Constraints as predicates on columns.

A constraint gives, for a value's column, a violation: a struct (path, constraint, value,
expected, details) where it is broken, else NULL.  All are built-in expressions, so plain
comparisons reach the Parquet scan when a caller filters by `holds`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.errors import ImpossibleToSatisfy, InvalidConstraint
from plumbline.functions.expr import Expression
from plumbline.functions.pattern import Pattern
from plumbline.functions.real import Real

VIOLATION = "struct<path:string,constraint:string,value:string,expected:string,details:string>"
Bound = int | str | Real | Expression
#: Columns that stand for variables while an expression is built; others are columns of their names.
ROW: dict[str, Column] = {}


@contextmanager
def scope(known: dict[str, Column]) -> Iterator[None]:
    """Expressions that are built inside read the variables in known from its columns."""
    before = dict(ROW)
    ROW.clear()
    ROW.update(known)
    try:
        yield
    finally:
        ROW.clear()
        ROW.update(before)


#: Whether the predicate that is built now stands by itself, so that it may be a Python function; inside a function of an array none can.
_PLAIN = [False]


@contextmanager
def plainly(yes: bool = True) -> Iterator[None]:
    """Predicates that are built inside are parts of a projection (or, with False, of a function of an array)."""
    before, _PLAIN[0] = _PLAIN[0], yes
    try:
        yield
    finally:
        _PLAIN[0] = before


#: Fixed alphabets by name.
ALPHABETS = {
    "Letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "UpperCase": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "LowerCase": "abcdefghijklmnopqrstuvwxyz",
    "Numbers": "0123456789",
    "AlphaNumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "UpperAlphaNumeric": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "LowerAlphaNumeric": "abcdefghijklmnopqrstuvwxyz0123456789",
}


def bound(x: Bound) -> Expression | Real:
    return x if isinstance(x, (Expression, Real)) else Expression(x)


def low_column(x: Expression | Real, real: bool) -> Column:
    """The least value that a bound allows, as a column of the value's kind."""
    if isinstance(x, Real):
        return F.lit(x.at_least()) if real else F.lit(x.ceiling()).cast("long")
    return x.column(ROW).cast("double" if real else "long")


def high_column(x: Expression | Real, real: bool) -> Column:
    if isinstance(x, Real):
        return F.lit(x.at_most()) if real else F.lit(x.floor()).cast("long")
    return x.column(ROW).cast("double" if real else "long")


def broken(bad: Column, name: str, value: Column, expected: str | Column, path: str | Column = "", details: str | Column = "") -> Column:
    text = [x if isinstance(x, Column) else F.lit(x) for x in (path, expected, details)]
    made = F.struct(text[0].alias("path"), F.lit(name).alias("constraint"), value.cast("string").alias("value"), text[1].alias("expected"), text[2].alias("details"))
    return F.when(bad, made.cast(VIOLATION))


class Constraint:
    """Subclasses give violation(value); names are the variables it reads; real says that the value is a double."""

    names: tuple[str, ...] = ()
    real = False

    def violation(self, value: Column) -> Column:
        raise NotImplementedError

    def holds(self, value: Column) -> Column:
        return self.violation(value).isNull()

    def __str__(self) -> str:
        return type(self).__name__


class _Bounds(Constraint):
    def __init__(self, low: Bound | None, high: Bound | None):
        self.low, self.high = (None if x is None else bound(x) for x in (low, high))
        self.names = tuple(sorted({n for x in (self.low, self.high) if isinstance(x, Expression) for n in x.names}))
        fixed = [x.fraction if isinstance(x, Real) else x.constant() for x in (self.low, self.high) if x is not None]
        if len(fixed) == 2 and None not in fixed and fixed[0] > fixed[1]:
            raise ImpossibleToSatisfy(f"{self} is empty")

    def holds(self, value: Column) -> Column:
        parts = []
        if self.low is not None:
            parts.append(value >= low_column(self.low, self.real))
        if self.high is not None:
            parts.append(value <= high_column(self.high, self.real))
        return reduce(lambda a, b: a & b, parts)

    def violation(self, value: Column) -> Column:
        return broken(~self.holds(value), type(self).__name__, value, str(self))

    def __str__(self) -> str:
        if self.low is None:
            return f"at most {self.high}"
        return f"at least {self.low}" if self.high is None else f"between {self.low} and {self.high}"


class Between(_Bounds):
    def __init__(self, low: Bound, high: Bound):
        super().__init__(low, high)


class AtLeast(_Bounds):
    def __init__(self, low: Bound):
        super().__init__(low, None)


class AtMost(_Bounds):
    def __init__(self, high: Bound):
        super().__init__(None, high)


class OneOf(Constraint):
    """Options are values of the variable's type, Reals, or expressions (texts, for numbers)."""

    def __init__(self, options: Sequence, numeric: bool | None = None):
        self.options = list(options)
        if not self.options:
            raise ImpossibleToSatisfy("no option is left")
        self.numeric, self.kind = numeric, None
        self.names = tuple(sorted({n for o in self.options if isinstance(o, Expression) for n in o.names}))

    def bind(self, numeric: bool, kind: str | None = None) -> "OneOf":
        """Texts are expressions in numeric variables; kind is the type of options that are lists or tuples."""
        made = type(self).__new__(type(self))
        made.__dict__.update(self.__dict__)
        made.options = [Expression(o) if numeric and isinstance(o, str) else o for o in self.options]
        made.numeric, made.kind = numeric, kind
        made.names = tuple(sorted({n for o in made.options if isinstance(o, Expression) for n in o.names}))
        return made

    def holds(self, value: Column) -> Column:
        if self.real:
            near = [F.abs(value - (F.lit(float(o.fraction)) if isinstance(o, Real) else o.column(ROW) if isinstance(o, Expression) else F.lit(o))) < 1e-9 if isinstance(o, (Real, Expression)) else value == F.lit(o) for o in self.options]
            return reduce(lambda a, b: a | b, near)
        plain = [o for o in self.options if not isinstance(o, (Real, Expression))]
        made = [o.column(ROW) for o in self.options if isinstance(o, Expression)] + [F.lit(o.floor()).cast("long") for o in self.options if isinstance(o, Real) and o.fraction.denominator == 1]
        tests = ([_among(value, plain, self.kind)] if plain else []) + [value == c for c in made]
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    def violation(self, value: Column) -> Column:
        return broken(~self.holds(value), type(self).__name__, value, str(self))

    def __str__(self) -> str:
        return "one of {" + ", ".join(map(str, self.options)) + "}"


def _among(value: Column, options: list, kind: str | None) -> Column:
    if all(isinstance(o, (int, float, str)) for o in options):
        return value.isin(options)
    return reduce(lambda a, b: a | b, (value == (literal(o).cast(kind) if kind else literal(o)) for o in options))


def literal(x) -> Column:
    """Python lists, tuples, dicts and scalars as array, struct and scalar columns."""
    if isinstance(x, dict):
        return F.struct(*(literal(v).alias(k) for k, v in x.items()))
    if isinstance(x, tuple):
        return F.struct(*(literal(v).alias(f"_{i}") for i, v in enumerate(x)))
    if isinstance(x, list):
        return F.array(*map(literal, x))
    return F.lit(x).cast("long") if isinstance(x, int) and not isinstance(x, bool) else F.lit(x)


class Exactly(OneOf):
    def __init__(self, value):
        super().__init__([value])

    def __str__(self) -> str:
        return f"exactly {self.options[0]}"


class Mod(Constraint):
    """value = remainder (mod modulus), mathematically; a modulus must be positive."""

    def __init__(self, remainder: int | str, modulus: int | str):
        self.remainder, self.modulus = Expression(remainder), Expression(modulus)
        self.names = tuple(sorted({*self.remainder.names, *self.modulus.names}))
        if self.modulus.constant() is not None and self.modulus.constant() <= 0:
            raise InvalidConstraint("a modulus must be positive")

    def holds(self, value: Column) -> Column:
        m = self.modulus.column(ROW)
        m = F.when(m > 0, m).otherwise(F.raise_error(F.lit("a modulus must be positive")).cast("long"))
        return F.pmod(value, m) == F.pmod(self.remainder.column(ROW), m)

    def violation(self, value: Column) -> Column:
        return broken(~self.holds(value), "Mod", value, str(self))

    def __str__(self) -> str:
        return f"{self.remainder} (mod {self.modulus})"


class SizeCategory(Constraint):
    """A hint for generation: any, min, tiny, small, medium, large, huge, max.  Every value passes."""

    NAMES = ("any", "min", "tiny", "small", "medium", "large", "huge", "max")
    #: What each category contains.
    INSIDE = {"min": ("min", "tiny", "small"), "tiny": ("tiny", "small"), "small": ("small",), "max": ("max", "huge", "large"), "huge": ("huge", "large"), "large": ("large",), "medium": ("medium",)}

    def __init__(self, name: str):
        if name not in self.NAMES:
            raise InvalidConstraint(f"unknown size {name}")
        self.name = name

    def merged(self, other: "SizeCategory") -> "SizeCategory":
        if "any" in (self.name, other.name):
            return other if self.name == "any" else self
        for a, b in ((self, other), (other, self)):
            if b.name in self.INSIDE[a.name]:
                return a
        raise ImpossibleToSatisfy(f"{self.name} and {other.name} exclude each other")

    def violation(self, value: Column) -> Column:
        return F.lit(None).cast(VIOLATION)

    def holds(self, value: Column) -> Column:
        return F.lit(True)


class Custom(Constraint):
    """check(value, *values of names) -> boolean Column.

    A pandas UDF fits for validation; generation takes built-in functions only, as it draws again inside a row.
    """

    def __init__(self, name: str, check: Callable[..., Column], names: Sequence[str] = ()):
        self.name, self.check, self.names = name, check, tuple(sorted(names))
        self.given = tuple(names)

    def holds(self, value: Column) -> Column:
        return self.check(value, *(ROW[n] if n in ROW else F.col(f"`{n}`") for n in self.given))

    def violation(self, value: Column) -> Column:
        return broken(~self.holds(value), self.name, value, self.name)


class _Length(Constraint):
    """Through an inner integer spec; `size` measures the value."""

    def __init__(self, *inner):
        from plumbline.operators.specs import Integer

        self.inner = inner[0] if len(inner) == 1 and isinstance(inner[0], Integer) else Integer(*(x if isinstance(x, Constraint) else Exactly(Expression(x)) for x in inner))
        self.names = self.inner.names

    def size(self, value: Column) -> Column:
        return F.size(value).cast("long")

    def violation(self, value: Column) -> Column:
        return _nested(self.inner.violation(self.size(value)), F.lit("length"))

    def __str__(self) -> str:
        return f"length: {self.inner}"


class Length(_Length):
    """Of an array in elements; of a string in characters, or in bytes with unit="bytes"."""

    def __init__(self, *inner, unit: str = "characters"):
        super().__init__(*inner)
        self.unit, self.text = unit, False

    def size(self, value: Column) -> Column:
        if not self.text:
            return F.size(value).cast("long")
        return (F.length(value) if self.unit == "characters" else F.octet_length(value)).cast("long")


def _nested(v: Column, step: Column) -> Column:
    """A violation seen from one level up: the path gets a step in front."""
    path = F.when(v["path"] == "", step).otherwise(F.concat_ws(" / ", step, v["path"]))
    return F.when(v.isNotNull(), F.struct(path.alias("path"), *(v[k].alias(k) for k in ("constraint", "value", "expected", "details"))).cast(VIOLATION))


class Alphabet(Constraint):
    def __init__(self, chars: str):
        self.chars = ALPHABETS.get(chars, chars)

    def violation(self, value: Column) -> Column:
        rest = F.translate(value, self.chars, "")
        at = _first_of(value, rest)
        return broken(rest != "", "Alphabet", F.substring(rest, 1, 1), f"a character of {self.chars}", F.concat(F.lit("index "), at.cast("string")))

    def holds(self, value: Column) -> Column:
        return F.translate(value, self.chars, "") == ""

    def __str__(self) -> str:
        return f"characters of {self.chars}"


def _first_of(value: Column, rest: Column) -> Column:
    """Where the first character that is left stands."""
    return F.call_function("locate", F.substring(rest, 1, 1), value) - 1


class DistinctCharacters(Constraint):
    def violation(self, value: Column) -> Column:
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        return broken(F.size(F.array_distinct(chars)) != F.size(chars), "DistinctCharacters", value, "distinct characters", _pair(chars))


def _pair(items: Column) -> Column:
    """indices i and j of the first element that equals an earlier one: among neighbours once they are sorted."""
    ordered = F.array_sort(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    later = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
    twice = F.zip_with(F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), later, lambda a, b: F.when(a["x"].eqNullSafe(b["x"]), F.struct(b["i"].alias("j"), a["i"].alias("i"))))
    first = F.array_min(F.array_compact(twice))
    return F.concat(F.lit("indices "), first["i"].cast("string"), F.lit(" and "), first["j"].cast("string"))


class SimplePattern(Constraint):
    def __init__(self, text: str):
        self.pattern = Pattern(text)
        self.names = self.pattern.names

    def holds(self, value: Column) -> Column:
        return self.pattern.matches(value, ROW)

    def violation(self, value: Column) -> Column:
        return broken(~self.holds(value), "SimplePattern", value, str(self))

    def __str__(self) -> str:
        return f"pattern {self.pattern.text}"


class Elements(Constraint):
    """Every element satisfies a spec; the path names the first that does not."""

    def __init__(self, spec):
        self.spec, self.names = spec, spec.names

    def violation(self, value: Column) -> Column:
        with plainly(False):
            each = F.transform(value, lambda x, i: _nested(self.spec.violation(x), F.concat(F.lit("index "), i.cast("string"))))
            return F.try_element_at(F.filter(each, lambda v: v.isNotNull()), F.lit(1))

    def holds(self, value: Column) -> Column:
        with plainly(False):
            return F.forall(value, lambda x: self.spec.violation(x).isNull())

    def __str__(self) -> str:
        return f"elements: {self.spec}"


class Element(Constraint):
    """Field i of a tuple, or alternative i of a tagged union where it is the active one."""

    def __init__(self, i: int, spec):
        self.i, self.spec, self.names, self.tagged = i, spec, spec.names, False

    def violation(self, value: Column) -> Column:
        inner = _nested(self.spec.violation(value[f"_{self.i}"]), F.lit(f"index {self.i}"))
        return F.when(value["tag"] == self.i, inner) if self.tagged else inner

    def __str__(self) -> str:
        return f"element {self.i}: {self.spec}"


class DistinctElements(Constraint):
    def violation(self, value: Column) -> Column:
        return broken(~self.holds(value), "DistinctElements", F.lit(None), "distinct elements", _pair(value))

    def holds(self, value: Column) -> Column:
        return F.size(F.array_distinct(value)) == F.size(value)


class Sorted(Constraint):
    """No neighbour is before(later, earlier) of key; ascending by default."""

    LESS = staticmethod(lambda a, b: a < b)
    SAME = staticmethod(lambda x: x)

    def __init__(self, before: Callable[[Column, Column], Column] | None = None, key: Callable[[Column], Column] | None = None, descending: bool = False):
        before, key = before or Sorted.LESS, key or Sorted.SAME
        self.plain = before is Sorted.LESS and key is Sorted.SAME
        self.before = (lambda a, b: b < a) if descending else before
        self.key, self.descending = key, descending

    def compared(self, a: Column, b: Column) -> Column:
        """-1, 0 or 1 for array_sort."""
        return F.when(self.before(self.key(a), self.key(b)), -1).when(self.before(self.key(b), self.key(a)), 1).otherwise(0)

    def violation(self, value: Column) -> Column:
        bad = F.transform(value, lambda x, i: (i > 0) & self.before(self.key(x), self.key(F.element_at(value, F.greatest(i, F.lit(1))))))
        at = F.array_position(bad, F.lit(True)) - 1
        return broken(at >= 0, "Sorted", F.lit(None), "sorted", F.concat(F.lit("indices "), (at - 1).cast("string"), F.lit(" and "), at.cast("string")))


class _Count(Constraint):
    def __init__(self, *inner):
        from plumbline.operators.specs import Integer

        self.inner = Integer(*(x if isinstance(x, Constraint) else Exactly(Expression(x)) for x in inner))
        self.names = self.inner.names


class NumNodes(_Count):
    def violation(self, value: Column) -> Column:
        return _nested(self.inner.violation(value["num_nodes"]), F.lit("number of nodes"))


class NumEdges(_Count):
    def violation(self, value: Column) -> Column:
        return _nested(self.inner.violation(F.size(value["edges"]).cast("long")), F.lit("number of edges"))


class EdgeNodes(Constraint):
    """Edges join nodes 0 ... num_nodes - 1.  Every graph has this one."""

    def violation(self, value: Column) -> Column:
        n = value["num_nodes"]
        good = lambda e: F.coalesce((F.least(e["u"], e["v"]) >= 0) & (F.greatest(e["u"], e["v"]) < n) & e["u"].isNotNull() & e["v"].isNotNull(), F.lit(False))
        at = F.array_position(F.transform(value["edges"], good), F.lit(False)) - 1
        edge = F.try_element_at(value["edges"], (F.greatest(at, F.lit(0)) + 1).cast("int"))
        shown = F.concat_ws(" ", edge["u"].cast("string"), edge["v"].cast("string"))
        return broken(at >= 0, "EdgeNodes", shown, F.concat(F.lit("nodes below "), n.cast("string")), F.concat(F.lit("edge "), at.cast("string")))

    def holds(self, value: Column) -> Column:
        n = value["num_nodes"]
        return F.forall(value["edges"], lambda e: F.coalesce((F.least(e["u"], e["v"]) >= 0) & (F.greatest(e["u"], e["v"]) < n) & e["u"].isNotNull() & e["v"].isNotNull(), F.lit(False)))


class Loopless(Constraint):
    def violation(self, value: Column) -> Column:
        loops = F.filter(value["edges"], lambda e: e["u"] == e["v"])
        first = F.try_element_at(loops, F.lit(1))["u"].cast("string")
        return broken(F.size(loops) > 0, "Loopless", first, "no loops", "", F.concat(F.lit("loop at node "), first))


class NoParallelEdges(Constraint):
    def violation(self, value: Column) -> Column:
        # Texts, as arrays of structs are compared pair by pair, and texts by their hashes.
        pairs = F.transform(value["edges"], lambda e: F.concat_ws(" ", F.least(e["u"], e["v"]).cast("string"), F.greatest(e["u"], e["v"]).cast("string")))
        return broken(F.size(F.array_distinct(pairs)) != F.size(pairs), "NoParallelEdges", F.lit(None), "no parallel edges", "", _pair(pairs))


class SimpleGraph(Constraint):
    def violation(self, value: Column) -> Column:
        return F.coalesce(Loopless().violation(value), NoParallelEdges().violation(value))


class Connected(Constraint):
    """For graphs held in a row.  No nodes are not connected, one is.  Graphs held as edge tables: operators.graphs.

    By disjoint sets over Arrow lists, in nearly linear time.  Inside a function of an array, where Python cannot be called, labels of
    nodes are merged along the edges, n - 1 times at most.
    """

    def violation(self, value: Column) -> Column:
        n = value["num_nodes"]
        if _PLAIN[0]:
            ends = [F.transform(value["edges"], _end(x)) for x in ("u", "v")]
            return broken(~connected_rows(n, *ends), "Connected", F.lit(None), "connected")
        start = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))

        def merge(labels: Column, e: Column) -> Column:
            a, b = (F.try_element_at(labels, (e[x] + 1).cast("int")) for x in ("u", "v"))
            return F.when(a != b, F.transform(labels, lambda x: F.when(x == b, a).otherwise(x))).otherwise(labels)

        labels = F.aggregate(value["edges"], start, merge)
        return broken((n < 1) | (F.size(F.array_distinct(labels)) > 1), "Connected", F.lit(None), "connected")


def _end(x: str) -> Callable[[Column], Column]:
    return lambda e: e[x]


def connected_rows(n: Column, u: Column, v: Column) -> Column:
    """Whether the edges (u[i], v[i]) connect nodes 0 ... n - 1; NULL where one is NULL.  Edges of other nodes join nothing."""
    from plumbline.operators.disjoint import connected

    @F.arrow_udf("boolean")
    def run(n, u, v):
        return connected(n, u, v)

    return run(n, u, v)


class EdgeLabels(Constraint):
    def __init__(self, spec):
        self.spec, self.names = spec, spec.names

    def violation(self, value: Column) -> Column:
        each = F.transform(value["edges"], lambda e, i: _nested(self.spec.violation(e["label"]), F.concat(F.lit("edge "), i.cast("string"), F.lit("'s label"))))
        return F.try_element_at(F.filter(each, lambda v: v.isNotNull()), F.lit(1))


class NodeLabels(Constraint):
    def __init__(self, spec):
        self.spec, self.names = spec, spec.names

    def violation(self, value: Column) -> Column:
        each = F.transform(value["node_labels"], lambda x, i: _nested(self.spec.violation(x), F.concat(F.lit("node "), i.cast("string"), F.lit("'s label"))))
        return F.try_element_at(F.filter(each, lambda v: v.isNotNull()), F.lit(1))
