"""Variable specs: a type with constraints, its predicate, its generator and its text form.

A spec is immutable.  `violation(column)` is the first broken constraint in order of declaration;
`generate(keys)` is a Column that only depends on the row's coordinates and on the variables that the
constraints read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.errors import GenerationError, ImpossibleToSatisfy, InvalidConstraint, PlumblineError, TypeMismatch
from plumbline.functions import draw
from plumbline.functions.expr import HIGH, LOW, Expression
from plumbline.functions.real import Real as Exact
from plumbline.operators import constraints as C


class Spec:
    accepts: tuple[type, ...] = ()
    real = numeric = False
    #: How values are written, and the defaults.
    formats: dict[str, object] = {}

    def __init__(self, *constraints: C.Constraint):
        self.constraints = tuple(self._adapted(c) for c in constraints)
        self.names = tuple(sorted({n for c in self.constraints for n in c.names}))
        self._options()

    def _adapted(self, c: C.Constraint) -> C.Constraint:
        if not isinstance(c, (*self.accepts, C.Custom, C.OneOf)):
            raise TypeMismatch(f"{type(self).__name__} does not take {type(c).__name__}")
        if isinstance(c, C.OneOf):
            c = c.bind(self.numeric, self.dtype if isinstance(self, (Array, Tuple)) else None)
        c.real = self.real
        return c

    def _options(self) -> list | None:
        """Options that all fixed lists share."""
        out = None
        for c in self.constraints:
            if isinstance(c, C.OneOf) and not c.names:
                values = [_value(o) for o in c.options]
                out = values if out is None else [o for o in out if o in values]
                if not out:
                    raise ImpossibleToSatisfy("no option is left")
        return out

    def also(self, *constraints: C.Constraint) -> "Spec":
        """With more constraints."""
        return self._made((*self.constraints, *constraints))

    def _made(self, constraints: Iterable[C.Constraint]) -> "Spec":
        out = type(self).__new__(type(self))
        out.__dict__.update(self.__dict__)
        Spec.__init__(out, *constraints)
        return out

    def merged(self, other: "Spec") -> "Spec":
        """Both specs' constraints: the values that both allow; of other's format, what is not as by default."""
        if type(self) is not type(other):
            raise TypeMismatch(f"{type(self).__name__} and {type(other).__name__}")
        out = self.also(*other.constraints)
        for name, default in self.formats.items():
            if getattr(other, name) != default:
                setattr(out, name, getattr(other, name))
        return out

    def violation(self, value: Column) -> Column:
        found = [c.violation(value) for c in self.constraints]
        return F.coalesce(*found) if found else F.lit(None).cast(C.VIOLATION)

    def holds(self, value: Column) -> Column:
        return self.violation(value).isNull()

    def unique(self, known: dict | None = None):
        """The only value that is left, or None if that is not known."""
        options = self._options()
        for c in self.find(C.OneOf):
            if c.names:
                try:
                    values = [o.value(known) if isinstance(o, Expression) else _value(o) for o in c.options]
                except PlumblineError:  # a variable is not known
                    continue
                options = values if options is None else [o for o in options if o in values]
        return options[0] if options is not None and len(options) == 1 else None

    def aims(self) -> bool:
        """Whether every value that generate makes satisfies the spec, unless none does."""
        return not self.find(C.Custom)

    def sound(self, *keys) -> Column:
        """A value that satisfies the spec: drawn again until one fits, if generate cannot aim at it; NULL if none does."""
        return self.generate(*keys) if self.aims() else self.retried(lambda attempt: self.generate(*keys, attempt))

    def retried(self, draw: Callable[[Column], Column], most: int = 1000) -> Column:
        """The first of most draws that satisfies the spec, or NULL; later attempts are not evaluated."""
        for c in self.find(C.Custom):
            if hasattr(c.check, "evalType"):
                raise GenerationError(f"{c.name} is a Python function, which can be validated but not aimed at", retryable=False)

        def step(found: Column, attempt: Column) -> Column:
            return F.coalesce(found, F.element_at(F.transform(F.array(draw(attempt)), lambda v: F.when(self.holds(v), v)), 1))

        def block(first: int, end: int) -> Column:
            return F.aggregate(F.sequence(F.lit(first), F.lit(end - 1)), F.lit(None).cast(self.dtype), step)

        # A step is called even where a value is found: so in blocks, and later ones only where none is.
        ends = [0, *(x for x in (8, 64) if x < most), most]
        with C.plainly(False):
            return F.coalesce(*(block(a, b) for a, b in zip(ends, ends[1:], strict=False)))

    def edge_cases(self) -> list["Spec"]:
        return []

    def find(self, kind: type) -> list:
        return [c for c in self.constraints if isinstance(c, kind)]

    def __str__(self) -> str:
        return ", ".join(map(str, self.constraints)) or "no constraints"

    def _choice(self, keys: tuple, also=lambda o: F.lit(True)) -> Column:
        """One of the options that satisfy all other constraints, and also(option); NULL if none does."""
        options = self._options()
        if options is not None:
            made = F.array(*map(C.literal, options))
        else:
            made = F.array(*(o.column(C.ROW) if isinstance(o, Expression) else C.literal(_value(o)) for o in self.find(C.OneOf)[0].options))
        fixed = [c for c in self.constraints if isinstance(c, C.OneOf) and not c.names]
        lists = [c for c in self.constraints if isinstance(c, C.OneOf) and c.names]
        rest = [c for c in self.constraints if c not in fixed] if options is not None else [c for c in self.constraints if c is not lists[0]]
        made = made.cast(f"array<{self.dtype}>")
        with C.plainly(False):
            fits = F.filter(made, lambda o: reduce(lambda a, b: a & b, (c.holds(o) for c in rest), F.lit(True)) & also(o))
        return draw.element(fits, *keys)


def _value(o):
    if isinstance(o, Exact):
        return o.fraction.numerator if o.fraction.denominator == 1 else float(o.fraction)
    if isinstance(o, Expression):
        return o.constant()
    return o


class _Number(Spec):
    numeric = True
    accepts = (C.Between, C.AtLeast, C.AtMost)

    def limits(self) -> tuple[Column | None, Column | None]:
        """The largest lower and the smallest upper bound; literal bounds are folded here, on the driver."""
        lows, highs, low, high = [], [], None, None
        for c in self.find(C._Bounds):
            for x, columns, fold in ((c.low, lows, max), (c.high, highs, min)):
                if x is None:
                    continue
                v = (x.at_least() if x is c.low else x.at_most()) if isinstance(x, Exact) and self.real else (x.ceiling() if x is c.low else x.floor()) if isinstance(x, Exact) else x.constant()
                if v is None:
                    columns.append(x.column(C.ROW).cast(self.dtype))
                elif x is c.low:
                    low = v if low is None else fold(low, v)
                else:
                    high = v if high is None else fold(high, v)
        if low is not None and high is not None and low > high:
            raise ImpossibleToSatisfy(str(self))
        self.fixed = (low, high, bool(lows or highs))
        lows += [F.lit(low).cast(self.dtype)] * (low is not None)
        highs += [F.lit(high).cast(self.dtype)] * (high is not None)
        return (F.greatest(*lows) if len(lows) > 1 else lows[0] if lows else None), (F.least(*highs) if len(highs) > 1 else highs[0] if highs else None)


class Integer(_Number):
    dtype = "bigint"
    accepts = (*_Number.accepts, C.Mod, C.SizeCategory)

    def size(self) -> str:
        out = C.SizeCategory("any")
        for c in self.find(C.SizeCategory):
            out = out.merged(c)
        return out.name

    def generate(self, *keys) -> Column:
        return self.within(None, None, *keys)

    def aims(self) -> bool:
        return super().aims() and (len(self.find(C.Mod)) < 2 or bool(self.find(C.OneOf)))

    def within(self, least: Column | None, most: Column | None, *keys) -> Column:
        """A value of the spec that is also between least and most; NULL if there is none."""
        if self.find(C.OneOf):
            inside = lambda o: reduce(lambda a, b: a & b, [*([o >= least] if least is not None else []), *([o <= most] if most is not None else [])], F.lit(True))
            return self._choice(keys, inside)
        low, high = self.limits()
        a, b, open_bounds = self.fixed
        mods = self.find(C.Mod)
        if low is None and high is None and mods and least is None and most is None:
            raise GenerationError(f"no bounds: {self}", retryable=False)
        narrow = not open_bounds and least is None and most is None and a is not None and b is not None and b - a < 1 << 60
        low = F.lit(LOW).cast("long") if low is None else low
        high = F.lit(HIGH).cast("long") if high is None else high
        low, high = low if least is None else F.greatest(low, least), high if most is None else F.least(high, most)
        first_of = lambda x: x
        if mods:
            m = mods[-1].modulus.column(C.ROW)
            first_of = lambda x: F.try_add(x, F.pmod(F.pmod(mods[-1].remainder.column(C.ROW), m) - F.pmod(x, m), m))
        if self.size() != "any":
            # A size is a wish: where it holds no value, the whole range does.
            a, b = size_range(low, high, self.size())
            inside = F.coalesce(first_of(a) <= b, F.lit(False))
            low, high = F.when(inside, a).otherwise(low), F.when(inside, b).otherwise(high)
        if mods:
            first = first_of(low)
            if narrow:
                return F.when(first <= high, first + m * draw.integer(F.lit(0).cast("long"), F.call_function("div", high - first, m), *keys))
            large = lambda c: c.cast("decimal(20,0)")
            last = F.call_function("div", large(high) - large(first), F.greatest(m, F.lit(1)))
            return F.when(first <= high, (large(first) + large(m) * large(draw.integer(F.lit(0).cast("long"), last, *keys))).cast("long"))
        return draw.integer(low, high, *keys, narrow=narrow)

    def unique(self, known: dict | None = None):
        found = super().unique(known)
        if found is not None:
            return found
        try:
            low = max((b.low.ceiling() if isinstance(b.low, Exact) else b.low.value(known)) for b in self.find(C._Bounds) if b.low is not None)
            high = min((b.high.floor() if isinstance(b.high, Exact) else b.high.value(known)) for b in self.find(C._Bounds) if b.high is not None)
            for m in self.find(C.Mod):
                r, k = m.remainder.value(known), m.modulus.value(known)
                low, high = low + (r - low) % k, high - (high - r) % k
        except (PlumblineError, ValueError):  # a variable is not known, or there is no bound
            return None
        return low if low == high else None

    def edge_cases(self) -> list["Integer"]:
        return [self.also(C.Exactly(x)) for x in self.edge_values()]

    def edge_values(self) -> list[int]:
        """Bounds, small values, powers of two and their neighbours, halves and roots; inside the bounds, in order, once."""
        self.limits()
        low, high, _ = self.fixed
        low, high = LOW if low is None else low, HIGH if high is None else high
        some = [0, 1, -1, 2, -2]
        for k in (7, 8, 15, 16, 31, 32, 62):
            some += [s * ((1 << k) + d) for s in (1, -1) for d in (-1, 0, 1)]
        half = lambda x: x // 2 if x >= 0 else -(-x // 2)
        some += [half(low), half(high), low + 1, high - 1]
        if high > 0:
            root = math.isqrt(high)
            some += [root - 1, root, root + 1]
        return list(dict.fromkeys([low, high, *(x for x in some if low < x < high)]))


#: Fixed values of the size categories: up to N, the last small and the last medium offset.
SIZE_STEPS = [(300, 30, 100), (5_000, 100, 500), (5_000_000, 300, 5_000)]
SIZE_REST = (2_000, 1_000_000)


def size_thresholds(n: Column) -> dict[str, Column]:
    """Within 1 ... n: where tiny, small and medium end and where huge begins."""
    small, medium = (F.lit(x).cast("long") for x in SIZE_REST)
    for top, s, m in reversed(SIZE_STEPS):
        small, medium = F.when(n <= top, F.lit(s)).otherwise(small), F.when(n <= top, F.lit(m)).otherwise(medium)
    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    small = F.when(n <= 100, root).otherwise(small).cast("long")
    half = F.call_function("div", n, F.lit(2).cast("long"))
    medium = F.when(n <= 100, F.least(F.greatest(half, small), n)).otherwise(medium).cast("long")
    tiny = F.when(small <= 10, small).otherwise(F.greatest(F.lit(10), F.floor(F.log2(n.cast("double"))))).cast("long")
    huge = F.when(n <= 10, medium).otherwise(F.call_function("div", n, F.lit(10).cast("long")) * 9).cast("long")
    return {"tiny": tiny, "small": small, "medium": medium, "huge": huge}


def size_range(low: Column, high: Column, size: str) -> tuple[Column, Column]:
    """The part of [low, high] that a size category means; the whole where N = high - low + 1 does not fit."""
    if size == "any":
        return low, high
    if size in ("min", "max"):
        return (low, low) if size == "min" else (high, high)
    at = size_thresholds(high - low + 1)
    first, last = {
        "tiny": (None, at["tiny"]), "small": (None, at["small"]), "medium": (at["small"], at["medium"]),
        "large": (at["medium"], None), "huge": (at["huge"], None),
    }[size]
    return (low if first is None else low + first - 1), (high if last is None else low + last - 1)


class RealFormat:
    """Digits after the point in text."""

    def __init__(self, digits: int = 6):
        if not 1 <= digits <= 20:
            raise InvalidConstraint("1 to 20 digits")
        self.digits = digits


class Real(_Number):
    dtype, real = "double", True

    def __init__(self, *constraints, digits: int = 6):
        self.format = RealFormat(digits)
        super().__init__(*constraints)

    def merged(self, other: "Spec") -> "Spec":
        """As for other specs, but the digits are always other's."""
        out = super().merged(other)
        out.format = other.format
        return out

    def generate(self, *keys) -> Column:
        if self.find(C.OneOf):
            return self._choice(keys).cast("double")
        low, high = self.limits()
        if low is None or high is None:
            raise GenerationError(f"no bounds: {self}", retryable=False)
        return draw.real(low, high, *keys)

    def unique(self, known: dict | None = None):
        """Also the only value between bounds that meet."""
        found = super().unique(known)
        if found is not None:
            return found
        try:
            low = max((b.low.at_least() if isinstance(b.low, Exact) else float(b.low.value(known))) for b in self.find(C._Bounds) if b.low is not None)
            high = min((b.high.at_most() if isinstance(b.high, Exact) else float(b.high.value(known))) for b in self.find(C._Bounds) if b.high is not None)
        except (PlumblineError, ValueError):  # a variable is not known, or there is no bound
            return None
        return low if low == high else None


class String(Spec):
    dtype = "string"
    accepts = (C.Length, C.SizeCategory, C.Alphabet, C.DistinctCharacters, C.SimplePattern)

    def _adapted(self, c: C.Constraint) -> C.Constraint:
        c = super()._adapted(c)
        if isinstance(c, C.Length):
            c.text = True
        return c

    def length(self) -> Integer | None:
        found = self.find(C.Length)
        sizes = [C.SizeCategory(c.name) for c in self.find(C.SizeCategory)]
        return Integer(*(x for c in found for x in c.inner.constraints), *sizes) if found else None

    def alphabet(self) -> str | None:
        out = None
        for c in self.find(C.Alphabet):
            out = c.chars if out is None else "".join(x for x in out if x in c.chars)
        if out == "":
            raise ImpossibleToSatisfy("the alphabets share no character")
        return out

    def generate(self, *keys) -> Column:
        if self.find(C.OneOf):
            return self._choice(keys)
        chars = self.alphabet()
        if self.find(C.SimplePattern):
            return self.find(C.SimplePattern)[-1].pattern.generate(*keys, columns=C.ROW, alphabet=chars)
        length = self.length()
        if chars is None or length is None:
            raise GenerationError("a string needs an alphabet and a length, or a pattern", retryable=False)
        if self.find(C.DistinctCharacters):
            n = length.also(C.AtMost(len(set(chars))), C.AtLeast(0)).generate(*keys, "length")
            return F.array_join(draw.without_replacement(F.array(*map(F.lit, dict.fromkeys(chars))), n, *keys), "")
        n = length.also(C.AtLeast(0)).generate(*keys, "length")
        letter = lambda i: F.substring(F.lit(chars), (draw.draw(*keys, i) % len(chars) + 1).cast("int"), F.lit(1))
        return F.array_join(F.transform(draw.numbered(n), letter), "")

    def aims(self) -> bool:
        return super().aims() and not (self.find(C.SimplePattern) and self.find((C.Length, C.DistinctCharacters)) or len(self.find(C.SimplePattern)) > 1 or any(c.unit == "bytes" for c in self.find(C.Length)))

    def edge_cases(self) -> list["String"]:
        length = self.length()
        return [self.also(C.Length(x)) for x in (length.also(C.AtLeast(0)).edge_values() if length else [])]


class Array(Spec):
    accepts = (C._Length, C.Length, C.SizeCategory, C.Elements, C.DistinctElements, C.Sorted)
    formats = {"separator": " "}

    def __init__(self, element: Spec, *constraints, separator: str = " "):
        self.element, self.separator = element, separator
        super().__init__(C.Elements(element), *constraints)

    @property
    def dtype(self) -> str:
        return f"array<{self.element.dtype}>"

    def length(self) -> Integer | None:
        found = self.find(C.Length)
        sizes = [C.SizeCategory(c.name) for c in self.find(C.SizeCategory)]
        return Integer(*(x for c in found for x in c.inner.constraints), *sizes, C.AtLeast(0)) if found else None

    def _element(self) -> Spec:
        out = self.element
        for c in self.find(C.Elements)[1:]:
            out = out.merged(c.spec)
        return out

    def generate(self, *keys) -> Column:
        if self.find(C.OneOf):
            return self._choice(keys)
        length, element = self.length(), self._element()
        if length is None:
            raise GenerationError("an array needs a length", retryable=False)
        n = length.sound(*keys, "length")
        if self.find(C.DistinctElements):
            out = self._distinct(element, n, keys)
        else:
            out = F.transform(draw.numbered(n), lambda i: element.sound(*keys, "elem", i))
        for c in self.find(C.Sorted):
            if c.plain:
                out = F.reverse(F.array_sort(out)) if c.descending else F.array_sort(out)
            else:
                out = F.array_sort(out, c.compared)
        return draw.let(out, lambda o: F.when(n.isNotNull() & ~F.exists(o, lambda x: x.isNull()), o))

    def aims(self) -> bool:
        return super().aims() and len(self.find(C.Sorted)) < 2

    def _distinct(self, element: Spec, n: Column, keys: tuple) -> Column:
        """Different values, or NULL.  Of an integer range, places of a keyed permutation; else the first n different draws."""
        if isinstance(element, Integer) and not element.find(C.Mod) and not element.find(C.OneOf) and element.aims() and element.size() == "any":
            low, high = element.limits()
            if low is not None and high is not None:
                count = F.try_add(F.try_subtract(high, low), F.lit(1).cast("long"))
                # A range of more than 2^62 values has no number for each; draws differ there.
                return F.when(n.isNotNull(), draw.let(count, lambda c: F.coalesce(F.when(c <= 1 << 62, draw.distinct_integers(c, n, low, *keys, "elem")), F.when(F.coalesce(c > 1 << 62, F.lit(True)), self._first_different(element, n, keys)))))
        return self._first_different(element, n, keys)

    def _first_different(self, element: Spec, n: Column, keys: tuple) -> Column:
        # n H(n) + 14 n draws leave a place empty with a probability of less than 1 %, even if there are no more values than places.
        budget = (n * (F.log(n.cast("double") + 1) + 15)).cast("long")
        drawn = F.array_distinct(F.transform(draw.numbered(budget), lambda i: element.sound(*keys, "elem", i)))
        return draw.let(drawn, lambda d: F.when(F.size(d) >= n, F.slice(d, F.lit(1), n.cast("int"))))

    def edge_cases(self) -> list["Array"]:
        length = self.length()
        return [self.also(C.Length(x)) for x in (length.edge_values() if length else [])]


class Tuple(Spec):
    accepts = (C.Element,)
    formats = {"separator": " "}

    def __init__(self, *parts, separator: str = " "):
        self.parts = [p for p in parts if isinstance(p, Spec)]
        self.separator = separator
        super().__init__(*(C.Element(i, p) for i, p in enumerate(self.parts)), *(p for p in parts if isinstance(p, C.Constraint)))

    @property
    def dtype(self) -> str:
        return "struct<" + ",".join(f"_{i}:{p.dtype}" for i, p in enumerate(self.parts)) + ">"

    def _part(self, i: int) -> Spec:
        out = self.parts[i]
        for c in self.find(C.Element)[len(self.parts) :]:
            out = out.merged(c.spec) if c.i == i else out
        return out

    def generate(self, *keys) -> Column:
        if self.find(C.OneOf):
            return self._choice(keys)
        made = [self._part(i).sound(*keys, f"<{i}>") for i in range(len(self.parts))]
        return F.when(reduce(lambda a, b: a & b, (m.isNotNull() for m in made), F.lit(True)), F.struct(*(m.alias(f"_{i}") for i, m in enumerate(made))))


class Nothing(Spec):
    """The unit type: an alternative without a value."""

    dtype = "void"


class Variant(Tuple):
    """A tagged union: struct(tag, _0, ..., _n) with the tag's field set and the others NULL."""

    def __init__(self, *parts, tags: tuple[str, ...] = (), separator: str = " "):
        super().__init__(*parts, separator=separator)
        self.tags = tuple(tags) or tuple(map(str, range(len(self.parts))))
        if len({t.lower() for t in self.tags}) != len(self.parts) or not all(t and t.isprintable() and " " not in t for t in self.tags):
            raise InvalidConstraint("tags must be printable, and differ by more than case")

    def _adapted(self, c: C.Constraint) -> C.Constraint:
        c = super()._adapted(c)
        if isinstance(c, C.Element):
            c.tagged = True
        return c

    @property
    def dtype(self) -> str:
        return "struct<tag:int," + ",".join(f"_{i}:{'int' if isinstance(p, Nothing) else p.dtype}" for i, p in enumerate(self.parts)) + ">"

    def generate(self, *keys) -> Column:
        if self.find(C.OneOf):
            return self._choice(keys)
        tag = (draw.draw(*keys, "tag") % len(self.parts)).cast("int")
        made = [F.lit(None).cast("int") if isinstance(p, Nothing) else F.when(tag == i, self._part(i).sound(*keys, f"<{i}>")) for i, p in enumerate(self.parts)]
        full = reduce(lambda a, b: a | b, ((tag == i) & (F.lit(True) if isinstance(p, Nothing) else made[i].isNotNull()) for i, p in enumerate(self.parts)))
        return F.when(full, F.struct(tag.alias("tag"), *(c.alias(f"_{i}") for i, c in enumerate(made))))


class Graph(Spec):
    """Undirected, as struct(num_nodes, edges array<struct(u, v[, label])>[, node_labels]); nodes are 0-based."""

    formats = {"one_based": False, "edge_label": None, "node_label": None}
    accepts = (C.EdgeNodes, C.NumNodes, C.NumEdges, C.SizeCategory, C.Connected, C.Loopless, C.NoParallelEdges, C.SimpleGraph, C.EdgeLabels, C.NodeLabels)

    def __init__(self, *constraints, edge_label: Spec | None = None, node_label: Spec | None = None, one_based: bool = False):
        self.edge_label, self.node_label, self.one_based = edge_label, node_label, one_based
        super().__init__(C.EdgeNodes(), *constraints)

    @property
    def dtype(self) -> str:
        label = f",label:{self.edge_label.dtype}" if self.edge_label else ""
        return f"struct<num_nodes:bigint,edges:array<struct<u:bigint,v:bigint{label}>>" + (f",node_labels:array<{self.node_label.dtype}>" if self.node_label else "") + ">"

    def unique(self, known: dict | None = None):
        """Also a graph without edges, and one node with as many loops as are asked for."""
        found = super().unique(known)
        if found is not None:
            return found
        nodes, edges = (c.unique(known) for c in self._counts())
        if nodes is None or self.node_label and nodes:
            return None
        edges = 0 if nodes == 0 else edges
        if edges == 0:
            return {"num_nodes": nodes, "edges": []}
        loops = not self.find((C.Loopless, C.SimpleGraph)) and not self.edge_label and (edges == 1 or not self.find((C.NoParallelEdges, C.SimpleGraph)))
        return {"num_nodes": 1, "edges": [{"u": 0, "v": 0}] * edges} if nodes == 1 and edges is not None and loops else None

    def _counts(self) -> tuple[Integer, Integer]:
        nodes = Integer(*(x for c in self.find(C.NumNodes) for x in c.inner.constraints), *(C.SizeCategory(c.name) for c in self.find(C.SizeCategory)), C.AtLeast(0))
        return nodes, Integer(*(x for c in self.find(C.NumEdges) for x in c.inner.constraints), C.AtLeast(0))

    def generate(self, *keys) -> Column:
        """A random tree first if it must be connected, then the rest of the edges."""
        if not self.find(C.NumNodes) or not self.find(C.NumEdges):
            raise GenerationError("a graph needs numbers of nodes and edges", retryable=False)
        nodes, edges = self._counts()
        loops = not self.find((C.Loopless, C.SimpleGraph))
        parallel = not self.find((C.NoParallelEdges, C.SimpleGraph))
        connected = bool(self.find(C.Connected))
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

        def with_nodes(n: Column) -> Column:
            # Pairs of different nodes, and the loops.
            most = F.call_function("div", n * (n + 1 if loops else n - 1), F.lit(2).cast("long"))
            top = F.when((n > 0) if loops else (n > 1), F.lit(HIGH).cast("long")).otherwise(zero) if parallel else most
            m = edges.within(F.greatest(n - 1, zero) if connected else None, top, *keys, "num_edges")
            return draw.let(m, lambda m: F.when(m.isNotNull(), self._of(n, m, most, loops, parallel, connected, keys)))

        if edges.limits()[1] is None and not edges.find(C.OneOf) and parallel:
            raise GenerationError("the number of edges has no upper bound", retryable=False)
        return draw.let(nodes.within(one if connected else None, None, *keys, "num_nodes"), with_nodes)

    def _of(self, n: Column, m: Column, most: Column, loops: bool, parallel: bool, connected: bool, keys: tuple) -> Column:
        """A graph of n nodes and m edges, of `most` possible pairs."""
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        edge = lambda u, v: F.struct(u.cast("long").alias("u"), v.cast("long").alias("v"))
        none = F.expr("cast(array() as array<struct<u:bigint,v:bigint>>)")
        parent = lambda i: draw.draw(*keys, "tree", i) % (i + 1)
        tree = F.transform(draw.numbered(F.greatest(n - 1, zero)), lambda i: edge(parent(i), i + 1)) if connected else none
        rest = F.greatest(m - (F.greatest(n - 1, zero) if connected else zero), zero)
        if parallel:

            def far(i: Column) -> Column:
                u, w = draw.draw(*keys, "u", i) % F.greatest(n, one), draw.draw(*keys, "v", i)
                return edge(u, w % F.greatest(n, one) if loops else F.pmod(u + 1 + w % F.greatest(n - 1, one), F.greatest(n, one)))

            out = F.concat(tree, F.transform(draw.numbered(rest), far))
        else:
            # Pairs are numbers, loops follow them: all of few, shuffled, or as many places of a permutation as are needed.
            pairs = F.call_function("div", n * (n - 1), F.lit(2).cast("long"))
            few = draw.shuffled(F.transform(draw.numbered(F.least(most, F.lit(draw.FEW).cast("long"))), lambda i: i), *keys, "edges")
            many = F.transform(draw.numbered(m), lambda i: draw.permuted(most, i, *keys, "edges"))
            chosen = F.when(most <= draw.FEW, few).otherwise(many)
            if connected:
                chosen = F.array_except(chosen, F.transform(draw.numbered(F.greatest(n - 1, zero)), lambda i: draw.pair_number(parent(i), i + 1)))
            place = lambda p: F.when(p < pairs, draw.pair(p)).otherwise(edge(p - pairs, p - pairs)) if loops else draw.pair(p)
            out = F.concat(tree, F.transform(F.slice(chosen, F.lit(1), rest.cast("int")), place))
        if self.edge_label:
            out = F.transform(out, lambda e, i: F.struct(e["u"].alias("u"), e["v"].alias("v"), self.edge_label.sound(*keys, "edge_label", i).alias("label")))
        extra = [F.transform(draw.numbered(n), lambda i: self.node_label.sound(*keys, "node_label", i)).alias("node_labels")] if self.node_label else []
        return F.struct(n.alias("num_nodes"), out.alias("edges"), *extra)
