"""Random draws as pure functions of a row's coordinates.

A draw hashes seed, coordinates (generator, call, case), the path of the value and the attempt,
so it does not depend on partitions, can be pruned, repeated and checked by SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of the keyed permutation, and how often it is applied to leave the places above n.
ROUNDS, WALK = 4, 64
#: Up to so many values are drawn as the start of a shuffle of all.
FEW = 64


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is read."""
    return F.element_at(F.transform(F.array(value), then), 1)


def draw(*keys: Column | str | int) -> Column:
    """Uniform in [0, 2^60)."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def wide(*keys) -> Column:
    """Uniform in [0, 2^120), as a decimal."""
    high, low = (draw(*keys, part).cast("decimal(19,0)") for part in ("high", "low"))
    return (high * F.lit(1 << 60).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def integer(low: Column, high: Column, *keys, narrow: bool = False) -> Column:
    """Uniform in [low, high], up to the whole range of 64 bits; NULL if low is above high.

    narrow says that there are known to be between 1 and 2^60 values.
    """
    if narrow:
        return low + draw(*keys) % (high - low + 1)
    low, high = low.cast("long"), high.cast("long")
    span = F.try_add(F.try_subtract(high, low), F.lit(1).cast("long"))
    few = low + draw(*keys) % F.greatest(span, F.lit(1).cast("long"))
    # A span that does not fit 64 bits is NULL.
    exact = (high.cast("decimal(38,0)") - low.cast("decimal(38,0)") + F.lit(1).cast("decimal(38,0)")).cast("decimal(38,0)")
    many = (low.cast("decimal(38,0)") + (wide(*keys) % exact).cast("decimal(38,0)")).cast("long")
    return F.when(low > high, F.lit(None).cast("long")).when(span <= 1 << 60, few).otherwise(many)


def real(low: Column, high: Column, *keys) -> Column:
    """From a 53-bit draw."""
    u = F.shiftright(draw(*keys), 7).cast("double") * F.lit(2.0**-53)
    return low + u * (high - low)


def element(options: Column, *keys) -> Column:
    """One of the options; NULL if there is none."""
    n = F.size(options)
    return F.when(n > 0, F.try_element_at(options, (draw(*keys) % F.greatest(n, F.lit(1)) + 1).cast("int")))


def numbered(n: Column) -> Column:
    """0 ... n - 1; SEQUENCE counts down when n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.expr("cast(array() as array<long>)"))


def shuffled(items: Column, *keys) -> Column:
    """In the order of a draw for each place."""
    tagged = F.transform(items, lambda x, i: F.struct(draw(*keys, i).alias("o"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def without_replacement(items: Column, k: Column, *keys) -> Column:
    return F.slice(shuffled(items, *keys), F.lit(1), k.cast("int"))


def with_replacement(items: Column, k: Column, *keys) -> Column:
    return F.transform(numbered(k), lambda i: element(items, *keys, i))


def permutation(n: Column, low: Column, *keys) -> Column:
    return shuffled(F.transform(numbered(n), lambda i: i + low), *keys)


def _rounds(x: Column, a: Column, b: Column, keys: tuple) -> Column:
    """A permutation of 0 ... a * b - 1: x is a pair of places below a and b, and each round moves one by a draw of the other."""
    left, right = F.call_function("div", x, b), x % b
    out = F.struct(left.alias("l"), right.alias("r"))
    for i in range(ROUNDS):
        out = let(out, _round(i, a, b, keys))
    return let(out, lambda p: p["l"] * b + p["r"])


def _round(i: int, a: Column, b: Column, keys: tuple) -> Callable[[Column], Column]:
    if i % 2:
        return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + draw(*keys, "round", F.lit(i), p["l"]) % b) % b).alias("r"))
    return lambda p: F.struct(((p["l"] + draw(*keys, "round", F.lit(i), p["r"]) % a) % a).alias("l"), p["r"].alias("r"))


def permuted(n: Column, i: Column, *keys) -> Column:
    """Where a permutation of 0 ... n - 1 that the keys choose sends i: any k places give k different values, without a list of n.

    A Feistel network over a * b places, with a = ceil(sqrt(n)) and b as small as fits; a value that is not below n is
    sent on until it is.  Fewer than a places are not below n, so that a walk ends within as many steps; of
    n > 4096 it has not ended after 64 with a probability of 2^-384, and gives NULL.
    """
    root = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def with_sides(a: Column) -> Column:
        return let(F.greatest(F.call_function("div", n + a - 1, a), F.lit(1).cast("long")), lambda b: walked(a, b))

    def walked(a: Column, b: Column) -> Column:
        first = _rounds(i.cast("long"), a, b, keys)
        # Most are below n at once, and take no steps.
        further = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), y, lambda x, _: F.when(x < n, x).otherwise(_rounds(x, a, b, keys)))
        return let(first, lambda y: F.when(y < n, y).otherwise(let(further(y), lambda x: F.when(x < n, x))))

    return let(F.greatest(root, F.lit(1).cast("long")), with_sides)


def distinct_integers(n: Column, k: Column, low: Column, *keys) -> Column:
    """k different integers of low ... low + n - 1, in time that grows with k alone; NULL if there are not as many."""
    few = F.slice(permutation(F.least(n, F.lit(FEW).cast("long")), low, *keys), F.lit(1), F.greatest(k, F.lit(0)).cast("int"))
    many = F.transform(numbered(k), lambda i: low + permuted(n, i, *keys))
    return F.when(k <= F.greatest(n, F.lit(0)), F.when(n <= FEW, few).otherwise(many))


def _below(v: Column) -> Column:
    """Pairs of nodes below v: v (v - 1) / 2, halved before it is multiplied."""
    return F.shiftright(v, 1) * (v - 1).bitwiseOR(F.lit(1).cast("long"))


def pair(p: Column) -> Column:
    """The unordered pair of different nodes with number p, below 2^61: 0 is {0, 1}, 1 is {0, 2}, 2 is {1, 2}, and so on."""
    guess = F.floor((F.sqrt(8.0 * p.cast("double") + 1.0) + 1.0) / 2.0).cast("long")
    # The square root of a large number may be off by one.
    larger = lambda v: F.when(_below(v) > p, v - 1).when(_below(v + 1) <= p, v + 1).otherwise(v)
    return let(let(guess, larger), lambda v: F.struct((p - _below(v)).alias("u"), v.alias("v")))


def pair_number(u: Column, v: Column) -> Column:
    """The number of {u, v}, which differ."""
    return _below(F.greatest(u, v)) + F.least(u, v)
