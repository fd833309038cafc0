"""Exact decimal bounds for double columns.

A bound is a fraction.  Comparing a double with it is exact once the bound is moved to
the nearest double on the inner side, so the predicate stays an ordinary comparison.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from plumbline.errors import ParseError

_REAL = re.compile(r"([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,2}))?\Z")


class Real:
    """From "1.25", "1e-3", or numerator and denominator."""

    def __init__(self, value: str | int, below: int | None = None):
        if below is not None or isinstance(value, int):
            self.fraction = Fraction(value, 1 if below is None else below)
        else:
            m = _REAL.match(value.strip())
            if not m or not (m[2] or m[3]) or (m[3] == "" and "." in value):
                raise ParseError("Real", value)
            digits = (m[2] + (m[3] or "")).strip("0") or "0"
            if len(digits) > 19:
                raise ParseError("Real", value, why="too many digits")
            self.fraction = Fraction(int(m[2] + (m[3] or "") or 0), 10 ** len(m[3] or "")) * Fraction(10) ** int(m[4] or 0) * (-1 if m[1] == "-" else 1)
        if max(abs(self.fraction.numerator), self.fraction.denominator) >= 1 << 63:
            raise ParseError("Real", str(value), why="does not fit 64 bits")

    def __str__(self) -> str:
        return str(self.fraction)

    def floor(self) -> int:
        return math.floor(self.fraction)

    def ceiling(self) -> int:
        return math.ceil(self.fraction)

    def at_least(self) -> float:
        """The smallest double that is not below."""
        x = float(self.fraction)
        return x if Fraction(x) >= self.fraction else math.nextafter(x, math.inf)

    def at_most(self) -> float:
        """The largest double that is not above."""
        x = float(self.fraction)
        return x if Fraction(x) <= self.fraction else math.nextafter(x, -math.inf)
