"""A small pattern language: greedy, without backtracking.

Characters, [sets] with ranges and ^, groups with | alternatives, and repetition ?, +, *,
{n}, {low,high} whose bounds are integer expressions over other variables.  A part takes its
longest prefix and never gives it back; the first alternative that matches wins.  That is what
possessive and atomic regular expressions do, so a pattern compiles to one Java regex (or a
regex column, if bounds depend on the row).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.errors import PatternEvaluationError, PatternParseError
from plumbline.functions import draw
from plumbline.functions.expr import Expression

ALL = frozenset(map(chr, range(128)))
_RANGES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


@dataclass
class Part:
    chars: frozenset[str] = frozenset()
    low: Expression | None = None  # None: 0, or no repetition when `once`
    high: Expression | None = None  # None: no limit
    once: bool = True
    any_of: list["Part"] = field(default_factory=list)
    all_of: list["Part"] = field(default_factory=list)


class Pattern:
    def __init__(self, text: str):
        self.text, self.at, self.source = text, 0, self._plain(text)
        if not self.source:
            raise PatternParseError("SimplePattern", text, 0, "empty pattern")
        self.root = self._alternatives(inside=False)
        if self.at < len(self.source):
            self._fail("unexpected character")
        self.names = tuple(sorted(self._names(self.root)))

    def _fail(self, why: str):
        raise PatternParseError("SimplePattern", self.text, self.at, why)

    def _plain(self, text: str) -> list[tuple[str, bool]]:
        """(character, escaped) without free blanks; only a backslash and a blank can be escaped."""
        out, i = [], 0
        while i < len(text):
            if text[i] == "\\":
                if text[i + 1 : i + 2] not in ("\\", " "):
                    raise PatternParseError("SimplePattern", text, i, "unknown escape")
                out.append((text[i + 1], True))
                i += 2
                continue
            if text[i] != " ":
                out.append((text[i], False))
            i += 1
        return out

    def _is(self, c: str) -> bool:
        return self.at < len(self.source) and self.source[self.at] == (c, False)

    def _alternatives(self, inside: bool) -> Part:
        options = [self._sequence()]
        while self._is("|"):
            self.at += 1
            options.append(self._sequence())
        if inside:
            if not self._is(")"):
                self._fail("expected ')'")
            self.at += 1
        return options[0] if len(options) == 1 else Part(any_of=options)

    def _sequence(self) -> Part:
        parts = []
        while self.at < len(self.source) and not self._is("|") and not self._is(")"):
            if self._is("("):
                self.at += 1
                parts.append(self._alternatives(inside=True))
                if any(self._is(c) for c in "?+*{"):
                    self._fail("groups cannot be repeated")
            else:
                parts.append(self._repeated(self._set()))
        if not parts:
            self._fail("empty scope")
        return parts[0] if len(parts) == 1 else Part(all_of=parts)

    def _set(self) -> frozenset[str]:
        c, escaped = self.source[self.at]
        if escaped or c != "[":
            if not escaped and c in "]{}?+*^":
                self._fail(f"'{c}' needs a set")
            self.at += 1
            return frozenset(c)
        self.at += 1
        body = []
        # "[" may stand in a set; "]" only as its first character, before another "]".
        while not self._is("]") or not body and self.source[self.at + 1 : self.at + 2] == [("]", False)]:
            if self.at >= len(self.source):
                self._fail("expected ']'")
            body.append(self.source[self.at][0])
            self.at += 1
        self.at += 1
        if not body:
            self._fail("empty set")
        negated = len(body) > 1 and body[0] == "^"
        body = body[negated:]
        out: set[str] = set()
        i = 0
        while i < len(body):
            if i + 2 < len(body) and body[i + 1] == "-":
                home = next((r for r in _RANGES if body[i] in r and body[i + 2] in r), None)
                if home is None or body[i] > body[i + 2]:
                    self._fail("bad range")
                new = set(home[home.index(body[i]) : home.index(body[i + 2]) + 1])
                i += 3
            else:
                if body[i] == "-" and i != len(body) - 1:
                    self._fail("'-' must be last or between")
                new = {body[i]}
                i += 1
            if out & new:
                self._fail("duplicate character")
            out |= new
        return frozenset(ALL - out if negated else out)

    def _repeated(self, chars: frozenset[str]) -> Part:
        if self.at >= len(self.source) or self.source[self.at][1]:
            return Part(chars)
        c = self.source[self.at][0]
        if c in "?+*":
            self.at += 1
            return Part(chars, Expression(int(c == "+")), Expression(1) if c == "?" else None, once=False)
        if c != "{":
            return Part(chars)
        end = next((i for i in range(self.at, len(self.source)) if self.source[i] == ("}", False)), None)
        if end is None:
            self._fail("expected '}'")
        body = "".join(x for x, _ in self.source[self.at + 1 : end])
        self.at = end + 1
        low, comma, high = _split_bounds(body)
        if not comma:
            if not low:
                self._fail("empty repetition")
            return Part(chars, Expression(low), Expression(low), once=False)
        return Part(chars, Expression(low) if low else None, Expression(high) if high else None, once=False)

    def _names(self, part: Part) -> set[str]:
        own = {n for e in (part.low, part.high) if e for n in e.names}
        return own.union(*map(self._names, part.any_of + part.all_of))

    def regex(self, columns: dict[str, Column] | None = None) -> Column | str:
        """A Java regex for whole strings; a text unless bounds depend on columns."""
        if not self.names:
            return r"\A(?>" + _regex(self.root) + r")\z"
        return F.concat(F.lit(r"\A(?>"), _regex_column(self.root, columns or {}), F.lit(r")\z"))

    def matches(self, value: Column, columns: dict[str, Column] | None = None) -> Column:
        made = self.regex(columns)
        return F.regexp_like(value, F.lit(made) if isinstance(made, str) else made)

    def generate(self, *keys, columns: dict[str, Column] | None = None, alphabet: str | None = None) -> Column:
        """A string that the pattern matches: uniform lengths, characters and alternatives."""
        return _generate(self.root, keys, "p", columns or {}, alphabet)


def _split_bounds(body: str) -> tuple[str, bool, str]:
    """At the comma outside parentheses."""
    depth = 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            return body[:i], True, body[i + 1 :]
    return body, False, ""


def char_class(chars: frozenset[str]) -> str:
    return "[" + "".join(f"\\x{ord(c):02x}" for c in sorted(chars)) + "]"


def _regex(part: Part) -> str:
    if part.any_of:
        return "(?>" + "|".join(map(_regex, part.any_of)) + ")"
    if part.all_of:
        return "".join(map(_regex, part.all_of))
    if part.once:
        return char_class(part.chars)
    low = max(0, part.low.value()) if part.low else 0
    high = part.high.value() if part.high else None
    if high is not None and high < low:
        return r"(?!)"
    return f"{char_class(part.chars)}{{{low},{'' if high is None else high}}}+"


def _regex_column(part: Part, columns: dict[str, Column]) -> Column:
    if part.any_of:
        inner = [x for p in part.any_of for x in (F.lit("|"), _regex_column(p, columns))][1:]
        return F.concat(F.lit("(?>"), *inner, F.lit(")"))
    if part.all_of:
        return F.concat(*(_regex_column(p, columns) for p in part.all_of))
    if part.once or not {*(part.low.names if part.low else ()), *(part.high.names if part.high else ())}:
        return F.lit(_regex(part))
    low = F.greatest(part.low.column(columns), F.lit(0).cast("long")) if part.low else F.lit(0).cast("long")
    high = part.high.column(columns) if part.high else None
    text = F.concat(F.lit(char_class(part.chars) + "{"), low.cast("string"), F.lit(","), F.lit("") if high is None else high.cast("string"), F.lit("}+"))
    return text if high is None else F.when(high < low, F.lit("(?!)")).otherwise(text)


def _generate(part: Part, keys: tuple, path: str, columns: dict, alphabet: str | None) -> Column:
    if part.any_of:
        made = F.array(*(_generate(p, keys, f"{path}.{i}", columns, alphabet) for i, p in enumerate(part.any_of)))
        return draw.element(made, *keys, path)
    if part.all_of:
        return F.concat(*(_generate(p, keys, f"{path}.{i}", columns, alphabet) for i, p in enumerate(part.all_of)))
    chars = "".join(sorted(part.chars if alphabet is None else part.chars & set(alphabet)))
    if part.once:
        low = high = F.lit(1).cast("long")
    else:
        if part.high is None:
            raise PatternEvaluationError("an unlimited repetition cannot be generated")
        low = F.greatest(part.low.column(columns), F.lit(0).cast("long")) if part.low else F.lit(0).cast("long")
        high = part.high.column(columns)
    if not chars:
        raise PatternEvaluationError("no character is left to choose from")
    n = draw.integer(low, high, *keys, path)
    letters = F.transform(draw.numbered(n), lambda i: F.substring(F.lit(chars), (draw.draw(*keys, path, i) % len(chars) + 1).cast("int"), F.lit(1)))
    return F.array_join(letters, "")
