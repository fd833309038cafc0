"""Values as short text, for messages about single rows."""

from __future__ import annotations

from collections.abc import Callable

WIDTH, ITEMS = 100, 3
#: How values of a caller's own types are shown, by type: a function of the value and the width.
HOOKS: dict[type, Callable[[object, int], str]] = {}


def shown(value, width: int = WIDTH) -> str:
    """A value in about width characters: long texts and arrays lose their middle or end, at least ITEMS items stay.

    A struct with tag is an alternative, one with num_nodes and edges a graph; other structs are
    tuples.  Characters that do not print are shown by their codes.
    """
    if value is None:
        return "unset"
    for kind, text in HOOKS.items():
        if isinstance(value, kind):
            return text(value, width)
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return _text(value, width)
    fields = value.asDict() if hasattr(value, "asDict") else value if isinstance(value, dict) else None
    if fields is not None and {"num_nodes", "edges"} <= set(fields):
        pairs = [f"{e['u']}-{e['v']}" + (f" ({shown(e['label'], width)})" if "label" in e else "") for e in fields["edges"]]
        return f"Graph(n={fields['num_nodes']}, m={len(pairs)}, edges={_items(pairs, width, '[]')})"
    if fields is not None and "tag" in fields:
        part = fields.get(f"_{fields['tag']}")
        return f"(alternative {fields['tag']})" + ("" if part is None else f" {shown(part, width)}")
    if fields is not None:
        return _items([shown(v, width) for v in fields.values()], width, "<>")
    if isinstance(value, (list, tuple)):
        return _items([shown(v, max(10, width // 2)) for v in value], width, "[]")
    return str(value)


def _text(text: str, width: int) -> str:
    out = [c if c.isprintable() else f"[ASCII {ord(c)}]" if ord(c) < 128 else f"[U+{ord(c):04X}]" for c in text]
    if len(out) > width:
        half = max(1, (width - 3) // 2)
        out = [*out[:half], "...", *out[-half:]]
    return "`" + "".join(out) + "`"


def _items(items: list[str], width: int, brackets: str) -> str:
    out, used = [], 0
    for i, x in enumerate(items):
        if i >= ITEMS and used + len(x) + 2 > width:
            out.append(f"... ({len(items) - i} more)")
            break
        out.append(x)
        used += len(x) + 2
    return brackets[0] + ", ".join(out) + brackets[1]
