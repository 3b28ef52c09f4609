"""Replacement templates: $1, $name, ${name}, $$; a name is the longest run of letters, digits and underscores."""

from __future__ import annotations

import re

_PART = re.compile(r"\$(?:\$|\{([^}]*)\}|([0-9A-Za-z_]+))")


def parts(template: str) -> list[str | tuple[str]]:
    """Literal strings, and names as 1-tuples."""
    out: list = []
    at = 0
    for m in _PART.finditer(template):
        out.append(template[at : m.start()])
        out.append("$" if m[0] == "$$" else (m[1] if m[1] is not None else m[2],))
        at = m.end()
    return [p for p in [*out, template[at:]] if p != ""]


def _index(name: str, groups: int, names: dict[str, int]) -> int | None:
    i = int(name) if name.isdigit() else names.get(name)
    return i if i is not None and i <= groups else None


def to_java(template: str, groups: int, names: dict[str, int]) -> str:
    """For Java's replaceAll; unknown groups are empty."""
    out = ""
    for p in parts(template):
        if isinstance(p, str):
            out += p.replace("\\", "\\\\").replace("$", "\\$")
        elif (i := _index(p[0], groups, names)) is not None:
            out += f"${i}"
            out += "\0"
    # a digit after $1 would extend it; Java takes an escaped character as it is
    return re.sub("\0(.?)", lambda m: ("\\" + m[1]) if m[1].isdigit() else m[1], out, flags=re.S)


def expand(template: str, match, names: dict[str, int]) -> str:
    groups = match.re.groups
    out = ""
    for p in parts(template):
        if isinstance(p, str):
            out += p
        elif (i := _index(p[0], groups, names)) is not None:
            out += match[i] or ""
    return out
