"""A strict parser of the pattern dialect, and its translation for Java and Python.

The default dialect has no look-around and no back-references; both are rejected here, since
Java would silently accept them.  Constructs that Java reads differently (swapped greed,
POSIX classes, possessive quantifiers, half word boundaries, set operators, scripts) are
parsed and written anew, never passed through.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Flags:
    i: bool = False
    m: bool = True
    s: bool = False
    U: bool = False
    u: bool = True
    x: bool = False
    R: bool = False


@dataclass
class Node:
    kind: str  # lit class dot assert group rep cat alt
    flags: Flags
    value: object = None
    kids: list = field(default_factory=list)


@dataclass
class Set:
    """A character class: ranges, named parts (Java, Python), nested sets, one operator chain."""

    negated: bool = False
    ranges: list = field(default_factory=list)
    named: list = field(default_factory=list)  # (name, negated)
    nested: list = field(default_factory=list)
    ops: list = field(default_factory=list)  # (operator, Set)


POSIX = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F", "blank": "\\t ", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\t-\\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
_JAVA_WORD, _PY_WORD = "\\p{IsAlphabetic}\\p{M}\\p{Nd}\\p{Pc}\\u200C\\u200D", "\\p{Alphabetic}\\p{M}\\p{Nd}\\p{Pc}\\u200C\\u200D"
_SPACE = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_CATEGORIES = {"L", "Lu", "Ll", "Lt", "Lm", "Lo", "M", "Mn", "Mc", "Me", "N", "Nd", "Nl", "No", "P", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "S", "Sm", "Sc", "Sk", "So", "Z", "Zs", "Zl", "Zp", "C", "Cc", "Cf", "Co", "Cs", "Cn"}
_LONG = {"Letter": "L", "Uppercase_Letter": "Lu", "Lowercase_Letter": "Ll", "Mark": "M", "Number": "N", "Decimal_Number": "Nd", "Punctuation": "P", "Symbol": "S", "Separator": "Z", "Other": "C"}
_BINARY = {"Alphabetic": "Alphabetic", "Alpha": "Alphabetic", "Uppercase": "Uppercase", "Lowercase": "Lowercase", "White_Space": "White_Space", "Ideographic": "Ideographic", "Emoji": "Emoji"}
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "0": "\0"}
_BOUNDARIES = {"start": "wstart", "end": "wend", "start-half": "wstarthalf", "end-half": "wendhalf"}


class Parser:
    def __init__(self, pattern: str, flags: Flags):
        self.p, self.at, self.groups, self.names = pattern, 0, 0, {}
        self.flags = flags

    def fail(self, why: str) -> PatternError:
        return PatternError(f"{why} at {self.at} in {self.p!r}")

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def take(self) -> str:
        if self.at >= len(self.p):
            raise self.fail("pattern ends early")
        self.at += 1
        return self.p[self.at - 1]

    def parse(self) -> Node:
        node = self.alternation()
        if self.at < len(self.p):
            raise self.fail("unopened group")
        return node

    def alternation(self) -> Node:
        outer, arms = self.flags, [self.concatenation()]
        while self.peek() == "|":
            self.at += 1
            arms.append(self.concatenation())
        self.flags = outer
        return arms[0] if len(arms) == 1 else Node("alt", outer, kids=arms)

    def blank(self) -> None:
        while self.flags.x and self.peek():
            if self.peek().isspace():
                self.at += 1
            elif self.peek() == "#":
                while self.peek() and self.take() != "\n":
                    pass
            else:
                return

    def concatenation(self) -> Node:
        kids: list[Node] = []
        while True:
            self.blank()
            c = self.peek()
            if not c or c in "|)":
                return kids[0] if len(kids) == 1 else Node("cat", self.flags, kids=kids)
            if c in "*+?" or c == "{" and kids and self.bounds(look=True):
                if not kids or kids[-1].kind == "flags":
                    raise self.fail("nothing to repeat")
                kids.append(self.repetition(kids.pop()))
                continue
            node = self.atom()
            if node is not None:
                kids.append(node)

    def bounds(self, look: bool = False) -> tuple[int, int | None] | None:
        import re

        m = re.compile(r"\{\s*(\d+)\s*(?:(,)\s*(\d+)?\s*)?\}").match(self.p, self.at)
        if not m:
            raise self.fail("bad repetition")
        lo = int(m[1])
        hi = lo if not m[2] else int(m[3]) if m[3] else None
        if hi is not None and hi < lo or lo > 1000 or (hi or 0) > 1000:
            raise self.fail("bad repetition bounds")
        if not look:
            self.at = m.end()
        return lo, hi

    def repetition(self, kid: Node) -> Node:
        c = self.peek()
        if c == "{":
            lo, hi = self.bounds()
        else:
            self.at += 1
            lo, hi = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        lazy = self.peek() == "?"
        self.at += lazy
        return Node("rep", self.flags, (lo, hi, lazy == self.flags.U), [kid])  # the last: greedy

    def atom(self) -> Node | None:
        c = self.take()
        f = self.flags
        if c == "(":
            return self.group()
        if c == "[":
            return Node("class", f, self.char_class())
        if c == ".":
            return Node("dot", f)
        if c == "^":
            return Node("assert", f, "line_start" if f.m else "text_start")
        if c == "$":
            return Node("assert", f, "line_end" if f.m else "text_end")
        if c == "\\":
            return self.escape()
        return Node("lit", f, c)

    def group(self) -> Node | None:
        outer = self.flags
        index = name = None
        if self.peek() == "?":
            self.at += 1
            for bad in ("=", "!", "<=", "<!", ">", "#", "|"):
                if self.peek(len(bad)) == bad:
                    raise self.fail("look-around and its like are not supported")
            if self.peek(2) == "P<" or self.peek() == "<":
                self.at += 2 if self.peek() == "P" else 1
                end = self.p.find(">", self.at)
                name = self.p[self.at : end]
                if end < 0 or not name.replace("_", "a").replace(".", "a").replace("[", "a").replace("]", "a").isalnum() or name[0].isdigit():
                    raise self.fail("bad group name")
                if name in self.names:
                    raise self.fail("group name used twice")
                self.at = end + 1
                self.groups += 1
                index = self.names[name] = self.groups
            else:
                on, seen = True, ""
                while (c := self.take()) not in ":)":
                    if c == "-" and on:
                        on = False
                    elif c in "imsUuxR":
                        self.flags = replace(self.flags, **{c: on})
                        seen += c
                    else:
                        raise self.fail("unknown flag")
                if c == ")":
                    if not seen:
                        raise self.fail("empty flags")
                    return None  # holds until the group's end
        else:
            self.groups += 1
            index = self.groups
        body = self.alternation_keeping()
        if self.peek() != ")":
            raise self.fail("unclosed group")
        self.at += 1
        self.flags = outer
        return Node("group", outer, (index, name), [body])

    def alternation_keeping(self) -> Node:
        return self.alternation()

    def hexadecimal(self, c: str) -> str:
        if self.peek() == "{":
            end = self.p.find("}", self.at)
            digits, self.at = self.p[self.at + 1 : end], end + 1
        else:
            n = {"x": 2, "u": 4, "U": 8}[c]
            digits = self.peek(n)
            self.at += n
        try:
            return chr(int(digits, 16))
        except ValueError:
            raise self.fail("bad hexadecimal escape") from None

    def unicode_class(self, negated: bool) -> tuple[str, bool]:
        if self.peek() == "{":
            end = self.p.find("}", self.at)
            if end < 0:
                raise self.fail("unclosed class name")
            name, self.at = self.p[self.at + 1 : end], end + 1
        else:
            name = self.take()
        if name.startswith("^"):
            name, negated = name[1:], not negated
        return "p:" + name, negated

    def named(self, c: str) -> tuple[str, bool] | None:
        if c in "dswDSW":
            return c.lower(), c.isupper()
        if c in "pP":
            return self.unicode_class(c == "P")
        return None

    def escape(self) -> Node:
        c = self.take()
        f = self.flags
        if c.isdigit() and c != "0":
            raise self.fail("back-references are not supported")
        if c == "k":
            raise self.fail("back-references are not supported")
        if got := self.named(c):
            return Node("class", f, Set(named=[got]))
        if c in "xuU":
            return Node("lit", f, self.hexadecimal(c))
        if c == "b" and self.peek() == "{":
            end = self.p.find("}", self.at)
            name = self.p[self.at + 1 : end]
            if name not in _BOUNDARIES:
                raise self.fail("unknown boundary")
            self.at = end + 1
            return Node("assert", f, _BOUNDARIES[name])
        if c in "bBAz<>":
            return Node("assert", f, {"b": "word", "B": "not_word", "A": "text_start", "z": "text_end", "<": "wstart", ">": "wend"}[c])
        if c in _SIMPLE:
            return Node("lit", f, _SIMPLE[c])
        if c.isalnum():
            raise self.fail(f"unknown escape \\{c}")
        return Node("lit", f, c)

    def class_char(self) -> str | tuple[str, bool]:
        c = self.take()
        if c != "\\":
            return c
        c = self.take()
        if got := self.named(c):
            return got
        if c in "xuU":
            return self.hexadecimal(c)
        if c in _SIMPLE:
            return _SIMPLE[c]
        if c.isalnum():
            raise self.fail(f"unknown escape \\{c} in a class")
        return c

    def char_class(self) -> Set:
        out = current = Set()
        if self.peek() == "^":
            self.at += 1
            out.negated = True
        first = True
        while True:
            if self.flags.x:
                self.blank()
            c = self.peek()
            if not c:
                raise self.fail("unclosed class")
            if c == "]" and not first:
                self.at += 1
                return out
            first = False
            if self.peek(2) in ("&&", "--", "~~"):
                op = self.peek(2)
                self.at += 2
                current = Set()
                out.ops.append((op, current))
                first = True
                continue
            if self.peek(2) == "[:":
                end = self.p.find(":]", self.at)
                name = self.p[self.at + 2 : end]
                bad = name.startswith("^")
                if end < 0 or name.lstrip("^") not in POSIX:
                    raise self.fail("unknown POSIX class")
                self.at = end + 2
                current.named.append(("posix:" + name.lstrip("^"), bad))
                continue
            if c == "[":
                self.at += 1
                current.nested.append(self.char_class())
                continue
            lo = self.class_char()
            if isinstance(lo, tuple):
                current.named.append(lo)
                continue
            if self.peek() == "-" and self.peek(2) not in ("-]", "--"):
                self.at += 1
                hi = self.class_char()
                if isinstance(hi, tuple) or hi < lo:
                    raise self.fail("bad class range")
                current.ranges.append((lo, hi))
            else:
                current.ranges.append((lo, lo))


def parse(pattern: str, flags: Flags | None = None) -> tuple[Node, Parser]:
    parser = Parser(pattern, flags or Flags())
    return parser.parse(), parser


def escape_char(c: str) -> str:
    o = ord(c)
    if c.isascii() and c.isalnum():
        return c
    if o < 0x80:
        return f"\\x{o:02X}"
    return f"\\u{o:04X}" if o < 0x10000 else c


class Writer:
    """Writes an AST for ``java`` or for Python's ``regex`` module (version 1)."""

    def __init__(self, target: str = "java"):
        self.java = target == "java"

    def word(self, f: Flags) -> str:
        return "[" + (("0-9A-Za-z_") if not f.u else _JAVA_WORD if self.java else _PY_WORD) + "]"

    def part(self, name: str, f: Flags) -> str:
        """The inside of a class."""
        if name == "w":
            return self.word(f)[1:-1]
        if name == "d":
            return "\\p{Nd}" if f.u else "0-9"
        if name == "s":
            return _SPACE if f.u else "\\t-\\r "
        if name.startswith("posix:"):
            return POSIX[name[6:]]
        name = name[2:]
        key, _, value = name.replace(":", "=").partition("=")
        value = value or key
        if value in _CATEGORIES or value in _LONG:
            return f"\\p{{{_LONG.get(value, value)}}}"
        if value in _BINARY and key == value:
            return f"\\p{{{'Is' if self.java else ''}{_BINARY[value]}}}"
        if value.lower() == "any":
            return "\\x00-\\x{10FFFF}" if self.java else "\\x00-\\U0010FFFF"
        if key == value or key in ("sc", "script", "scx", "Script"):
            return f"\\p{{Is{value}}}" if self.java else f"\\p{{Script={value}}}"
        if key in ("gc", "General_Category"):
            return f"\\p{{{_LONG.get(value, value)}}}"
        raise PatternError(f"unknown class {name!r}")

    def char_set(self, s: Set, f: Flags) -> str:
        parts = ["".join(escape_char(a) if a == b else f"{escape_char(a)}-{escape_char(b)}" for a, b in s.ranges)]
        for name, bad in s.named:
            parts.append(f"[^{self.part(name, f)}]" if bad else f"[{self.part(name, f)}]")
        parts += [self.char_set(n, f) for n in s.nested]
        body = "[" + "".join(parts) + "]" if any(parts) else "[^\\x00-\\x{10FFFF}]" if self.java else "[^\\x00-\\U0010FFFF]"
        for op, other in s.ops:
            o = self.char_set(other, f)
            if op == "&&":
                body = f"[{body}&&{o}]"
            elif op == "--":
                body = f"[{body}&&[^{o}]]"
            else:
                body = f"[[{body}&&[^{o}]][{o}&&[^{body}]]]"
        return f"[^{body}]" if s.negated else body

    def folded(self, text: str, f: Flags) -> str:
        return f"(?{'iu' if self.java and f.u else 'i'}:{text})" if f.i else text

    def write(self, n: Node) -> str:
        f = n.flags
        if n.kind == "lit":
            return self.folded(escape_char(n.value), f) if n.value.isalpha() else escape_char(n.value)
        if n.kind == "class":
            return self.folded(self.char_set(n.value, f), f)
        if n.kind == "dot":
            return "[\\x00-\\x{10FFFF}]" if f.s and self.java else "(?s:.)" if f.s else "[^\\r\\n]" if f.R else "[^\\n]"
        if n.kind == "assert":
            w = self.word(f)
            end = "(?=\\r?\\n|\\r?\\z)" if f.R and self.java else "(?=\\r?\\n|\\r?\\Z)" if f.R else "(?![^\\n])"
            return {
                "line_start": "(?<![^\\n])", "line_end": end, "text_start": "\\A", "text_end": "\\z" if self.java else "\\Z",
                "word": f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))", "not_word": f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))",
                "wstart": f"(?<!{w})(?={w})", "wend": f"(?<={w})(?!{w})", "wstarthalf": f"(?<!{w})", "wendhalf": f"(?!{w})",
            }[n.value]
        if n.kind == "group":
            index, _ = n.value
            return f"({'' if index else '?:'}{self.write(n.kids[0])})"
        if n.kind == "rep":
            lo, hi, greedy = n.value
            q = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((lo, hi), f"{{{lo}}}" if lo == hi else f"{{{lo},{'' if hi is None else hi}}}")
            kid = self.write(n.kids[0])
            single = n.kids[0].kind in ("lit", "class", "dot") and not kid.startswith("(?")  # needs no group, for which Java takes stack
            return f"{kid if single else f'(?:{kid})'}{q}{'' if greedy else '?'}"
        if n.kind == "alt":
            return "(?:" + "|".join(self.write(k) for k in n.kids) + ")"
        return "".join(self.write(k) for k in n.kids)


def can_be_empty(n: Node) -> bool:
    if n.kind in ("lit", "class", "dot"):
        return False
    if n.kind == "assert":
        return True
    if n.kind == "rep":
        return n.value[0] == 0 or can_be_empty(n.kids[0])
    if n.kind == "alt":
        return any(map(can_be_empty, n.kids))
    return all(map(can_be_empty, n.kids))


def smart_insensitive(pattern: str, fixed: bool) -> bool:
    """Smart case: insensitive iff there is a literal and none is upper case."""
    if fixed:
        return not any(c.isupper() for c in pattern)
    try:
        tree, _ = parse(pattern)
    except PatternError:
        plain, i = "", 0
        while i < len(pattern):
            if pattern[i] == "\\":
                i += 2
                continue
            plain += pattern[i]
            i += 1
        return not any(c.isupper() for c in plain)
    literals: list[str] = []

    def of_set(s: Set) -> None:
        for a, b in s.ranges:
            literals.extend((a, b))
        for x in [*s.nested, *(o for _, o in s.ops)]:
            of_set(x)

    def walk(n: Node) -> None:
        if n.kind == "lit":
            literals.append(n.value)
        elif n.kind == "class":
            of_set(n.value)
        for k in n.kids:
            walk(k)

    walk(tree)
    return bool(literals) and not any(c.isupper() for c in literals)


def escape(text: str) -> str:
    """The pattern that matches the text."""
    return "".join("\\" + c if c in "\\.+*?()|[]{}^$#&-~" else c for c in text)
