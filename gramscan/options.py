"""Queries and their options."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from .functions import pattern as P


class Case(Enum):
    SENSITIVE = "sensitive"
    INSENSITIVE = "insensitive"
    SMART = "smart"


class Engine(Enum):
    DEFAULT = "default"
    PCRE2 = "pcre2"
    AUTO = "auto"


class BinaryMode(Enum):
    QUIT = "quit"
    BINARY = "binary"
    TEXT = "text"


class Mode(Enum):
    LINES = "lines"
    ONLY_MATCHING = "only_matching"
    COUNT_LINES = "count_lines"
    COUNT_MATCHES = "count_matches"
    FILES_WITH_MATCHES = "files_with_matches"
    FILES_WITHOUT_MATCH = "files_without_match"

    @staticmethod
    def resolve(flags: list[str], invert: bool = False) -> Mode:
        """Of flags in their order (count, count-matches, files-with-matches, files-without-match, only-matching):
        the last of the first four wins over only-matching; counted matches of inverted lines are counted lines."""
        known = {"count": Mode.COUNT_LINES, "count-matches": Mode.COUNT_MATCHES, "files-with-matches": Mode.FILES_WITH_MATCHES, "files-without-match": Mode.FILES_WITHOUT_MATCH}
        for f in flags:
            if f not in known and f != "only-matching":
                raise ValueError(f"unknown mode {f!r}")
        chosen = next((known[f] for f in reversed(flags) if f in known), None)
        only = "only-matching" in flags
        if invert and (only and chosen in (None, Mode.COUNT_LINES) or chosen is Mode.COUNT_MATCHES):
            return Mode.COUNT_LINES
        if only and chosen is Mode.COUNT_LINES:
            return Mode.COUNT_MATCHES
        return chosen or (Mode.ONLY_MATCHING if only else Mode.LINES)


def pattern_lines(text: str) -> list[str]:
    """The patterns of a pattern file: a line each, trimmed; blank lines and those that begin with # are dropped."""
    return [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]


def config_arguments(text: str, arguments: list[str]) -> list[str]:
    """The arguments of a configuration file, one a line, before those given; none of them with --no-config."""
    return arguments if "--no-config" in arguments else [*pattern_lines(text), *arguments]


@dataclass(frozen=True)
class Query:
    """Patterns, OR-ed in their order, with search options."""

    patterns: tuple[str, ...]
    fixed: bool = False
    word: bool = False
    line: bool = False
    case: Case = Case.SENSITIVE
    unicode: bool = True
    invert: bool = False
    engine: Engine = Engine.DEFAULT
    multiline: bool = False
    dotall: bool = False
    crlf: bool = False
    null_data: bool = False
    encoding: str = "auto"
    binary: BinaryMode = BinaryMode.QUIT
    max_count: int | None = None
    before: int = 0
    after: int = 0
    passthru: bool = False
    replace: str | None = None
    pattern_limit: int = 10 << 20
    _compiled: dict = field(default_factory=dict, compare=False, repr=False)

    @staticmethod
    def of(*patterns: str, **options) -> Query:
        return Query(tuple(patterns), **options)

    @staticmethod
    def from_sources(options: list[str] = (), files: list[str] = (), positional: str | None = None, **more) -> Query:
        """Patterns of options, then of the texts of pattern files; the positional one counts only if there are neither."""
        patterns = [*options, *(p for text in files for p in pattern_lines(text))]
        if not options and not files:
            if positional is None:
                raise ValueError("no pattern is given")
            patterns = [positional]
        return Query(tuple(patterns or [r"[^\s\S]"]), **more)  # pattern files without patterns match nothing

    def __post_init__(self):
        if self.max_count == 0:
            raise ValueError("max_count must be positive")
        if sum(map(len, self.patterns)) > self.pattern_limit:
            raise P.PatternError("pattern exceeds the size limit")

    @property
    def insensitive(self) -> bool:
        if self.case is Case.SMART:
            return all(P.smart_insensitive(p, self.fixed) for p in self.patterns)
        return self.case is Case.INSENSITIVE

    @property
    def joined(self) -> str:
        """One pattern, leftmost-first; whole lines win over whole words."""
        body = "|".join(f"(?:{P.escape(p) if self.fixed else p})" for p in self.patterns)
        if self.line:
            return f"^(?:{body})$"
        if self.word:
            return f"\\b{{start-half}}(?:{body})\\b{{end-half}}"
        return body

    def compiled(self) -> Compiled:
        if "c" not in self._compiled:
            self._compiled["c"] = Compiled(self)
        return self._compiled["c"]


class Compiled:
    """A query's pattern for both tiers.  Auto takes the default engine and Java's own dialect if that fails."""

    def __init__(self, q: Query):
        self.native_dialect = q.engine is Engine.PCRE2
        self.tree = None
        flags = P.Flags(i=q.insensitive, u=q.unicode, s=q.multiline and q.dotall, R=q.crlf)
        if not self.native_dialect:
            try:
                for p in q.patterns if not q.fixed else ():
                    P.parse(p, flags)  # each must be valid by itself
                self.tree, parser = P.parse(q.joined, flags)
                self.groups, self.names = parser.groups, parser.names
                self.java, self.python = P.Writer("java").write(self.tree), P.Writer("python").write(self.tree)
                self.can_be_empty = P.can_be_empty(self.tree)
            except P.PatternError:
                if q.engine is not Engine.AUTO:
                    raise
                self.native_dialect = True
        if self.native_dialect:
            import re

            import regex

            body = "|".join(f"(?:{re.escape(p) if q.fixed else p})" for p in q.patterns)
            body = f"^(?:{body})$" if q.line else f"(?<!\\w)(?:{body})(?!\\w)" if q.word else body
            lead = "md" + "U" * q.unicode + "iu" * q.insensitive + "s" * flags.s
            self.java = f"(?{lead}){body}"
            self.python = f"(?m{'i' * q.insensitive}{'s' * flags.s}){body}"
            try:
                compiled = regex.compile(self.python)
            except regex.error as e:
                raise P.PatternError(str(e)) from None
            self.groups, self.names = compiled.groups, dict(compiled.groupindex)
            self.can_be_empty = compiled.match("") is not None
