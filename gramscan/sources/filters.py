"""Path rules: scopes, excludes, hidden names, globs, types, ignore files, depth, size, order."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Usual names of file types.
TYPES: dict[str, list[str]] = {
    "c": ["*.c", "*.h"], "cpp": ["*.cpp", "*.cc", "*.cxx", "*.hpp", "*.hh"], "css": ["*.css", "*.scss"], "csv": ["*.csv"], "go": ["*.go"], "html": ["*.htm", "*.html"],
    "java": ["*.java"], "js": ["*.js", "*.jsx", "*.mjs"], "json": ["*.json", "*.jsonl"], "make": ["Makefile", "*.mk"], "md": ["*.md", "*.markdown"], "py": ["*.py", "*.pyi"],
    "asm": ["*.asm", "*.s", "*.S"], "bat": ["*.bat"], "clojure": ["*.clj", "*.cljc", "*.cljs", "*.cljx"], "cmake": ["*.cmake", "CMakeLists.txt"], "cs": ["*.cs"], "cuda": ["*.cu", "*.cuh"], "d": ["*.d"], "dart": ["*.dart"], "diff": ["*.patch", "*.diff"],
    "docker": ["*Dockerfile*"], "elixir": ["*.ex", "*.eex", "*.exs"], "elm": ["*.elm"], "erlang": ["*.erl", "*.hrl"], "fortran": ["*.f", "*.f77", "*.f90", "*.f95", "*.for"], "graphql": ["*.graphql"], "haskell": ["*.hs", "*.lhs"], "julia": ["*.jl"], "jupyter": ["*.ipynb"],
    "kotlin": ["*.kt", "*.kts"], "less": ["*.less"], "license": ["COPYING", "COPYING[.-]*", "LICENSE", "LICENSE[.-]*", "NOTICE"], "lisp": ["*.el", "*.jl", "*.lisp", "*.lsp", "*.sc", "*.scm"], "lock": ["*.lock", "package-lock.json"], "log": ["*.log"], "lua": ["*.lua"],
    "nix": ["*.nix"], "objc": ["*.h", "*.m"], "ocaml": ["*.ml", "*.mli", "*.mll", "*.mly"], "perl": ["*.pl", "*.perl", "*.plx", "*.pm", "*.t"], "php": ["*.php", "*.phtml"], "protobuf": ["*.proto"], "r": ["*.R", "*.r", "*.Rmd"], "ruby": ["Gemfile", "*.gemspec", "Rakefile", "*.rb"],
    "sass": ["*.sass", "*.scss"], "scala": ["*.scala", "*.sbt"], "svg": ["*.svg"], "swift": ["*.swift"], "tex": ["*.tex", "*.ltx", "*.cls", "*.sty", "*.bib"], "tf": ["*.tf"], "vim": ["*.vim"], "vue": ["*.vue"], "zig": ["*.zig"], "rust": ["*.rs"], "sh": ["*.sh", "*.bash"], "sql": ["*.sql"], "toml": ["*.toml"], "ts": ["*.ts", "*.tsx"], "txt": ["*.txt"], "xml": ["*.xml"], "yaml": ["*.yaml", "*.yml"],
}


def glob_regex(glob: str) -> str:
    """A path pattern in the manner of ignore files, as a regular expression that Java and Python share."""
    anchored = "/" in glob.rstrip("/")
    directory = glob.endswith("/")
    g, out, i = glob.strip("/"), "", 0
    while i < len(g):
        c = g[i]
        if g[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif g[i:] == "/**":
            out, i = out + "/.+", len(g)
        elif g[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := g.find("]", i + 2)) > 0:
            body = g[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "{" and (end := g.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(re.escape(x).replace("\\*", "[^/]*") for x in g[i + 1 : end].split(",")) + ")", end + 1
        elif c == "\\" and i + 1 < len(g):
            out, i = out + re.escape(g[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if directory else "(?:/.*)?$")


def parse_size(text: str) -> int:
    m = re.fullmatch(r"(\d+)([KMG]?B?)", text.strip().upper())
    if not m:
        raise ValueError(f"bad size {text!r}")
    return int(m[1]) * 1024 ** {"": 0, "B": 0, "K": 1, "M": 2, "G": 3}[m[2].rstrip("B") if m[2] != "B" else ""]


class Types:
    """Type definitions; changes as --type-add and --type-clear make them."""

    def __init__(self):
        self.known = {k: list(v) for k, v in TYPES.items()}

    def add(self, text: str) -> None:
        name, _, rest = text.partition(":")
        if rest.startswith("include:"):
            for other in rest[8:].split(","):
                self.known.setdefault(name, []).extend(self.known[other])
        elif rest:
            self.known.setdefault(name, []).append(rest)
        else:
            raise ValueError(f"bad type definition {text!r}")

    def clear(self, name: str) -> None:
        self.known.pop(name, None)

    def globs(self, name: str) -> list[str]:
        if name == "all":
            return [g for v in self.known.values() for g in v]
        if name not in self.known:
            raise ValueError(f"unknown type {name!r}")
        return self.known[name]


@dataclass
class Filter:
    hidden: bool = False  # include hidden names
    ignore_dot: bool = True
    ignore_vcs: bool = True
    ignore_exclude: bool = True
    ignore_parent: bool = True
    require_git: bool = False
    ignore_files: list[str] = field(default_factory=list)
    globs: list[str] = field(default_factory=list)
    iglobs: list[str] = field(default_factory=list)
    types: list[tuple[str, bool]] = field(default_factory=list)  # (name, selected)
    exclude: list[str] = field(default_factory=list)
    max_depth: int | None = None
    max_size: int | None = None
    follow: bool = False
    one_file_system: bool = False
    definitions: Types = field(default_factory=Types)

    def unrestricted(self, times: int) -> Filter:
        """-u: no ignore rules; -uu: hidden names too."""
        if times >= 1:
            self.ignore_dot = self.ignore_vcs = self.ignore_exclude = self.ignore_parent = False
            self.ignore_files = []
        if times >= 2:
            self.hidden = True
        return self

    def _overrides(self) -> list[tuple[str, bool]]:
        """(regex, whitelisted) in order."""
        lead = "(?i)" if self.iglobs else ""
        return [(lead + glob_regex(g.removeprefix("!")), not g.startswith("!")) for g in [*self.globs, *self.iglobs]]

    def column(self, path: Column, walked: bool = True, size: Column | None = None, admission: str = "full") -> Column:
        """The rules that need a path and a size, as one native expression.  admission "indexed": hidden names were dealt with when the index was built."""
        if self.max_size is not None and size is None:
            raise ValueError("a size limit needs the size's column")
        out = F.lit(True) if self.max_size is None else size <= self.max_size
        if walked and not self.hidden and admission == "full":
            out = out & ~path.rlike(r"(^|/)\.[^/]")
        for x in self.exclude:
            if x:
                out = out & ~in_scope(path, x)
        rules = self._overrides()
        if rules:
            verdict = F.lit(not any(good for _, good in rules))
            for pattern, good in rules:
                verdict = F.when(path.rlike(pattern), F.lit(good)).otherwise(verdict)
            out = out & verdict
        if self.types:
            verdict = F.lit(not any(good for _, good in self.types))
            for name, good in self.types:
                any_of = "|".join(f"(?:{glob_regex(g)})" for g in self.definitions.globs(name))
                verdict = F.when(path.rlike(any_of), F.lit(good)).otherwise(verdict)
            out = out & verdict
        if self.max_depth is not None:
            out = out & (F.size(F.split(path, "/")) - 1 <= self.max_depth)
        return out

    def admits(self, path: str, walked: bool = True) -> bool:
        """``column`` for one path."""
        if walked and not self.hidden and re.search(r"(^|/)\.[^/]", path):
            return False
        if any(x and (path == x or path.startswith(x + "/")) for x in self.exclude):
            return False
        rules = self._overrides()
        verdict = not any(g for _, g in rules)
        for pattern, good in rules:
            if re.search(pattern, path):
                verdict = good
        if not verdict:
            return False
        verdict = not any(g for _, g in self.types)
        for name, good in self.types:
            if any(re.search(glob_regex(g), path) for g in self.definitions.globs(name)):
                verdict = good
        return verdict and (self.max_depth is None or path.count("/") <= self.max_depth)


def in_scope(path: Column, scope: str) -> Column:
    scope = scope.strip("/")
    return F.lit(True) if scope in ("", ".") else (path == scope) | path.startswith(scope + "/")


def scoped(df: DataFrame, scopes: list[str]) -> DataFrame:
    """Rows within any of the scopes; an empty one admits all."""
    if not scopes:
        return df
    rule = F.lit(False)
    for s in scopes:
        rule = rule | in_scope(F.col("path"), s)
    return df.where(rule)


def ordered(df: DataFrame, key: str = "path", descending: bool = False) -> DataFrame:
    """By path parts or by a time column, ties by path; descending reverses all of it."""
    columns = [*([F.col(key)] if key not in ("path", "none") else []), F.split("path", "/")]
    return df if key == "none" else df.orderBy(*[c.desc() if descending else c.asc() for c in columns])


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    explicit: bool
    modified: float = 0.0
    accessed: float = 0.0
    created: float = 0.0


def _rules_of(folder: str, base: str, names: list[str]) -> list[tuple[str, str, bool, bool]]:
    """(base, regex, negated, directories only) of the ignore files of a folder."""
    out = []
    for name in names:
        try:
            lines = open(os.path.join(folder, name), encoding="utf-8", errors="replace").read().splitlines()
        except (FileNotFoundError, NotADirectoryError, IsADirectoryError):
            continue
        for line in lines:
            line = line.rstrip() if not line.endswith("\\ ") else line
            if line and not line.startswith("#"):
                bad = line.startswith("!")
                rule = line[1:] if bad else line.removeprefix("\\")
                out.append((base, glob_regex(rule.rstrip("/") if rule.endswith("/") else rule), bad, rule.endswith("/")))
    return out


def walk(root: str, scopes: list[str], rules: Filter) -> list[Found]:
    """Regular files under the root, sorted by path parts, each once.  A scope that is a file bypasses
    hidden and ignore rules; missing scopes are skipped."""
    out: dict[str, Found] = {}
    git = not rules.require_git or os.path.isdir(os.path.join(root, ".git"))
    names = [*([".gitignore"] if rules.ignore_vcs and git else []), *([".ignore", ".rgignore"] if rules.ignore_dot else [])]
    top: list = []
    if rules.ignore_vcs and git:  # the user's own ignore file counts least
        own = os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git")
        top += _rules_of(own, "", ["ignore"])
    if rules.ignore_exclude and git:
        top += _rules_of(os.path.join(root, ".git/info"), "", ["exclude"])
    if rules.ignore_parent:
        parents = []
        folder = os.path.dirname(os.path.abspath(root))
        while folder != os.path.dirname(folder):
            parents.append(folder)
            folder = os.path.dirname(folder)
        for folder in reversed(parents):
            top += [(None, r, bad, d) for _, r, bad, d in _rules_of(folder, "", names)]
    for name in rules.ignore_files:
        top += _rules_of(root, "", [name])

    def ignored(path: str, is_dir: bool, active: list) -> bool:
        verdict = False
        for base, pattern, bad, only_dirs in active:
            if only_dirs and not is_dir:
                continue
            inner = path if not base else path.removeprefix(base + "/")
            if re.search(pattern, inner):
                verdict = not bad
        return verdict

    def add(path: str, full: str, explicit: bool, walked: bool) -> None:
        s = os.stat(full)
        if (rules.max_size is None or s.st_size <= rules.max_size) and rules.admits(path, walked):
            out.setdefault(path, Found(path, s.st_size, explicit, s.st_mtime, s.st_atime, getattr(s, "st_birthtime", s.st_ctime)))

    device = os.stat(root).st_dev

    def visit(folder: str, path: str, active: list) -> None:
        active = active + _rules_of(folder, path, names)
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            inner = f"{path}/{entry.name}" if path else entry.name
            is_dir = entry.is_dir(follow_symlinks=rules.follow)
            if not rules.hidden and entry.name.startswith(".") or ignored(inner, is_dir, active):
                continue
            if any(x and (inner == x or inner.startswith(x + "/")) for x in rules.exclude):
                continue
            if is_dir:
                if not rules.one_file_system or entry.stat().st_dev == device:
                    if rules.max_depth is None or inner.count("/") < rules.max_depth:
                        visit(entry.path, inner, active)
            elif entry.is_file(follow_symlinks=rules.follow):
                add(inner, entry.path, False, True)

    for scope in scopes or [""]:
        scope = "" if scope in (".", "./") else scope.strip("/")
        full = os.path.join(root, scope)
        if os.path.isfile(full):
            add(scope, full, True, False)
        elif os.path.isdir(full):
            active = list(top)
            at = root
            for part in scope.split("/")[:-1] if scope else []:
                active += _rules_of(at, os.path.relpath(at, root).removeprefix("."), names)
                at = os.path.join(at, part)
            visit(full, scope, active)
    return [out[p] for p in sorted(out, key=lambda p: p.split("/"))]
