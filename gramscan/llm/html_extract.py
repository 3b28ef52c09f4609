"""Main text of web pages; a host's repeated strings decide where markup doesn't.

Markup first: elements that never hold main text (menus, headers and footers, sidebars,
forms, scripts, styles, adverts, notices, comments of readers) are skipped by name, role or
class, and where a page marks its article (article, main, role=main), only that counts.

Pages without such a mark go through the host suffix array: the word streams of the
remaining blocks of a host's pages are concatenated, a suffix array (prefix doubling) finds
strings of at least ``least`` words that occur on distinct pages, and blocks that such
strings cover are boilerplate; the unique runs stay.  An article that is marked as such is
not put through it, since an article that several pages carry in full would vanish.
Hosts are dealt in parts of about ``group`` pages, so that a host of any size is never
in one task.  A suffix array finds what repeats within a part.  For what repeats between parts, each
part of a host of several sends the distinct hashes of its strings of ``least`` words, and of its
shorter blocks, and gets those back that another part has too.  So the size of a host and the way it is dealt
change nothing, but for collisions of 64-bit hashes.

Blocks: text between tags that break lines.  Character references are decoded, white space
and ``br`` inside a block become one space, blocks are trimmed and joined by two newlines in
page order.
Null and empty pages give an empty text.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, fresh, small
from .textops import SPACE, Words, mix, raw, shingles, signed, words_of

_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
SKIPPED = {"head", "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "math", "object", "embed", "canvas", "video", "audio", "button", "select", "option", "textarea", "input", "title", "menu", "dialog", "fieldset"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|nav|navbar|navigation|menu|breadcrumbs?|header|footer|masthead|sidebar|comments?|disqus|replies|share|sharing|social|newsletter|subscribe|signup|login|popup|modal|overlay|widget|related|recommend\w*|pagination|pager|toolbar)(?:$|[\s_-])", re.I)
#: An element that marks an article, or a heading, is dropped for fewer names: it may well have a "header" or "related" class.
_NOT_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|comments?|disqus|replies|reply|teasers?|newsletter|subscribe|sidebar|popup|modal)(?:$|[\s_-])", re.I)
_FEW = {"article", "main", "h1", "h2", "h3", "h4", "h5", "h6"}
#: A tag with a quote that is never closed ends at its first ">".
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_EACH = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


def _skipped(name: str, attributes: str) -> bool:
    if name in SKIPPED:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in _ROLES or key in ("class", "id") and name not in ("html", "body") and (_NOT_ARTICLE if name in _FEW else _NAMED).search(value):
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def _marks(name: str, attributes: str) -> bool:
    """Whether the element is the page's article."""
    if name in ("article", "main"):
        return True
    if "role" not in attributes.lower():
        return False
    roles = [value for key, value in _EACH.findall(attributes) if key.lower() == "role"]
    return bool(roles) and "main" in roles[0].strip("\"'").lower().split()


def blocks(page: str) -> tuple[list[str], bool]:
    """Blocks of main text, and whether the page marks its article."""
    inside: list[str] = []
    anywhere: list[str] = []
    piece: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, skipped, main
    skip = main = 0
    marked = False

    def flush() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if text:
                (inside if main else anywhere).append(text)

    def pop_to(at: int) -> None:
        nonlocal skip, main
        while len(stack) > at:
            _, s, m = stack.pop()
            skip -= s
            if m:
                flush()
                main -= 1

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        found = (_TAG.match(page, lt) or _BROKEN.match(page, lt)) if lt >= 0 else None
        if lt < 0:
            if not skip:
                piece.append(page[at:])
            break
        if lt > at and not skip:
            piece.append(page[at:lt])
        if found is None:
            if not skip:
                piece.append("<")
            at = lt + 1
            continue
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if name == "br":
            if not skip:
                piece.append(" ")
            continue
        if found[1]:
            if name not in _INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
            continue
        if name not in _INLINE:
            flush()
        if name in _VOID:
            continue
        if name in _CLOSES_P or name == "li" or name == "body":
            ends = {"p"} | ({"li"} if name == "li" else set()) | ({"head"} if name == "body" else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
        attributes = found[3]
        bad = _skipped(name, attributes)
        if name in _RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = end.start() if end else size
            stack.append((name, True, False))
            skip += 1
            continue
        if attributes.rstrip().endswith("/") and name not in _INLINE and name not in _CLOSES_P:
            continue
        is_main = not skip and not bad and _marks(name, attributes)
        if is_main:
            marked = True
            main += 1
        skip += bad
        stack.append((name, bad, is_main))
    flush()
    return (inside if marked else anywhere), marked


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes, by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:] if width < n else []
        order = np.lexsort((second, rank))
        change = np.concatenate([[0], (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change)
        width *= 2
        if width >= n or rank[order[-1]] == n - 1:
            return order


def repeated(tokens: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """Which tokens lie in a string of ``least`` tokens that occurs on two pages or more.

    tokens must hold a value of its own between pages."""
    covered = np.zeros(len(tokens), bool)
    if len(tokens) < least:
        return covered
    order = suffix_array(tokens)
    order = order[order <= len(tokens) - least]
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(least):  # neighbours that share their first words
        same &= tokens[order[1:] + k] == tokens[order[:-1] + k]
    group = np.concatenate([[0], np.cumsum(~same)])
    pages = np.unique(np.stack([group, page[order]]), axis=1)[0]
    many = np.bincount(pages, minlength=group[-1] + 1) > 1
    start = order[many[group]]
    edge = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + least, -1)
    return np.cumsum(edge[:-1]) > 0


def _words(pages: list[list[str]]) -> tuple[Words, np.ndarray]:
    """Words of all blocks, and the page of each word."""
    w = words_of(*raw(pa.array([b for p in pages for b in p], pa.string())), SPACE)
    return w, np.repeat(np.arange(len(pages)), [len(p) for p in pages])[w.row]


def _strings(w: Words, page: np.ndarray, least: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``least`` words of a page, and the index of the first of them; salt: of the host."""
    h, at = shingles(replace(w, row=page), least)
    return mix(h ^ np.uint64(salt)), at


def _short(block: str, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(block.encode(), digest_size=8, key=salt.to_bytes(8, "big")).digest(), "big")


def distinct_strings(pages: list[list[str]], least: int, salt: int) -> np.ndarray:
    """Distinct hashes of the pages' strings of ``least`` words and of their shorter blocks."""
    w, page = _words(pages)
    flat = [b for p in pages for b in p]
    short = {flat[k] for k in np.flatnonzero(np.diff(w.first) < least).tolist()}
    return np.unique(np.concatenate([_strings(w, page, least, salt)[0], np.array([_short(b, salt) for b in short], np.uint64)]))


def unique_blocks(pages: list[list[str]], least: int, share: float, elsewhere: np.ndarray | None = None, salt: int = 0) -> list[list[str]]:
    """Each page's blocks less those of which repeated strings cover ``share`` of the words.

    elsewhere: those of ``distinct_strings`` that pages of the host outside of this list have as well."""
    flat = [b for p in pages for b in p]
    if not flat:
        return pages
    w, page = _words(pages)
    page_of_block = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    at = np.flatnonzero(np.diff(page, prepend=page[:1]))
    tokens = np.insert(w.hash, at, np.arange(len(at), dtype=np.uint64))
    pages_of = np.insert(page, at, page[at])
    covered = np.delete(repeated(tokens, pages_of, least), at + np.arange(len(at)))
    others: set[int] = set()
    if elsewhere is not None and len(elsewhere):
        h, first = _strings(w, page, least, salt)
        first = first[np.isin(h, elsewhere)]
        edge = np.zeros(len(covered) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + least, -1)
        covered |= np.cumsum(edge[:-1]) > 0
        others = set(elsewhere.tolist())
    # a block shorter than a string counts as covered if the same block stands on another page
    full = np.bincount(w.row, covered, len(flat)) / np.maximum(np.diff(w.first), 1)
    where: dict[str, set[int]] = {}
    for b, p in zip(flat, page_of_block.tolist(), strict=True):
        where.setdefault(b, set()).add(p)
    again = lambda b: len(where[b]) > 1 or bool(others) and _short(b, salt) in others
    keep = [full[k] < share and not (w.first[k + 1] - w.first[k] < least and again(b)) for k, b in enumerate(flat)]
    out, k = [], 0
    for p in pages:
        out.append([b for i, b in enumerate(p) if keep[k + i]])
        k += len(p)
    return out


def host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _stripped(cut: DataFrame, least: int, share: float, group: int) -> DataFrame:
    """page_id, url, text of (page_id, url, host, blocks), without what repeats on pages of a host."""
    large = cut.groupBy("host").agg(F.ceil(F.count("*") / group).alias("parts")).where("parts > 1")
    n_large = large.count()
    dealt = cut.join(small(large, n_large, 24), "host", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("page_id"), F.col("parts")), F.lit(0)))
    salt = lambda table: table.column("host")[0].as_py() % (1 << 64)

    def strings(table: pa.Table) -> pa.Table:
        h = distinct_strings(table.column("blocks").to_pylist(), least, salt(table))
        return pa.table({"h": pa.array(signed(h)), **{c: pa.array(np.full(len(h), table.column(c)[0].as_py(), np.int64)) for c in ("host", "part")}})

    def strip(table: pa.Table, again: pa.Table | None = None) -> pa.Table:
        elsewhere = None if again is None else again.column("h").to_numpy().view(np.uint64)
        out = ["\n\n".join(b) for b in unique_blocks(table.column("blocks").to_pylist(), least, share, elsewhere, salt(table))]
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(out, pa.string())})

    parts, fields = dealt.select("page_id", "url", "host", "part", "blocks").groupBy("host", "part"), f"page_id {cut.schema['page_id'].dataType.simpleString()}, url string, text string"
    if not n_large:
        return parts.applyInArrow(lambda table: strip(table), fields)
    sent = dealt.where("parts > 1").select("host", "part", "blocks").groupBy("host", "part").applyInArrow(strings, "h long, host long, part long")
    by_hash = Window.partitionBy("h")
    again = sent.withColumns({"lo": F.min("part").over(by_hash), "hi": F.max("part").over(by_hash)}).where("lo < hi").select("h", "host", "part")
    return parts.cogroup(again.groupBy("host", "part")).applyInArrow(strip, fields)


def extract(pages: DataFrame, least: int = 8, share: float = 0.8, group: int = 500) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = fresh(pages, "page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()

    def parsed(batches):
        for batch in batches:
            out = [blocks(h) if h else ([], True) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), pa.array([b for b, _ in out], pa.list_(pa.string())), pa.array([m for _, m in out])], names=["page_id", "url", "host", "blocks", "marked"])

    every = rows.withColumn("host", F.xxhash64(host(F.col("url")))).mapInArrow(parsed, f"page_id {kind}, url string, host long, blocks array<string>, marked boolean")
    every = Scratch(pages.sparkSession, "html").write(every)
    plain = every.where("marked").select("page_id", "url", F.array_join("blocks", "\n\n").alias("text"))
    rest = _stripped(every.where("not marked").drop("marked"), least, share, group)
    return plain.unionByName(rest).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
