"""SQL for DuckDB of those operators that SQL can express."""

from __future__ import annotations

import re

from .license_scan import PHRASES, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
    SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g"""

#: Every word stands between spaces of its own.
_WORD = "' ' || {} || ' '"


def _form(template: str) -> str:
    """A template as a regular expression over words between spaces of their own."""
    out = ""
    for part in re.findall(r"\[|\]|<\d+>|[0-9A-Za-z]+", template):
        out += "(?:" if part == "[" else ")?" if part == "]" else f"(?: [^ ]+ ){{0,{part[1:-1]}}}" if part[0] == "<" else f" {part.lower()} "
    return out


def license_scan() -> str:
    phrases = {label: "".join(f" {w} " for w in p.split()) for p, label in PHRASES.items()}
    places = " + ".join(f"len(string_split(t, '{p}')) - 1" for p in phrases.values())
    before = ", ".join(f"CASE WHEN contains(t, '{p}') THEN len(regexp_extract_all(string_split(t, '{p}')[1], '[^ ]+')) END" for p in phrases.values())
    last = ", ".join(f"CASE WHEN contains(t, '{p}') THEN len(a) - len(regexp_extract_all(string_split(t, '{p}')[-1], '[^ ]+')) - {len(p.split())} END" for p in phrases.values())
    base = ", ".join(f"CASE WHEN contains(t, '{p}') THEN '{label}' END" for label, p in phrases.items())
    own = ", ".join(f"CASE WHEN regexp_matches(t, '{_form(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    joined = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    return f"""
    WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM documents),
    l AS (SELECT doc_id, a, array_to_string(list_transform(a, lambda x: {_WORD.format('x')}), '') AS t FROM w),
    f AS (SELECT doc_id, a, {places} AS n, least({before}) AS first_word, greatest({last}) AS last_word, [{base}] AS base, [{own}] AS own FROM l)
    SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
      {joined.format('base')} AS base_labels, {joined.format('list_concat(base, own)')} AS labels,
      CASE WHEN len(list_filter(own, lambda x: x IS NOT NULL)) > 0 THEN 1.0::DOUBLE ELSE n::DOUBLE / (n + 1) END AS score FROM f"""


WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    g AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS sound FROM g"""

#: All pairs that share a shingle; components by reachability.
MINHASH = f"""
    WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(a[k : k + 3], ' ') AS h FROM (SELECT doc_id, a, unnest(generate_series(1, greatest(len(a) - 3, 1))) AS k FROM w WHERE len(a) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a),
    m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""
