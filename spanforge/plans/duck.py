"""Builders of DuckDB SQL that finds the spans of a pattern. RE2 has no look-around, so patterns with it are searched place by place."""

from __future__ import annotations

from collections.abc import Sequence

from .fixtures import quoted


def tiles(relation: str, parts: Sequence[str], values: Sequence[int], category: str, rule: str, flags: str = "(?i)") -> str:
    """SELECT doc_id, category, rule_id, start, stop, value of the sensitive tiles of a pattern without look-around."""
    p = quoted(flags + "".join(f"({x})" for x in parts))
    groups = ", ".join(f"regexp_extract_all(text, {p}, {i}) AS g{i}" for i in range(1, len(parts) + 1))
    out = []
    for v in values:
        upto = "".join(f" + length(g{i}[k])" for i in range(1, v + 1))
        out.append(f"SELECT doc_id, {quoted(category)} AS category, {quoted(rule)} AS rule_id, (pos{upto})::INT AS start, (pos{upto} + length(g{v + 1}[k]))::INT AS stop, g{v + 1}[k] AS value FROM s")
    return (
        f"WITH t AS (SELECT doc_id, text FROM {relation} AS r), m AS (SELECT *, regexp_extract_all(text, {p}, 0) AS g0, string_split_regex(text, {p}) AS gaps, {groups} FROM t), "
        "e AS (SELECT *, unnest(range(1, len(g0) + 1)) AS k FROM m), "
        "s AS (SELECT *, list_sum(list_transform(list_slice(gaps, 1, k), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(g0, 1, k - 1), lambda x: length(x))), 0) AS pos FROM e) "
        + " UNION ALL ".join(out)
    )


def scan(relation: str, pattern: str, first: str, before: str, tail: str, name: str, flags: str = "") -> str:
    """CTEs (to stand after WITH RECURSIVE) that end in <name>(doc_id, text, start, stop): leftmost matches of pattern that don't overlap.

    first: class of the first character; before: class that must not stand before it; tail: what must follow, consumed."""
    p = quoted(f"^{flags}({pattern})(?:{tail})")
    return f"""
{name}_t AS (SELECT doc_id, text FROM {relation} AS r WHERE regexp_matches(text, {quoted(flags + pattern)})),
{name}_c AS (SELECT doc_id, text, i FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM {name}_t)
             WHERE regexp_matches(substr(text, i, 1), {quoted(first)}) AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), {quoted(before)}))),
{name}_h AS (SELECT * FROM (SELECT doc_id, text, i, length(regexp_extract(substr(text, i, 400), {p}, 1)) AS n FROM {name}_c) WHERE n > 0),
{name}_n AS (SELECT a.*, (SELECT min(b.i) FROM {name}_h b WHERE b.doc_id = a.doc_id AND b.i >= a.i + a.n) AS nxt FROM {name}_h a),
{name}_p AS (SELECT * FROM {name}_n WHERE i = (SELECT min(i) FROM {name}_h b WHERE b.doc_id = {name}_n.doc_id) UNION ALL SELECT x.* FROM {name}_p p JOIN {name}_n x ON x.doc_id = p.doc_id AND x.i = p.nxt),
{name} AS (SELECT doc_id, text, (i - 1)::INT AS start, (i - 1 + n)::INT AS stop FROM {name}_p)""".strip()
