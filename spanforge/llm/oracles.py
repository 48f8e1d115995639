"""DuckDB SQL for the queries of this subpackage, over the views of the test tables."""

from __future__ import annotations

from .quality_rules import DEFAULT as RULES
from .quality_rules import SEQUENCE
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

#: Words, base metrics and base verdict of every document; ends in the relation base.
QUALITY_BASE = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 9),
ws AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS s FROM win),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM ws) WHERE n > 1),
cover AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS r FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cover USING (rid)),
base AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {percent} * n_words AS base_failed FROM m)
""".format(min_words=RULES.min_words, percent=RULES.max_repeat_percent)


def _first_step() -> str:
    """The first step of the sequence that rejects a row; the number of steps if none does."""
    cutoffs = dict(RULES.cutoffs)
    steps = [(r, float(c)) for r in SEQUENCE for c in cutoffs[r]]
    return f"least({len(steps)}, {', '.join(f'CASE WHEN {r} > {c!r}::DOUBLE THEN {i} ELSE {len(steps)} END' for i, (r, c) in enumerate(steps))})"


def _stratum() -> str:
    langs = ", ".join(f"'{x}'" for x in RULES.languages)
    bands = " + ".join(f"(n_words >= {x})::INT" for x in RULES.bands)
    return f"CASE WHEN lang IN ({langs}) THEN lang ELSE 'other' END || ':' || ({bands})::VARCHAR"


_ALPHA, _STEPS = RULES.max_false_rejection, sum(len(cs) for _, cs in RULES.cutoffs)
_LEVEL = RULES.delta / ((len(RULES.languages) + 1) * (len(RULES.bands) + 1) + len(RULES.languages) + 2)
_NAMES = ", ".join(f"('{x}', '{x}:{b}')" for x in (*RULES.languages, "other") for b in range(len(RULES.bands) + 1))

#: The last safe step of each stratum, from base; ends in the relation judged with kept.
QUALITY_VERDICT = f"""
v AS (SELECT *, {_stratum()} AS stratum, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_share, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_share,
             n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_share, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word FROM base),
f AS (SELECT *, {_first_step()} AS first FROM v),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT unnest([stratum, split_part(stratum, ':', 1), 'all']) AS g, first FROM f JOIN good USING (doc_id) WHERE NOT base_failed),
k AS (SELECT g, step, count(*) AS n, count(*) FILTER (first <= step) AS k FROM held, range({_STEPS}) AS s(step) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {_ALPHA!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_ALPHA!r}) + (n - i) * ln({1.0 - _ALPHA!r})))) END AS tail FROM k),
safe AS (SELECT g, max(CASE WHEN pow({1.0 - _ALPHA!r}, n) > {_LEVEL!r} THEN NULL WHEN tail <= {_LEVEL!r} THEN step ELSE -1 END) AS last FROM p GROUP BY g),
each AS (SELECT s.stratum, own.last AS own, lang.last AS of_lang, CASE WHEN s.lang <> 'other' AND lang.g IS NOT NULL THEN (SELECT last FROM safe WHERE g = 'all') END AS of_all
         FROM (VALUES {_NAMES}) AS s(lang, stratum) LEFT JOIN safe own ON own.g = s.stratum LEFT JOIN safe lang ON lang.g = s.lang),
settled AS (SELECT stratum, coalesce(own, of_lang, of_all, -1) AS last, CASE WHEN own IS NOT NULL THEN 'stratum' WHEN of_lang IS NOT NULL THEN 'language' ELSE 'all' END AS by_whom FROM each),
judged AS (SELECT f.*, NOT base_failed AND first > last AS kept, CASE WHEN last >= 0 THEN by_whom END AS certified_by FROM f JOIN settled USING (stratum))
"""

OP9 = f"WITH {QUALITY_BASE.strip()}, {QUALITY_VERDICT.strip()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, certified_by FROM judged"

#: One opening character, backslashes and the rest of a control string; the escape adds a character to each.
_CONTROL = r"[<\[]\\*(?:/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_]{1,32}\|>)"

OP8 = rf"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id, lone) AS n,
             12 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + len(regexp_extract_all(replace(replace(role, '\', '\\'), chr(10), '\n'), '{_CONTROL}')) + 1
             + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + 11 AS size FROM c),
s AS (SELECT *, 3 + sum(size) OVER (PARTITION BY conv_id, lone ORDER BY k) AS upto FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id, lone
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, least(10, len(w)) AS m, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM bi),
di AS (SELECT rid, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
h AS (SELECT rid, i, di.m, item_id FROM di JOIN p ON p.m = di.m AND p.s = array_to_string(list_slice(di.w, di.i, di.i + di.m - 1), ' ')),
hw AS (SELECT rid, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM h) GROUP BY rid),
it AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)
"""

#: Pieces, units, first occurrences and the units to remove; the ends of pieces are marked, as RE2 has no lookahead (texts hold no U+0001).
OP2 = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text <> '')),
ls AS (SELECT rid, doc_id, string_split(replace(regexp_replace(text, '([.!?,;:])([\x20\x09\x0B-\x0D])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS l FROM t),
pc AS (SELECT rid, doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS k FROM ls),
po AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM pc),
pw AS (SELECT *, sum(w) OVER (PARTITION BY rid ORDER BY k) AS upto, row_number() OVER (PARTITION BY rid ORDER BY k) AS i,
              translate(array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM po WHERE w > 0),
al AS (SELECT rid, list(norm ORDER BY i) AS norms FROM pw GROUP BY rid),
un AS (SELECT a.rid, a.doc_id, a.start, b.start + length(b.x) AS stop, a.i, b.i AS j FROM (SELECT *, upto - w + {least} AS need FROM pw) a ASOF JOIN pw b ON a.rid = b.rid AND a.need <= b.upto),
ud AS (SELECT un.*, t.text, md5(array_to_string(list_slice(norms, i, j), ' ')) AS digest FROM un JOIN al USING (rid) JOIN t USING (rid)),
ur AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start, first_value(rid) OVER w AS kept_rid, first_value(stop) OVER w AS kept_stop FROM ud WINDOW w AS (PARTITION BY digest ORDER BY doc_id NULLS LAST, start))
SELECT doc_id, start::BIGINT AS start, stop::BIGINT AS stop, digest, kept_doc_id, kept_start::BIGINT AS kept_start FROM ur WHERE rid <> kept_rid OR start >= kept_stop
""".replace("{least}", "16")

#: Every window of 50 bytes with the least id of its documents, the runs of those that have a smaller one, and what lies between.
OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, doc_id, i, array_slice(b, i, i + 49) AS s FROM (SELECT rid, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM w JOIN m USING (s) WHERE first < doc_id OR (doc_id IS NULL AND first IS NOT NULL)),
k AS (SELECT rid, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM g),
r AS (SELECT rid, run, min(i) AS a, max(i) + 49 AS z FROM k GROUP BY rid, run),
p AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS upto FROM r),
o AS (SELECT rid, sum(z - a + 1)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(CASE WHEN a > upto + 1 THEN hex(array_slice(b, upto + 1, a - 1)) ELSE '' END, '' ORDER BY a) || CASE WHEN max(z) < octet_length(any_value(b)) THEN hex(array_slice(any_value(b), max(z) + 1, octet_length(any_value(b)))) ELSE '' END AS kept FROM p JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN o.rid IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256 FROM d LEFT JOIN o USING (rid)
"""


def _rounds() -> str:
    """Assignment and means of each round; the squared distance is compared without the point's own square."""
    near = "arg_min(e, {'d': list_inner_product(c, c) - 2 * list_inner_product(y, c), 'e': e}) AS e"
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT rid, pt.p AS p, {near} FROM pt JOIN b{r} ON pt.p = b{r}.p GROUP BY rid, pt.p)")
        if r < ROUNDS:
            out.append(f"m{r} AS (SELECT a.p AS p, a.e AS e, j, floor(sum(y[j]) / count(*)) AS m FROM a{r} a JOIN pt ON pt.rid = a.rid AND pt.p = a.p, (SELECT unnest(range(1, (SELECT max(len(y)) FROM pt) + 1)) AS j) GROUP BY ALL)")
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT b.e AS e, b.p AS p, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS c FROM m{r} GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)")
    return ",\n".join(out)


OP13 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0),
q AS (SELECT unnest(range({PARTS})) AS p),
pt AS MATERIALIZED (SELECT rid, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS y FROM v, q),
s AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM v QUALIFY e < {ENTRIES}),
b0 AS MATERIALIZED (SELECT e, p, y AS c FROM s JOIN pt USING (rid)),
{_rounds()},
f AS (SELECT rid, string_agg(lower(lpad(to_hex(a.e), 2, '0')), '' ORDER BY a.p) AS code, sum(list_inner_product(list_transform(list_zip(y, c), lambda z: z[1] - z[2]), list_transform(list_zip(y, c), lambda z: z[1] - z[2])))::BIGINT AS error
  FROM a{ROUNDS} a JOIN b{ROUNDS} b ON a.p = b.p AND a.e = b.e JOIN pt USING (rid) WHERE pt.p = a.p GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(k::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) FROM (SELECT p, e, unnest(c) AS k, unnest(range(len(c))) AS j FROM b{ROUNDS})) AS codebooks_sha256
FROM f JOIN v USING (rid)
"""
