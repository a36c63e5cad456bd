"""The SQL of ``more_rows`` and of the sliding windows."""

from __future__ import annotations

from ..functions import text as tx
from .catalog import sentences_sql, tokens_sql
from .engine_sql import chain, options, strip
from .more_rows import DATES, DIMS, GREETINGS, UNITS, VERSIONS

D = "d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"
S = f"s AS MATERIALIZED (SELECT doc_id, source, text, {sentences_sql('text')} AS s FROM d)"


def tokens_of(x: str) -> str:
    """The estimate of a text's tokens."""
    return f"CAST(CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, round_even(greatest(length({x}) / 4.0::DOUBLE, len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: length(w) > 0)) * 1.3::DOUBLE), 0)) END AS BIGINT)"


def unquoted(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({x}, '(?m)^\s*>.*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def plain(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'), '`{{1,2}}([^`]*)`{{1,2}}', '\1', 'g'), '(?m)^\s*#+\s*', '', 'g'), '\s+', ' ', 'g')")


N = "chr(10)"
_marks = f"list_transform(string_split('a' || {N} || '```' || {N} || 'b' || {N} || '~~~' || {N} || text || {N} || '  ```' || {N} || 'z', {N}), lambda x: CASE WHEN regexp_matches(x, '^ *(```|~~~)') THEN 1 ELSE 0 END)"
_size = f"CASE WHEN doc_id % 7 = 0 THEN 'no size' ELSE (doc_id * 37 % 2000) || CASE WHEN doc_id % 2 = 0 THEN '.5 ' ELSE ',000' END || {options(UNITS, f'doc_id % {len(UNITS)}')} END"
_unit = {"KiB": "1024", "kb": "1000", "MiB": "1048576", "mb": "1000000", "bytes": "1", "": "1"}
_bytes = f"CASE WHEN doc_id % 7 = 0 THEN 'no size' ELSE CAST(CAST(trunc(CASE WHEN doc_id % 2 = 0 THEN doc_id * 37 % 2000 + 0.5::DOUBLE ELSE (doc_id * 37 % 2000) * 1000.0::DOUBLE END * CASE doc_id % {len(UNITS)} {' '.join(f'WHEN {i} THEN {_unit[u]}' for i, u in enumerate(UNITS))} END) AS BIGINT) AS VARCHAR) END"
_greeting = "list_filter(regexp_split_to_array(lower(g), '[^a-z0-9]+'), lambda t: length(t) > 0)"
_small = "[" + ", ".join(f"'{w}'" for w in tx.SMALL_TALK) + "]"
_sets = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"

_hex = lambda x: f"list_transform(range(1, {DIMS + 1}), lambda i: strpos('0123456789abcdef', substr(md5({x}), i, 1)) - 1 - 7.5::DOUBLE)"

_sections = [
    ("body", 1, "", "", None, "'intro'"),
    ("body-2", 1, "", "", None, "'lead'"),
    ("part-one", 2, "Part one", "Part one", None, "trim('One ' || array_to_string(s, ' '))"),
    ("sub", 3, "Sub", "Part one/Sub", "part-one", f"'```' || {N} || '# no heading' || {N} || '```'"),
    ("part-one-2", 2, "Part one", "Part one", "part-one", "coalesce(s[1], 'none')"),
    ("last", 2, "Last", "Last", None, "'end'"),
]
_section_rows = " UNION ALL ".join(
    f"SELECT 'docs:' || doc_id || ':{slug}' AS chunk_id, 'Product Docs v3.1 > guide > Page ' || doc_id || '{''.join(f' > {p}' for p in path.split('/') if p)}' AS context_header, {f"'docs:' || doc_id || ':{parent}'" if parent else 'CAST(NULL AS VARCHAR)'} AS parent_id, '{title}' AS section_title, '{path}' AS path, CAST({level} AS BIGINT) AS heading_level, md5({body}) AS text_md5 FROM s"
    for slug, level, title, path, parent, body in _sections
)

# Small sections join the one before; so does the last one in any case.
MERGED = (
    f"parts AS (SELECT doc_id, list_transform(range(0, len(s) // 3 + 1), lambda k: array_to_string(list_slice(s, k * 3 + 1, k * 3 + 3), ' ')) AS p FROM s), own AS (SELECT doc_id, list_filter(list_transform(p, lambda x, i: {{'k': i - 1, 'x': x}}), lambda y: length(y.x) > 0) AS p FROM parts), "
    f"fold(doc_id, p, i, first, x, done) AS (SELECT doc_id, p, 1, p[1].k, p[1].x, []::STRUCT(k BIGINT, x VARCHAR)[] FROM own WHERE len(p) > 0 UNION ALL SELECT doc_id, p, i + 1, CASE WHEN small THEN first ELSE p[i + 1].k END, CASE WHEN small THEN x || {N} || {N} || '## S' || p[i + 1].k || {N} || p[i + 1].x ELSE p[i + 1].x END, "
    f"CASE WHEN small THEN done ELSE list_append(done, {{'k': first, 'x': x}}) END FROM (SELECT *, {tokens_of('p[i + 1].x')} < 120 AS small FROM fold WHERE i < len(p))), "
    "whole AS (SELECT doc_id, list_append(done, {'k': first, 'x': x}) AS kept FROM fold WHERE i = len(p))"
)
# A piece is cut before the paragraph that would exceed it; the last paragraph begins the next piece if it is short.
SPLIT = (
    f"costs AS (SELECT doc_id, s, list_transform(s, lambda x: {tokens_of('x')}) AS c, {tokens_of(f"array_to_string(s, {N} || {N})")} <= 200 AS fits FROM s WHERE len(s) > 0), "
    "walk(doc_id, s, c, i, used, piece) AS (SELECT doc_id, s, c, 1, c[1], 0 FROM costs WHERE NOT fits UNION ALL SELECT doc_id, s, c, i + 1, CASE WHEN used + c[i + 1] > 200 THEN CASE WHEN length(s[i]) <= 400 AND NOT contains(s[i], '```') THEN c[i] ELSE 0 END + c[i + 1] ELSE used + c[i + 1] END, CASE WHEN used + c[i + 1] > 200 THEN piece + 1 ELSE piece END FROM walk WHERE i < len(s)), "
    f"pieces AS (SELECT doc_id, piece, min(i) AS a, max(i) AS b, any_value(s) AS s FROM (SELECT doc_id, piece, i, s FROM walk) GROUP BY doc_id, piece), "
    f"out AS (SELECT doc_id, piece, CASE WHEN piece > 0 AND length(s[a - 1]) <= 400 AND NOT contains(s[a - 1], '```') THEN s[a - 1] || {N} || {N} ELSE '' END || array_to_string(list_slice(s, a, b), {N} || {N}) AS x FROM pieces UNION ALL SELECT doc_id, 0, array_to_string(s, {N} || {N}) FROM costs WHERE fits)"
)
SLIDE = (
    f"costs AS (SELECT doc_id, source, s, list_transform(s, lambda x: {tokens_of('x')}) AS c FROM s WHERE len(s) > 0), sums AS (SELECT *, list_transform(range(0, len(c) + 1), lambda i: coalesce(list_sum(list_slice(c, 1, i)), 0)) AS t FROM costs WHERE len(c) <= 300 UNION ALL SELECT doc_id, source, s, c, list_prepend(0::HUGEINT, list(r ORDER BY i)) FROM (SELECT *, sum(x) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, source, s, c, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM costs WHERE len(c) > 300)) GROUP BY doc_id, source, s, c), "
    "walk(doc_id, t, i, a, w) AS (SELECT doc_id, t, 1, 1, 0 FROM sums UNION ALL SELECT doc_id, t, i + 1, CASE WHEN t[i + 2] - t[a] > 700 THEN list_filter(range(a, i + 2), lambda z: t[i + 1] - t[z] <= 105)[1] ELSE a END, CASE WHEN t[i + 2] - t[a] > 700 THEN w + 1 ELSE w END FROM walk WHERE i < len(t) - 1), "
    "wins AS (SELECT doc_id, w, min(a) AS a, max(i) AS b FROM walk GROUP BY doc_id, w), counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM wins)"
)
SEMANTIC = (
    f"costs AS MATERIALIZED (SELECT doc_id, s, list_transform(s, lambda x: {tokens_of('x')}) AS c, list_transform(s, lambda x: list_distinct({tokens_sql('x')})) AS t FROM s WHERE len(s) > 0), "
    f"near AS MATERIALIZED (SELECT doc_id, s, c, list_transform(range(1, len(s)), lambda i: {_sets('t[i]', 't[i + 1]')}) AS a FROM costs), lows AS MATERIALIZED (SELECT *, list_sort(a)[1 + greatest(0, least(len(a) - 1, CAST(trunc(len(a) * 25 / 100.0) AS BIGINT)))] AS low FROM near), "
    "walk(doc_id, c, a, low, i, used, w) AS (SELECT doc_id, c, a, low, 1, c[1], 0 FROM lows UNION ALL SELECT doc_id, c, a, low, i + 1, CASE WHEN cut THEN 0 ELSE used END + c[i + 1], CASE WHEN cut THEN w + 1 ELSE w END FROM (SELECT *, len(c) >= 3 AND ((a[i] <= low AND used >= 150 * 0.4::DOUBLE) OR used + c[i + 1] > 150) AS cut FROM walk WHERE i < len(c))), "
    "wins AS (SELECT doc_id, w, min(i) AS x, max(i) AS y FROM walk GROUP BY doc_id, w), counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM wins)"
)
_clean = unquoted("body")
POSTS = (
    "posts AS MATERIALIZED (SELECT conv_id, turn, role AS speaker, CASE WHEN turn % 5 = 1 THEN 'staff' WHEN turn % 5 = 2 THEN NULL ELSE 'user' END AS role, (length(text) + turn) % 6 AS votes, turn % 7 = 3 AS accepted, CASE WHEN turn = 0 THEN NULL WHEN role = 'assistant' THEN 0 ELSE turn - 1 END AS parent, '> quoted' || chr(10) || coalesce(text, '') AS body FROM conversations), "
    "named AS (SELECT *, coalesce(role, 'user') || CASE WHEN accepted THEN ', accepted' ELSE '' END || ', ' || coalesce(votes, 0) || ' votes' AS who, " + _clean + " AS said FROM posts), "
    f"openings AS (SELECT conv_id, role, votes, turn, said, {sentences_sql('said')} AS s FROM named WHERE turn = 0), "
    f"asked AS (SELECT *, 'QUESTION: Thread ' || conv_id || chr(10) || CASE WHEN {tokens_of('said')} <= 180 THEN said ELSE coalesce(nullif(array_to_string(list_slice(s, 1, len(list_filter(range(1, len(s) + 1), lambda i: list_sum(list_transform(list_slice(s, 1, i), lambda x: {tokens_of('x')})) <= 180))), ' '), ''), left(said, 600)) END AS q FROM openings), "
    "replies AS (SELECT conv_id, parent, count(*) AS n, string_agg(chr(10) || chr(10) || 'FOLLOW-UP (' || who || '):' || chr(10) || said, '' ORDER BY turn) AS more FROM named WHERE parent IS NOT NULL GROUP BY conv_id, parent), "
    "kept AS (SELECT a.*, q.q, coalesce(r.n, 0) AS n, coalesce(r.more, '') AS more FROM named a JOIN asked q USING (conv_id) LEFT JOIN replies r ON r.conv_id = a.conv_id AND r.parent = a.turn WHERE a.parent = 0 AND a.turn > 0 AND (a.accepted OR coalesce(a.role, '') = 'staff' OR a.votes >= 3))"
)

#: Folded questions and all their products, for vectors of terms and chunks that are given.
DENSE = (
        f"tv AS MATERIALIZED (SELECT source, term, {_hex('term')} AS v, 1 + length(term) / 10.0::DOUBLE AS idf FROM (SELECT DISTINCT source, term FROM posts)), cv AS MATERIALIZED (SELECT source, chunk_id, doc_id, {_hex('chunk_id')} AS x FROM ch), qv AS (SELECT qid, qi, source, d, sum((1 + ln(qtf)) * idf * v[d]) AS y FROM asked JOIN tv USING (term), (SELECT unnest(range(1, {DIMS + 1})) AS d) GROUP BY qid, qi, source, d), "
        "qu_ AS MATERIALIZED (SELECT qid, qi, source, list(y ORDER BY d) AS q FROM qv GROUP BY qid, qi, source), sc AS (SELECT qid, qi, source, chunk_id, doc_id, list_inner_product(q, x) / greatest(sqrt(list_inner_product(q, q)), 1e-12) AS score FROM qu_ JOIN cv USING (source))"
)

ORACLES: dict[str, str] = {
    "text_forms": f"WITH {D}, m AS (SELECT doc_id, text, {_marks} AS m FROM d) SELECT doc_id, md5({unquoted(f"('> said' || {N} || text || {N} || {N} || {N} || {N} || '> more' || {N} || 'end')")}) AS unquoted, md5({plain(f"('## Head' || {N} || text || ' ```code' || {N} || 'block``` and `inline` end')")}) AS plain, array_to_string(list_transform(m, lambda x, i: CASE WHEN x = 1 OR coalesce(list_sum(list_slice(m, 1, i - 1)), 0) % 2 = 1 THEN '1' ELSE '0' END), '') AS fenced FROM m",
    "text_values": (
        f"WITH {D}, {S}, t AS (SELECT doc_id, {_bytes} AS bytes, round(list_cosine_similarity({_hex('text')}, {_hex('source')}), 6) AS cosine, {options(GREETINGS, f'doc_id % {len(GREETINGS)}')} AS g, {options(DATES, f'doc_id % {len(DATES)}')} AS x, {options(VERSIONS, f'doc_id % {len(VERSIONS)}')} AS v, {tokens_sql('text')} AS t, {tokens_sql("coalesce(s[1], '')")} AS f, md5(text) AS h FROM s), l AS (SELECT *, list_transform(range(1, 33), lambda z: substr(h, z, 1)) AS l FROM t) "
        f"SELECT doc_id, bytes, cosine, len({_greeting}) BETWEEN 1 AND 6 AND len(list_filter({_greeting}, lambda w: NOT list_contains({_small}, w))) = 0 AS greeting, CAST(CASE WHEN regexp_matches(left(x, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(left(x, 10) AS DATE) END AS VARCHAR) AS day, array_to_string(list_transform(list_filter(string_split(coalesce(v, '0'), '.'), lambda p: regexp_matches(p, '^[0-9]+$')), lambda p: CAST(CAST(p AS INTEGER) AS VARCHAR)), '|') AS parts, "
        f"round({_sets('list_distinct(t)', 'list_distinct(f)')}, 6) AS likeness, array_to_string(list_transform(l, lambda z, i: z || CASE WHEN len(list_filter(list_slice(l, 1, i), lambda y: y = z)) > 1 THEN '-' || len(list_filter(list_slice(l, 1, i), lambda y: y = z)) ELSE '' END), '|') AS names FROM l"
    ),
    "docs_sections": f"WITH {D}, {S} {_section_rows}",
    "merged_sections": f"WITH RECURSIVE {D}, {S}, {MERGED}, rows_ AS (SELECT doc_id, CASE WHEN len(kept) > 1 AND {tokens_of('kept[len(kept)].x')} < 120 THEN list_append(list_slice(kept, 1, len(kept) - 2), {{'k': kept[len(kept) - 1].k, 'x': kept[len(kept) - 1].x || {N} || {N} || '## S' || kept[len(kept)].k || {N} || kept[len(kept)].x}}) ELSE kept END AS kept FROM whole), e AS (SELECT doc_id, unnest(kept) AS r FROM rows_) SELECT 'docs:' || doc_id || ':s' || r.k AS chunk_id, 'S' || r.k AS section_title, md5(r.x) AS text_md5 FROM e",
    "split_sections": f"WITH RECURSIVE {D}, {S}, {SPLIT} SELECT 'docs:' || doc_id || ':p' || CASE WHEN piece > 0 THEN '-p' || (piece + 1) ELSE '' END AS chunk_id, md5(x) AS text_md5 FROM out",
    "sliding_windows": f"WITH RECURSIVE {D}, {S}, {SLIDE} SELECT 'blog:' || doc_id || ':w' || w AS chunk_id, CAST(w AS BIGINT) AS window_index, n AS window_count, {tokens_of(f"('Product Blog > ' || chr(34) || source || chr(34) || {N} || {N} || array_to_string(list_slice(s, a, b), ' '))")} AS token_count FROM counted JOIN s USING (doc_id)",
    "semantic_windows": f"WITH RECURSIVE {D}, {S}, {SEMANTIC} SELECT 'blog:' || doc_id || ':w' || w AS chunk_id, CAST(w AS BIGINT) AS window_index, n AS window_count, md5(array_to_string(list_slice(s, x, y), ' ')) AS text_md5 FROM counted JOIN s USING (doc_id)",
    "thread_answers": (
        f"WITH {POSTS} SELECT 'forum:' || conv_id || ':p' || turn AS chunk_id, 'forum:' || conv_id AS parent_id, 'Product Forum > solved > v2.4 > \"Thread ' || conv_id || '\" > ' || CASE WHEN accepted THEN 'accepted answer by ' || coalesce(role, 'user') ELSE 'answer by ' || coalesce(role, 'user') || ' (' || votes || ' votes)' END AS context_header, coalesce(role, 'user') AS author_role, CAST(votes AS BIGINT) AS votes, accepted AS is_accepted, n AS corroborating_followups, false AS unanswered, "
        "md5(q || chr(10) || chr(10) || 'ANSWER (' || who || '):' || chr(10) || said || more) AS text_md5 FROM kept UNION ALL SELECT 'forum:' || conv_id || ':p0', 'forum:' || conv_id, 'Product Forum > solved > v2.4 > \"Thread ' || conv_id || '\" > original question', coalesce(role, 'user'), CAST(votes AS BIGINT), false, CAST(NULL AS BIGINT), true, md5(q) FROM asked WHERE conv_id NOT IN (SELECT conv_id FROM kept)"
    ),
    "frontmatter": f"WITH {D} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN '3.1' END AS version, CASE WHEN doc_id % 3 = 0 THEN true END AS canonical, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 END AS BIGINT) AS tags, md5(CASE WHEN doc_id % 3 = 1 THEN '---' || {N} || 'not: json' || {N} || '---' || {N} ELSE '' END || 'Body ' || text) AS body_md5 FROM d",
    "forum_scan": "SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'Thread ' || conv_id AS title, 'solved' AS status, count(*) AS posts, md5(arg_min('> quoted' || chr(10) || coalesce(text, ''), turn)) AS body_md5 FROM conversations GROUP BY conv_id",
    "blog_scan": f"WITH {D} SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'Post ' || doc_id AS title, '2024-01-05' AS published_at, md5(text) AS body_md5 FROM d",
    "numbered_rows": f"WITH {D} SELECT doc_id, row_number() OVER (ORDER BY md5(text), doc_id) - 1 AS doc_pos FROM d",
    "chunk_dump": f"WITH {D}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(source || {N} || {N} || text, '\\s+'), lambda x: length(x) > 0) AS w FROM d), i AS (SELECT doc_id, w, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 769) / 616.0) AS BIGINT)))) AS k FROM w) SELECT 'blog:' || doc_id || ':u' || k AS chunk_id, 'blog' AS source, 'blog:' || doc_id AS parent_id, 'uniform' AS chunker, md5(array_to_string(list_slice(w, k * 616 + 1, k * 616 + 769), ' ')) AS text_md5 FROM i",
    "trace_log": "SELECT 't' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS trace_id, '2024-01-01T00:00:' || lpad(CAST(item_id % 60 AS VARCHAR), 2, '0') AS timestamp, 'About RETRIES' AS query FROM benchmark WHERE item_id % 2 = 0 ORDER BY timestamp DESC, trace_id DESC LIMIT 20",
    "dense_lists": chain("asked", f", {DENSE} " "SELECT qid, CAST(qi AS INTEGER) AS qi, source, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, qi, source ORDER BY round(score, 9) DESC, doc_id, chunk_id) AS rank FROM sc WHERE score > 1e-6) WHERE rank <= 10"),
}
