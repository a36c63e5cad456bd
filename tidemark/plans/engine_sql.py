"""The SQL of ``engine_rows``: every stage of the engine as a common table expression over the driver's tables."""

from __future__ import annotations

import re

from ..functions import text as tx
from ..operators import answers as gen
from ..operators import conflicts as con
from ..operators import questions as qry
from ..operators.rerank import WEIGHTS
from .catalog import quoted, sentences_sql, tokens_sql
from .engine_rows import AREAS, ASKED, CONFIG, ROLES, SAID, SOURCES, TYPES, VERSIONS

BRAND = CONFIG.get("brand")


def own(text: str) -> str:
    return text.replace("{brand}", BRAND.lower())


def options(values, number: str) -> str:
    return "[" + ", ".join("NULL" if v is None else quoted(v) for v in values) + f"][CAST({number} AS BIGINT) + 1]"


def cues(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {quoted(own(w))})" for w in words) + ")"


def once(items: str) -> str:
    """The first of each value of a list, in order, without regard to case."""
    return f"list_filter({items}, lambda x, i: list_position(list_transform({items}, lambda z: lower(z)), lower(x)) = i)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def major(x: str) -> str:
    return f"string_split({x}, '.')[1]"


K = "(doc_id // 3)"
DATE = f"CASE WHEN {K} % 13 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 900 AS INTEGER) AS VARCHAR) END"
SHOWN = f"coalesce(text, '') || ' ' || {options(SAID, 'doc_id % 16')} || ' ' || {options(SAID, '(doc_id // 16) % 16')}"

CTES: dict[str, str] = {}
CTES["cc"] = (
    f"SELECT doc_id, {options(SOURCES, 'doc_id % 3')} AS source, {options(SOURCES, 'doc_id % 3')} || ':d' || (doc_id // 9) || ':' || doc_id AS chunk_id, 'd' || (doc_id // 9) AS doc, {SHOWN} AS shown, "
    f"CASE WHEN doc_id % 17 <> 0 THEN 'Title ' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN {options(TYPES, f'{K} % 5')} END AS doc_type, {options(VERSIONS, f'{K} % 4')} AS version, CASE WHEN doc_id % 3 <> 0 THEN {options(ROLES, f'{K} % 4')} END AS role, "
    f"CASE WHEN doc_id % 3 = 1 THEN doc_id % 50 END AS votes, doc_id % 3 = 1 AND doc_id % 7 = 0 AS accepted, doc_id % 3 = 1 AND doc_id % 11 = 0 AS unanswered, CASE WHEN doc_id % 3 = 1 THEN {K} % 3 ELSE 0 END AS follow_ups, {DATE} AS day, "
    f"{options(AREAS, f'{K} % 6')} AS area, CASE {K} % 4 WHEN 0 THEN ['retries'] WHEN 1 THEN ['cli', 'auth'] ELSE []::VARCHAR[] END AS tags FROM documents"
)
CTES["c1"] = f"SELECT *, source || ' notes' || chr(10) || shown AS text, {tokens_sql('shown')} AS seen FROM cc"
# The header stands on a line of its own, so its tokens come first.
CTES["ch"] = f"SELECT *, list_concat({tokens_sql("(source || ' notes')")}, seen) AS tokens FROM c1"
CTES["posts"] = "SELECT source, chunk_id, doc_id, dl, term, count(*) AS tf FROM (SELECT source, chunk_id, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM ch) GROUP BY ALL"
CTES["stats"] = "SELECT source, count(*) AS n, avg(len(tokens)) AS avgdl FROM ch GROUP BY source"
CTES["terms"] = "SELECT p.source, p.term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts p JOIN stats USING (source) GROUP BY p.source, p.term"
CTES["known"] = "SELECT term, count(*) AS df FROM posts GROUP BY term"
CTES["q0"] = f"SELECT CAST(item_id AS VARCHAR) AS qid, {options(ASKED, f'item_id % {len(ASKED)}')} || trim(coalesce({sentences_sql('text')}[1], ''), ' \t\n\r') AS query FROM benchmark"
_kinds = " ".join(f"WHEN regexp_matches(l, {quoted('|'.join(f'(?:{own(p)})' for p in patterns))}) THEN '{name}'" for name, patterns in qry.INTENTS.items())
_areas = ", ".join(f"{{'n': {' + '.join(f'CAST(contains(l, {quoted(own(w))}) AS INTEGER)' for w in words)}, 'i': {-i}, 'area': '{area}'}}" for i, (area, words) in enumerate(qry.AREAS.items()))
_version = r"'(?i)\bv?([23])\.(\d+)(?:\.\d+)?\b'"
_plain = "[" + ", ".join(quoted(own(w)) for w in qry.NO_ENTITIES) + "]"
_found = rf"list_filter(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9._\-]*'), lambda t: NOT list_contains({_plain}, lower(t)) AND (regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '[_.\-]') OR regexp_matches(t, '^.+[A-Z]')))"
CTES["q1"] = f"SELECT qid, query, lower(query) AS l FROM q0"
CTES["q2"] = (
    f"SELECT qid, query, l, CASE {_kinds} ELSE 'unknown' END AS intent, CASE WHEN regexp_extract(query, {_version}, 1) <> '' THEN regexp_extract(query, {_version}, 1) || '.' || regexp_extract(query, {_version}, 2) END AS version_mentioned, "
    f"list_max([{_areas}]) AS best, {_found} AS raw, CASE {' '.join(f'WHEN contains(l, {quoted(n)}) THEN {quoted(more)}' for n, more in qry.SYNONYMS)} END AS words FROM q1"
)
CTES["q3"] = f"SELECT *, CASE WHEN best.n > 0 THEN best.area END AS asked_area, list_slice({once('raw')}, 1, 8) AS entities FROM q2"
CTES["q4"] = "SELECT *, list_filter([trim(query || coalesce(' ' || words, '')), CASE WHEN asked_area IS NOT NULL THEN trim(query || ' ' || replace(asked_area, '_', ' ')) END], lambda x: x IS NOT NULL AND lower(x) <> lower(trim(query))) AS fresh FROM q3"
CTES["q5"] = f"SELECT *, list_slice({once('fresh')}, 1, 3) AS expanded FROM q4"
CTES["q6"] = r"SELECT *, list_filter(list_concat([trim(query)], expanded), lambda x: length(x) > 0) AS every, intent IN ('api_reference', 'version_migration') OR regexp_matches(l, '\b(default|maximum|max|limit|exactly)\b') AS canonical FROM q5"
CTES["qq"] = f"SELECT *, {once('every')} AS queries, list_distinct({tokens_sql('query')}) AS unsorted, {tokens_sql('query')} AS qt FROM q6"
CTES["qa"] = "SELECT * EXCLUDE (unsorted), list_filter(qt, lambda x, i: list_position(qt, x) = i) AS qu FROM qq"
CTES["asked"] = f"SELECT qid, qi, term, count(*) AS qtf FROM (SELECT qid, qi, unnest({tokens_sql('phrase')}) AS term FROM (SELECT qid, unnest(range(0, len(queries))) AS qi, unnest(queries) AS phrase FROM qa)) GROUP BY ALL"
CTES["scored"] = "SELECT qid, qi, p.source, p.chunk_id, p.doc_id, sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl)) * a.qtf) AS score FROM asked a JOIN posts p USING (term) JOIN terms t ON t.source = p.source AND t.term = p.term JOIN stats s ON s.source = p.source GROUP BY ALL"
CTES["hits"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, qi, source ORDER BY round(score, 9) DESC, doc_id, chunk_id) AS rank FROM scored) WHERE rank <= 20 AND score > 0"
CTES["fused"] = "SELECT qid, source, chunk_id, sum(CASE WHEN qi = 0 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END / (60 + rank)) AS rrf FROM hits GROUP BY ALL"
_weights = CONFIG.get("retrieval.weights")
_a = CONFIG.get("retrieval.authority")
_r = CONFIG.get("retrieval.recency")
_forum = f"({_a['forum_accepted_weight']}::DOUBLE * CAST(accepted AS INTEGER) + {_a['forum_votes_weight']}::DOUBLE * least(coalesce(votes, 0) / {_a['forum_votes_saturation']}.0::DOUBLE, 1.0::DOUBLE) + {_a['forum_staff_weight']}::DOUBLE * CASE role WHEN 'staff' THEN 1.0 WHEN 'mvp' THEN 0.6 ELSE 0.0 END)"
CTES["w0"] = (
    f"SELECT f.qid, f.rrf, c.*, a.query, a.intent, a.version_mentioned, a.entities, a.qt, a.qu, CASE a.intent || '/' || f.source {' '.join(f'WHEN {quoted(f"{i}/{s}")} THEN {w}' for i, row in _weights.items() for s, w in row.items())} END::DOUBLE AS source_weight, "
    f"CASE WHEN c.source = 'docs' THEN CASE c.doc_type {' '.join(f'WHEN {quoted(t)} THEN {p}' for t, p in _a['docs_type_prior'].items())} ELSE 0.8 END::DOUBLE WHEN c.source = 'forum' THEN CASE WHEN unanswered THEN 0.1::DOUBLE WHEN follow_ups > 0 THEN least({_forum} + 0.05, 1.0) ELSE {_forum} END ELSE CASE WHEN role = 'staff' THEN {_a['blog_staff_bonus']} ELSE {_a['blog_guest_bonus']} END::DOUBLE END AS authority, "
    f"CASE WHEN a.intent IN ({', '.join(map(quoted, _r['skip_for_intents']))}) OR c.source = 'docs' OR c.day IS NULL THEN 1.0::DOUBLE ELSE greatest({_r['floor']}::DOUBLE, exp(-ln(2.0::DOUBLE) * greatest(0, DATE {quoted(str(_r['reference_date']))} - CAST(c.day AS DATE)) / {_r['half_life_days']})) END AS recency FROM fused f JOIN ch c USING (source, chunk_id) JOIN qa a USING (qid)"
)
CTES["weighed"] = f"SELECT *, round(source_weight * rrf * (1 + {_a['beta']}::DOUBLE * authority) * (1 + {_r['strength']}::DOUBLE * (recency - 1)), 12) AS rs FROM w0"
CTES["filtered"] = f"SELECT * FROM weighed WHERE version_mentioned IS NULL OR coalesce(doc_type IN ('changelog', 'guide'), false) OR coalesce(area = 'migration', false) OR version IS NULL OR {major('version')} = {major('version_mentioned')}"
_pool, _floor = CONFIG.get("retrieval.candidate_pool"), CONFIG.get("retrieval.min_per_source")
CTES["p0"] = "SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rs DESC, chunk_id) AS own FROM filtered"
CTES["p1"] = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN own > {_floor} THEN 1 ELSE 0 END, rs DESC, chunk_id) AS place FROM p0"
CTES["pool"] = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rs DESC, chunk_id) AS rank_before FROM p1 WHERE place <= {_pool} OR own <= {_floor}"
CTES["f0"] = "SELECT *, list_filter(qu, lambda t: list_contains(tokens, t)) AS met, count(*) OVER (PARTITION BY qid) AS pool_n FROM pool"
CTES["f1"] = "SELECT qid, map(list(term), list(idf)) AS idf FROM (SELECT qid, term, ln(1 + (any_value(pool_n) + 1.0) / (count(*) + 0.5)) AS idf FROM (SELECT qid, pool_n, unnest(met) AS term FROM f0) GROUP BY qid, term) GROUP BY qid"
_total = lambda terms: f"coalesce(list_sum(list_transform({terms}, lambda t: coalesce(idf[t], 1.0::DOUBLE))), 0)"
CTES["f2"] = (
    f"SELECT f0.*, {_total('met')} / nullif({_total('qu')}, 0) AS share, len(tokens) AS tn, list_transform(met, lambda t: list_position(tokens, t)) AS firsts, list_transform(met, lambda t: len(tokens) + 1 - list_position(list_reverse(tokens), t)) AS lasts, "
    "list_distinct(list_transform(range(1, len(qt)), lambda i: qt[i] || ' ' || qt[i + 1])) AS qb, list_distinct(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS tb FROM f0 LEFT JOIN f1 USING (qid)"
)
CTES["f3"] = (
    "SELECT *, coalesce(share, 0) AS coverage, CASE len(met) WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE least(1.0, len(met)::DOUBLE / greatest(list_max(lasts) - list_min(firsts) + 1, len(met))) END::DOUBLE AS proximity, CASE WHEN len(qt) < 2 THEN 0.0 ELSE len(list_intersect(qb, tb))::DOUBLE / len(qb) END::DOUBLE AS phrase, "
    "CASE WHEN len(entities) = 0 THEN 0.0 ELSE len(list_filter(entities, lambda e: contains(lower(text), lower(e))))::DOUBLE / len(entities) END::DOUBLE AS identifier, CASE WHEN len(met) = 0 THEN 0.0 ELSE 1 - (list_min(firsts) - 1)::DOUBLE / tn END::DOUBLE AS position, "
    f"CASE WHEN version_mentioned IS NULL OR version IS NULL THEN 0.5 WHEN {major('version_mentioned')} <> {major('version')} THEN 0.0 WHEN version_mentioned = version THEN 1.0 ELSE 0.75 END::DOUBLE AS version_match FROM f2"
)
CTES["featured"] = f"SELECT *, CASE WHEN len(qt) = 0 OR tn = 0 THEN 0.0 ELSE round({' + '.join(f'{w}::DOUBLE * {"version_match" if n == "version" else n}' for n, w in WEIGHTS.items())}, 12) END::DOUBLE AS ce FROM f3"
_norm = lambda x: f"CASE WHEN max({x}) OVER w - min({x}) OVER w < 1e-12 THEN 0.5::DOUBLE ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"
CTES["normed"] = f"SELECT *, {_norm('ce')} AS cn, {_norm('rs')} AS rn FROM featured WINDOW w AS (PARTITION BY qid)"
_alpha = CONFIG.get("rerank.alpha")
CTES["b0"] = f"SELECT *, round({_alpha}::DOUBLE * cn + {1 - _alpha!r}::DOUBLE * rn, 12) AS final_score FROM normed WHERE rank_before <= {CONFIG.get('rerank.rerank_top_n')}"
CTES["blended"] = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, chunk_id) AS blend_rank FROM b0"
_k, _per_s, _per_d = CONFIG.get("rerank.final_k"), CONFIG.get("rerank.caps.max_per_source"), CONFIG.get("rerank.caps.max_per_document")
CTES["items"] = "SELECT qid, list({'c': chunk_id, 's': source, 'd': doc, 'v': final_score, 'w': list_distinct(seen)} ORDER BY blend_rank) AS it FROM blended GROUP BY qid"
CTES["quota(qid, it, i, chosen, passed)"] = (
    "SELECT qid, it, 0, []::BIGINT[], []::BIGINT[] FROM items UNION ALL SELECT qid, it, i + 1, CASE WHEN fits THEN list_append(chosen, i + 1) ELSE chosen END, CASE WHEN fits THEN passed ELSE list_append(passed, i + 1) END "
    f"FROM (SELECT *, len(chosen) < {_k} AND len(list_filter(chosen, lambda x: it[x].s = it[i + 1].s)) < {_per_s} AND len(list_filter(chosen, lambda x: it[x].d = it[i + 1].d)) < {_per_d} AS fits FROM quota WHERE i < len(it))"
)
CTES["taken"] = f"SELECT qid, list_transform(list_sort(list_slice(list_concat(chosen, passed), 1, {_k})), lambda x: it[x]) AS it FROM quota WHERE i = len(it)"
_jac = "CASE WHEN len(it[i].w) = 0 OR len(it[j].w) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(it[i].w, it[j].w))::DOUBLE / len(list_distinct(list_concat(it[i].w, it[j].w))) END"
CTES["alike"] = f"SELECT qid, it, list_transform(range(1, len(it) + 1), lambda i: list_transform(range(1, len(it) + 1), lambda j: {_jac})) AS sim, list_transform(it, lambda x: x.v) AS v FROM taken"
_lambda = CONFIG.get("rerank.mmr.lambda")
CTES["mmr(qid, it, sim, v, chosen)"] = (
    "SELECT qid, it, sim, v, [1::BIGINT] FROM alike UNION ALL SELECT qid, it, sim, v, list_append(chosen, -best.i) FROM (SELECT *, list_max(list_transform(list_filter(range(1, len(v) + 1), lambda i: NOT list_contains(chosen, i)), "
    f"lambda i: {{'s': round({_lambda}::DOUBLE * v[i] - {1 - _lambda!r}::DOUBLE * list_max(list_transform(chosen, lambda j: sim[i][j])), 12), 'i': -i}})) AS best FROM mmr WHERE len(chosen) < len(v))"
)
CTES["picked"] = "SELECT qid, unnest(list_transform(chosen, lambda i: it[i].c)) AS chunk_id, unnest(range(1, len(chosen) + 1)) AS rank_after FROM mmr WHERE len(chosen) = len(v)"
CTES["final"] = "SELECT b.*, p.rank_after FROM blended b JOIN picked p USING (qid, chunk_id)"


def claim_sql(text: str) -> str:
    """A list of structs (attribute, value, evidence), one for each attribute that a text has."""
    found = []
    for attribute, patterns in con.CLAIMS.items():
        cases = []
        for pattern, value in patterns:
            # There is no look-ahead here: what it looks for is matched, and group 1 is the match without it.
            plain, _, ahead = pattern.replace("{brand}", re.escape(BRAND)).partition("(?=")
            regex = quoted(f"(?i)({plain})" + ahead.removesuffix(")"))
            whole = f"regexp_extract({text}, {regex}, 1)"
            here = f"strpos({text}, {whole})"
            rest = f"substr({text}, {here} + length({whole}))"
            part = f"regexp_extract({text}, {regex}, 2)" if value in (None, "bytes") else quoted(own(value))
            if value == "bytes":
                number = f"regexp_extract(replace(replace(lower({part}), ',', ''), '_', ''), '([0-9]+(?:\\.[0-9]+)?)\\s*(kib|kb|mib|mb|bytes|b)?', 1)"
                unit = f"regexp_extract(replace(replace(lower({part}), ',', ''), '_', ''), '([0-9]+(?:\\.[0-9]+)?)\\s*(kib|kb|mib|mb|bytes|b)?', 2)"
                part = f"CAST(CAST(CAST({number} AS DOUBLE) * CASE {unit} WHEN 'kib' THEN 1024 WHEN 'kb' THEN 1000 WHEN 'mib' THEN 1048576 WHEN 'mb' THEN 1000000 ELSE 1 END AS BIGINT) AS VARCHAR)"
            evidence = strip(f"regexp_extract(substr({text}, 1, {here} - 1), '[^.]*$') || {whole} || CASE WHEN contains({rest}, '.') THEN regexp_extract({rest}, '(?s)^[^.]*\\.') ELSE substr({rest}, 1, 120) END")
            cases.append(f"WHEN regexp_matches({text}, {regex}) THEN {{'attribute': {quoted(attribute)}, 'value': {part}, 'evidence': {evidence}}}")
        found.append(f"CASE {' '.join(cases)} END")
    return f"list_filter([{', '.join(found)}], lambda c: c IS NOT NULL)"


_order = CONFIG.get("contradiction.source_authority_order")
_staff = "coalesce(role IN ('staff', 'mvp'), false)"
_tier = f"CASE WHEN source = 'docs' THEN CASE WHEN doc_type = 'changelog' THEN 'docs:changelog' ELSE 'docs' END WHEN source = 'forum' THEN CASE WHEN {_staff} THEN 'forum:staff' WHEN accepted THEN 'forum:accepted' WHEN coalesce(votes, 0) >= 20 THEN 'forum:high_votes' ELSE 'forum:low_votes' END ELSE CASE WHEN role = 'staff' THEN 'blog:staff' ELSE 'blog:guest' END END"
CTES["facts"] = (
    f"SELECT qid, chunk_id, rank_after, source, shown, seen, version, doc_type, doc, coalesce(area, '') AS area, tags, {_staff} AS staff, accepted OR coalesce(votes, 0) >= 10 AS popular, source = 'docs' OR {_staff} OR (source = 'forum' AND (accepted OR coalesce(votes, 0) >= 20)) AS credible, "
    f"list_filter([{', '.join(f'CASE WHEN {cues("text", words)} THEN {quoted(name)} END' for name, words in con.SCOPES.items())}], lambda s: s IS NOT NULL) AS scopes, {cues('shown', con.OBSERVED)} AS observed, {cues('shown', con.UNDOCUMENTED)} AS undocumented, {cues('shown', con.DEPRECATED)} AS deprecated, {cues('shown', con.RECONCILED)} AS reconciled, "
    f"{_tier} AS tier, coalesce(list_position([{', '.join(map(quoted, _order))}], {_tier}), {len(_order) + 1}) AS authority, list_transform(list_filter(string_split(coalesce(version, '0'), '.'), lambda p: regexp_matches(p, '^[0-9]+$')), lambda p: CAST(p AS INTEGER)) AS parts, coalesce(CAST(day AS DATE) - DATE '1970-01-01', 0) AS day FROM final"
)
CTES["said"] = f"SELECT * EXCLUDE (c), c.attribute, c.value, c.evidence FROM (SELECT *, unnest({claim_sql('shown')}) AS c FROM facts)"
CTES["observers"] = "SELECT qid, list(DISTINCT doc) AS observers FROM facts WHERE source = 'forum' AND observed GROUP BY qid"
_least = CONFIG.get("contradiction.empirical_override.min_independent_reports")
_kind = lambda name, ok, sure: f"{{'relationship': '{name}', 'reconcilable': {ok}, 'confidence': CAST({sure} AS DOUBLE)}}"
CTES["pairs"] = (
    "SELECT a, b, a.qid AS qid, a.attribute AS attribute, coalesce(o.observers, []) AS observers, a.source = 'docs' AS docs_a, b.source = 'docs' AS docs_b, CASE WHEN a.source = 'docs' THEN b ELSE a END AS other "
    "FROM said a JOIN said b ON a.qid = b.qid AND a.attribute = b.attribute AND a.rank_after < b.rank_after AND a.value <> b.value LEFT JOIN observers o ON o.qid = a.qid"
)
_acknowledged = "(attribute = 'legacy_ack_flag' AND (a.deprecated OR b.deprecated))"
CTES["typed"] = (
    f"SELECT *, CASE WHEN a.reconciled OR b.reconciled THEN {_kind('complementary', 'true', 0.88)} WHEN len(a.scopes) > 0 AND len(b.scopes) > 0 AND NOT list_has_any(a.scopes, b.scopes) THEN {_kind('complementary', 'true', 0.85)} "
    f"WHEN (docs_a OR docs_b) AND other.source = 'forum' AND other.observed AND len(list_filter(observers, lambda d: d <> other.doc)) + 1 >= {_least} THEN {_kind('empirical_override', 'true', 0.89)} "
    f"WHEN (NOT a.credible OR NOT b.credible) AND (docs_a OR docs_b) THEN {_kind('misconception', 'false', 0.8)} WHEN a.version <> b.version AND {major('a.version')} = {major('b.version')} THEN {_kind('conditional', 'true', 0.88)} WHEN a.version <> b.version THEN {_kind('version_drift', 'true', 0.9)} "
    f"WHEN {_acknowledged} AND docs_a AND docs_b AND list_sort([a.value, b.value]) = ['available', 'removed'] THEN {_kind('docs_drift', 'false', 0.92)} WHEN attribute = 'enqueue_api' OR {_acknowledged} THEN {_kind('deprecation', 'true', 0.85)} WHEN docs_a AND docs_b THEN {_kind('docs_drift', 'false', 0.8)} "
    f"WHEN docs_a OR docs_b THEN {_kind('misconception', 'false', 'CASE WHEN other.popular THEN 0.86 ELSE 0.72 END')} WHEN a.source = 'forum' AND b.source = 'forum' AND a.staff <> b.staff THEN {_kind('misconception', 'false', 'CASE WHEN CASE WHEN a.staff THEN b.popular ELSE a.popular END THEN 0.84 ELSE 0.7 END')} ELSE {_kind('contradict', 'false', 0.65)} END AS kind, "
    "attribute AS topic, attribute || ' = ' || a.value || ': ' || substr(a.evidence, 1, 200) AS claim_a, attribute || ' = ' || b.value || ': ' || substr(b.evidence, 1, 200) AS claim_b FROM pairs"
)
_overlap = "((a.area <> '' AND a.area = b.area) OR list_has_any(a.tags, b.tags) OR (b.area <> '' AND list_contains(a.tags, b.area)) OR (a.area <> '' AND list_contains(b.tags, a.area)))"
CTES["both_"] = (
    "SELECT a.qid AS qid, struct_pack(chunk_id := a.chunk_id, source := a.source, rank_after := a.rank_after, tags := a.tags, authority := a.authority, parts := a.parts, day := a.day) AS a, struct_pack(chunk_id := b.chunk_id, source := b.source, rank_after := b.rank_after, tags := b.tags, authority := b.authority, parts := b.parts, day := b.day) AS b, topic, kind, claim_a, claim_b, 1 AS pass FROM typed UNION ALL "
    "SELECT a.qid, struct_pack(chunk_id := a.chunk_id, source := a.source, rank_after := a.rank_after, tags := a.tags, authority := a.authority, parts := a.parts, day := a.day), struct_pack(chunk_id := b.chunk_id, source := b.source, rank_after := b.rank_after, tags := b.tags, authority := b.authority, parts := b.parts, day := b.day), "
    f"'{con.GAP}', {_kind('docs_gap', 'true', 0.82)}, 'no page of the documentation says anything about it', substr(b.shown, 1, 220), 2 FROM facts a JOIN facts b ON a.qid = b.qid AND a.source = 'docs' AND b.source <> 'docs' AND b.undocumented AND b.staff AND {_overlap} "
    "WHERE NOT EXISTS (SELECT 1 FROM (SELECT qid AS tq, a.chunk_id AS ta, b.chunk_id AS tb FROM typed) t WHERE tq = a.qid AND ((ta = a.chunk_id AND tb = b.chunk_id) OR (ta = b.chunk_id AND tb = a.chunk_id)))"
)
CTES["found"] = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kind.confidence DESC, CASE WHEN a.source = b.source THEN 1 ELSE 0 END, pass, least(a.rank_after, b.rank_after), greatest(a.rank_after, b.rank_after), topic) AS finding FROM both_) "
    f"WHERE finding <= {CONFIG.get('contradiction.pair_selection.max_pairs')}"
)
_by_area = "CASE topic " + " ".join(f"WHEN {quoted(t)} THEN list_contains([{', '.join(map(quoted, areas))}], asked_area)" for t, areas in con.ATTRIBUTE_AREAS.items()) + " ELSE false END"
CTES["bearing"] = (
    f"SELECT f.*, asked_area, coalesce({_by_area}, false) OR list_has_any(qt, {tokens_sql("replace(topic, '_', ' ')")}) OR coalesce(CASE WHEN topic = '{con.GAP}' THEN b.rank_after <= 3 AND (asked_area IS NULL OR len(b.tags) = 0 OR list_contains(b.tags, asked_area)) ELSE a.rank_after <= 3 AND b.rank_after <= 3 END, false) AS bears "
    f"FROM found f JOIN qa USING (qid) WHERE kind.relationship IN ({', '.join(map(quoted, con.CONFLICTS))})"
)
CTES["kept"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, least(a.chunk_id, b.chunk_id), greatest(a.chunk_id, b.chunk_id), topic ORDER BY finding) AS nth FROM bearing WHERE bears) WHERE nth = 1"
CTES["newer"] = "SELECT *, CASE WHEN a.parts <> b.parts THEN a.parts > b.parts ELSE a.day >= b.day END AS a_newer, kind.relationship AS rel FROM kept"
CTES["strong"] = "SELECT *, CASE WHEN a.authority <> b.authority THEN a.authority < b.authority ELSE a_newer END AS a_stronger FROM newer"
CTES["resolved"] = (
    "SELECT *, CASE WHEN rel IN ('version_drift', 'conditional') THEN 'version_scoping' WHEN rel = 'deprecation' THEN 'explicit_deprecation' WHEN rel = 'empirical_override' THEN 'empirical_override' WHEN rel = 'docs_gap' THEN 'docs_gap_staff_authority' WHEN rel IN ('contradict', 'misconception') THEN 'authority_canonical' WHEN rel = 'docs_drift' THEN 'recency_within_tier' ELSE 'unresolved' END AS rule, "
    "CASE WHEN rel = 'deprecation' THEN CASE WHEN a.source = 'docs' THEN true WHEN b.source = 'docs' THEN false ELSE a_stronger END WHEN rel = 'docs_gap' THEN a.source <> 'docs' WHEN rel IN ('contradict', 'misconception') THEN a_stronger WHEN rel = 'docs_drift' THEN a_newer END AS a_wins FROM strong"
)
_g = CONFIG.get("generation")
_most = _g["max_context_chunks"]
CTES["qterms"] = "SELECT qid, unnest(qu) AS term, unnest(range(0, len(qu))) AS pos FROM qa"
CTES["used"] = f"SELECT * FROM final WHERE rank_after <= {_most}"
CTES["ctx"] = "SELECT qid, term, count(*) AS df FROM (SELECT qid, unnest(list_distinct(seen)) AS term FROM used) GROUP BY qid, term"
CTES["best"] = "SELECT qid, max(ce) AS best_ce, count(*) AS n FROM used GROUP BY qid"
CTES["covered"] = "SELECT qid, avg(CASE WHEN coalesce(df, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS coverage FROM qterms JOIN best USING (qid) LEFT JOIN ctx USING (qid, term) WHERE length(term) > 2 AND coalesce(df, 0) <= greatest(1, floor(n * 0.6::DOUBLE)) GROUP BY qid"
CTES["unknown"] = "SELECT qid, avg(CASE WHEN df IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS unknown FROM qterms LEFT JOIN known USING (term) WHERE length(term) > 3 AND coalesce(df, 0) <= (SELECT sum(n) FROM stats) * 0.6::DOUBLE GROUP BY qid"
CTES["signals"] = f"SELECT *, none OR best_ce < {_g['refuse_below_score']} OR coverage < {_g['refuse_below_coverage']} OR unknown >= {_g['refuse_above_unknown_ratio']} AS refused FROM (SELECT qid, coalesce(best_ce, 0) AS best_ce, CASE WHEN n IS NULL THEN 0 ELSE coalesce(coverage, 1) END AS coverage, coalesce(unknown, 0) AS unknown, n IS NULL AS none FROM qa LEFT JOIN best USING (qid) LEFT JOIN covered USING (qid) LEFT JOIN unknown USING (qid))"
CTES["pivots"] = f"SELECT qid, list(term) AS pivots FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY df, pos) AS r FROM qterms JOIN known USING (term) WHERE length(term) > 2) WHERE r <= {max(1, _g['quote_pivot_terms'])} GROUP BY qid"
CTES["named"] = "SELECT qid, list(a.chunk_id) || list(b.chunk_id) AS names FROM resolved GROUP BY qid"
CTES["quotable"] = "SELECT u.* FROM used u LEFT JOIN pivots USING (qid) LEFT JOIN named USING (qid) WHERE pivots IS NULL OR rank_after = 1 OR coalesce(list_contains(names, chunk_id), false) OR list_has_any(pivots, tokens)"
_plain_text = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?s)```.*?```', ' ', 'g'), '`{1,2}([^`]*)`{1,2}', '\1', 'g'), '(?m)^\s*#+\s*', '', 'g'), '\s+', ' ', 'g')"
CTES["s0"] = f"SELECT qid, chunk_id, qu, unnest(s) AS raw, unnest(range(0, len(s))) AS pos FROM (SELECT qid, chunk_id, qu, {sentences_sql('shown')} AS s FROM used)"
CTES["s1"] = f"SELECT *, list_filter(qu, lambda t: list_contains({tokens_sql('said')}, t)) AS met FROM (SELECT *, {strip(_plain_text)} AS said FROM s0) WHERE length(said) BETWEEN {gen.SHORTEST} AND {gen.LONGEST}"
CTES["s2"] = "SELECT qid, chunk_id, pos, any_value(raw) AS raw, any_value(said) AS said, sum(coalesce(ln(1 + (n + 1.0) / (df + 0.5)), 1.0)) AS score FROM (SELECT qid, chunk_id, pos, raw, said, unnest(met) AS term FROM s1) JOIN best USING (qid) LEFT JOIN ctx USING (qid, term) GROUP BY qid, chunk_id, pos"
CTES["s3"] = (
    f"SELECT *, round(score * CASE WHEN regexp_matches(said, '\\?\\s*$') OR said LIKE 'QUESTION:%' THEN {gen.QUESTION}::DOUBLE ELSE 1.0 END * CASE WHEN length(said) - length(replace(said, '|', '')) >= 3 THEN {gen.TABLE}::DOUBLE ELSE 1.0 END * CASE WHEN regexp_matches(said, '[0-9]') THEN {gen.NUMBER}::DOUBLE ELSE 1.0 END * CASE WHEN contains(raw, '--') OR contains(raw, '`') THEN {gen.CODE}::DOUBLE ELSE 1.0 END, 9) AS points FROM s2"
)
CTES["bodies"] = f"SELECT qid, chunk_id, string_agg(said, ' ' ORDER BY pos) AS body FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY points DESC, pos) AS r FROM s3) WHERE r <= {gen.QUOTED_SENTENCES} GROUP BY qid, chunk_id"
CTES["labelled"] = (
    "SELECT *, CASE source WHEN 'docs' THEN 'Documentation — ' || coalesce(title, doc) || ' (v' || coalesce(version, '?') || ')' WHEN 'forum' THEN 'Forum — ' || CASE WHEN accepted THEN 'accepted answer' ELSE 'answer' END || ' by ' || coalesce(role, 'user') || ', ' || coalesce(votes, 0) || ' votes' "
    "ELSE 'Blog — ' || coalesce(role, 'guest') || ', ' || substr(coalesce(day, ''), 1, 7) || ' (v' || coalesce(version, '?') || ' era)' END AS label FROM final"
)
CTES["quoting"] = f"SELECT qid, chunk_id, body, label, row_number() OVER (PARTITION BY qid ORDER BY q) - 1 AS nth FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank_after) AS q FROM quotable) JOIN bodies USING (qid, chunk_id) JOIN labelled USING (qid, chunk_id) WHERE q <= {gen.QUOTED_CHUNKS}"
CTES["texts"] = "SELECT qid, string_agg('**' || label || ':** ' || body, chr(10) || chr(10) ORDER BY nth) AS text, string_agg(chunk_id || ' ' || nth || ' ' || md5(substr(body, 1, 300)), '|' ORDER BY nth) AS citations FROM quoting GROUP BY qid"
CTES["told"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY finding) AS r FROM resolved) WHERE r <= {gen.SHOWN}"
CTES["answered"] = (
    f"SELECT s.qid, s.refused, CASE WHEN s.refused THEN '' ELSE coalesce(t.text, {quoted(gen.NOTHING)}) END AS quoted, CASE WHEN s.refused THEN '' ELSE coalesce(t.citations, '') END AS citations, u.used, u.sources, "
    "CASE WHEN s.refused THEN '' ELSE coalesce(t.text, '') || coalesce((SELECT string_agg(substr(claim_a, 1, 180) || chr(10) || substr(claim_b, 1, 180), chr(10)) FROM told d WHERE d.qid = s.qid), '') END AS whole "
    "FROM signals s LEFT JOIN texts t USING (qid) LEFT JOIN (SELECT qid, list(chunk_id ORDER BY rank_after, chunk_id) AS used, (SELECT string_agg(source || '=' || n, '|' ORDER BY source) FROM (SELECT source, count(*) AS n FROM used x WHERE x.qid = y.qid GROUP BY source)) AS sources FROM used y GROUP BY qid) u USING (qid)"
)
_gold_label = f"{{'label': {options(SOURCES, 'k % 3')} || ':d' || ((item_id * 7 + k * 3) % 100), 'grade': 1 + k % 3}}"
CTES["gold"] = (
    f"SELECT item_id, CAST(item_id AS VARCHAR) AS qid, CASE WHEN item_id % 4 = 3 THEN [] ELSE list_append(list_transform(range(0, 30), lambda k: {_gold_label}), {{'label': {options(SOURCES, 'item_id % 3')} || ':d' || (item_id // 9) || ':' || item_id, 'grade': 3}}) END AS relevant, "
    "CASE WHEN item_id % 2 = 0 THEN ['docs', 'forum'] ELSE []::VARCHAR[] END AS expected, CASE item_id % 3 WHEN 0 THEN 'c1' WHEN 1 THEN '' END AS conflict, item_id % 5 = 0 AS refusal, item_id % 7 = 0 AS no_conflict FROM benchmark"
)
CTES["grades"] = "SELECT qid, chunk_id, max(l.grade) AS grade FROM (SELECT qid, unnest(relevant) AS l FROM gold) JOIN ch ON chunk_id = l.label OR starts_with(chunk_id, l.label || ':') GROUP BY qid, chunk_id"
_gain = lambda g, r: f"(pow(2.0, {g}) - 1) / log2({r} + 1.0)"
CTES["ideal"] = f"SELECT qid, sum(CASE WHEN r <= 10 THEN {_gain('grade', 'r')} ELSE 0 END) AS ideal, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC) AS r FROM grades) GROUP BY qid"
CTES["got"] = f"SELECT qid, sum(CASE WHEN rank_after <= 10 THEN {_gain('grade', 'rank_after')} ELSE 0 END) AS dcg, count(*) FILTER (rank_after <= 5) AS h5, count(*) FILTER (rank_after <= 10) AS h10, min(rank_after) AS first FROM final JOIN grades USING (qid, chunk_id) GROUP BY qid"
CTES["pooled"] = "SELECT qid, count(*) AS h20 FROM pool JOIN grades USING (qid, chunk_id) WHERE rank_before <= 20 GROUP BY qid"
CTES["ranking"] = "SELECT qid, coalesce(dcg / ideal, 0) AS ndcg10, coalesce(h5 / total, 0) AS recall5, coalesce(h10 / total, 0) AS recall10, coalesce(h20 / total, 0) AS recall20_pool, coalesce(1.0::DOUBLE / first, 0) AS mrr FROM (SELECT qid, coalesce(n, len(relevant))::DOUBLE AS total FROM gold LEFT JOIN ideal USING (qid) WHERE len(relevant) > 0) LEFT JOIN ideal USING (qid) LEFT JOIN got USING (qid) LEFT JOIN pooled USING (qid)"
CTES["sourced"] = "SELECT qid, len(list_intersect(any_value(expected), list(DISTINCT source)))::DOUBLE / len(any_value(expected)) AS source_recall, coalesce(avg(CASE WHEN source IS NULL THEN NULL WHEN list_contains(expected, source) THEN 1.0::DOUBLE ELSE 0.0 END), 0) AS source_precision FROM gold LEFT JOIN final USING (qid) WHERE len(expected) > 0 GROUP BY qid"
CTES["moved"] = "SELECT qid, rank_before - rank_after AS way, rank_before > 3 AND rank_after <= 3 AS promoted FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank_after) AS r FROM final JOIN grades USING (qid, chunk_id) WHERE grade >= 2) WHERE r = 1"
CTES["scores"] = (
    "SELECT g.*, coalesce(a.refused, true) AS refused, len(relevant) = 0 OR item_id % 2 = 1 OR contains(lower(a.whole), 'max_retries') AS contains_ok, NOT contains(lower(a.whole), 'broken on') AS excludes_ok, ranking.* EXCLUDE (qid), source_recall, source_precision, way, promoted, "
    "len(relevant) > 0 AND no_conflict AS calm, len(relevant) > 0 AND coalesce(conflict, '') <> '' AND NOT no_conflict AS wants, "
    "coalesce((SELECT bool_or(kind.relationship = 'complementary') FROM found f WHERE f.qid = g.qid), false) AS complementary, (SELECT count(*) FROM resolved r WHERE r.qid = g.qid) AS n_resolved, coalesce((SELECT bool_or(topic = 'worker_concurrency_default') FROM resolved r WHERE r.qid = g.qid), false) AS workers, "
    "coalesce((SELECT bool_or(rel = 'contradict') FROM resolved r WHERE r.qid = g.qid), false) AS contradicts, (SELECT arg_min(rel, finding) FROM resolved r WHERE r.qid = g.qid) AS first_rel, (SELECT arg_min(rule, finding) FROM resolved r WHERE r.qid = g.qid) AS first_rule "
    "FROM gold g LEFT JOIN answered a USING (qid) LEFT JOIN ranking USING (qid) LEFT JOIN sourced USING (qid) LEFT JOIN moved USING (qid)"
)
CTES["conflicts"] = "SELECT *, CASE WHEN calm THEN complementary WHEN wants THEN n_resolved > 0 ELSE false END AS conflict_detected, CASE WHEN calm THEN workers WHEN wants OR len(relevant) = 0 THEN false ELSE contradicts END AS false_positive FROM scores"


def chain(last: str, select: str) -> str:
    """``select`` over all stages up to ``last``."""
    names = list(CTES)
    upto = next(i for i, n in enumerate(names) if n.split("(")[0] == last)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS {'' if '(' in n else 'MATERIALIZED '}({CTES[n]})" for n in names[: upto + 1]) + " " + select


_mean = lambda c, when="true", digits=4: f"CAST(coalesce(round_even(avg(CASE WHEN {when} THEN coalesce(CAST({c} AS DOUBLE), 0) END), {digits}), 0) AS DOUBLE)"
ORACLES: dict[str, str] = {
    "question_expansions": chain("qa", "SELECT qid, intent, array_to_string(entities, '|') AS entities, array_to_string(expanded, '|') AS expanded, array_to_string(queries, '|') AS queries, canonical AS requires_canonical_answer FROM qa"),
    "raw_lists": chain("hits", "SELECT 'bm25' AS arm, qid, CAST(qi AS INTEGER) AS qi, source, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits"),
    "weighed_candidates": chain("weighed", "SELECT qid, chunk_id, round(rrf, 9) AS rrf, source_weight, round(authority, 6) AS authority, round(recency, 6) AS recency, round(rs + 1e-11, 9) AS score FROM weighed"),
    "version_filtered": chain("filtered", "SELECT qid, chunk_id, version AS version_own FROM filtered"),
    "pooled_candidates": chain("pool", "SELECT qid, chunk_id, CAST(rank_before AS INTEGER) AS rank_before FROM pool"),
    "retrieval_stats": chain("filtered", "SELECT h.qid, h.source, count(*) AS bm25_hits, CAST(0 AS BIGINT) AS dense_hits, count(DISTINCT h.chunk_id) AS fused, coalesce((SELECT (v // 1000000 + CASE WHEN v % 1000000 > 500000 OR (v % 1000000 = 500000 AND (v // 1000000) % 2 = 1) THEN 1 ELSE 0 END) / 1e6 FROM (SELECT CAST(round(max(rs) * 1e12) AS BIGINT) AS v FROM filtered f WHERE f.qid = h.qid AND f.source = h.source)), 0.0) AS top_score FROM hits h GROUP BY h.qid, h.source"),
    "rerank_features": chain("featured", "SELECT qid, chunk_id, round(coverage, 6) AS coverage, round(proximity, 6) AS proximity, round(phrase, 6) AS phrase, round(identifier, 6) AS identifier, round(position, 6) AS position, round(version_match, 6) AS version_match, round(ce, 6) AS ce_score FROM featured"),
    "blended_scores": chain("blended", "SELECT qid, chunk_id, round(final_score, 6) AS final_score, CAST(blend_rank AS INTEGER) AS blend_rank FROM blended"),
    "alpha_sweep": chain("normed", "SELECT alpha, qid, chunk_id, CAST(r AS INTEGER) AS blend_rank FROM (SELECT *, row_number() OVER (PARTITION BY alpha, qid ORDER BY round(alpha * cn + (1 - alpha) * rn, 12) DESC, chunk_id) AS r FROM normed, (SELECT i / 10.0::DOUBLE AS alpha FROM range(0, 11) t(i))) WHERE r <= 3"),
    "quota_chunks": chain("taken", "SELECT qid, unnest(list_transform(it, lambda x: x.c)) AS chunk_id, CAST(unnest(range(1, len(it) + 1)) AS INTEGER) AS rank_after FROM taken"),
    "final_chunks": chain("final", "SELECT qid, chunk_id, CAST(rank_before AS INTEGER) AS rank_before, CAST(rank_after AS INTEGER) AS rank_after, CAST(rank_before - rank_after AS INTEGER) AS rank_delta FROM final"),
    "without_reranking": chain("pool", f"SELECT qid, chunk_id, CAST(rank_before AS INTEGER) AS rank_after, round(rs + 1e-11, 9) AS final_score FROM pool WHERE rank_before <= {_k}"),
    "rerank_stats": chain("blended", f"SELECT qid, count(*) AS reranked, round(avg(CASE WHEN blend_rank <= {_k} THEN abs(rank_before - blend_rank) END), 6) AS moved, CAST(max(CASE WHEN blend_rank = 1 AND rank_before <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS top1_changed, round(min(ce), 6) AS ce_min, round(max(ce), 6) AS ce_max FROM blended GROUP BY qid"),
    "chunk_facts": chain("facts", "SELECT qid, chunk_id, version, area, array_to_string(tags, '|') AS tags, doc, staff, popular, credible, array_to_string(scopes, '|') AS scopes, observed, undocumented, deprecated, reconciled, tier, CAST(authority AS BIGINT) AS authority_rank, array_to_string(parts, '.') AS parts, CAST(day AS BIGINT) AS day FROM facts"),
    "claims_found": chain("cc", f"SELECT chunk_id, c.attribute AS attribute, c.value AS value, md5(c.evidence) AS evidence_md5 FROM (SELECT chunk_id, unnest({claim_sql('shown')}) AS c FROM cc)"),
    "conflict_findings": chain("found", "SELECT qid, CAST(finding AS INTEGER) AS finding, a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, topic, kind.relationship AS relationship, kind.reconcilable AS reconcilable, kind.confidence AS confidence, md5(claim_a || '|' || claim_b) AS claims_md5 FROM found"),
    "conflicts_resolved": chain("resolved", "SELECT qid, CAST(finding AS INTEGER) AS finding, topic, CASE WHEN rule = 'version_scoping' THEN 'both' WHEN rule = 'empirical_override' THEN 'disclose_both' WHEN rule = 'unresolved' THEN 'unresolved' WHEN rule = 'docs_gap_staff_authority' OR NOT a_wins THEN CASE WHEN a_wins THEN a.chunk_id ELSE b.chunk_id END ELSE a.chunk_id END AS winner, CASE WHEN rule IN ('explicit_deprecation', 'authority_canonical', 'recency_within_tier') THEN CASE WHEN a_wins THEN b.chunk_id ELSE a.chunk_id END END AS loser, rule AS rule_fired, true AS must_disclose FROM resolved"),
    "similar_pairs": chain("facts", f"SELECT qid, ca AS chunk_id_a, cb AS chunk_id_b, round(s, 6) AS similarity FROM (SELECT a.qid, a.chunk_id AS ca, b.chunk_id AS cb, CASE WHEN len(a.seen) = 0 OR len(b.seen) = 0 THEN 0.0 ELSE len(list_intersect(a.seen, b.seen))::DOUBLE / len(list_distinct(list_concat(a.seen, b.seen))) END AS s FROM facts a JOIN facts b ON a.qid = b.qid AND a.rank_after < b.rank_after AND {_overlap}) WHERE s >= 0.2::DOUBLE * 0.25"),
    "refusal_signals": chain("signals", "SELECT qid, round(best_ce, 6) AS best_ce, round(coverage, 6) AS coverage, round(unknown, 6) AS unknown, refused FROM signals"),
    "quotable_chunks": chain("quotable", "SELECT qid, chunk_id FROM quotable"),
    "context_idf": chain("best", "SELECT qid, term, round(ln(1 + (n + 1.0) / (df + 0.5)), 6) AS idf FROM ctx JOIN best USING (qid)"),
    "quoted_sentences": chain("bodies", "SELECT qid, chunk_id, md5(body) AS body_md5, CAST(length(body) AS BIGINT) AS size FROM bodies"),
    "source_labels": chain("labelled", "SELECT qid, chunk_id, label FROM labelled"),
    "disclosures": chain("told", "SELECT qid, count(*) + 1 AS parts, string_agg(rule, '|' ORDER BY r) AS rules FROM told GROUP BY qid"),
    "answers": chain("answered", "SELECT qid, refused, md5(quoted) AS quoted_md5, citations, array_to_string(CASE WHEN refused THEN list_slice(coalesce(used, []), 1, 3) ELSE used END, '|') AS used, sources FROM answered"),
    "label_grades": chain("grades", "SELECT qid, chunk_id, CAST(grade AS BIGINT) AS grade FROM grades"),
    "ranking_quality": chain("ranking", "SELECT qid, round(ndcg10, 6) AS ndcg10, round(recall5, 6) AS recall5, round(recall10, 6) AS recall10, round(recall20_pool, 6) AS recall20_pool, round(mrr, 6) AS mrr FROM ranking"),
    "question_scores": chain("scores", "SELECT qid, len(relevant) > 0 AS ranked, refused, refused = refusal AS refusal_correct, contains_ok, excludes_ok, round(source_recall, 6) AS source_recall, round(source_precision, 6) AS source_precision, CAST(way AS BIGINT) AS gold_displacement, promoted AS promoted_into_top3 FROM scores"),
    "conflict_scores": chain("conflicts", "SELECT qid, conflict_detected, CASE WHEN calm AND complementary THEN 'complementary' WHEN wants THEN first_rel END AS conflict_relationship, CASE WHEN wants THEN first_rule END AS conflict_rule, false_positive AS false_positive_conflict FROM conflicts"),
    "score_summary": chain("conflicts", f"SELECT count(*) AS questions, count(*) FILTER (NOT refusal) AS ranked_questions, {', '.join(f'{_mean(c, "NOT refusal")} AS {c}' for c in ('ndcg10', 'recall5', 'recall10', 'recall20_pool', 'mrr', 'source_recall', 'source_precision'))}, {_mean('promoted', 'NOT refusal')} AS promoted_into_top3, {_mean('abs(way)', 'NOT refusal AND way IS NOT NULL', 3)} AS gold_displacement, {_mean('conflict_detected', "coalesce(conflict, '') <> '' AND NOT false_positive")} AS conflict_detected, {_mean('false_positive')} AS false_positive_conflict, {_mean('refused = refusal')} AS refusal_correct, {_mean('contains_ok')} AS contains_ok, {_mean('excludes_ok')} AS excludes_ok FROM conflicts"),
}
