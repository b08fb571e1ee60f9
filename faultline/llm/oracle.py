"""DuckDB SQL of the training-data queries that SQL can express.

Not expressible: tokens (1), the trained filter (2), fuzzy classes of hashed candidates (6),
XXH64 (8), the block rules (9) and the random field (10); tests hold those against brute
force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

import string

from faultline.llm import fill_in_middle as FIM
from faultline.llm import mixing as MIX
from faultline.llm import quality_rules as Q
from faultline.llm.chat_format import CHATML
from faultline.llm.queries import PROBE

_SPACE = r"\x20\x09-\x0D"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped(c: str) -> str:
    return rf"replace(replace({c}, '\', '\\'), '<|', '<\|')"


def _chat() -> str:
    t = CHATML
    moves = " OR ".join(
        f"(prev = {_q(state)} AND role IN ({', '.join(map(_q, sorted(to)))}))" for state, to in t.moves.items())
    order = "ORDER BY turn NULLS FIRST, role, text"
    probe = ", ".join(f"(-1, {k}, {_q(r)}, {_q(PROBE)})" for k, r in enumerate(("user", "assistant")))
    around = len(t.opener) + len(t.after_role) + len(t.closer)
    return rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES {probe}) p(conv_id, turn, role, text)),
m AS (SELECT *, coalesce(lag(role) OVER w, '') AS prev, lead(turn) OVER w IS NULL AND
             row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last
      FROM r WINDOW w AS (PARTITION BY conv_id {order}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' {order})) AS loss_sha256,
       CAST(sum({around} + length(replace({_escaped('role')}, chr(10), '\n')) + length({_escaped('text')})) AS BIGINT)
         AS formatted_chars,
       bool_and({moves}) AND bool_or(is_last AND role = 'assistant') AS valid
FROM m GROUP BY conv_id"""


def _decontaminate() -> str:
    fold = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    words = rf"regexp_extract_all({fold}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
k AS MATERIALIZED (SELECT DISTINCT item_id, size, array_to_string(w[i + 1:i + size], ' ') AS g
                   FROM (SELECT item_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM s)),
x AS (SELECT doc_id, size, i, array_to_string(w[i + 1:i + size], ' ') AS g
      FROM (SELECT doc_id, w, size, unnest(range(greatest(0, len(w) - size + 1))) AS i
            FROM d CROSS JOIN (SELECT DISTINCT size FROM k))),
h AS MATERIALIZED (SELECT x.doc_id, x.i, x.size, k.item_id FROM x JOIN k ON x.size = k.size AND x.g = k.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _count(c: str, chars: str) -> str:
    return f"(length({c}) - length(translate({c}, {_q(chars)}, '')))"


def _quality() -> str:
    words = rf"list_filter(regexp_split_to_array({{}}, '[{_SPACE}]+'), lambda x: x <> '')"
    phrases = " OR ".join(f"contains(lower(x), {_q(p)})" for p in Q.PHRASES)
    fails = f"""CASE WHEN n = 0 THEN false WHEN n <= {Q.PHRASE_MAX_WORDS} AND ({phrases}) THEN true
      WHEN n < {Q.SHARE_MIN_WORDS} THEN false
      ELSE {_count('x', Q.SEPARATORS)} > {Q.MAX_SEPARATORS_PER_WORD} * n
        OR {_count('x', Q.SYMBOLS)} > {Q.MAX_SYMBOLS_PER_WORD} * n
        OR (length(x) - length(replace(x, '!!', ''))) / 2 > {Q.MAX_SHOUTS_PER_WORD} * n
        OR (upper(x) = x AND lower(x) <> x)
        OR (n >= {4 * Q.SHARE_MIN_WORDS} AND len(list_distinct(lw)) < {Q.MIN_DISTINCT_SHARE} * n)
        OR {_count('x', Q.ENDS)} = 0 END"""
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {words.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
lw AS MATERIALIZED (SELECT doc_id, x, {words.format('x')} AS lw FROM l),
j AS (SELECT doc_id, x, n, {fails} AS fails FROM (SELECT *, len(lw) AS n FROM lw)),
a AS (SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT CASE WHEN n > 0 THEN x END) AS n_dup_lines,
             coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS kept_words FROM j GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM c) GROUP BY 1),
f AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST({_count('d.t', Q.SYMBOLS)} AS BIGINT) AS n_symbols, a.n_dup_lines,
             coalesce(p.n, 0) AS n_repeat_words, a.kept_words
      FROM d JOIN a USING (doc_id) LEFT JOIN p USING (doc_id)),
v AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND kept_words >= {Q.MIN_KEPT} * n_words AS kept
FROM v"""


def _warc() -> str:
    letters = string.ascii_uppercase + "234567"
    group = "CAST('0x' || substr(h, {}, 5) AS BIGINT)"
    digest = " || ".join(f"substr('{letters}', CAST(({group.format(5 * g + 1)} >> {s}) & 31 AS INTEGER) + 1, 1)"
                         for g in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, strlen(b) AS payload_bytes, {digest} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS ok
FROM r"""


def _fill_in_middle() -> str:
    p, s, m = (_q(x) for x in (FIM.PREFIX, FIM.SUFFIX, FIM.MIDDLE))
    h = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{FIM.LINE}') AS u,
             sha256('{FIM.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {h} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m})
                       OR h3 % 100 >= {FIM.FIM_PERCENT} THEN 'plain'
                  WHEN h4 % 100 < {FIM.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM r),
x AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
             array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || pre || {s} || suf || {m} || mid
                        ELSE {s} || suf || {p} || pre || {m} || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM x"""


def _mixing() -> str:
    epochs, share = MIX.MAX_EPOCHS, f"CAST({MIX.SHARE} AS DOUBLE)"
    taken = " + ".join(f"greatest(0, least(size, quota - {e} * source_size - start))" for e in range(epochs))
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')) AS BIGINT) AS size,
             md5('{MIX.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS size FROM d GROUP BY source),
w AS (SELECT *, CAST({list(MIX.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(MIX.WEIGHTS)} + 1]
             AS DOUBLE) AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY size / weight, source) AS r FROM w),
c AS (SELECT *, {share} * sum(size) OVER () - {epochs} * coalesce(
               sum(size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM o),
f AS (SELECT * FROM c WHERE weight * rest / shares <= {epochs} * size ORDER BY r LIMIT 1),
t AS (SELECT c.source, CAST(c.size AS BIGINT) AS source_size,
             CASE WHEN c.r < f.r THEN {epochs} * c.size ELSE c.weight * f.rest / f.shares END AS target FROM c CROSS JOIN f),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST({taken} AS BIGINT) AS taken FROM p"""


ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": _chat(),
    "op4_decontaminate": _decontaminate(),
    "op5_quality_rules": _quality(),
    "op7_warc": _warc(),
    "op12_fill_in_middle": _fill_in_middle(),
    "op13_mixing": _mixing(),
}
