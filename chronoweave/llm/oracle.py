"""The same results as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  string_split(text, chr(10)) AS al FROM d),
starts AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 7], ' ')) AS n FROM starts),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM win WHERE n >= 2) GROUP BY rid),
ln AS (SELECT rid, pos, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS spoken,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
    len(regexp_extract_all(regexp_replace(line, '[\x20\x09]', '  ', 'g'), '(^|[\x20\x09])(\||\x{BB}|\x{203A}|\x{2022}|>)([\x20\x09]|$)')) AS signs
  FROM (SELECT rid, unnest(al) AS line, generate_subscripts(al, 1) AS pos FROM w)),
judged AS (SELECT *, spoken AND (NOT regexp_matches(line, '[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}]["''\x{201D}\x{2019}\x{BB})\]]*[\x20\x09-\x0D]*$')
    OR (signs >= 3 AND signs * 5 >= nw)
    OR regexp_matches(lower(line), '@BOILERPLATE@')) AS bad FROM ln),
lost AS (SELECT rid, count(*) FILTER (bad)::BIGINT AS n_failed_lines,
    coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (bad), 0)::BIGINT AS lost FROM judged GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    n_failed_lines, lost FROM w LEFT JOIN cov USING (rid) JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_failed_lines,
  CASE WHEN word_chars > 0 THEN lost * 100 // word_chars ELSE 0 END::BIGINT AS lost_percent,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost * 100 <= word_chars * 50) AS kept
FROM m
"""

_OP1 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>((?s).*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x:
    trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'),
      '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""

_OP4 = r"""
WITH u AS (SELECT page_id, url, position('://' IN url) AS p0 FROM pages),
h AS (SELECT page_id, url, CASE WHEN p0 > 0 THEN translate(regexp_extract(substr(url, p0 + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN p0 > 0 THEN regexp_extract(substr(url, p0 + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
  CASE WHEN p0 > 0 THEN regexp_extract(substr(url, p0 + 3), '^[^/?#]*[^?#]*\?([^#]*)', 1) END AS query FROM u),
c AS (SELECT page_id, url, host, path, list_sort(list_filter(string_split(query, '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS q FROM h),
k AS (SELECT page_id, url, host, path, CASE WHEN q IS NOT NULL THEN
    regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/index\.html?$', ''), '/+$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canon FROM c),
listed AS (SELECT DISTINCT canon FROM k WHERE canon IS NOT NULL AND len(list_intersect(string_split(host, '.'), [@LABELS@])) > 0),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(decision, h, p)),
best AS (SELECT page_id, url, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(decision, length(r.h || r.p)) AS decision
  FROM (SELECT DISTINCT page_id, url, host, path FROM k) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT k.page_id, host, path, rule, l.canon IS NOT NULL AS listed,
  coalesce(decision, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN best ON k.page_id IS NOT DISTINCT FROM best.page_id AND k.url IS NOT DISTINCT FROM best.url LEFT JOIN listed l ON k.canon = l.canon
"""

_OP6 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

_OP7 = r"""
WITH t AS (SELECT * FROM (VALUES @TEMPLATES@) x(template, licence, text)),
f AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(9) || chr(13), '  ') AS text,
    source || '/' || (doc_id // 1000) || CASE WHEN doc_id % 50 = 0 THEN '/LICENSE' ELSE '/' || (doc_id % 100 // 10) || '/' || doc_id || '.txt' END AS path FROM documents),
g AS (SELECT rid, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
    CASE WHEN regexp_matches(text, '@CUE@') THEN list_transform(string_split(text, chr(10)), lambda x: trim(x)) END AS raw FROM f),
g1 AS (SELECT *, list_transform(raw, lambda x: trim(regexp_replace(regexp_replace(x, '@COMMENT@', ''), '@COMMENT_END@', ''))) AS bare FROM g WHERE raw IS NOT NULL),
g2 AS (SELECT *, list_filter(list_transform(string_split_regex(array_to_string(bare, chr(10)), '\n\n+'), lambda b: replace(b, chr(10), ' ')), lambda b: regexp_matches(b, '@CUE@')) AS blocks,
    coalesce(list_position(list_transform(raw, lambda x: x <> '' AND NOT regexp_matches(x, '@COMMENT@')), true), 0) AS code,
    CASE WHEN regexp_matches(ltrim(array_to_string(raw, ' ')), '^(?:/\*|<!--)')
      THEN coalesce(list_position(list_transform(raw, lambda x: contains(x, '*/') OR contains(x, '-->')), true), 0) ELSE 0 END AS closed FROM g1),
g3 AS (SELECT *, array_to_string(list_filter(CASE WHEN ends_with(path, '/LICENSE') THEN bare
      ELSE bare[1:greatest(CASE WHEN code > 0 THEN code - 1 ELSE len(bare) END, closed)] END, lambda x: x <> ''), ' ') AS whole,
    list_filter(list_concat(bare, flatten(list_transform(blocks, lambda b: string_split(regexp_replace(b, '@SENTENCE_END@', '\1' || chr(10), 'g'), chr(10))))), lambda x: regexp_matches(x, '@CUE@')) AS parts FROM g2),
h AS (SELECT rid, path, dir, true AS part, unnest(list_distinct(list_concat(parts, blocks))) AS statement FROM g3
  UNION ALL SELECT rid, path, dir, false, whole FROM g3 WHERE regexp_matches(whole, '@CUE@')),
st AS (SELECT DISTINCT statement FROM h),
sw AS (SELECT statement, unnest(list_filter(regexp_split_to_array(lower(statement), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM st),
sc AS (SELECT statement, term, count(*) AS tf FROM sw GROUP BY ALL),
tw AS (SELECT template, licence, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM t),
tc AS (SELECT template, licence, term, count(*) AS tf FROM tw GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM st) + (SELECT count(*) FROM t) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0 AS idf
  FROM (SELECT term FROM sc UNION ALL SELECT term FROM tc) GROUP BY term),
sv AS (SELECT statement, term, tf * idf AS w FROM sc JOIN idf USING (term)),
tv AS (SELECT template, licence, term, tf * idf AS v FROM tc JOIN idf USING (term)),
c AS (SELECT statement, licence, round(sum(w * v) / (any_value(sn) * any_value(tn)), 6) AS cosine FROM sv JOIN tv USING (term)
  JOIN (SELECT statement, sqrt(sum(w * w)) AS sn FROM sv GROUP BY 1) USING (statement)
  JOIN (SELECT template, sqrt(sum(v * v)) AS tn FROM tv GROUP BY 1) USING (template) GROUP BY statement, template, licence),
b AS (SELECT statement, licence, cosine FROM c WHERE cosine >= 0.6 QUALIFY row_number() OVER (PARTITION BY statement ORDER BY licence = 'Proprietary', cosine DESC, licence) = 1),
own AS (SELECT rid, licence, cosine FROM h JOIN b USING (statement) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY licence = 'Proprietary', part, cosine DESC, licence) = 1),
od AS (SELECT dir, licence, cosine FROM h JOIN b USING (statement) WHERE ends_with(path, '/LICENSE') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY licence = 'Proprietary', part, cosine DESC, licence) = 1),
inh AS (SELECT rid, od.dir, od.licence, od.cosine FROM g JOIN od ON g.dir = od.dir OR starts_with(g.dir, od.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(od.dir) DESC) = 1)
SELECT doc_id, path, coalesce(own.licence, inh.licence) AS licence, coalesce(own.cosine, inh.cosine) AS cosine,
  CASE WHEN own.rid IS NOT NULL THEN 'own' WHEN inh.rid IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.rid IS NULL THEN inh.dir END AS licence_dir
FROM g LEFT JOIN own USING (rid) LEFT JOIN inh USING (rid)
"""

_OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS s, md5(':' || coalesce(doc_id::VARCHAR, '')) AS code FROM documents),
x AS (SELECT s, count(*) AS cnt, floor(sqrt(count(*)) * 1000)::BIGINT AS x FROM d GROUP BY s),
y AS (SELECT *, greatest(240, count(*) OVER ()) - count(*) OVER () AS free, sum(x) OVER ()::BIGINT AS sx FROM x),
z AS (SELECT *, free * x // sx AS q, free * x % sx AS rem FROM y),
v AS (SELECT s, cnt, (1 + q + CASE WHEN row_number() OVER (ORDER BY rem DESC, s) <= free - sum(q) OVER () THEN 1 ELSE 0 END)::BIGINT AS n FROM z),
o AS (SELECT list(s ORDER BY s) AS ss, list(n ORDER BY s) AS ns, sum(n)::BIGINT AS total FROM v),
st AS (SELECT -1::BIGINT AS t, list_transform(ns, lambda a: 0::BIGINT) AS done, 0::BIGINT AS pick, 0::BIGINT AS k FROM o
  UNION ALL
  SELECT t + 1, list_transform(done, lambda c, i: c + CASE WHEN i = best THEN 1 ELSE 0 END), best, done[best]
  FROM (SELECT st.t, st.done, list_position(due, list_min(due)) AS best FROM (SELECT st.t, st.done,
      list_transform(range(1, len(ns) + 1), lambda i: CASE WHEN st.done[i] < ns[i] AND st.done[i] * total // ns[i] <= st.t + 1
        THEN ((st.done[i] + 1) * total + ns[i] - 1) // ns[i] END) AS due FROM st, o WHERE st.t + 1 < total) st)),
plan AS (SELECT ss[pick] AS s, k, k * total // ns[pick] AS release, ((k + 1) * total + ns[pick] - 1) // ns[pick] AS deadline, t AS slot FROM st, o WHERE t >= 0),
num AS (SELECT d.doc_id, d.source, d.s, n, (row_number() OVER (PARTITION BY d.s ORDER BY code, doc_id) - 1)::BIGINT AS seq FROM d JOIN v USING (s)),
out AS (SELECT n, ((cnt + 15) // 16) // n * total + slot AS t FROM v JOIN plan USING (s), o WHERE k = ((cnt + 15) // 16) % n),
dry AS (SELECT min(t) AS t FROM (SELECT t, sum(n) OVER (ORDER BY t) AS gone FROM out), o WHERE gone * 2 >= total)
SELECT doc_id, source, seq, seq // 16 AS block, seq // 16 // n * total + release AS release, seq // 16 // n * total + deadline AS deadline,
  seq // 16 // n * total + slot AS slot, (seq // 16 // n * total + slot) < dry.t AS in_mix
FROM num JOIN plan ON plan.s = num.s AND plan.k = seq // 16 % n, o, dry
"""

# The table of CRC-32 and the checksum of the bytes in column `bytes`.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab"
_CRC = "xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)]), 4294967295), 4294967295)"
_BYTES = "list_transform(regexp_extract_all(hex(encode(@)), '..'), lambda h: ('0x' || h)::BIGINT)"

_OP11 = r"""
WITH RECURSIVE k AS (@TABLE@),
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT rid, doc_id, @BYTES@ AS bytes FROM t),
c AS (SELECT rid, doc_id, len(bytes)::BIGINT + 1 AS size, @CRC@ AS text_crc32 FROM b, k),
v AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32), 1, 15))::BIGINT % 4096)::INTEGER AS virtual_slot FROM c),
w AS (SELECT s::INTEGER AS virtual_slot, (s % 8)::INTEGER AS old, coalesce(sum(size), 0)::BIGINT AS bytes, count(rid) AS n_rows
  FROM range(4096) r(s) LEFT JOIN v ON v.virtual_slot = s GROUP BY s),
hv AS (SELECT bytes, row_number() OVER (ORDER BY bytes DESC) AS i, sum(bytes) OVER (ORDER BY bytes DESC ROWS UNBOUNDED PRECEDING) - bytes AS prior, sum(bytes) OVER () AS total FROM w),
fair AS (SELECT (total - prior) // greatest(9 - i, 1) AS share FROM hv WHERE i = 8 OR (i < 8 AND bytes * (9 - i) < total - prior) ORDER BY i LIMIT 1),
h AS (SELECT w.*, fair.share, sum(bytes) OVER (PARTITION BY old ORDER BY bytes DESC, virtual_slot ROWS UNBOUNDED PRECEDING) AS held,
  row_number() OVER (PARTITION BY old ORDER BY bytes DESC, virtual_slot) AS nth FROM w, fair),
p AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS turn FROM h WHERE held > share AND nth > 1 AND bytes > 0),
s AS (SELECT 0::BIGINT AS turn, NULL::INTEGER AS virtual_slot, NULL::INTEGER AS shard,
    (SELECT list(x ORDER BY o) FROM (SELECT o, coalesce(sum(bytes), 0)::BIGINT AS x FROM range(8) q(o) LEFT JOIN h ON old = o AND (held <= share OR nth = 1) GROUP BY o)) AS loads
  UNION ALL
  SELECT p.turn, p.virtual_slot, list_position(loads, list_min(loads)) - 1,
    list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN p.bytes ELSE 0 END)
  FROM s JOIN p ON p.turn = s.turn + 1),
m AS (SELECT h.virtual_slot, coalesce(s.shard, h.old) AS shard, h.n_rows FROM h LEFT JOIN s ON s.virtual_slot = h.virtual_slot),
st AS (SELECT *, coalesce(sum(n_rows) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM m)
SELECT doc_id, size, text_crc32, 'bytes' AS law, st.shard,
  (start + row_number() OVER (PARTITION BY v.virtual_slot ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, v.virtual_slot
FROM v JOIN st ON v.virtual_slot = st.virtual_slot
"""

_EDIT = "lpad((substr({v}, 1, 9)::INTEGER + {c})::VARCHAR, 9, '0') || substr({v}, 10) || '{i}'"


def _edit(value: str, cost: str, initial: str) -> str:
    return "(" + _EDIT.format(v=value, c=cost, i=initial) + ")"


def _op12() -> str:
    """Lightest values per state as text: nine digits of cost, then the audit; the least text is the lightest."""
    inserted = f"""least(b2, {_edit("b0", "5", "I")}, {_edit("b1", "5", "I")}, {_edit("b3", "5", "I")}) AS i2"""
    into = lambda initial: "least(" + ", ".join(
        f"CASE WHEN kind = '{initial}' THEN {_edit(v, 'extra', 'K')} ELSE {_edit(v, 'extra + 1', 'R')} END" for v in (("i0", "i1", "j3") if initial == "u" else ("i2",))
    ) + ")"
    return rf"""
WITH RECURSIVE k AS ({_CRC_TABLE}),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_BYTES.replace("@", "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} AS bytes FROM conversations),
h AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS d FROM c, k),
x AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE d <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM x),
f AS (SELECT conv_id, turn, role, text, pos, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
  lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS next FROM p),
g AS (SELECT *, CASE WHEN blank OR again THEN 'd' ELSE initial END AS kind, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM f),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
  count(*) FILTER (initial || next NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
r AS (SELECT conv_id, 0::BIGINT AS seen, '000000000' AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, NULL::VARCHAR AS b3 FROM sums
  UNION ALL
  SELECT conv_id, pos, {_edit("i0", "2", "D")},
    least({_edit("i1", "2", "D")}, CASE WHEN kind = 's' THEN {_edit("i0", "extra", "K")} END),
    least({_edit("i2", "2", "D")}, CASE WHEN kind <> 'd' THEN {into("u")} END),
    least({_edit("j3", "2", "D")}, CASE WHEN kind <> 'd' THEN {into("a")} END)
  FROM (SELECT r.conv_id, g.pos, g.kind, g.extra, b0 AS i0, b1 AS i1, {inserted}, least(b3, {_edit("i2", "5", "I")}) AS j3
    FROM r JOIN g ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND g.pos = r.seen + 1)),
e AS (SELECT sums.*, least(b0, b3, {_edit("i2", "5", "I")}) AS best
  FROM (SELECT *, {inserted} FROM r) r JOIN sums ON r.conv_id IS NOT DISTINCT FROM sums.conv_id AND seen = n),
a AS (SELECT *, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM e),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS j FROM a WHERE audit <> ''),
o AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS row_no, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS nth FROM l),
q AS (SELECT o.*, g.role, g.text, g.initial, max(CASE WHEN edit = 'K' AND nth = 1 AND g.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id) AS led
  FROM o LEFT JOIN g ON o.conv_id IS NOT DISTINCT FROM g.conv_id AND o.row_no = g.pos AND edit <> 'I'),
z AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha
  FROM q WHERE edit <> 'D' GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN a ON o.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON o.conv_id IS NOT DISTINCT FROM z.conv_id
"""


_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(ws) < 200)::INTEGER + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INTEGER
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
    + 16 * coalesce(w.doc_id > first, false)::INTEGER AS fails FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
  list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::INTEGER, 1)) - 65))) AS sofar
  FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (fails & (coalesce(sofar, 0)::INTEGER | bit) = 0) AS kept,
  sum(n) FILTER (fails & coalesce(sofar, 0)::INTEGER = 0 AND fails & bit > 0) AS removed, sum(n) FILTER (fails & coalesce(sofar, 0)::INTEGER > 0 AND fails & bit > 0) AS redundant,
  sum(n) FILTER (fails = bit) AS unique_fails, sum(good) FILTER (fails & coalesce(sofar, 0)::INTEGER = 0 AND fails & bit > 0) AS good_lost,
  sum(toxic) FILTER (fails & coalesce(sofar, 0)::INTEGER = 0 AND fails & bit > 0) AS toxic_lost FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""


def _filled() -> dict[str, str]:
    from chronoweave.llm import licenses, quality
    from chronoweave.llm.queries import LISTED_LABELS

    templates = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    return {
        "op1_html_extraction": _OP1,
        "op4_url_filters": _OP4.replace("@LABELS@", ", ".join(f"'{x}'" for x in LISTED_LABELS)),
        "op6_exact_top_k": _OP6,
        "op7_license_scan": _OP7.replace("@CUE@", licenses.CUE).replace("@COMMENT@", licenses.COMMENT).replace("@COMMENT_END@", licenses.COMMENT_END)
        .replace("@SENTENCE_END@", licenses.SENTENCE_END).replace("@TEMPLATES@", templates),
        "op9_mix_sources": _OP9,
        "op11_sharding": _OP11.replace("@TABLE@", _CRC_TABLE).replace("@BYTES@", _BYTES.replace("@", "text")).replace("@CRC@", _CRC),
        "op12_conversation_repair": _op12(),
        "op13_filter_audit": _OP13,
        "op5_quality_rules": _OP5.replace("@BOILERPLATE@", "|".join(quality.BOILERPLATE)),
    }


ORACLE = _filled()
