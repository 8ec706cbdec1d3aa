"""The registered queries' results in DuckDB's SQL, where SQL can express them.

None for op3 and op8 (trained models), op4 (token ids of a vocabulary file), op12
(runs of any period in any text), op6 (its rule for private keys needs a reference back to a group, which DuckDB's
patterns don't have) and pipeline (stages of these): tests hold them against
brute force, round trips or held-out labels.
"""

from __future__ import annotations

from . import chat, decontaminate, licenses, neardup, quality, sharding

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(col: str) -> str:
    return f"translate(coalesce({col}, ''), '{UPPER}', '{LOWER}')"


def words(col: str) -> str:
    return rf"regexp_extract_all({fold(col)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_NOTICES = [(phrase, label, licenses.edits_allowed(phrase), phrase.count(" ") + 1, int((phrase, label) in licenses.BASE)) for phrase, label in licenses.NOTICES]
_PIECES = [(phrase, piece) for phrase, _, _, pieces, _ in licenses.NoticeFinder().notices for piece, _ in pieces]
_OTHERS = ", ".join(f"'{x}'" for x in sorted(licenses.OTHERS))

# all spans of whole words near a notice's length are compared, in texts that hold a piece of it
OP1 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w, array_to_string({words('text')}, ' ') AS line FROM documents),
n(phrase, label, edits, size, base) AS (VALUES {_values(_NOTICES)}),
p(phrase, piece) AS (VALUES {_values(_PIECES)}),
c AS MATERIALIZED (SELECT DISTINCT r, phrase FROM d JOIN p ON contains(line, piece)),
k AS (SELECT r, w, n.*, unnest(range(1, len(w) + 1)) AS a FROM c JOIN d USING (r) JOIN n USING (phrase)),
z AS (SELECT *, unnest(range(greatest(size - edits, 1), size + edits + 1)) AS m FROM k),
s AS (SELECT r, phrase, label, edits, size, base, a, m, array_to_string(w[a:a + m - 1], ' ') AS span FROM z WHERE a + m - 1 <= len(w)),
e AS (SELECT *, levenshtein(span, phrase) AS d FROM s WHERE abs(length(span) - length(phrase)) <= edits),
f AS (SELECT * FROM e WHERE d = 0 OR d <= edits AND span NOT IN ({_OTHERS})
        AND list_filter(string_split(span, ' '), lambda x: regexp_matches(x, '[0-9]')) = list_filter(string_split(phrase, ' '), lambda x: regexp_matches(x, '[0-9]'))),
g AS (SELECT r, count(*) FILTER (d = 0 AND base = 1) AS n_base, min(a - 1) FILTER (d = 0 AND base = 1) AS first_word, max(a - 1) FILTER (d = 0 AND base = 1) AS last_word,
        list_aggregate(list_sort(list_distinct(list(label) FILTER (d = 0 AND base = 1))), 'string_agg', ',') AS base_labels,
        list_aggregate(list_sort(list_distinct(list(label))), 'string_agg', ',') AS labels, max(1 - d / length(phrase)) AS score FROM f GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (r)
"""

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
b AS (SELECT item_id, {words('text')} AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS pattern
      FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
sizes AS (SELECT DISTINCT n FROM p),
spot AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS pattern
         FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, spot.n, k, item_id FROM spot JOIN p ON p.n = spot.n AND p.pattern = spot.pattern),
covered AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS pos FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

# every pair of documents that share a shingle is compared; then the closure of the links
OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({fold('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {neardup.SHINGLE} THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[k:k + {neardup.SHINGLE} - 1], ' ') FOR k IN range(1, len(w) - {neardup.SHINGLE} + 2)]) END AS s FROM d),
e AS (SELECT r, len(s) AS n, unnest(s) AS x FROM s WHERE doc_id IS NOT NULL),
shared AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n
         FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r AND 100 * least(a.n, b.n) >= {neardup.THRESHOLD} * greatest(a.n, b.n) GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * n >= {neardup.THRESHOLD} * (na + nb - n)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS r, min(doc_id) AS low FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM s LEFT JOIN low USING (r)
"""


def escaped(col: str) -> str:
    for plain, code in chat.ESCAPES:
        col = f"replace({col}, '{plain}', '{code}')"
    return col


_MARKS = len(chat.OPEN + chat.MID + chat.CLOSE)
_BACK = range(1, chat.HISTORY_TURNS + 1)


def _again(k: int) -> str:
    """Whether the k turns before turn i can be repeated in a window that begins with it."""
    total = " + ".join(f"b{j}" for j in range(1, k + 1))
    return f"WHEN i > {k} AND {total} + size <= room" + (f" AND {total} <= {chat.HISTORY}" if k > 1 else "") + f" THEN {k}"


# windows are opened turn by turn: used is what the open one holds, again how many turns before its first it repeats
OP10 = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord,
        {escaped('role')} AS r, {escaped('text')} AS x FROM c),
z AS (SELECT *, strlen(r) + strlen(x) + {_MARKS} AS size, length(r) + length(x) + {_MARKS} AS chars, ord = 1 AND role = 'system' AS system FROM o),
h AS (SELECT conv_id, coalesce(max(CASE WHEN system THEN size END), 0) AS head, coalesce(max(CASE WHEN system THEN chars END), 0) AS head_chars,
        {chat.BUDGET} - coalesce(max(CASE WHEN system THEN size END), 0) AS room FROM z GROUP BY conv_id),
t AS (SELECT z.conv_id, size, chars, room, row_number() OVER w AS i,
        {', '.join(f'coalesce(lag(size, {k}) OVER w, 0) AS b{k}, coalesce(lag(chars, {k}) OVER w, 0) AS c{k}' for k in _BACK)}
      FROM z JOIN h ON z.conv_id = h.conv_id WHERE NOT system WINDOW w AS (PARTITION BY z.conv_id ORDER BY ord)),
g AS (SELECT *, CASE {' '.join(_again(k) for k in reversed(_BACK))} ELSE 0 END AS fit FROM t),
gg AS (SELECT *, size{''.join(f' + CASE WHEN fit >= {k} THEN b{k} ELSE 0 END' for k in _BACK)} AS fresh,
        chars{''.join(f' + CASE WHEN fit >= {k} THEN c{k} ELSE 0 END' for k in _BACK)} AS fresh_chars FROM g),
walk AS (
  SELECT conv_id, i, fresh AS used, true AS opens FROM gg WHERE i = 1
  UNION ALL
  SELECT gg.conv_id, gg.i, CASE WHEN walk.used + gg.size > gg.room THEN gg.fresh ELSE walk.used + gg.size END, walk.used + gg.size > gg.room
  FROM walk JOIN gg ON gg.conv_id = walk.conv_id AND gg.i = walk.i + 1),
total AS (SELECT h.conv_id, greatest(count(*) FILTER (opens), 1) * any_value(head_chars) + coalesce(sum(CASE WHEN opens THEN fresh_chars ELSE chars END), 0) AS formatted_chars
          FROM h LEFT JOIN walk ON walk.conv_id = h.conv_id LEFT JOIN gg ON gg.conv_id = walk.conv_id AND gg.i = walk.i GROUP BY h.conv_id),
digest AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord) AS turns,
             coalesce(string_agg(text, '' ORDER BY ord) FILTER (role = 'assistant'), '') AS loss FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM digest JOIN total USING (conv_id)
"""

# shards are filled point by point: each step puts what fits of a point's rows into the next shard clockwise
OP5 = f"""
WITH RECURSIVE poly(k, c) AS (SELECT 0, list(i ORDER BY i) FROM range(256) t(i)
  UNION ALL SELECT k + 1, [CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FOR x IN c] FROM poly WHERE k < 8),
crc AS (SELECT c FROM poly WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT) % {sharding.POINTS} AS point,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {sharding.PARTS} AS part FROM documents),
e AS MATERIALIZED (SELECT r, doc_id, point, part, strlen(text) + 16 AS size,
    xor(list_reduce([CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(text)), '..')], lambda acc, b: xor(acc >> 8, c[(xor(acc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM d, crc),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY point ORDER BY part, doc_id, text_crc32, size) - 1 AS rank FROM e),
spots AS (SELECT s, v, CAST(CAST('0x' || substr(md5(s || '/' || v), 1, 16) AS UBIGINT) % {sharding.POINTS} AS BIGINT) AS spot FROM range({{count}}) a(s), range({sharding.VIRTUAL_NODES}) b(v)),
wheel AS MATERIALIZED (SELECT spot, s, row_number() OVER (ORDER BY spot, s) - 1 AS i FROM spots),
nodes AS (SELECT count(*) AS nodes FROM wheel),
points AS MATERIALIZED (SELECT point, count(*) AS n, row_number() OVER (ORDER BY point) AS j, (SELECT count(*) FROM wheel WHERE spot < point) AS first FROM d GROUP BY point),
total AS (SELECT count(*) AS total FROM d),
walk AS (
  SELECT 0::BIGINT AS j, 0::BIGINT AS point, 0::BIGINT AS low, 0::BIGINT AS n, 0::BIGINT AS i, 0::BIGINT AS shard, 0::BIGINT AS slot, 0::BIGINT AS take,
    [0::BIGINT FOR x IN range({{count}})] AS used
  UNION ALL
  SELECT j, point, low, n, i, shard, used[shard + 1], take, list_concat(used[1:shard], [used[shard + 1] + take], used[shard + 2:])
  FROM (SELECT j, point, low, n, y.i AS i, used, s AS shard, least(total // {{count}} + CAST(s < total % {{count}} AS BIGINT) - used[s + 1], n - low) AS take
        FROM (SELECT CASE WHEN w.low + w.take < w.n THEN w.j ELSE w.j + 1 END AS j, w.used, w.low + w.take < w.n AS same, w.low + w.take AS went, w.i + 1 AS next FROM walk w) x
        JOIN (SELECT j AS pj, point, n, first FROM points) p ON p.pj = x.j
        , LATERAL (SELECT CASE WHEN same THEN went ELSE 0 END AS low, CASE WHEN same THEN next ELSE first END AS i) y
        , nodes, total JOIN wheel ON wheel.i = y.i % nodes) z),
runs AS (SELECT point, low, shard, slot, take FROM walk WHERE take > 0)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, slot + rank - low AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM ranked JOIN runs ON ranked.point = runs.point AND rank >= low AND rank < low + take
""".replace("{count}", "40")

_K = quality.COMMON_WORDS
_JS = """CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum([
  (CASE WHEN {p}[i] > 0 THEN {p}[i] / list_sum({p}) * log2({p}[i] / list_sum({p}) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END
 + CASE WHEN {q}[i] > 0 THEN {q}[i] / list_sum({q}) * log2({q}[i] / list_sum({q}) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) ELSE 0 END) / 2
  FOR i IN range(1, len({p}) + 1)]), 0)) ELSE 0 END"""


def _limit(most: float, shape: tuple[float, float]) -> str:
    return f"{most} * least(1.0, sqrt({shape[0] ** 2} + {shape[1] ** 2} / greatest(n_words, 1)))"


OP9 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    regexp_extract_all(lower(coalesce(text, '')), '[a-z\x{{80}}-\x{{10FFFF}}]+') AS plain FROM documents),
counted AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(plain) AS x FROM d WHERE lang IS NOT NULL) GROUP BY ALL),
ranked AS (SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS k FROM counted),
top AS MATERIALIZED (SELECT * FROM ranked WHERE k <= {_K}),
hist AS (SELECT r, map_from_entries(list((k, n))) AS h FROM (SELECT r, k, count(*) AS n FROM (SELECT r, lang, unnest(plain) AS x FROM d) JOIN top USING (lang, x) GROUP BY r, k) GROUP BY r),
spelled AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
grams AS (SELECT r, k, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM spelled WINDOW o AS (PARTITION BY r ORDER BY k)),
twice AS (SELECT r, k FROM grams WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
again AS (SELECT r, count(DISTINCT k + j) AS n FROM twice, range(3) t(j) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS MATERIALIZED (SELECT d.r, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^.,;:!?''"()-]', '', 'g')) AS marks, length(text) AS chars,
    CASE WHEN lang IS NOT NULL THEN [coalesce(h[k], 0) FOR k IN range(1, {_K + 1})] END AS found, len(plain) AS total
  FROM d LEFT JOIN hist USING (r) LEFT JOIN again USING (r) LEFT JOIN lines USING (r)),
f AS MATERIALIZED (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [word_chars - n_symbols - upper - digits - marks, upper, digits, marks, n_symbols, chars - word_chars] AS classes, list_append(found, total - list_sum(found)) AS common FROM m),
summed AS (SELECT lang, i, sum(classes[i]) AS c FROM f, range(1, 7) t(i) WHERE NOT base_failed GROUP BY ALL),
refs AS (SELECT lang, list(c ORDER BY i) AS ref_classes FROM summed WHERE lang IS NOT NULL GROUP BY lang
  UNION ALL SELECT NULL, list(c ORDER BY i) FROM (SELECT i, sum(c) AS c FROM summed GROUP BY i)),
spoken AS (SELECT lang, list(c ORDER BY i) AS ref_common FROM (SELECT lang, i, sum(common[i]) AS c FROM f, range(1, {_K + 2}) t(i) WHERE NOT base_failed AND lang IS NOT NULL GROUP BY ALL) GROUP BY lang),
far AS (SELECT f.*, CASE WHEN ref_classes IS NULL THEN 0 ELSE {_JS.format(p='classes', q='ref_classes')} END AS class_distance,
    CASE WHEN common IS NULL OR ref_common IS NULL THEN 0 ELSE {_JS.format(p='common', q='ref_common')} END AS common_distance
  FROM f LEFT JOIN refs ON f.lang IS NOT DISTINCT FROM refs.lang LEFT JOIN spoken ON f.lang = spoken.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND class_distance <= {_limit(quality.MAX_CLASS, quality.CLASS_LIMIT)} AND common_distance <= {_limit(quality.MAX_COMMON, quality.COMMON_LIMIT)} AS kept
FROM far
"""

# each round compares all entries; rows are numbered, since ids can repeat
_NEAREST = """(SELECT r, part, any_value(y) AS y, min(d * 1000 + e) AS best FROM (
    SELECT r, p.part, y, e, list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN {book} b ON p.part = b.part) GROUP BY r, part)"""
_MEANS = """(SELECT b.part, b.e, coalesce(any_value(m), any_value(b.c)) AS c FROM {book} b LEFT JOIN (
    SELECT part, e, list(q ORDER BY i) AS m FROM (
      SELECT part, best % 1000 AS e, i, CAST(floor(sum(y[i]) / count(*)) AS BIGINT) AS q FROM {near}, range(1, (SELECT max(w) + 1 FROM v)) t(i) GROUP BY ALL) GROUP BY part, e) n
  ON b.part = n.part AND b.e = n.e GROUP BY b.part, b.e)"""

OP11 = f"""
WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 256) AS BIGINT)) AS q, len(embedding) // 16 AS w FROM k),
p AS MATERIALIZED (SELECT r, part, q[part * w + 1 : part * w + w] AS y FROM v, range(16) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, y AS c FROM p WHERE r <= 64),
a0 AS MATERIALIZED {_NEAREST.format(book='b0')},
b1 AS MATERIALIZED {_MEANS.format(book='b0', near='a0')},
a1 AS MATERIALIZED {_NEAREST.format(book='b1')},
b2 AS MATERIALIZED {_MEANS.format(book='b1', near='a1')},
a2 AS MATERIALIZED {_NEAREST.format(book='b2')},
o AS (SELECT r, string_agg(lower(printf('%02x', (best % 1000)::INTEGER)), '' ORDER BY part) AS code, sum(best // 1000)::BIGINT AS error FROM a2 GROUP BY r),
s AS (SELECT vec_id, label, code, error FROM v JOIN o USING (r))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256 FROM s
"""

# the given pages mark their article and use few references; each is decoded in turn, the ampersand last
OP13 = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""

ORACLES: dict[str, str] = {
    "op1_license_scan": OP1,
    "op2_decontaminate": OP2,
    "op5_shard": OP5,
    "op7_near_duplicates": OP7,
    "op9_quality": OP9,
    "op10_chat_format": OP10,
    "op11_vector_codes": OP11,
    "op13_main_text": OP13,
}
