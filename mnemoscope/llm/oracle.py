"""DuckDB SQL for the queries that SQL can express.

Left out, and tested against brute force or held-out labels instead: op2 (an
expression parser), op3 and op7 (fitted models) and op4 (hashed weights).
"""

from __future__ import annotations

from .mixing import MAX_EPOCHS
from .quality_rules import MIN_GROUP, MIN_WORDS, SPREAD, SUB_BITS, TAIL
from .secret_scan import RULES
from .spelling import LENGTH, LETTERS, NOISE, OCCURRENCES, TIMES

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format('text')} AS words FROM documents),
grams AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, w.lang, w.source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, lines.lines AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id),
r AS (SELECT *, CASE WHEN n_words >= {MIN_WORDS} THEN [n_symbols * 1000000 // word_chars, n_repeat_words * 1000000 // n_words, n_dup_lines * 1000000 // n_lines, word_chars * 1000000 // n_words] END AS v FROM c),
e AS (SELECT lang, source, unnest(['symbols', 'repeats', 'dup_lines', 'word_length']) AS rule, unnest(v) AS v FROM r WHERE v IS NOT NULL),
b AS (SELECT lang, source, rule, (v >> s) << s AS bucket FROM (SELECT *, greatest(length(bin(v)) - {SUB_BITS + 1}, 0)::INTEGER AS s FROM e)),
k AS (SELECT lang, source, 0 AS level, rule, bucket FROM b UNION ALL SELECT lang, NULL, 1, rule, bucket FROM b UNION ALL SELECT NULL, NULL, 2, rule, bucket FROM b),
h AS (SELECT lang, source, level, rule, bucket, count(*) AS n FROM k GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, level, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, level, rule) AS total FROM h),
q AS (SELECT lang, source, level, rule, max(total) AS total, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3,
    min(bucket) FILTER (upto * 100 >= total * (100 - {TAIL})) AS lo, min(bucket) FILTER (upto * 100 >= total * {TAIL}) AS hi FROM u GROUP BY ALL),
p AS (SELECT a.lang, a.source, a.rule, CASE WHEN a.total >= {MIN_GROUP} THEN a.q1 WHEN l.total >= {MIN_GROUP} THEN l.q1 ELSE g.q1 END AS q1,
    CASE WHEN a.total >= {MIN_GROUP} THEN a.q3 WHEN l.total >= {MIN_GROUP} THEN l.q3 ELSE g.q3 END AS q3,
    CASE WHEN a.total >= {MIN_GROUP} THEN a.lo WHEN l.total >= {MIN_GROUP} THEN l.lo ELSE g.lo END AS lo,
    CASE WHEN a.total >= {MIN_GROUP} THEN a.hi WHEN l.total >= {MIN_GROUP} THEN l.hi ELSE g.hi END AS hi
    FROM q a JOIN q l ON l.level = 1 AND l.rule = a.rule AND l.lang IS NOT DISTINCT FROM a.lang JOIN q g ON g.level = 2 AND g.rule = a.rule WHERE a.level = 0),
t AS (SELECT lang, source, rule, CASE WHEN q3 > q1 THEN q1 - {SPREAD} * (q3 - q1) ELSE lo END AS low, CASE WHEN q3 > q1 THEN q3 + {SPREAD} * (q3 - q1) ELSE hi + (1::BIGINT << greatest(length(bin(hi)) - {SUB_BITS + 1}, 0)::INTEGER) - 1 END AS high FROM p),
j AS (SELECT r.doc_id, string_agg(x.rule, ',' ORDER BY x.i) AS failed FROM r, LATERAL (SELECT unnest(['symbols', 'repeats', 'dup_lines', 'word_length']) AS rule, unnest(r.v) AS v, unnest([1, 2, 3, 4]) AS i) x
    JOIN t ON t.rule = x.rule AND t.lang IS NOT DISTINCT FROM r.lang AND t.source IS NOT DISTINCT FROM r.source WHERE x.v > t.high OR (x.rule = 'word_length' AND x.v < t.low) GROUP BY r.doc_id),
f AS (SELECT r.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(j.failed, '') AS failed FROM r LEFT JOIN j ON j.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM f
"""

_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || d[i:i])::INTEGER), 4, '0')), '') AS bits FROM m)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[i * 5 + 1:i * 5 + 1]::INTEGER + 8 * bits[i * 5 + 2:i * 5 + 2]::INTEGER + 4 * bits[i * 5 + 3:i * 5 + 3]::INTEGER + 2 * bits[i * 5 + 4:i * 5 + 4]::INTEGER + bits[i * 5 + 5:i * 5 + 5]::INTEGER, 1)), '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""


def _plain(pattern: str) -> str:
    """The pattern without inline flags, which mean more than ASCII in other engines."""
    if "(?i:" not in pattern:
        return pattern
    head, rest = pattern.split("(?i:", 1)
    body, tail = rest.split(")", 1)
    return head + "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in body) + ")" + tail


#: The two rules that need possessive repeats or a look ahead, without them.  A base64 run at the end of its line is
#: followed by the mark that ``marked`` puts there; marks don't count in positions.
_MARK = "\uf8ff"
_SPACE, _KEY = rf"(?:[\x20\x09-\x0D{_MARK}]|\\[nr])+", "-----{0} [A-Z ]{{0,20}}PRIVATE KEY-----"
_WITHOUT_LOOK = {
    "private_key": f"{_KEY.format('BEGIN')}(?:(?:-{{0,4}}[^-])*{_KEY.format('END')}|(?:{_SPACE}(?:(?:Proc-Type|DEK-Info):[^\\r\\n]*|[A-Za-z0-9+/=]{{16,}}|[A-Za-z0-9+/=]+{_MARK}))*)",
    "url_login": r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@",
}


def _rule_sql(r, rank: int) -> str:
    p = _WITHOUT_LOOK.get(r.name) or _plain(r.pattern)
    if r.group:  # one group, for the secret
        p = p.replace("((", "(", 1).replace("))", ")", 1)
    p = p.replace("'", "''")
    gaps = p.replace("([", "(?:[") if r.group else p
    text = "marked" if r.name == "private_key" else "text"
    return f"""SELECT doc_id, '{r.name}' AS rule, {rank} AS rank, {r.least} AS least, regexp_split_to_array({text}, '{gaps}') AS gaps, regexp_extract_all({text}, '{p}', 0) AS found, regexp_extract_all({text}, '{p}', {r.group}) AS secret FROM d"""


_OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '([A-Za-z0-9+/=])([\x20\x09]*(?:[\r\n]|\\[nr]|$))', '\1{_MARK}\2', 'g') AS marked FROM documents), m AS ({' UNION ALL '.join(_rule_sql(r, i) for i, r in enumerate(RULES))}),
e AS (SELECT doc_id, rule, rank, least, unnest(range(1, len(found) + 1)) AS i, replace(unnest(found), '{_MARK}', '') AS f, unnest(secret) AS s, replace(unnest(gaps[1:len(found)]), '{_MARK}', '') AS g FROM m WHERE len(found) > 0),
x AS (SELECT *, sum(length(g) + length(f)) OVER (PARTITION BY doc_id, rule ORDER BY i) AS stop FROM e),
y AS (SELECT doc_id, rule, rank, stop - length(f) AS start, rule || ':' || (stop - length(f)) || ':' || stop AS span FROM x WHERE length(s) >= least),
z AS (SELECT doc_id, count(*) FILTER (rule = 'assign') AS n_assign, count(*) FILTER (rule = 'access') AS n_access, count(*) FILTER (rule = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN z ON z.doc_id = d.doc_id
"""

_OP8 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format('text')})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
l AS (SELECT *, source_size * {MAX_EPOCHS}.0::DOUBLE AS lim FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM l WINDOW o AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(struct_pack(r := lim / weight, level := level)) AS x FROM v WHERE lim >= level * weight),
t AS (SELECT source, source_size, CASE WHEN x IS NULL OR lim < x.level * weight THEN lim ELSE x.level * weight END AS target FROM v CROSS JOIN f),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, (epoch * source_size + upto) / target AS finish FROM (SELECT q.*, unnest(range({MAX_EPOCHS})) AS epoch FROM q WHERE size > 0 AND target > 0)),
k AS (SELECT doc_id, size, key, upto, source, sum(size) OVER (ORDER BY finish, source NULLS LAST ROWS UNBOUNDED PRECEDING) <= (SELECT sum(source_size) FROM s) AS fits FROM e),
n AS (SELECT source, upto, sum(size) FILTER (fits) AS taken FROM k GROUP BY source, upto)
SELECT q.doc_id, q.size, q.source_size, q.target, CASE WHEN q.size > 0 THEN coalesce(n.taken, 0) ELSE 0 END::BIGINT AS taken FROM q LEFT JOIN n ON n.source IS NOT DISTINCT FROM q.source AND n.upto = q.upto
"""

_OP9 = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS words FROM documents), r AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS k FROM r), twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM g) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM twice) GROUP BY doc_id),
each AS (SELECT w.doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w), dead AS (SELECT doc_id, unnest(ps) AS p, true AS hit FROM gone),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) FILTER (hit IS NULL) AS body, count(hit) AS n FROM each e LEFT JOIN dead ON dead.doc_id = e.doc_id AND dead.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_FOLDED = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10 = rf"""
WITH i AS (SELECT item_id, {_FOLDED.format('text')} AS words FROM benchmark), ig AS (SELECT DISTINCT item_id, array_to_string(words[k:k + 4], ' ') AS g FROM (SELECT item_id, words, unnest(range(1, len(words) - 3)) AS k FROM i WHERE len(words) >= 5)),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1), d AS (SELECT doc_id, {_FOLDED.format('text')} AS words FROM documents),
dg AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM d WHERE len(words) >= 5)),
s AS (SELECT item_id, ' ' || array_to_string(words, ' ') || ' ' AS run FROM i WHERE len(words) BETWEEN 1 AND 4)
SELECT doc_id, item_id, n::INTEGER AS n_shingles, count(*)::INTEGER AS n_found, count(*)::DOUBLE / n AS containment FROM ig JOIN dg USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0 FROM d JOIN s ON contains(' ' || array_to_string(d.words, ' ') || ' ', run)
"""

#: CRC-32 of text up to U+07FF, byte by byte and bit by bit.
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split({0}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192::BIGINT + unicode(ch) // 64, 128::BIGINT + unicode(ch) % 64] END)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384)), 4294967295::BIGINT), 4294967295::BIGINT)"""

_OP12 = f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]{{{LENGTH},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT doc, run, count(*) AS n FROM r GROUP BY ALL), h AS (SELECT run, n, {_CRC32.format("doc || ':' || run")} AS h FROM k),
e AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
d AS (SELECT word, left(word, i - 1) || '_' || substr(word, i + 1) AS gap, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.gap = b.gap AND a.word <> b.word UNION SELECT d.word, w.word FROM d JOIN w ON d.less = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.less = w.word),
b AS (SELECT p.word, count(*)::BIGINT AS n_near, arg_min(struct_pack(n := w.n, word := p.other), struct_pack(n := -w.n, word := p.other)) AS best FROM p JOIN w ON w.word = p.other GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= {TIMES} * w.n THEN best.word END AS form, CASE WHEN best.n >= {TIMES} * w.n THEN best.n END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
t AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(t.root, t.step) AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word GROUP BY ALL
"""

_OP11 = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i, k, size FROM (
    SELECT conv_id, turn, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS k, length(coalesce(text, ''))::BIGINT AS size FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {_CRC32.format('conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, i, k, size FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND i <= h UNION ALL SELECT c.conv_id, 1, i, k, size FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
p AS (SELECT conv_id, row_number() OVER o AS d, md5(string_agg(k, '') OVER o) AS prefix, size FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM p GROUP BY d, prefix),
e AS (SELECT d, prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS top FROM p) WHERE d = top GROUP BY d, prefix),
u AS (SELECT n.*, q.prefix AS above FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
k AS (SELECT d - 1 AS d, above AS prefix, count(*) AS n FROM u WHERE d > 0 GROUP BY ALL),
s AS (SELECT a.d, a.prefix, sum((u.n_convs - 1) * u.size)::BIGINT AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM u LEFT JOIN k USING (d, prefix) JOIN p a ON a.conv_id = u.conv_id AND a.d <= u.d GROUP BY a.d, a.prefix)
SELECT u.conv_id, u.d AS depth, v.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM u LEFT JOIN u v ON v.d = u.d - 1 AND v.prefix = u.above LEFT JOIN k ON k.d = u.d AND k.prefix = u.prefix LEFT JOIN e ON e.d = u.d AND e.prefix = u.prefix JOIN s ON s.d = u.d AND s.prefix = u.prefix
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _OP1, "op5_warc_zip": _OP5, "op6_secret_scan": _OP6, "op8_mixing": _OP8, "op9_substring_dedup": _OP9, "op10_decontaminate": _OP10, "op11_prefix_trie": _OP11, "op12_spelling_variants": _OP12}
