"""DuckDB SQL of the queries that SQL can express on whole tables. Random
orders (op7), tokenizers (op2) and fingerprints (op4) are tested against
brute force instead."""

from __future__ import annotations

from shoptally.llm import chat, fill_in_middle, license_scan, line_dedup, ngram_join, quality_rules, secret_scan, vector_codes

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _line_dedup() -> str:
    m, near = line_dedup.MIN_CHARS, line_dedup.NEAR_CHARS
    return f"""
WITH lines AS (
  SELECT doc_id, no - 1 AS no, line, trim(line, {_BLANK}) AS bare FROM (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
firsts AS (SELECT bare, min((doc_id, no)) AS f, length(bare) AS n FROM lines WHERE length(bare) >= {m} GROUP BY bare),
long AS (SELECT * FROM firsts WHERE n >= {near}),
pairs AS (
  SELECT a.bare AS a, a.f AS fa, b.bare AS b, b.f AS fb, least(a.n, b.n) AS q FROM long a
  JOIN (SELECT *, unnest([n - 1, n, n + 1]) AS other FROM long) b ON a.n = b.other AND a.bare <> b.bare AND b.f < a.f),
near AS (
  SELECT DISTINCT a FROM pairs
  WHERE (left(a, q // 2) = left(b, q // 2) OR right(a, q - q // 2) = right(b, q - q // 2)) AND levenshtein(a, b) <= 1),
marked AS (
  SELECT l.*, f.f IS NOT NULL AND (l.doc_id, l.no) <> f.f AS equal,
         f.f IS NOT NULL AND (l.doc_id, l.no) = f.f AND l.bare IN (SELECT a FROM near) AS near
  FROM lines l LEFT JOIN firsts f USING (bare))
SELECT doc_id, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (equal) AS n_equal, count(*) FILTER (near) AS n_near,
       coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT equal AND NOT near), '') AS kept_text
FROM marked GROUP BY doc_id"""


_URLS = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS day,
         nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '') AS segment FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL),
seeded AS (SELECT host, (ascii(host) * 31 + ascii(right(host, 9)) * 7 + length(host) * 17)::INTEGER % 300 AS v,
                  array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS domain FROM hosts),
events AS (
  SELECT 'block' AS list, 'domain' AS kind, domain AS pattern, 'add' AS action, DATE '2024-01-01' + v AS day FROM seeded
  UNION ALL SELECT 'block', 'domain', domain, 'remove', DATE '2024-01-01' + (v + 40) FROM seeded
  UNION ALL SELECT 'block', 'prefix', host || '/de', 'add', DATE '2024-07-01' FROM seeded
  UNION ALL SELECT 'block', 'host', host, 'add', DATE '2024-02-01' FROM seeded WHERE contains(host, 'ads-')
  UNION ALL SELECT 'allow', 'host', host, 'add', DATE '2024-01-01' + (v + 10) FROM seeded WHERE starts_with(host, 'm.')
  UNION ALL SELECT 'allow', 'host', host, 'remove', DATE '2024-01-01' + (v + 20) FROM seeded WHERE starts_with(host, 'm.')),
days AS (SELECT list, kind, pattern, day, bool_and(action = 'add') AS state FROM events GROUP BY ALL),
asked AS (
  SELECT page_id, day, 'domain' AS kind, array_to_string(string_split(host, '.')[k:], '.') AS pattern
  FROM (SELECT *, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS k FROM captures WHERE host IS NOT NULL)
  UNION ALL SELECT page_id, day, 'host', host FROM captures WHERE host IS NOT NULL
  UNION ALL SELECT page_id, day, 'prefix', host || '/' || segment FROM captures WHERE segment IS NOT NULL),
state AS (  -- as of: the entry's last event day up to the fetch day
  SELECT a.page_id, a.kind, a.pattern, d.list, arg_max(d.state, d.day) AS active
  FROM asked a JOIN days d ON a.kind = d.kind AND a.pattern = d.pattern AND d.day <= a.day GROUP BY ALL),
met AS (
  SELECT page_id, (CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END, length(pattern), list = 'allow',
                   list || ':' || kind || ':' || pattern) AS e, list, list || ':' || kind || ':' || pattern AS name FROM state WHERE active)
SELECT c.page_id, c.url, c.host, c.day AS fetched_on, count(m.page_id) AS matches,
       coalesce(arg_max(m.list, m.e) = 'block', FALSE) AS blocked, arg_max(m.name, m.e) AS decided_by
FROM captures c LEFT JOIN met m USING (page_id) GROUP BY c.page_id, c.url, c.host, c.day"""


def _license_scan() -> str:
    notices = ", ".join(f"({k}, {_quote(t.license)}, {_quote(t.notice)})" for k, t in enumerate(license_scan.TEMPLATES))
    plain = r"string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    n = license_scan.N
    return f"""
WITH t AS (SELECT *, {plain.format('notice')} AS w, least({n}, len({plain.format('notice')})) AS n FROM (VALUES {notices}) v(template, license, notice)),
ts AS (SELECT DISTINCT template, license, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM t)),
tm AS (SELECT *, count(*) OVER (PARTITION BY template) AS m FROM ts),
d AS (SELECT doc_id, {plain.format('text')} AS w FROM documents),
ds AS (SELECT doc_id, n, i - 1 AS pos, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM t))),
hits AS (SELECT ds.doc_id, ds.pos, tm.* FROM ds JOIN tm ON ds.n = tm.n AND ds.s = tm.s),
placed AS (SELECT *, unnest([pos // m * m, pos // m * m - m]) AS win FROM hits),
wins AS (SELECT doc_id, license, template, n, m, win, count(DISTINCT s) AS got, min(pos) AS a, max(pos) AS z FROM placed WHERE win >= 0
         GROUP BY doc_id, license, template, n, m, win HAVING 100 * count(DISTINCT s) >= {license_scan.PERCENT} * m),
best AS (SELECT doc_id, license, min((-got / m, a, z + n, template)) AS e FROM wins GROUP BY doc_id, license)
SELECT doc_id, license, e[4] AS template, -e[1] AS containment, e[2]::INTEGER AS start_word, e[3]::INTEGER AS end_word FROM best"""


def _secret_scan() -> str:
    parts = []
    for order, r in enumerate(secret_scan.RULES):
        p = _quote(r.pattern)
        parts.append(f"""SELECT doc_id, {order} AS o, '{r.kind}' AS kind, m, v, g, i FROM (
  SELECT doc_id, m, v, g, unnest(generate_series(1, len(m))) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.value}) AS v, string_split_regex(t, {p}) AS g FROM texts
    WHERE regexp_matches(t, {p}))) WHERE length(v[i]) >= {r.least}""")
    kinds = ", ".join(f"count(s.o) FILTER (kind = '{k}') AS n_{k}" for k in secret_scan.BASE)
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE)
    name = "kind || ':' || a || ':' || (a + n)"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
s AS (SELECT doc_id, o, kind, length(m[i]) AS n, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM hits)
SELECT d.doc_id, {kinds}, sha256(coalesce(string_agg({name}, ',' ORDER BY a, o) FILTER (kind IN ({base})), '')) AS base_sha256,
       coalesce(string_agg({name}, ',' ORDER BY a, o), '') AS spans
FROM texts d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


def _quality_rules() -> str:
    q, w = quality_rules, quality_rules.WINDOW
    gram = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER p" for k in range(1, w))])
    rules = [*q.RULES, "any"]
    sums = ", ".join(f"count(*) FILTER (f_{r}) AS k_{r}" for r in rules)
    per = " UNION ALL ".join(f"SELECT source, n_docs, '{r}' AS rule, k_{r} AS failed FROM sums" for r in rules)
    fails = ", ".join(f"CASE WHEN f_{r} THEN '{r}' END" for r in q.RULES)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
grams AS (SELECT doc_id, i, {gram} AS g FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range({w}) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(ls, lambda l: trim(l, {_BLANK}) <> '') AS l FROM d),
m AS (SELECT doc_id, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS f_base, 10 * n_symbols > 3 * n_words AS f_symbols,
        2 * upper > word_chars AS f_capitals, 2 * n_dup_lines > n_lines AS f_dup_lines,
        word_chars > 15 * n_words OR word_chars < 2 * n_words AS f_word_length FROM m),
g AS (SELECT *, {' OR '.join(f'f_{r}' for r in q.RULES)} AS f_any FROM f),
sums AS (SELECT source, count(*) AS n_docs, {sums} FROM g GROUP BY source),
per AS ({per}),
prior AS (SELECT rule, sum(failed) / sum(n_docs) AS mean,
                 sum(n_docs * (failed / n_docs) * (failed / n_docs)) / sum(n_docs) - (sum(failed) / sum(n_docs)) ** 2 AS spread FROM per GROUP BY rule),
strong AS (SELECT rule, mean, CASE WHEN spread > 0 THEN greatest(1.0, least(1e4, mean * (1 - mean) / spread - 1)) ELSE 1e4 END AS s FROM prior),
rates AS (SELECT source, rule, (failed + mean * s) / (n_docs + s) AS rate FROM per JOIN strong USING (rule)),
verdicts AS (SELECT source, coalesce(list(rule) FILTER (rate > {q.MAX_RATE}), []) AS habits, bool_or(rule = 'any' AND rate > {q.BLOCK_RATE}) AS blocked
             FROM rates GROUP BY source),
out AS (SELECT g.*, habits, blocked, list_filter([{fails}], lambda x: x IS NOT NULL) AS fails FROM g JOIN verdicts v ON g.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed, coalesce(array_to_string(fails, ','), '') AS failed_rules,
       blocked AS host_blocked, NOT f_base AND NOT blocked AND NOT list_has_any(fails, habits) AS kept FROM out"""


def _chat() -> str:
    t, say = chat.TEMPLATE, "<|im_end|><|im_start|>assistant ok"
    steps = ", ".join(f"({_quote(a)}, {_quote(b)})" for a, bs in t.follows.items() for b in bs)
    loss, final = (", ".join(map(_quote, x)) for x in (t.loss_roles, t.final))
    escape = r"regexp_replace({0}, '<(\|+)', '<|\1', 'g')".format
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {_quote(say)}), (-1, 1, 'assistant', {_quote(say)})),
n AS (SELECT *, row_number() OVER p - 1 AS i, lag(role, 1, '') OVER p AS before, row_number() OVER q = 1 AS last
      FROM c WINDOW p AS (PARTITION BY conv_id ORDER BY turn, role, text), q AS (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC)),
m AS (SELECT *, (before, role) NOT IN (VALUES {steps}) AS bad FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role IN ({loss})), '')) AS loss_sha256,
       CAST(sum({len(t.start) + len(t.end) + 2} + length(replace({escape('role')}, chr(10), '<|n')) + length({escape('text')})) AS BIGINT) AS formatted_chars,
       NOT bool_or(bad) AND bool_or(last AND role IN ({final})) AS valid, CAST(min(i) FILTER (bad) AS INTEGER) AS bad_turn
FROM m GROUP BY conv_id"""


def _ngram_join() -> str:
    n, p = ngram_join.N, ngram_join.PERCENT
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{low}') AS text FROM documents),
w AS (SELECT doc_id, {_WORDS} AS ws FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {n - 1}], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - {n - 1}, 1))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * shared >= {p} * (p.n + q.n - shared)),
near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS a, x AS b FROM near UNION SELECT r.a, near.y FROM reach r JOIN near ON r.b = near.x),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON d.doc_id = a"""


def _vector_codes() -> str:
    v = vector_codes
    floored = "CAST((s - ((s % c) + c) % c) // c AS BIGINT)"  # // truncates
    rounds = []
    for r in range(v.ROUNDS):
        rounds.append(f"""
n{r} AS MATERIALIZED (
  SELECT vec_id, p, min((d, e)) AS best FROM (
    SELECT q.vec_id, q.p, b.e, list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM pieces q JOIN b{r} b USING (p)) GROUP BY vec_id, p),
b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT p, e, list({floored} ORDER BY i) AS x FROM (
      SELECT p, e, i, CAST(sum(c1) AS BIGINT) AS s, count(*) AS c FROM (
        SELECT q.p, n.best[2] AS e, unnest(q.x) AS c1, generate_subscripts(q.x, 1) AS i FROM pieces q JOIN n{r} n USING (vec_id, p))
      GROUP BY p, e, i) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)""")
    last = v.ROUNDS
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {v.SCALE:g}) AS BIGINT)) AS x, len(embedding) // {v.PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT vec_id, p, x[p * w + 1:(p + 1) * w] AS x FROM kept, range({v.PARTS}) r(p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM pieces
  JOIN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {v.ENTRIES}) USING (vec_id)),
{','.join(rounds)},
final AS (
  SELECT vec_id, p, min((d, e)) AS best FROM (
    SELECT q.vec_id, q.p, b.e, list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM pieces q JOIN b{last} b USING (p)) GROUP BY vec_id, p),
coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM final GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (vec_id), books"""


def _fill_in_middle() -> str:
    f = fill_in_middle
    marked = " OR ".join(f"contains(t, '{s}')" for s in f.ORDER)
    part = {f.PREFIX: "substring(t, 1, a)", f.MIDDLE: "substring(t, a + 1, b - a)", f.SUFFIX: "substring(t, b + 1, n - b)"}
    output = {k: " || ".join(f"'{s}' || {part[s]}" for s in order) for k, order in f.FORMS.items()}
    draw = ", ".join(f"CAST('0x' || substring(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{f.SEED}:' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, t, n, {draw} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR {marked} OR h3 % 100 >= {f.PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {f.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN {output['spm']} ELSE {output['psm']} END) AS output_sha256, sha256(t) AS restored_sha256
FROM c"""


#: base32 of a SHA-1 in SQL: five hex digits are four base32 digits.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, h, translate(array_to_string(list_transform(range(8), lambda k: lpad(upper(to_base(CAST('0x' || s[k * 5 + 1:k * 5 + 5] AS BIGINT), 32)), 4, '0')), ''),
             '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS b FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, strlen(h) AS payload_bytes, b AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


ORACLE: dict[str, str] = {
    "op1_line_dedup": _line_dedup(),
    "op3_url_filter": _URLS,
    "op5_license_scan": _license_scan(),
    "op6_secret_scan": _secret_scan(),
    "op8_quality_rules": _quality_rules(),
    "op9_chat_format": _chat(),
    "op10_ngram_join": _ngram_join(),
    "op11_vector_codes": _vector_codes(),
    "op12_fill_in_middle": _fill_in_middle(),
    "op13_warc": _WARC,
}
