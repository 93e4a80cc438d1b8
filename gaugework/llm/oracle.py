"""The text operators' queries in SQL, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x20\\x09-\\x0D]+"

JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE
    list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, coalesce(l.n, 0) AS n_links
FROM sets s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = s.doc_id
"""


REPEATS = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)
), firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT w.doc_id, unnest(range(w.i, w.i + 50)) AS p FROM windows w JOIN firsts f ON w.g = f.g WHERE f.first < w.doc_id)
), words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS text, count(*) AS n
  FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_SECRETS = (
    ("assign", f"({_EITHER})[\"''\']?\\x20*[:=]\\x20*[\"''\']?([A-Za-z0-9+/_.=-]+)".replace("''\'", "''"), 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
)


def _found(name: str, pattern: str, group: int, least: int, rank: int) -> str:
    """Matches of a pattern with their positions: what is between them is measured by splitting."""
    return f"""{name}_all AS (
  SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS part,
    list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS gaps FROM docs
), {name}_at AS (
  SELECT doc_id, m[i] AS body, part[i] AS part,
    list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_all)
), {name}_spans AS (
  SELECT doc_id, {rank} AS rank, '{name}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(body) AS BIGINT) AS e, body
  FROM {name}_at WHERE length(part) >= {least})"""


_TAIL = (
    "(CASE WHEN {z} >= 0 THEN {t} ELSE 1 - {t} END)",
    "0.3989422804014327::DOUBLE * exp(-{x} * {x} / 2) * ({u} * (0.319381530::DOUBLE + {u} * (-0.356563782::DOUBLE + {u} * "
    "(1.781477937::DOUBLE + {u} * (-1.821255978::DOUBLE + {u} * 1.330274429::DOUBLE)))))",
)


def _tail(z: str) -> str:
    x = f"abs({z})"
    u = f"(1 / (1 + 0.2316419::DOUBLE * {x}))"
    return _TAIL[0].format(z=z, t=_TAIL[1].format(x=x, u=u))


_HEX, _B32 = "0123456789abcdef", UPPER + "234567"
_B62 = UPPER + LOWER + "0123456789"
_STEPS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)
_ABOVE = ", ".join(f"count(*) FILTER (p > {t}::DOUBLE) AS n{i}" for i, t in enumerate(_STEPS))
_CHOICE = " ".join(
    f"WHEN n{i} > 0 AND n{i} - (1 - {t}::DOUBLE) * (n8 / 0.5::DOUBLE) <= 0.05::DOUBLE * n{i} THEN {t}::DOUBLE"
    for i, t in enumerate(_STEPS)
)
SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), {", ".join(_found(*k, rank) for rank, k in enumerate(_SECRETS))}
, {_found("random", "[A-Za-z0-9+/_-]{{20,}}={{0,2}}".replace("{{", "{").replace("}}", "}"), 0, 0, 3)}
, base AS (SELECT * FROM assign_spans UNION ALL SELECT * FROM access_spans UNION ALL SELECT * FROM hex_spans
), encoded AS (
  SELECT *, CASE WHEN regexp_full_match(b, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(b, '[A-Z2-7]+') THEN 'base32'
    WHEN regexp_full_match(b, '[A-Za-z0-9]+') THEN 'base62' ELSE 'base64' END AS encoding
  FROM (SELECT *, rtrim(body, '=') AS b FROM random_spans)
), spelled AS (
  SELECT *, CASE encoding WHEN 'hex' THEN '{_HEX}' WHEN 'base32' THEN '{_B32}' WHEN 'base62' THEN '{_B62}' ELSE '{_B62}+/' END
    AS alphabet, CASE encoding WHEN 'hex' THEN lower(b) ELSE translate(b, '-_', '+/') END AS c FROM encoded
), coded AS (
  SELECT *, CAST(length(c) AS DOUBLE) AS n, CAST(length(alphabet) AS DOUBLE) AS k,
    list_transform(string_split(c, ''), lambda x: instr(alphabet, x) - 1) AS x FROM spelled
), counted AS (
  SELECT *, list_sum(list_transform(string_split(alphabet, ''), lambda a: power(length(c) - length(replace(c, a, '')), 2))) AS squares,
    len(list_filter(x, lambda v: v >= k / 2)) AS high,
    1 + list_sum(list_transform(range(1, len(x)), lambda i: CASE WHEN (x[i] >= k / 2) <> (x[i + 1] >= k / 2) THEN 1 ELSE 0 END)) AS runs,
    list_sum(x) AS total, list_sum(list_transform(x, lambda v: v * v)) AS total2,
    list_sum(list_transform(range(1, len(x)), lambda i: x[i] * x[i + 1])) AS products, x[1] + x[-1] AS ends FROM coded
), measured AS (
  SELECT *, (pow((k / n * squares - n) / (k - 1), 1.0::DOUBLE / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z1,
    2.0::DOUBLE * high * (n - high) AS twice, total / n AS mean, total2 - n * (total / n) * (total / n) AS square,
    products - (total / n) * (2 * total - ends) + (n - 1) * (total / n) * (total / n) AS crossed FROM counted
), tested AS (
  SELECT *, CASE WHEN twice * (twice - n) > 0 THEN abs(runs - twice / n - 1) / sqrt(twice * (twice - n) / (n * n * (n - 1))) END AS z2,
    CASE WHEN square > 0 THEN abs(crossed / square * sqrt(n) + 1 / sqrt(n)) END AS z3 FROM measured
), combined AS (
  SELECT *, -(ln(least(greatest({_tail("z1")}, 1e-12::DOUBLE), 1)) + ln(least(greatest(coalesce(2 * {_tail("z2")}, 1e-12::DOUBLE), 1e-12::DOUBLE), 1))
    + ln(least(greatest(coalesce(2 * {_tail("z3")}, 1e-12::DOUBLE), 1e-12::DOUBLE), 1))) AS f FROM tested
), scored AS (SELECT *, exp(-f) * (1 + f + f * f / 2) AS p, CAST(floor(log2(n)) AS INTEGER) AS band FROM combined
), bands AS (SELECT encoding, band, {_ABOVE} FROM scored GROUP BY encoding, band
), chosen AS (SELECT encoding, band, CASE {_CHOICE} END AS bar FROM bands
), added AS (
  SELECT s.doc_id, s.rank, s.kind, s.s, s.e, s.body FROM scored s JOIN chosen c ON s.encoding = c.encoding AND s.band = c.band
  WHERE s.p > c.bar AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.s < s.e AND s.s < b.e)
), spans AS (SELECT *, kind || ':' || s || ':' || e AS item FROM (SELECT * FROM base UNION ALL SELECT * FROM added)
), by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(item, ',' ORDER BY s, rank, e) FILTER (kind <> 'random') AS base,
    string_agg(item, ',' ORDER BY s, rank, e) AS spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN by_doc b ON b.doc_id = d.doc_id
"""

_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_HOST = f"translate(regexp_extract({{0}}, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in _RULES)


def _rank(edges: str, name: str, rounds: int = 10) -> str:
    steps = [f"{name}_back AS (SELECT host, mass * 15 // 100 AS mass FROM {name}_0)"]
    for i in range(1, rounds + 1):
        steps.append(f"""{name}_{i} AS (
  SELECT host, CAST(sum(mass) AS BIGINT) AS mass FROM (
    SELECT e.dst AS host, m.mass * 85 // (100 * e.degree) AS mass FROM {name}_{i - 1} m JOIN {edges} e ON e.src = m.host
    UNION ALL SELECT host, mass FROM {name}_back) GROUP BY host HAVING sum(mass) > 0)""")
    return ", ".join(steps)


def _seeds(name: str, verdict: str) -> str:
    return f"""{name}_0 AS (
  SELECT host, CAST({1 << 40} // (SELECT count(*) FROM judged WHERE verdict = '{verdict}') * count(*) AS BIGINT) AS mass
  FROM judged WHERE verdict = '{verdict}' GROUP BY host)"""


URLS = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}
), own AS (
  SELECT page_id, coalesce(html, '') AS html, {_HOST.format("coalesce(url, '')")} AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
), fitting AS (
  SELECT o.page_id, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY o.page_id ORDER BY length(r.host || r.path) DESC) AS place
  FROM own o JOIN rules r ON (o.host = r.host OR ends_with(o.host, '.' || r.host)) AND starts_with(o.path, r.path)
), judged AS (
  SELECT o.*, f.rule, f.verdict FROM own o LEFT JOIN fitting f ON f.page_id = o.page_id AND f.place = 1
), links AS (
  SELECT DISTINCT src, dst FROM (
    SELECT host AS src, {_HOST.format("link")} AS dst FROM (
      SELECT host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS link FROM own)
    WHERE contains(link, '://')) WHERE src <> '' AND dst <> '' AND src <> dst
), ahead AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM links
), behind AS (SELECT dst AS src, src AS dst, count(*) OVER (PARTITION BY dst) AS degree FROM links
), {_seeds("trust", "allow")}, {_rank("ahead", "trust")}, {_seeds("doubt", "block")}, {_rank("behind", "doubt")}
SELECT j.page_id, j.host, j.path, j.rule,
  coalesce(j.verdict, CASE WHEN coalesce(d.mass, 0) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(t.mass, 0) AS trust, coalesce(d.mass, 0) AS distrust
FROM judged j LEFT JOIN trust_10 t ON t.host = j.host LEFT JOIN doubt_10 d ON d.host = j.host
"""


_NULLS = "coalesce(lang, '') AS lang, coalesce(source, '') AS source"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
DIVERGENCE = f"""
WITH docs AS (SELECT {_NULLS}, {_TERMS} AS terms FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 10
), found AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs)
  SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (SELECT DISTINCT lang, source FROM docs
), sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term
), totals AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term
), shares AS (
  SELECT c.*, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY c.lang, source) + 2 * v) AS BIGINT) AS p
  FROM cells c JOIN sizes s ON s.lang = c.lang
), common AS (
  SELECT t.lang, term, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY t.lang) + 2 * v) AS BIGINT) AS q
  FROM totals t JOIN sizes s ON s.lang = t.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found_all AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, CAST((p - q) * (p - q) // (p + q) AS BIGINT)
  FROM shares s JOIN common c ON c.lang = s.lang AND c.term = s.term WHERE s.n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found_all
) WHERE part = 'pair' OR rank <= 10
"""


def _code_steps(rounds: int = 2) -> str:
    """Assignments and codebooks by turns; the first codebook is c0, the last assignment a{rounds}."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT row, part, arg_min({{'entry': entry, 'd': d}}, d * 64 + entry) AS got FROM (
    SELECT p.row, p.part, c.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda j: (p.x[j] - c.x[j]) * (p.x[j] - c.x[j])))::BIGINT AS d
    FROM pieces p JOIN c{i} c ON c.part = p.part) GROUP BY row, part)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT part, entry, list(m ORDER BY j) AS x FROM (
    SELECT a.part, a.got.entry AS entry, j, CAST(floor_div(sum(p.x[j]), count(*)) AS BIGINT) AS m
    FROM a{i} a JOIN pieces p ON p.row = a.row AND p.part = a.part, LATERAL (SELECT unnest(range(1, len(p.x) + 1)) AS j)
    GROUP BY a.part, a.got.entry, j) GROUP BY part, entry
), c{i + 1} AS (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry)""")
    return ", ".join(steps).replace("floor_div(sum(p.x[j]), count(*))", "(sum(p.x[j]) - ((sum(p.x[j]) % count(*)) + count(*)) % count(*)) // count(*)")


CODES = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS (
  SELECT row, part, x[part * len(x) // 16 + 1:(part + 1) * len(x) // 16] AS x FROM (SELECT row, x, unnest(range(16)) AS part FROM kept)
), c0 AS (SELECT part, row - 1 AS entry, x FROM pieces WHERE row <= 64
), {_code_steps()}
, books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM c2
), coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', a.got.entry), '' ORDER BY a.part) AS code, CAST(sum(a.got.d) AS BIGINT) AS error
  FROM kept k JOIN a2 a ON a.row = k.row GROUP BY k.row, k.vec_id, k.label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM coded, books
"""

_LEAK_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS = f"""
WITH docs AS (SELECT doc_id, {_LEAK_WORDS} AS w FROM documents
), items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_LEAK_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (SELECT p.doc_id, p.i, p.k, w.item FROM places p JOIN windows w ON w.k = p.k AND w.g = p.g
), covered AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS spot FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": SECRETS, "op4_url_filter": URLS, "op7_ngram_jaccard_join": JACCARD, "op9_substring_dedup": REPEATS,
        "op11_divergence_audit": DIVERGENCE, "op12_vector_codes": CODES, "op13_decontamination": LEAKS,
    }
