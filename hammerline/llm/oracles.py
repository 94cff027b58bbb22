"""DuckDB SQL for the training-data queries that SQL expresses; each computes its rows by a plain route
(whole windows, all sharing pairs, recursion), without hashing tricks or sketches."""

from __future__ import annotations

from .licenses import BREAK, PHRASES, TEMPLATES, pairs_of
from .mixing import BLOCKS, FILLS, LEAST_BLOCKS
from .quality import ERROR, RISK, RULES

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def substring_dedup(width: int = 50) -> str:
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
s AS (SELECT doc_id, word, i, n, CASE WHEN i + {width} <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)) END AS seq FROM u),
o AS (SELECT seq, min(doc_id) AS least FROM s WHERE seq IS NOT NULL GROUP BY seq),
l AS (SELECT s.doc_id, s.word, s.i, coalesce(o.least < s.doc_id, false) AS lost FROM s LEFT JOIN o ON s.seq = o.seq),
c AS (SELECT doc_id, word, i, bool_or(lost) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS gone FROM l),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""


#: 40 hexadecimal digits in groups of five (20 bits), each as four characters of the base32 alphabet.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM h"""


def license_scan(containment: float = 0.85) -> str:
    places = []
    for phrase, label in PHRASES.items():
        hit = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split(), 1))
        places.append(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: {hit})) AS place FROM d")
    templates = ", ".join(f"({i}, '{label}', {pairs_of(text)})" for i, (label, text) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS ({" UNION ALL ".join(places)}),
g AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
t(id, label, pairs) AS (VALUES {templates}),
v AS (SELECT DISTINCT unnest(pairs) AS pair FROM t),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM d),
x AS (SELECT doc_id, place, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY place) AS pair FROM u),
h AS (SELECT x.doc_id, x.place, x.pair, CASE WHEN x.place - lag(x.place) OVER (PARTITION BY x.doc_id ORDER BY x.place) <= {BREAK} THEN 0 ELSE 1 END AS new FROM x JOIN v ON x.pair = v.pair),
i AS (SELECT doc_id, pair, sum(new) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS block FROM h),
k AS (SELECT t.id, label, len(pairs) AS size, unnest(pairs) AS pair FROM t),
o AS (SELECT i.doc_id, k.label, count(DISTINCT i.pair) / any_value(k.size) AS held FROM i JOIN k ON i.pair = k.pair GROUP BY i.doc_id, i.block, k.id, k.label HAVING count(DISTINCT i.pair) >= {containment} * any_value(k.size) - 1e-9),
m AS (SELECT doc_id, label, max(held) AS best FROM o GROUP BY doc_id, label),
a AS (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m),
z AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM a GROUP BY doc_id),
e AS (SELECT doc_id, max(best) AS best FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(e.best, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN z ON d.doc_id = z.doc_id LEFT JOIN e ON d.doc_id = e.doc_id"""


def quality_rules() -> str:
    rate = RISK / len(RULES)
    values = {"symbols": "n_symbols / greatest(word_chars, 1)", "capitals": "n_capitals / greatest(word_chars, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "lines": "n_dup_lines / greatest(n_lines, 1)"}
    grid = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, (_, cutoffs) in RULES.items() for i, c in enumerate(cutoffs, 1))
    measured = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, CAST({v} AS DOUBLE) AS value FROM f" for r, v in values.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
s AS (SELECT doc_id, i, CASE WHEN i + 8 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) END AS seq FROM u),
q AS (SELECT doc_id, i, seq IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, seq) > 1 AS twice FROM s),
c AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM q),
p AS (SELECT doc_id, count(*) FILTER (covered) AS n FROM c GROUP BY doc_id),
e AS (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM d),
f AS (SELECT e.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM e LEFT JOIN p ON e.doc_id = p.doc_id),
v AS ({measured}),
g(rule, step, cutoff) AS (VALUES {grid}),
k AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, count(*) FILTER (good) AS n FROM f JOIN k ON f.doc_id = k.doc_id GROUP BY stratum),
a AS (SELECT v.stratum, g.rule, g.step, g.cutoff, h.n, count(*) FILTER (k.good AND value > cutoff) AS wrong, count(*) FILTER (NOT k.good AND value > cutoff) AS hits FROM v JOIN k ON v.doc_id = k.doc_id JOIN h ON h.stratum = v.stratum JOIN g ON g.rule = v.rule GROUP BY ALL),
b AS (SELECT *, list_sum(list_transform(range(wrong + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({rate}) + (n - x) * ln(1 - {rate})))) <= {ERROR / len(RULES)} / (SELECT count(*) FROM h) AND wrong < n * {rate} AS sure FROM a),
o AS (SELECT *, bool_and(sure) OVER (PARTITION BY stratum, rule ORDER BY step) AS certified FROM b),
r AS (SELECT stratum, rule, arg_max(cutoff, (hits, -step)) AS cutoff FROM o WHERE certified AND hits > 0 GROUP BY stratum, rule),
t AS (SELECT DISTINCT v.doc_id FROM v JOIN r ON v.stratum = r.stratum AND v.rule = r.rule AND v.value > r.cutoff),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND t.doc_id IS NULL AS kept FROM m LEFT JOIN t ON m.doc_id = t.doc_id"""


def near_duplicates(width: int = 4, percent: int = 80) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
s AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) AS shingle FROM u),
g AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(shingle) AS shingle FROM s WHERE i + {width} <= n OR i = 0),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(CAST(shingle AS VARCHAR), ' ' ORDER BY shingle)) AS same FROM g GROUP BY doc_id),
e AS MATERIALIZED (SELECT same, min(doc_id) AS rep, any_value(n) AS n FROM z GROUP BY same),
x AS MATERIALIZED (SELECT g.doc_id, g.shingle, e.n FROM g JOIN e ON g.doc_id = e.rep),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
c(doc_id, reach) AS (SELECT rep, rep FROM e UNION SELECT c.doc_id, p.b FROM c JOIN p ON c.reach = p.a),
l AS (SELECT doc_id, min(reach) AS component_id FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN z ON d.doc_id = z.doc_id LEFT JOIN e ON z.same = e.same LEFT JOIN l ON l.doc_id = e.rep"""


def source_mixing(repeats: float = 1.5, seed: int = 11) -> str:
    """The exponent in closed form: without a budget a source of share x is read (largest / x) ** (1 - t) times."""
    rounds, last = [], "s0"
    for i in range(1, FILLS + 1):
        rounds.append(f"""f{i} AS (SELECT *, sum(CASE WHEN taken IS NULL AND n <= rest THEN n END) OVER (PARTITION BY source, copy ORDER BY key, block ROWS UNBOUNDED PRECEDING) AS run{i} FROM {last}),
g{i} AS (SELECT * REPLACE (CASE WHEN taken IS NOT NULL THEN taken WHEN n <= rest AND run{i} <= rest THEN {i} END AS taken) FROM f{i}),
s{i} AS (SELECT * REPLACE (rest - coalesce(sum(CASE WHEN taken = {i} THEN n END) OVER (PARTITION BY source, copy), 0) AS rest) FROM g{i})""")
        last = f"s{i}"
    joined = ",\n".join(rounds)
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS n_tokens, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS key FROM documents),
t AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
p AS (SELECT max(tokens) AS most, min(tokens) FILTER (tokens > 0) AS least, CAST(sum(tokens) AS BIGINT) AS total, count(*) AS sources FROM t),
e AS (SELECT source, tokens, CASE WHEN tokens = 0 THEN 1.0 ELSE round(pow(CAST(most AS DOUBLE) / tokens, CASE WHEN most = least THEN 1.0 ELSE least(1.0, ln({repeats}) / ln(CAST(most AS DOUBLE) / least)) END), 12) END AS epochs,
  greatest(greatest(1, least({LEAST_BLOCKS}, {BLOCKS} // sources)), CAST(({BLOCKS} * CAST(tokens AS HUGEINT) + greatest(total, 1) - 1) // greatest(total, 1) AS BIGINT)) AS blocks FROM t, p),
q AS (SELECT *, round(epochs * tokens, 6) AS quota FROM e),
r AS (SELECT d.doc_id, d.source, d.n_tokens, CAST('0x' || substr(md5(d.key || ':{seed}'), 1, 15) AS BIGINT) % q.blocks AS block, q.epochs, q.tokens, q.quota FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT source, block, epochs, tokens, quota, CAST(sum(n_tokens) AS BIGINT) AS n FROM r GROUP BY ALL),
c AS (SELECT *, unnest(range(greatest(CAST(ceil(epochs) AS INT), 1))) AS copy FROM b),
s0 AS (SELECT *, md5(concat_ws(':', source, block, copy, {seed})) AS key, CASE WHEN copy < floor(epochs) OR tokens = 0 THEN 0 END AS taken, quota - copy * tokens AS rest FROM c),
{joined},
k AS (SELECT source, block, copy, quota, copy * tokens + coalesce(sum(n) OVER (PARTITION BY source, copy ORDER BY taken, key, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {last} WHERE taken IS NOT NULL)
SELECT r.doc_id, r.source, r.n_tokens, r.block, CAST(k.copy AS INT) AS copy, round(CASE WHEN k.quota > 0 THEN least(1.0, k.before / k.quota) ELSE 0 END, 9) AS mix_key
FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source AND r.block = k.block"""


ORACLE_SQL = {
    "op8_source_mixing": source_mixing(),
    "op2_substring_dedup": substring_dedup(),
    "op3_warc_captures": WARC,
    "op4_license_scan": license_scan(),
    "op5_quality_rules": quality_rules(),
    "op9_near_duplicates": near_duplicates(),
}
