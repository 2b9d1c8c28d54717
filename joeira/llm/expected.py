"""SQL twins, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from joeira.llm.common import UPPER
from joeira.llm.licenses import COVERAGE, LONGER, NEAR, NOTICES, PHRASES
from joeira.llm.queries import MIX_BLOCK, MIX_DEFAULT, MIX_WEIGHTS, URL_RULES
from joeira.llm.url_filter import TRACKING

LOWER = UPPER.lower()


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _url_filter() -> str:
    rules = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = {_text(h)} OR ends_with(host, {_text('.' + h)})) AND starts_with(path, {_text(p)})" for _, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN {_text(h + p)}" for f, (_, h, p) in zip(fits, rules))
    said = " ".join(f"WHEN {f} THEN {_text(v)}" for f, (v, _, _) in zip(fits, rules))
    return f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM cut),
asked AS (
  SELECT *, array_to_string(list_sort([p for p in string_split(query, '&') IF p <> '' AND NOT regexp_matches(p, '^(?:{TRACKING})(?:=|$)')]), '&') AS kept FROM parts),
canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\\.', '')
    || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canon FROM asked),
judged AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CASE {said} END AS said,
    coalesce(canon IN (SELECT canon FROM canon WHERE contains(url, 'utm_source=') AND canon IS NOT NULL), false) AS on_list FROM canon)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN on_list THEN 'block' ELSE 'allow' END) AS verdict,
  said IS NULL AND on_list AS listed
FROM judged"""


def _licenses() -> str:
    rows = []
    for base, templates in ((True, PHRASES), (False, NOTICES)):
        for text, label in templates.items():
            label, *own = (label,) if base else label
            words = text.split()
            pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
            rows += [f"({_text(p)}, {_text(str(int(base)) + text)}, {_text(label)}, {base}, {i}, {len(pairs)}, {p in own}, {len(own)})" for i, p in enumerate(pairs)]
    return f"""
WITH templates(pair, template, label, base, t_pos, n_grams, own, n_own) AS (VALUES {", ".join(rows)}),
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grams AS (
  SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] AS pair FROM (SELECT doc_id, w, unnest(range(len(w) - 1)) AS pos FROM texts)),
votes AS (SELECT doc_id, template, label, base, n_grams, n_own, own, t_pos, pos - t_pos AS diagonal FROM grams JOIN templates USING (pair)),
diagonals AS (
  SELECT doc_id, template, label, base, n_grams, n_own, diagonal, count(*) AS votes, min(t_pos) AS t_first, max(t_pos) AS t_last, list(t_pos) AS t_all,
    [x.t FOR x IN list({{'t': t_pos, 'o': own}}) IF x.o] AS t_own
  FROM votes GROUP BY doc_id, template, label, base, n_grams, n_own, diagonal),
starts AS (
  SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {NEAR}, true) THEN 1 ELSE 0 END AS new
  FROM diagonals),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS place FROM starts),
places AS (
  SELECT doc_id, template, label, base, n_grams, n_own, place, min(diagonal + t_first) AS first_word, max(diagonal + t_last) + 1 AS last_word,
    max(votes) AS best, len(list_distinct(flatten(list(t_all)))) AS covered,
    len(list_distinct(flatten(list(t_own)))) AS held, coalesce(max(votes) FILTER (len(t_own) = n_own), 0) AS best_own,
    last_word - first_word + 1 <= (n_grams + 1) * {LONGER} AS short
  FROM numbered GROUP BY doc_id, template, label, base, n_grams, n_own, place),
judged AS (
  SELECT *, CASE WHEN base OR NOT short THEN best ELSE covered END / n_grams AS coverage,
    greatest(best_own, CASE WHEN short AND held = n_own THEN covered ELSE 0 END) / n_grams >= {COVERAGE} AS enough FROM places),
found AS (
  SELECT doc_id, count(*) FILTER (base AND coverage >= 1) AS n_base, min(first_word) FILTER (base AND coverage >= 1) AS first_word,
    max(first_word) FILTER (base AND coverage >= 1) AS last_word,
    list_sort(list(DISTINCT label) FILTER (base AND coverage >= 1)) AS base_labels,
    list_sort(list(DISTINCT label) FILTER ((base AND coverage >= 1) OR (NOT base AND enough))) AS labels,
    max(CASE WHEN base AND coverage >= 1 THEN 1.0 WHEN NOT base THEN coverage END) AS score
  FROM judged GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM texts t LEFT JOIN found USING (doc_id)"""


def _mixing() -> str:
    weight = " ".join(f"WHEN {_text(k)} THEN {w}" for k, w in MIX_WEIGHTS.items())
    return f"""
WITH RECURSIVE counts AS (
  SELECT source, CAST(CASE source {weight} ELSE {MIX_DEFAULT} END AS BIGINT) AS a FROM (SELECT DISTINCT source FROM documents)),
s AS (SELECT list(a ORDER BY source) AS a, CAST(sum(a) AS BIGINT) AS q, count(*) AS k FROM counts),
edf(t, c, p) AS (
  SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT) for x in a], CAST(0 AS BIGINT) FROM s
  UNION ALL
  SELECT t + 1, [c[i] + CASE WHEN i = p THEN 1 ELSE 0 END for i in range(1, k + 1)], p
  FROM (SELECT t, c, k, list_min([CASE WHEN (c[i] * q) // a[i] <= t THEN (((c[i] + 1) * q + a[i] - 1) // a[i]) * 10000 + i END for i in range(1, k + 1)]) % 10000 AS p
        FROM edf, s WHERE t < q)),
slots AS (SELECT p, list(t - 1 ORDER BY t) AS slots FROM edf WHERE t > 0 GROUP BY p),
sources AS (SELECT source, a, q, slots FROM (SELECT source, a, row_number() OVER (ORDER BY source) AS p FROM counts) JOIN slots USING (p), (SELECT q FROM s)),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS source_index FROM documents),
placed AS (
  SELECT doc_id, source, source_index, source_index // {MIX_BLOCK} AS block, a, q, slots FROM ranked JOIN sources USING (source)),
told AS (
  SELECT doc_id, source, source_index, block, (block // a) * q + slots[block % a + 1] AS slot, (block * q) // a AS release,
    ((block + 1) * q + a - 1) // a AS deadline FROM placed)
SELECT *, row_number() OVER (ORDER BY slot, source_index) - 1 AS position FROM told"""


_EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)"""

# Bytes are looked at as pairs of hexadecimal digits.
_REPEATS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
blocks AS (
  SELECT doc_id, o, substr(h, 2 * o + 1, 2098) AS part, least(1000, n - 49 - o) AS k
  FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 1000)) AS o FROM docs WHERE n >= 50)),
windows AS (SELECT doc_id, o + i AS p, substr(part, 2 * i + 1, 100) AS s FROM (SELECT doc_id, o, part, unnest(range(k)) AS i FROM blocks)),
least AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p FROM windows JOIN least USING (s) WHERE doc_id > low),
steps AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hits),
spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM steps) GROUP BY doc_id, r),
parts AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM spans
  UNION ALL SELECT doc_id, max(b), n FROM spans JOIN docs USING (doc_id) GROUP BY doc_id, n),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM parts JOIN docs USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)"""

_COLLOCATIONS = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM texts)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
f AS (
  SELECT lang, p, count(*) AS f FROM (SELECT lang, w[i:i + m] AS p FROM starts, (VALUES (0), (1), (2), (3)) AS sizes(m) WHERE i + m <= len(w)) GROUP BY lang, p),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
candidates AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1 AND f >= 30),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM candidates),
rated AS (
  SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:len(c.p)]),
lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, p, a, m, unnest(range(1, len(p) - m + 2)) AS i FROM (SELECT lang, p, a, unnest(range(2, len(p))) AS m FROM candidates WHERE len(p) > 2)),
covered AS (SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer FROM inner_parts GROUP BY 1, 2),
free AS (
  SELECT l.lang, array_to_string(l.p, ' ') AS phrase, a, l.l, l.r, score FROM lowest l LEFT JOIN covered c ON c.lang = l.lang AND c.p = l.p
  WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def _vector_codes() -> str:
    near = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p, c)])"
    steps = []
    for k in range(5):
        steps.append(f"near{k} AS MATERIALIZED (SELECT k, pos, min(CAST({near} AS BIGINT) * 256 + e) AS d FROM parts JOIN book{k} USING (pos) GROUP BY k, pos)")
        if k < 4:
            steps.append(f"""sums{k} AS (
  SELECT pos, d % 256 AS e, i, sum(p[i]) AS s, count(*) AS n FROM (SELECT pos, d, p, unnest(range(1, len(p) + 1)) AS i FROM near{k} JOIN parts USING (k, pos)) GROUP BY pos, e, i),
means{k} AS (SELECT pos, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM sums{k} GROUP BY pos, e),
book{k + 1} AS MATERIALIZED (SELECT pos, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (pos, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT k, pos, v[pos * (len(v) // 4) + 1:(pos + 1) * (len(v) // 4)] AS p FROM kept, (VALUES (0), (1), (2), (3)) AS positions(pos)),
book0 AS (SELECT pos, k - 1 AS e, p AS c FROM parts WHERE k <= 256),
{", ".join(steps)},
coded AS (
  SELECT k, string_agg(lpad(to_hex(d % 256), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(d // 256) AS BIGINT) AS error FROM near4 GROUP BY k)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) FROM book4) AS codebooks_sha256
FROM kept JOIN coded USING (k)"""


EXPECTED_SQL: dict[str, str] = {
    "op13_vector_codes": _vector_codes(),
    "op12_collocations": _COLLOCATIONS,
    "op3_embeddings": _EMBEDDINGS,
    "op7_repeats": _REPEATS,
    "op4_url_filter": _url_filter(),
    "op8_licenses": _licenses(),
    "op10_mixing": _mixing(),
}
