"""DuckDB SQL for the queries that SQL can express."""

from collections import Counter

from sparkfolio.llm.licenses import SHARED, SPDX, TEMPLATES, TEXTS, clause_words, field_pattern, marks, terms_of

WORD = r"[^\x20\x09-\x0D]+"

TERM = r"regexp_extract_all(lower({}), '\d+(?:\.\d+)*|[\p{{L}}\p{{N}}]+')"
_ALL = [(f"{name}#{i}{end}", name, notice, text) for notice, end, group in ((True, "", TEMPLATES), (False, "#full", TEXTS)) for name, texts in sorted(group.items()) for i, text in enumerate(texts)]
_TF = ", ".join(f"('{t}', '{n}', {not notice}, '{term}', {k})" for t, n, notice, text in _ALL for term, k in sorted(Counter(terms_of(text)).items()))
_MARKS = ", ".join(f"('{t}', {needed!r}::VARCHAR[], {barred!r}::VARCHAR[])" for t, _, notice, text in _ALL for needed, barred in [marks(text, notice)])
_INSIDE = repr(clause_words([text for _, _, notice, text in _ALL if notice]))
_FIELD = field_pattern(sorted({name for _, name, _, _ in _ALL})).replace("'", "''")
_OTHER = " ".join(f"WHEN d.license = '{name}' AND contains(said, '{held}') AND {f"NOT contains(said, '{missing}')" if missing else 'true'} THEN '{other}'" for name, ways in SHARED.items() for other, held, missing in ways)
_PART, _SET = "source || '/part' || doc_id // 1000", "source || '/part' || doc_id // 1000 || '/set' || doc_id // 100"

OP4 = f"""
WITH files AS (
  SELECT doc_id, text, CASE WHEN doc_id % 100 = 0 THEN {_PART} || '/LICENSE' WHEN doc_id % 10 = 0 THEN {_SET} || '/LICENSE' ELSE {_SET} || '/' || doc_id || '.txt' END AS path
  FROM documents),
placed AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, path LIKE '%/LICENSE' AS is_license FROM files),
tf(template, license, full_text, term, tf) AS (VALUES {_TF}),
marks(template, needed, barred) AS (VALUES {_MARKS}),
vocabulary AS (SELECT DISTINCT term FROM tf),
total AS (SELECT count(*) AS n FROM files),
held AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({TERM.format("text")})) AS term FROM files) WHERE term IN (SELECT term FROM vocabulary) GROUP BY term),
idf AS (SELECT v.term, ln((1.0 + t.n) / (1.0 + coalesce(h.n, 0))) + 1.0 AS w FROM vocabulary v LEFT JOIN held h USING (term), total t),
vectors AS (SELECT template, license, full_text, term, tf * w AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT template, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY template),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM placed),
sentences AS (SELECT doc_id, unnest(string_split(regexp_replace(line, '([.;!?])[ \\t]+(\\p{{Lu}})', '\\1' || chr(10) || '\\2', 'g'), chr(10))) AS sentence FROM lines),
clauses AS (SELECT doc_id, trim(unnest(string_split(array_to_string(list_transform({TERM.format("sentence")}, lambda t: CASE WHEN list_contains({_INSIDE}, t) THEN t ELSE '|' END), ' '), '|'))) AS unit FROM sentences),
units AS (SELECT doc_id, line AS unit, false AS clause FROM lines UNION SELECT doc_id, text, false FROM placed WHERE is_license UNION SELECT doc_id, unit, true FROM clauses WHERE unit <> ''),
unit_terms AS (SELECT doc_id, unit, clause, term, count(*) AS tf FROM (SELECT doc_id, unit, clause, unnest({TERM.format("unit")}) AS term FROM units) GROUP BY ALL),
weighed AS (SELECT doc_id, unit, clause, term, tf * coalesce(w, (SELECT ln(1.0 + n) + 1.0 FROM total)) AS w FROM unit_terms LEFT JOIN idf USING (term)),
unit_norms AS (SELECT doc_id, unit, clause, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
products AS (SELECT u.doc_id, u.unit, u.clause, v.template, v.license, v.full_text, sum(u.w * v.w) AS s FROM weighed u JOIN vectors v USING (term) GROUP BY ALL),
held_terms AS (SELECT doc_id, unit, clause, list(term) AS terms FROM unit_terms GROUP BY ALL),
scores AS (SELECT p.doc_id, p.license, p.full_text, false AS tag, round(s / (n.norm * u.norm), 9) AS score FROM products p JOIN norms n USING (template) JOIN unit_norms u ON u.doc_id = p.doc_id AND u.unit = p.unit AND u.clause = p.clause
  JOIN marks m USING (template) JOIN held_terms h ON h.doc_id = p.doc_id AND h.unit = p.unit AND h.clause = p.clause WHERE NOT (p.clause AND p.license LIKE 'LicenseRef-%') AND list_has_all(h.terms, m.needed) AND NOT list_has_any(h.terms, m.barred)),
tags AS (SELECT doc_id, regexp_replace(coalesce(nullif(regexp_extract(text, '{SPDX}', 1), ''), nullif(regexp_extract(text, '{_FIELD}', 1), '')), '[ \\t]+', ' ', 'g') AS expression FROM files),
named AS (SELECT doc_id, CASE WHEN length(replace(expression, '(', '')) = length(replace(expression, ')', '')) THEN expression ELSE translate(expression, '()', '') END AS license FROM tags WHERE expression IS NOT NULL),
best AS (SELECT doc_id, license, full_text, tag, score FROM (SELECT * FROM scores WHERE score >= 0.8 UNION ALL SELECT doc_id, license, false, true, 1.0 FROM named)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY full_text DESC, tag DESC, license LIKE 'LicenseRef-%', score DESC, license) = 1),
declared AS (SELECT d.doc_id, CASE WHEN d.full_text OR d.tag THEN d.license {_OTHER} ELSE d.license END AS license, d.full_text, d.tag, d.score
  FROM best d JOIN (SELECT doc_id, array_to_string({TERM.format("text")}, ' ') AS said FROM files) USING (doc_id)),
licensed AS (SELECT dir, license FROM declared JOIN placed USING (doc_id) WHERE is_license QUALIFY row_number() OVER (PARTITION BY dir ORDER BY full_text DESC, tag DESC, license LIKE 'LicenseRef-%', score DESC, license) = 1),
nearest AS (
  SELECT d.dir, l.dir AS up, l.license FROM (SELECT DISTINCT dir FROM placed) d JOIN licensed l ON l.dir = '' OR d.dir = l.dir OR starts_with(d.dir, l.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(l.dir) DESC) = 1)
SELECT p.doc_id, p.path, coalesce(d.license, n.license) AS license, d.score, d.license IS NOT NULL AS declared, CASE WHEN d.license IS NULL THEN n.up END AS inherited_from
FROM placed p LEFT JOIN declared d USING (doc_id) LEFT JOIN nearest n ON n.dir = p.dir
"""

OP7 = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size::DOUBLE * 3.0::DOUBLE AS cap
  FROM sizes),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
capped AS (SELECT *, level * weight >= cap AS is_capped FROM levels),
free AS (SELECT arg_min(level, cap / weight) AS level FROM capped WHERE NOT is_capped),
plan AS (
  SELECT source, source_size, CASE WHEN is_capped THEN cap ELSE (SELECT level FROM free) * weight END AS target FROM capped),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS budget
  FROM plan),
alike AS (SELECT source, h, doc_id, size, sum(size) AS words FROM docs GROUP BY ALL),
running AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size) - words AS before_ FROM alike)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.copies + CASE WHEN 2 * r.before_ + r.words <= 2 * b.budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
JOIN running r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h AND d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.size = r.size
"""

OP9 = """
WITH pages AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines, text FROM documents),
keyed AS (SELECT doc_id, source, text, lines, [trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) FOR l IN lines] AS bare FROM pages),
seen AS (SELECT source, unnest(list_distinct([b FOR b IN bare IF b <> ''])) AS line FROM keyed),
often AS (
  SELECT s.source, s.line FROM (SELECT source, line, count(*) AS n FROM seen GROUP BY ALL) s
  JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) t ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.n >= 5 AND s.n > 0.05 * t.total),
hosts AS (SELECT source, list(line) AS drops FROM often GROUP BY source),
kept AS (
  SELECT k.doc_id, k.text, len(k.lines) AS n, list_filter(k.lines, lambda l : NOT list_contains(coalesce(h.drops, []), trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS rest
  FROM keyed k LEFT JOIN hosts h ON k.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(n - len(rest), 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(array_to_string(rest, chr(10)), '')) END AS kept_sha256
FROM kept
"""

OP12 = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents),
grouped AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM docs),
cut AS (
  SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(t, greatest(a, b) + 1) AS s,
         CASE WHEN n = 0 OR t LIKE '%<P>%' OR t LIKE '%<S>%' OR t LIKE '%<M>%' OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM grouped)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
grams AS (SELECT lang, m, unnest([array_to_string(w[i : i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase FROM split, (VALUES (1), (2), (3), (4)) t(m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, m, w, unnest(range(2, m)) AS size FROM candidates),
parts AS (SELECT lang, a, unnest([array_to_string(w[i : i + size - 1], ' ') FOR i IN range(1, m - size + 2)]) AS phrase FROM inner_),
longer AS (SELECT lang, phrase, max(a) AS above FROM parts GROUP BY ALL),
free AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.above IS NULL OR 100::HUGEINT * g.above < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM free JOIN totals USING (lang) QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op4_licenses": OP4,
    "op7_mixing": OP7,
    "op9_line_dedup": OP9,
    "op12_fill_middle": OP12,
    "op13_collocations": OP13,
}
