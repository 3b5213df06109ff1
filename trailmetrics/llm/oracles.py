"""DuckDB texts for the training-data queries that SQL can express.

They work the results out anew: whole-text comparisons instead of hashes, tables or parsing.
Language identification, packing and winnowing have none; their tests are by held-out
accuracy, round trip and brute force.
"""

from __future__ import annotations

from trailmetrics.llm import license_scan, mixing

BLANKS = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_scans() -> str:
    rows = ", ".join(
        f"({n}, '{label}', '{kind}', {len(text.split()) - 1}, {i}, '{a}', '{b}')"
        for n, (text, label, kind) in enumerate(license_scan.templates())
        for i, (a, b) in enumerate(zip(text.split(), text.split()[1:])))
    word = license_scan.WORD
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({LOWER}, '{word}') AS w FROM documents),
t(template, label, kind, grams, place, t0, t1) AS (VALUES {rows}),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS w0, w[i + 1] AS w1
      FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM docs)),
d AS (SELECT doc_id, template, label, kind, grams, pos - place AS diagonal, list(DISTINCT place) AS places
      FROM g JOIN t ON w0 = t0 AND w1 = t1 GROUP BY ALL),
n AS (SELECT *, CASE WHEN kind = 'text' AND (
          diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {license_scan.DRIFT}
          OR diagonal - last_value(CASE WHEN len(places) >= {license_scan.STRONG} THEN diagonal END IGNORE NULLS) OVER (
              PARTITION BY doc_id, template ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            <= grams // {license_scan.LONG_DRIFT}) THEN 0 ELSE 1 END AS fresh FROM d),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM n),
c AS (SELECT doc_id, label, kind, min(diagonal) AS start,
             len(list_distinct(flatten(list(places)))) / max(grams) AS covered
      FROM s GROUP BY doc_id, template, label, kind, span),
f AS (SELECT * FROM c WHERE covered >= CASE WHEN kind = 'text' THEN {license_scan.COVERED} ELSE 1 END)
SELECT doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (kind = 'base') AS n_base,
       min(start) FILTER (kind = 'base') AS first_word, max(start) FILTER (kind = 'base') AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base'), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(covered), 0.0)::DOUBLE AS score
FROM docs LEFT JOIN f USING (doc_id) GROUP BY doc_id, w"""


def minhash_near_dedup() -> str:
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWER}, '{BLANKS}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, w[i:i + 2] AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM docs)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM docs
                         UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
label AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM label LEFT JOIN n USING (doc_id)"""


URL_FILTERS = r"""
WITH host AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
                     TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919) % 525600) AS seen FROM pages),
parts AS (SELECT *, string_split(host, '.') AS l FROM host WHERE host <> ''),
names AS (SELECT host AS pattern FROM parts
          UNION SELECT array_to_string(l[greatest(len(l) - 2, 1):], '.') FROM parts),
num AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 4))::INT AS k FROM names),
listed AS (SELECT pattern, k, DATE '2024-01-01' + (k % 200)::INT AS first FROM num WHERE k % 3 = 0),
valid AS (SELECT pattern, 'list ' || (k % 4) AS category, first AS since, first + 60 AS until FROM listed
          UNION ALL SELECT pattern, 'list ' || (k % 4), first + 120, NULL FROM listed WHERE k % 2 = 0
          UNION ALL SELECT pattern, 'list ' || ((k + 1) % 4), first + 30, first + 90 FROM listed WHERE k % 6 = 0),
hit AS (SELECT page_id, pattern, category, since, row_number() OVER (
            PARTITION BY page_id ORDER BY length(pattern) DESC, category, since) AS n
        FROM parts JOIN valid ON (host = pattern OR ends_with(host, '.' || pattern))
            AND seen >= since AND (until IS NULL OR seen < until))
SELECT page_id, host, pattern IS NOT NULL AS blocked, pattern, category, strftime(since, '%Y-%m-%d') AS valid_from
FROM host LEFT JOIN (SELECT * FROM hit WHERE n = 1) USING (page_id)"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to,
       NULL::VARCHAR AS problem
FROM p"""


def source_mixing() -> str:
    """Water level by trying every number of full sources; positions by the closed form."""
    whole = [mixing.integral(s) for s in mixing.SCHEDULES]
    kinds = []
    for kind, schedule in enumerate(mixing.SCHEDULES):
        before, pieces = 0.0, []
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            slope, area = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
            pieces.append(
                f"WHEN goal < {before + area!r}::DOUBLE THEN {t0!r}::DOUBLE + 2 * (goal - {before!r}::DOUBLE) / ({w0!r}::DOUBLE"
                f" + sqrt({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * (goal - {before!r}::DOUBLE)))")
            before += area
        kinds.append(f"WHEN kind = {kind} THEN CASE {' '.join(pieces)} ELSE 1.0 END")
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{BLANKS}'))::BIGINT AS size,
                  md5(doc_id::VARCHAR) AS k FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
      FROM d GROUP BY source),
w AS (SELECT *, [{whole[0]!r}, {whole[1]!r}, {whole[2]!r}][kind + 1]::DOUBLE AS weight, 2 * total AS most FROM s),
o AS (SELECT *, row_number() OVER f AS n,
             ({mixing.SHARE!r}::DOUBLE * (SELECT sum(total) FROM w) - coalesce(sum(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW f AS (ORDER BY most / weight, kind, source NULLS FIRST)),
water AS (SELECT arg_min(level, n) AS water FROM o WHERE level * weight < most),
goal AS (SELECT source, kind, total::BIGINT AS source_size, coalesce(least(most, water * weight), most) AS target
         FROM o LEFT JOIN water ON true),
r AS (SELECT d.doc_id, size, source_size, target, kind, floor(target)::BIGINT AS cap,
             (sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
      FROM d JOIN goal g ON g.source IS NOT DISTINCT FROM d.source),
p AS (SELECT *, greatest(0, least(size, cap - start)) AS one, greatest(0, least(size, cap - source_size - start)) AS two,
             start::DOUBLE / nullif(target, 0) * [{whole[0]!r}, {whole[1]!r}, {whole[2]!r}][kind + 1]::DOUBLE AS goal FROM r)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
       CASE WHEN one > 0 THEN CASE {' '.join(kinds)} END END AS position
FROM p"""


SUBSTRING_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS m
        FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM docs)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
new AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM again),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM new),
span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM run GROUP BY doc_id, g),
edge AS (SELECT doc_id, coalesce(lag(b) OVER o, 0) AS kept_from, a AS kept_to, b - a AS gone FROM span
         WINDOW o AS (PARTITION BY doc_id ORDER BY a)
         UNION ALL SELECT doc_id, max(b), NULL, 0 FROM span GROUP BY doc_id),
kept AS (SELECT e.doc_id, sum(gone) AS n_removed, count(*) - 1 AS n_spans,
                string_agg(substr(h, (2 * kept_from + 1)::BIGINT, (2 * (coalesce(kept_to, length(h) // 2) - kept_from))::BIGINT), ''
                           ORDER BY kept_from) AS k
         FROM edge e JOIN docs d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT docs.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id"""


FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS s FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
             ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
             greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS f FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || f || '<M>' || m
              ELSE '<S>' || f || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


# The checksum goes byte by byte over its table of 256 entries; words are compared with one
# letter masked (replacements) or left out (deletions).
SPELLING_VARIANTS = r"""
WITH RECURSIVE crc AS (
    SELECT list(v ORDER BY i) AS crc FROM (
        SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) r(i))),
runs AS (SELECT doc_id, run, count(*) AS k FROM (
             SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
         WHERE length(run) >= 6 GROUP BY ALL),
drawn AS (SELECT run, k, xor(list_reduce([4294967295] || flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
              ELSE [195, unicode(c) - 64] END for c in string_split(doc_id || ':' || run, '')]),
              lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
          FROM runs, crc),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (
              SELECT CASE WHEN h % 199 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, k
              FROM drawn)
          WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS less FROM place),
mask AS (SELECT word, n, i, word[:i - 1] || '*' || word[i + 1:] AS masked FROM place),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM mask a JOIN mask b ON a.masked = b.masked AND a.word <> b.word
         UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
         UNION ALL SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
best AS (SELECT word, n, count(*) AS n_near, max(other_n) AS top, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word, n),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * words.n THEN other END AS form,
                 CASE WHEN top >= 5 * words.n THEN top END AS form_n
          FROM words LEFT JOIN best ON best.word = words.word),
walk(word, last) AS (SELECT word, word FROM forms UNION ALL
                     SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.last WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.last AS root FROM walk w JOIN forms f ON f.word = w.last AND f.form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON ends.word = forms.word"""


EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
           WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings
                         UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN degree USING (vec_id)"""


def all_oracles() -> dict[str, str]:
    return {
        "op1_license_scans": license_scans(),
        "op2_minhash_near_dedup": minhash_near_dedup(),
        "op4_url_filters": URL_FILTERS,
        "op5_exact_dedup": EXACT_DEDUP,
        "op6_warc": WARC,
        "op7_source_mixing": source_mixing(),
        "op8_substring_dedup": SUBSTRING_DEDUP,
        "op11_fill_in_middle": FILL_IN_MIDDLE,
        "op12_spelling_variants": SPELLING_VARIANTS,
        "op13_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    }
