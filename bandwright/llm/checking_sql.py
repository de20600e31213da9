"""DuckDB SQL for the queries that SQL can express."""

# Windows of ten words (fewer where the item has fewer) of the items, found at word places of the documents.
OP1 = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)
), gram AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT gram.doc_id, gram.i, gram.n, win.item FROM gram JOIN win USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# Every pair with a common shingle, its exact similarity, then reachability.
OP7 = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), gram AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM doc WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least_id AS component_id
FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) ON a = doc.doc_id
"""

OP8 = r"""
WITH doc AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY doc_id
), fig AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM doc LEFT JOIN rep USING (doc_id)
), ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.3 * n_words OR n_dup_lines > 3 AS failed,
    n_symbols > 0.15 * n_words OR n_dup_lines > 1.5 OR 100 * n_repeat_words > 25 * n_words AS suspect
  FROM fig
), host AS (SELECT source, count(*) AS n, sum(CAST(failed AS INT)) AS f FROM ruled GROUP BY source
), fit AS (
  SELECT least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS mean, var_pop(f / n) AS v, avg(1.0 / n) AS i FROM host
), prior AS (
  SELECT mean, greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) * i, 1e-9) - 1, 1.0) AS weight FROM fit
), verdict AS (SELECT source, (f + mean * weight) / (n + weight) AS host_rate FROM host, prior)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT (host_rate > 0.5 AND suspect) AS kept
FROM ruled r JOIN verdict v ON r.source IS NOT DISTINCT FROM v.source
"""

# All phrases of up to three words, every cut, and every longer phrase around a pair.
OP11 = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS p
  FROM documents
), line AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), gram AS (
  SELECT lang, 1 AS k, unnest(w) AS g FROM line
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM line
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM line
), f AS (SELECT lang, k, g, CAST(count(*) AS HUGEINT) AS n, string_split(g, ' ') AS w FROM gram GROUP BY lang, k, g
), cuts AS (
  SELECT c.lang, c.g, c.k, c.n AS a, j, array_to_string(c.w[1:j], ' ') AS head, array_to_string(c.w[j + 1:], ' ') AS tail
  FROM f c, (SELECT unnest([1, 2]) AS j) WHERE c.k > 1 AND c.n >= 10 AND j < c.k
), valued AS (
  SELECT cuts.*, x.n AS l, y.n AS r, 1000000 * a * a // (x.n * y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = head AND x.k = j JOIN f y ON y.lang = cuts.lang AND y.g = tail AND y.k = cuts.k - j
), lowest AS (
  SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), inside AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS g, n FROM f WHERE k = 3 AND n >= 10
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), n FROM f WHERE k = 3 AND n >= 10
), longest AS (SELECT lang, g, max(n) AS m FROM inside GROUP BY lang, g
), kept AS (
  SELECT v.* FROM lowest v LEFT JOIN longest e ON e.lang = v.lang AND e.g = v.g AND v.k = 2 WHERE e.m IS NULL OR 100 * e.m < 50 * v.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept
), total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(total.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

# Every group and language against every kept term, absent ones included.
OP12 = r"""
WITH doc AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), tok AS (SELECT lang, source, d, unnest(w) AS term FROM doc
), kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), own AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term
), grp AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM doc) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY lang, source) t ON t.lang = g.lang AND t.source = g.source
), voc AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), share AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(own.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(own.n, 0) + 1) // CAST(grp.total + voc.v AS HUGEINT) AS BIGINT) AS p,
    CAST(1 + 1000000000 * (kept.n + 1) // CAST(voc.total + voc.v AS HUGEINT) AS BIGINT) AS q
  FROM grp JOIN voc USING (lang) JOIN kept USING (lang) LEFT JOIN own ON own.lang = grp.lang AND own.source = grp.source AND own.term = kept.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM share WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM part)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

SQL = {"op1_decontamination": OP1, "op7_jaccard_join": OP7, "op8_quality_rules": OP8, "op11_collocations": OP11, "op12_source_divergence": OP12}
