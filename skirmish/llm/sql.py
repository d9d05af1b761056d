"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLE = {
    "op4_mix_sources": """
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source
), weighed AS (
  SELECT source, size, sqrt(size) AS weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 AND sum(weight) OVER () > 0
    THEN sum(size) OVER () * weight / sum(weight) OVER () / size ELSE 1.0 END AS rate
  FROM weighed
), terms AS (
  SELECT source, rate, k,
    exp(-rate) * coalesce(exp(sum(CASE WHEN k > 0 THEN ln(rate / k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k)), 1) AS p
  FROM rates, range(0, 800) AS t(k)
  WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), drawn AS (
  SELECT doc_id, source, lang, n_chars, md5(text) AS text_md5,
    '17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) AS identity
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER () AS r, (('0x' || substr(md5(identity), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM drawn
), counted AS (
  SELECT n.r, any_value(n.doc_id) AS doc_id, any_value(n.source) AS source, any_value(n.lang) AS lang,
    any_value(n.n_chars) AS n_chars, any_value(n.text_md5) AS text_md5, any_value(n.identity) AS identity, count(*) AS n_copies
  FROM numbered n JOIN cdf ON n.source IS NOT DISTINCT FROM cdf.source AND cdf.c < n.u
  GROUP BY n.r
)
SELECT doc_id, source, lang, n_chars, copy::INTEGER AS copy, md5(identity || '|' || copy::VARCHAR) AS shuffle_key, text_md5
FROM (SELECT *, unnest(range(n_copies)) AS copy FROM counted)
""",
    "op9_line_dedup": r"""
WITH pieces AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), raw AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM pieces
), e AS (
  SELECT doc_id, pos, line, w, row_number() OVER d AS i, sum(w) OVER d AS s
  FROM (SELECT *, len(regexp_extract_all(line, '[^ \t-\r]+')) AS w FROM raw) WHERE w > 0
  WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), windows AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.s - a.s + a.w >= 50 GROUP BY a.doc_id, a.i
  UNION
  SELECT b.doc_id, max(a.i), b.i FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 49 AND b.i AND b.s - a.s + a.w >= 50 GROUP BY b.doc_id, b.i
), contents AS (
  SELECT v.doc_id, v.i, v.j, min(pos) AS first, max(pos) AS last, string_agg(line, chr(10) ORDER BY pos) AS content
  FROM windows v JOIN e ON e.doc_id = v.doc_id AND e.i BETWEEN v.i AND v.j GROUP BY v.doc_id, v.i, v.j
), later AS (
  SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS n FROM contents) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later
), islands AS (
  SELECT doc_id, min(pos) AS a, max(pos) AS b FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g
), removed AS (
  SELECT doc_id, sum(b - a + 1)::BIGINT AS n_removed, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM islands GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM raw ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.removed, '') AS removed,
  md5(CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END) AS text_md5
FROM documents d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
    "op11_conversation_repair": r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS fault
  FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM source WHERE fault <> 0
), numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) AS initials
  FROM numbered
), counted AS (
  SELECT conv, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (initials NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv
), rule(s, initial, t) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ahead(s, t, cost, edits) AS (
  VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')
), step AS (
  SELECT a.s, j.conv, j.i, e.t, min({'cost': a.cost + e.cost, 'audit': a.edits || e.edit}) AS m
  FROM judged j CROSS JOIN ahead a JOIN LATERAL (
    SELECT a.t AS t, 2 AS cost, 'D' AS edit
    UNION ALL SELECT r.t, CASE j.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K' FROM rule r WHERE r.s = a.t AND r.initial = left(j.role, 1) AND j.fault NOT IN ('blank', 'duplicate')
    UNION ALL SELECT r.t, CASE j.fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R' FROM rule r WHERE r.s = a.t AND r.initial IN ('u', 'a') AND j.fault NOT IN ('blank', 'duplicate')
  ) e ON true
  GROUP BY a.s, j.conv, j.i, e.t
), dp(conv, i, s, cost, audit) AS (
  SELECT conv, 0::BIGINT, 0, 0, '' FROM counted
  UNION ALL
  SELECT conv, i, s, m.cost, m.audit FROM (
    SELECT d.conv, x.i, x.t AS s, min({'cost': d.cost + x.m.cost, 'audit': d.audit || x.m.audit}) AS m FROM dp d JOIN step x ON x.conv = d.conv AND x.i = d.i + 1 AND x.s = d.s GROUP BY d.conv, x.i, x.t
  )
), best AS (
  SELECT d.conv, min({'cost': d.cost + a.cost, 'audit': d.audit || a.edits}) AS m FROM dp d JOIN counted c ON c.conv = d.conv AND c.n = d.i JOIN ahead a ON a.s = d.s AND a.t IN (0, 3) GROUP BY d.conv
), letter AS (
  SELECT conv, unnest(string_split(m.audit, '')) AS edit, unnest(range(length(m.audit))) AS place FROM best WHERE m.audit <> ''
), placed AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS o FROM letter WINDOW w AS (PARTITION BY conv ORDER BY place)
), kept AS (
  SELECT p.conv, p.o, p.edit, j.role, CASE p.edit WHEN 'I' THEN '' ELSE j.text END AS text, max((p.o = 1 AND p.edit = 'K' AND j.role LIKE 's%')::INTEGER) OVER (PARTITION BY p.conv) AS system
  FROM placed p LEFT JOIN judged j ON j.conv = p.conv AND j.i = p.i AND p.edit <> 'I' WHERE p.edit <> 'D'
), repaired AS (
  SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o) AS whole FROM kept GROUP BY conv
), total AS (
  SELECT c.*, b.m.cost AS cost, b.m.audit AS audit, coalesce(r.whole, '') AS whole FROM counted c JOIN best b USING (conv) LEFT JOIN repaired r USING (conv)
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN total t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), token AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM token GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), size AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), cell AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM token SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, s.v,
    1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(sum(c.n) OVER (PARTITION BY g.lang, g.source), 0)::HUGEINT + 2 * s.v) AS p,
    1 + 1000000000 * (k.n + 2) // (s.total + 2 * s.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN cell c USING (lang, source, term)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), result AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM every WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM result)
WHERE part = 'pair' OR rank <= 10
""",
    "op13_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), usable AS (
  SELECT r, vec_id, label, e FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.r, b.r AS other FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reached(r, root) USING KEY (r) AS (
  SELECT r, vec_id FROM v
  UNION
  SELECT l.r, min(reached.root) FROM reached JOIN link l ON l.other = reached.r JOIN recurring.reached old ON old.r = l.r
  WHERE reached.root < old.root GROUP BY l.r
)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.r = v.r)::BIGINT AS n_links, reached.root AS component_id, v.vec_id = reached.root AS kept
FROM v JOIN reached USING (r)
""",
}
