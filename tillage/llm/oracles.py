"""The operators that SQL can express, as DuckDB SQL over the given tables: plain definitions, no anchors, seeds or trees."""

SUBSTRINGS = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
  f AS (SELECT k, min({'d': doc_id, 'i': i}) AS f FROM win GROUP BY k),
  later AS (SELECT doc_id, i FROM win JOIN f ON f.k = win.k WHERE doc_id > f.d OR (doc_id = f.d AND i > f.i)),
  gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, range(20) t(j)),
  words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d),
  kept AS (SELECT words.doc_id, string_agg(w, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY 1),
  lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
  SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id"""

NEAR = """WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
  pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b, c = x.n AND c = y.n AS same FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
  reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
  class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY 1), links AS (SELECT a, count(*) AS k, count(*) FILTER (same) AS s FROM link GROUP BY 1)
  SELECT d.doc_id, class_id, coalesce(k, 0) AS n_links, coalesce(s, 0) + 1 AS n_copies FROM d JOIN class ON class.a = d.doc_id LEFT JOIN links ON links.a = d.doc_id"""

BENCHMARK = """WITH dl AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
  il AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
  dw AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS p FROM dl),
  iw AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS k FROM il WHERE len(w) >= 6),
  d3 AS (SELECT doc_id, p, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS s FROM dw WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
  i3 AS (SELECT item_id, k, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS s FROM iw WINDOW o AS (PARTITION BY item_id ORDER BY k)),
  diag AS (SELECT DISTINCT doc_id, item_id, p - k AS shift FROM d3 JOIN i3 ON d3.s = i3.s),
  e AS (SELECT g.doc_id, g.item_id, shift, k, least(13, n) AS span, (i.w = d.w)::INT AS eq FROM diag g JOIN iw i ON i.item_id = g.item_id JOIN dw d ON d.doc_id = g.doc_id AND d.p = k + shift),
  s AS (SELECT a.doc_id, a.item_id, a.k + a.shift AS start, a.span, sum(b.eq) AS m FROM e a JOIN e b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.shift = a.shift
    AND b.k BETWEEN a.k AND a.k + a.span - 1 GROUP BY a.doc_id, a.item_id, a.shift, a.k, a.span HAVING count(*) = a.span AND sum(b.eq) * 13 >= a.span * 11),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, start, span DESC) AS rank FROM s)
  SELECT doc_id, item_id, start::BIGINT AS start, m::BIGINT AS matched, span::BIGINT AS compared FROM r WHERE rank = 1"""
