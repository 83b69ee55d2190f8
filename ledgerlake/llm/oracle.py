"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), wins AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS t
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), firsts AS (SELECT t, min(doc_id) AS first FROM wins GROUP BY t),
hit AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM wins JOIN firsts USING (t) WHERE first < coalesce(doc_id, 9223372036854775807)
), gone AS (SELECT r, list(j) AS js FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, k: js IS NULL OR NOT list_contains(js, k)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

OP7 = rf"""
WITH sized AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sums
), filled AS (
  SELECT *, sum(cap) OVER o - cap AS spent, sum(w) OVER () - sum(w) OVER o + w AS free,
    1.5::DOUBLE * sum(source_size) OVER () AS goal, row_number() OVER o AS k
  FROM weighed WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), unit AS (
  SELECT coalesce(arg_min((goal - spent) / free, k) FILTER ((goal - spent) / free <= cap / w), 0) AS u FROM filled
), targets AS (
  SELECT source, source_size, least(cap, u * w) AS target FROM filled, unit
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
    ('0x' || md5('mix-1:' || coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, ''))))[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

OP8 = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), lens AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hits AS (SELECT p.r, p.i, p.n, win.item_id FROM places p JOIN win ON p.t = win.t AND p.n = win.n),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, 'null') AS item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP9 = rf"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '{WS}', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM rows WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST)
"""


OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w))
  GROUP BY lang, k, phrase HAVING count(*) >= 100
), cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (
  SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a AS f, w, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand))
), longer AS (SELECT lang, phrase, max(f) AS most FROM inside GROUP BY lang, phrase),
kept AS (SELECT c.* FROM cand c LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:k], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)
), rated AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score, cut
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


# Every pair is compared, so the SQL is for small tables; the search has to find all of them here.
OP11 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND list_max(list_transform(embedding, lambda x: abs(x))) > 0, false) AS valid
  FROM embeddings
), u AS MATERIALIZED (SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v WHERE valid),
link AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) / (a.size * b.size) >= 0.95
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(vec_id) AS least FROM reach JOIN v ON v.r = b GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, low.least) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, low.least) AS kept
FROM v LEFT JOIN deg ON deg.a = r LEFT JOIN low ON low.a = r
"""


def _clustering(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every vector against every centroid, round by round."""
    near = """
SELECT r, arg_min(i, struct_pack(d := d, i := i)) AS i, min(d) AS d FROM (
  SELECT r, i, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM kept, {c}
) GROUP BY r"""
    out = f"""
WITH numbered AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
kept AS MATERIALIZED (
  SELECT r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM numbered
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS i, v AS c
  FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k})
)"""
    for t in range(rounds):
        out += f""", a{t} AS MATERIALIZED ({near.format(c=f"c{t}")}),
m{t} AS (
  SELECT i, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c
  FROM (SELECT i, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT i, unnest(v) AS x, unnest(range({dims})) AS j FROM a{t} JOIN kept USING (r)) GROUP BY i, j)
  GROUP BY i
), c{t + 1} AS MATERIALIZED (SELECT i, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (i))"""
    return out + f""", last AS MATERIALIZED ({near.format(c=f"c{rounds}")})
SELECT vec_id, i::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY i))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN kept USING (r) JOIN c{rounds} USING (i)
"""


SQL: dict[str, str] = {
    "op5_substring_dedup": OP5,
    "op7_mix_sources": OP7,
    "op8_decontaminate": OP8,
    "op9_exact_dedup": OP9,
    "op11_vector_links": OP11,
    "op12_centroid_clustering": _clustering(),
    "op13_phrase_collocations": OP13,
}
