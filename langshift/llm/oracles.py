"""DuckDB SQL for those of the numbered queries that SQL can express."""

from __future__ import annotations

from .license_scan import ASIDE, ENDS, LICENCE_WORDS, SPDX, SPDX_LINE, Tables, sequence_text

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH digests AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM digests GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM digests JOIN groups USING (text_sha256)
"""

WARC = """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM payloads LEFT JOIN firsts USING (payload_digest)
"""

NEAREST = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
WHERE rank <= 5
"""


def licenses() -> str:
    """The licence scan by joins: each run of lines of a piece with the known sentences, each document's
    sequence with one rule after the other."""
    tables = Tables()
    sentences = tables.normalised()
    known = ", ".join(f"('{s}', '{i}')" for s, i in sentences.items())
    ordered = ", ".join(f"({n}, '{licence}', '{sequence_text(ids)}')" for n, (licence, ids) in enumerate(tables.rules))
    most = max(len(s.split()) for s in sentences)
    normal = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'))"
    last = ", ".join(f"'{licence}'" for licence in sorted(tables.last))
    spdx = normal.format("regexp_replace(x, '([0-9])\\+', '\\1 or later', 'g')")
    members = f"string_split(replace(replace(replace({spdx}, ' or later', ' orlater'), ' or ', '|{SPDX_LINE}'), ' and ', '|{SPDX_LINE}'), '|')"
    one = "regexp_replace(replace(y, ' orlater', ' or later'), ' with .*$', '')"
    aside = normal.format(f"regexp_replace(x, '{ASIDE}', ' ', 'g')")
    lines = f"CASE WHEN contains(x, 'spdx') AND contains({spdx}, '{SPDX_LINE}') THEN list_transform({members}, lambda y: {one}) ELSE [{aside}] END"
    return f"""
WITH RECURSIVE known(sentence, identifier) AS (VALUES {known}), rules(n, licence, run) AS (VALUES {ordered}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '{SPDX}', '\\1 ', 'g') AS body FROM documents),
pieces AS MATERIALIZED (
  SELECT r, p, list_filter(flatten(list_transform(string_split(piece, chr(10)), lambda x: {lines})), lambda x: x <> '') AS own
  FROM (SELECT r, unnest(cut) AS piece, generate_subscripts(cut, 1) AS p FROM (SELECT r, regexp_split_to_array(body, '{ENDS}') AS cut FROM docs))),
firsts AS (SELECT r, p, own, unnest(range(1, len(own) + 1)) AS i FROM pieces),
runs AS (SELECT r, p, own, i, unnest(range(i, least(len(own), i + {most} - 1) + 1)) AS j FROM firsts),
matched AS (
  SELECT r, p, i, max(j) AS j, max_by(identifier, j) AS identifier
  FROM runs JOIN known ON array_to_string(own[i:j], ' ') = sentence GROUP BY r, p, i),
kept AS MATERIALIZED (
  SELECT * FROM (SELECT *, max(j) OVER (PARTITION BY r, p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM matched)
  WHERE before IS NULL OR j > before),
sequences AS (SELECT r, string_agg(identifier, ',' ORDER BY p, i) AS ids, string_agg(',' || identifier || ',', '' ORDER BY p, i) AS rest FROM kept GROUP BY r),
steps AS (
  SELECT r, 0 AS n, rest, '' AS found FROM sequences
  UNION ALL
  SELECT r, steps.n + 1, replace(rest, run, '|'), CASE WHEN contains(rest, run) THEN found || licence || ',' ELSE found END FROM steps JOIN rules ON rules.n = steps.n),
ends AS (SELECT r, rest, list_filter(string_split(found, ','), lambda x: x <> '') AS every, list_filter(every, lambda x: x NOT IN ({last})) AS own, CASE WHEN len(own) > 0 THEN own ELSE every END AS found FROM steps WHERE n = {len(tables.rules)}),
talk AS (
  SELECT r, count(*) AS unknown FROM pieces
  WHERE regexp_matches(array_to_string(own, ' '), '{LICENCE_WORDS}') AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.r = pieces.r AND k.p = pieces.p) GROUP BY r)
SELECT doc_id, coalesce(ids, '') AS sentence_ids,
       coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licenses,
       coalesce(array_to_string(list_filter(string_split(replace(e.rest, '|', ','), ','), lambda x: x <> ''), ','), '') AS unmatched,
       coalesce(unknown, 0) AS unknown_sentences
FROM docs LEFT JOIN sequences s USING (r) LEFT JOIN (SELECT r, rest AS rest, found FROM ends) e USING (r) LEFT JOIN talk USING (r)
"""


FILTER_AUDIT = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
flags AS (
  SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e FROM split),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM flags LEFT JOIN said USING (doc_id)),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
replayed AS (
  SELECT part, filter_order, good, toxic, fails, coalesce(list_min(list_transform(list_filter(string_split(fails, ''), lambda f: f <> ''), lambda f: instr(filter_order, f))), 6) AS first_step FROM docs, orders),
steps AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM replayed),
counted AS (
  SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS filter, count_if(first_step > step)::BIGINT AS kept, count_if(first_step = step)::BIGINT AS removed,
         count_if(first_step < step AND contains(fails, filter_order[step]))::BIGINT AS redundant, count_if(fails = filter_order[step])::BIGINT AS unique_fails,
         count_if(first_step = step AND good)::BIGINT AS good_lost, count_if(first_step = step AND toxic)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""


HARD_NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM usable a JOIN usable c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same) WHERE r <= 5),
ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


ORACLES = {"op5_exact_dedup": EXACT_DEDUP, "op7_warc": WARC, "op10_licenses": licenses(), "op12_hard_negatives": HARD_NEGATIVES, "op13_filter_audit": FILTER_AUDIT}
