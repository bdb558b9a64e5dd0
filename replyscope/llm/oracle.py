"""DuckDB SQL of the queries that SQL can express."""

from replyscope.llm.licenses import RULES, SENTENCES

MIX = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || md5(COALESCE(text, ''))) AS r
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2.0::DOUBLE AS cap FROM per
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per) * 1.5::DOUBLE
             - COALESCE(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), target AS (
  SELECT *, least(cap, COALESCE((SELECT max(level) FROM levels WHERE level * w <= cap) * w, cap)) AS target FROM levels
), size_of_block AS (
  SELECT CAST(least(greatest(floor(sum(target) / 262144), 1), 1024) AS BIGINT) AS block FROM target
), need AS (
  SELECT no, source_size, CAST(ceil(target / block) AS HUGEINT) AS need FROM target, size_of_block
), parts AS (
  SELECT no, source_size, COALESCE(sum(need) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, need, sum(need) OVER () AS total FROM need
), edges AS (
  SELECT no, source_size, CAST(lo AS HUGEINT) * 18446744073709551616 // CAST(total AS HUGEINT) AS a,
         CAST(lo + need AS HUGEINT) * 18446744073709551616 // CAST(total AS HUGEINT) AS b
  FROM parts WHERE need > 0
), points AS (
  SELECT slot, CAST(slot AS HUGEINT) * 11400714819323198485 % 18446744073709551616 AS u
  FROM (SELECT unnest(range(0, (SELECT CAST(sum(need) AS BIGINT) FROM need))) AS slot)
), slots AS (
  SELECT no, source_size, slot, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS nth FROM points JOIN edges ON u >= a AND u < b
), ends AS (
  SELECT no, least(count(*) * (SELECT block FROM size_of_block), 2 * any_value(source_size)) AS stop FROM slots GROUP BY no
), placed AS (
  SELECT s.doc_id, size, target.no, target.source_size, target, COALESCE(stop, 0) AS stop, r,
         CAST(sum(size) OVER (PARTITION BY target.no ORDER BY r, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS place, row_number() OVER () AS row_no
  FROM sizes s JOIN target ON s.source IS NOT DISTINCT FROM target.source LEFT JOIN ends ON ends.no = target.no
), passes AS (
  SELECT row_no, no, place + p * source_size AS lo, least(place + p * source_size + size, stop) AS hi
  FROM placed, (SELECT unnest([0, 1]) AS p) WHERE size > 0 AND place + p * source_size < stop
), cut AS (
  SELECT row_no, sum(hi - lo) AS taken, sum((hi - 1) // block - lo // block + 1) AS n_slots, min(lo // block) AS nth, any_value(no) AS no
  FROM passes, size_of_block GROUP BY row_no
)
SELECT doc_id, size, placed.source_size, target, CAST(COALESCE(taken, 0) AS BIGINT) AS taken, slot AS first_slot, CAST(COALESCE(n_slots, 0) AS BIGINT) AS n_slots
FROM placed LEFT JOIN cut USING (row_no) LEFT JOIN slots ON slots.no = cut.no AND slots.nth = cut.nth
"""

TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

NEAR = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM link GROUP BY a
)
SELECT e.vec_id, COALESCE(n.n_links, 0) AS n_links, COALESCE(low.component_id, e.vec_id) AS component_id,
       COALESCE(e.vec_id = COALESCE(low.component_id, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN low ON e.vec_id = low.a LEFT JOIN n ON e.vec_id = n.a
"""

LINES = r"""
WITH doc AS (
  SELECT doc_id, COALESCE(text, '') AS t FROM documents
), line AS (
  SELECT doc_id, i, part, strlen(t) AS n, len(parts) AS n_parts,
         trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, t, string_split(t, chr(10)) AS parts FROM doc), LATERAL (SELECT unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i)
), placed AS (
  SELECT *, CAST(sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(part) - 1 AS BIGINT) AS start FROM line
), ranked AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS gone,
         norm <> '' AND count(*) OVER (PARTITION BY norm) > 1 AS shared, len(string_split(norm, ' ')) AS words,
         least(start + strlen(part) + 1, n) AS stop
  FROM placed
), runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, shared ORDER BY i) AS run FROM ranked
), passages AS (
  SELECT *, shared AND sum(words) OVER (PARTITION BY doc_id, shared, run) > 20 AS passage FROM runs
)
SELECT doc_id, any_value(n) AS n_bytes, CASE WHEN any_value(n) > 0 THEN any_value(n_parts) ELSE 0 END AS n_units,
       CAST(COALESCE(sum(stop - start) FILTER (gone), 0) AS BIGINT) AS n_removed, count(*) FILTER (gone) AS n_spans,
       COALESCE(list([start, stop] ORDER BY start) FILTER (gone), []) AS removed,
       sha256(COALESCE(string_agg(part || CASE WHEN i < n_parts THEN chr(10) ELSE '' END, '' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256,
       CAST(COALESCE(sum(stop - start) FILTER (passage), 0) AS BIGINT) AS shared_passages,
       CAST(COALESCE(sum(stop - start) FILTER (passage AND gone), 0) AS BIGINT) AS removed_passages
FROM passages GROUP BY doc_id
"""

AUDIT = r"""
WITH doc AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), first AS (
  SELECT t, min(doc_id) AS first_id FROM doc GROUP BY t
), mark AS (
  SELECT doc_id, COALESCE(bool_or(quality = 1), false) AS good, COALESCE(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), class AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                regexp_matches(t, '[#$%&*|]'), COALESCE(first_id < doc.doc_id, false)] AS fails,
         COALESCE(good, false) AS good, COALESCE(toxic, false) AS toxic, count(*) AS n
  FROM doc JOIN first USING (t) LEFT JOIN mark ON doc.doc_id = mark.doc_id GROUP BY ALL
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), fate AS (
  SELECT part, filter_order, good, toxic, n, fails, list_transform(string_split(filter_order, ''), lambda x: fails[ascii(x) - 64]) AS hit
  FROM class, orders
), step AS (
  SELECT *, unnest([1, 2, 3, 4, 5]) AS step, COALESCE(NULLIF(list_position(hit, true), 0), 6) AS gone FROM fate
), total AS (
  SELECT part, filter_order, step, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
         sum(n) FILTER (hit[step] AND gone < step) AS redundant, sum(n) FILTER (hit[step] AND len(list_filter(hit, lambda x: x)) = 1) AS unique_fails,
         sum(n) FILTER (gone = step AND good) AS good_lost, sum(n) FILTER (gone = step AND toxic) AS toxic_lost
  FROM step GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(COALESCE(kept, 0) AS BIGINT) AS kept, CAST(COALESCE(removed, 0) AS BIGINT) AS removed,
       CAST(COALESCE(redundant, 0) AS BIGINT) AS redundant, CAST(COALESCE(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(COALESCE(good_lost, 0) AS BIGINT) AS good_lost, CAST(COALESCE(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(COALESCE(sum(removed) OVER (PARTITION BY part, filter_order[step]), 0) AS BIGINT) AS shapley
FROM total
"""

WARC = """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS html FROM pages
), one AS (
  SELECT html, max(page_id) AS last_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p GROUP BY html
), digest AS (
  SELECT html, last_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS UBIGINT) >> (35 - 5 * (i % 8))::UBIGINT) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest
  FROM one
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN last_id IS NULL OR page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last_id IS NULL OR page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM p JOIN digest USING (html)
"""


def _scan() -> str:
    quoted = ", ".join(f"'{s}'" for s in SENTENCES.values())
    ids = ", ".join(f"'{i}'" for i in SENTENCES)
    sql = f"""
WITH known AS (SELECT [{quoted}] AS sentences, [{ids}] AS ids),
seq AS (
  SELECT doc_id, list_filter(list_transform(
      string_split(regexp_replace(COALESCE(text, ''), '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)),
      lambda s: ids[list_position(sentences, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))]), lambda x: x IS NOT NULL) AS sentence_ids
  FROM documents, known
), r0 AS (
  SELECT doc_id, sentence_ids, '|' || array_to_string(list_transform(sentence_ids, lambda x: '<' || x || '>'), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM seq
)"""
    for i, (name, run) in enumerate(RULES):
        part = "".join(f"<{x}>" for x in run)
        sql += f""", r{i + 1} AS (
  SELECT doc_id, sentence_ids, replace(rest, '{part}', '|') AS rest, CASE WHEN contains(rest, '{part}') THEN list_append(found, '{name}') ELSE found END AS found
  FROM r{i}
)"""
    licenses = "list_filter(found, lambda x, i: list_position(found, x) = i)"
    return sql + f"\nSELECT doc_id, sentence_ids, {licenses} AS licenses, regexp_extract_all(rest, '<([^>]*)>', 1) AS unmatched FROM r{len(RULES)}"


SQL = {
    "op3_license_scan": _scan(),
    "op4_mix_sources": MIX,
    "op5_exact_top_k": TOP_K,
    "op6_line_dedup": LINES,
    "op9_embedding_dedup": NEAR,
    "op11_filter_audit": AUDIT,
    "op13_warc_archive": WARC,
}
