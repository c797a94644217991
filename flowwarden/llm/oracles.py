"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

SQL: dict[str, str] = {}

SQL["op3_mixing"] = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 15))::BIGINT AS draw
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place
  FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][(place % 3 + 1)::INT]::DOUBLE AS weight, 2.0 * source_size AS most,
         1.5 * sum(source_size) OVER () AS budget
  FROM sources
), levels AS (
  SELECT *, coalesce(sum(most) OVER lower, 0.0)::DOUBLE AS held, sum(weight) OVER upper AS weights
  FROM weighed
  WINDOW lower AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upper AS (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT budget::DOUBLE - held AS left_over, weights FROM levels
  WHERE weight * (budget::DOUBLE - held) <= most * weights ORDER BY most / weight, place LIMIT 1
), aims AS (
  SELECT source, source_size, least(most::DOUBLE, weight * left_over / weights) AS target
  FROM weighed, level
), rows AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, s.draw, s.source,
         CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size) ELSE 0 END AS whole
  FROM sizes s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), running AS (
  SELECT *, target - whole * source_size AS quota,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN quota > 0 AND 2 * before + size <= 2 * quota THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""

SQL["op8_minhash"] = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) t(i)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), named AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN named ON node = d.doc_id LEFT JOIN sizes USING (doc_id)
"""

SQL["op4_top_k"] = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SQL["op7_near_vectors"] = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), named AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN named ON node = vec_id LEFT JOIN counts ON a = vec_id
"""

_URL = r"'^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)'"
_PATH = r"'^[^:/?#]+://[^/?#]*/([^/?#]*)'"
_DAY = "DATE '2024-01-01' + (page_id * {0} % 366)::INT"


def _entries(rule: str, name: str, kind: str, value: str, added: bool, factor: int) -> str:
    return (
        f"SELECT '{name}' AS list, '{kind}' AS kind, {value} AS value, {added} AS added, "
        f"{_DAY.format(factor)} AS day FROM named WHERE {rule} AND url IS NOT NULL"
    )


_LOG = " UNION ALL ".join([
    _entries("page_id % 5 = 0", "block", "host", "host", True, 13),
    _entries("page_id % 10 = 5", "block", "host", "host", False, 29),
    _entries("page_id % 97 = 1", "block", "domain", "domains[-1]", True, 17),
    _entries("page_id % 97 = 2", "block", "domain", "domains[-1]", False, 19),
    _entries("page_id % 11 = 3", "allow", "prefix", "prefix", True, 23),
    _entries("page_id % 22 = 14", "allow", "prefix", "prefix", False, 31),
])

SQL["op2_url_filters"] = rf"""
WITH hosts AS (
  SELECT *, coalesce(regexp_replace(regexp_extract(lower(url), {_URL}, 1), '\.+$', ''), '') AS host,
         {_DAY.format(37)} AS fetched
  FROM pages
), named AS (
  SELECT *, host || '/' || coalesce(regexp_extract(url, {_PATH}, 1), '') AS prefix,
         list_transform(range(1, len(string_split(host, '.'))),
           lambda i: array_to_string(string_split(host, '.')[i:], '.')) AS domains
  FROM hosts
), log AS ({_LOG}
), daily AS (
  SELECT list, kind, value, day, bool_and(added) AS added FROM log
  WHERE value IS NOT NULL AND day IS NOT NULL GROUP BY ALL
), dated AS (
  SELECT *, lead(day) OVER (PARTITION BY list, kind, value ORDER BY day) AS until FROM daily
), keys AS (
  SELECT page_id, fetched, 'host' AS kind, host AS value FROM named
  UNION ALL SELECT page_id, fetched, 'prefix', prefix FROM named
  UNION ALL SELECT page_id, fetched, 'domain', unnest(domains) FROM named
), matched AS (
  SELECT page_id, list, k.kind || ':' || k.value AS entry, day
  FROM keys k JOIN dated d ON k.kind = d.kind AND k.value = d.value AND added
   AND day <= fetched AND (until IS NULL OR fetched < until)
), found AS (
  SELECT page_id, count(*) FILTER (list = 'block') AS n_block, count(*) FILTER (list = 'allow') AS n_allow,
         min(entry) FILTER (list = 'block') AS first_block, max(day) FILTER (list = 'block') AS since
  FROM matched GROUP BY page_id
)
SELECT page_id, host, fetched, coalesce(n_block, 0) AS n_block, coalesce(n_allow, 0) AS n_allow,
       first_block, since, coalesce(n_block, 0) > 0 AND coalesce(n_allow, 0) = 0 AS blocked
FROM named LEFT JOIN found USING (page_id)
"""

SQL["op6_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|'))
          + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(13)))
          + length('<|im_start|>') + length('<|im_end|>') + 2 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

SQL["op9_warc"] = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), named AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest)
            ELSE page_id END AS first_id
  FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named
"""

SQL["op11_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
