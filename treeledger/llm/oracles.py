"""Oracle SQL of the operators that SQL can express, each by a plain definition instead of the operator's method."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = """WITH bytes AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
 crc AS (SELECT doc_id, coalesce(source, '') AS source, length(h) // 2 + 8 AS size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(h) // 2), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
   lambda a, b: xor(list_reduce([xor(a, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)), a >> 8)), 4294967295) AS text_crc32 FROM bytes),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('interleave-1' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32), doc_id, text_crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n, CAST(('0x' || substr(md5('interleave-1' || source), 1, 6)) AS BIGINT) AS off FROM crc),
 placed AS (SELECT *, row_number() OVER (ORDER BY (rank * 16777216 + off) // n, source, rank) - 1 AS place, count(*) OVER () AS total FROM ranked)
 SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 24 // total AS INTEGER) AS shard, place - ((place * 24 // total) * total + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed"""

OP3 = f"""WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
 parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
 rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
 best AS (SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
 SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best"""

_ESCAPED = "replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '#', chr(92) || '#'), '<', chr(92) || '<')"
OP6 = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
 CAST(sum(4 + length(replace({_ESCAPED.format('role')}, ':', chr(92) || ':')) + 2 + length({_ESCAPED.format('text')}) + 9) AS BIGINT) AS formatted_chars FROM turns GROUP BY conv_id"""

OP7 = f"""WITH plain AS (SELECT doc_id, length(coalesce(text, '')) AS n, translate(coalesce(text, ''), {_BLANKS}, '') AS t FROM documents),
 best AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM plain)
 SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM best"""

OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), '{_UPPER}' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '{_LOWER}' || '     '), ' '), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 reach AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON x.a = r.b)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id"""

ORACLES = {"op2_interleaved_shards": OP2, "op3_url_rules": OP3, "op6_chat_format": OP6, "op7_exact_dedup": OP7, "op8_near_dedup": OP8}
