"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .sharding import MULTIPLIER, PARTS

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM sh),
g AS (SELECT doc_id, unnest(s) AS g FROM sh),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT walk.node, e.b FROM walk JOIN e ON walk.seen = e.a)
SELECT n.doc_id, n.n::bigint AS n_shingles, c.component_id FROM n JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM walk GROUP BY 1) c USING (doc_id)"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""

#: The jump hash as a walk of at most 18 steps; states are unsigned 64-bit numbers in wide integers. The checksum
#: folds the bytes with the reflected polynomial of CRC-32.
SHARDING = f"""
WITH RECURSIVE d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, b)) AS t),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_transform(range(1, size), lambda i: ('0x' || h[2 * i - 1:2 * i])::bigint),
  lambda crc, b: xor(t[xor(crc, b) % 256 + 1], crc // 256), 4294967295))::bigint AS text_crc32 FROM d, k),
j AS (SELECT doc_id, n, -1::bigint AS b, 0::bigint AS j, ((doc_id::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint) AS s FROM d, (VALUES (16), (17)) AS v(n)
  UNION ALL SELECT doc_id, n, j, floor((j + 1)::double * (2147483648::double / ((z // 8589934592) + 1)::double))::bigint, z
  FROM (SELECT *, ((s % 4294967296) * {MULTIPLIER} + (((s // 4294967296) * {MULTIPLIER % (1 << 32)}) % 4294967296) * 4294967296 + 1) % 18446744073709551616::hugeint AS z FROM j) WHERE j < n),
o AS (SELECT doc_id, n, max(b)::int AS shard FROM j GROUP BY 1, 2),
f AS (SELECT doc_id, min(z // 8589934592)::bigint % {PARTS} AS part FROM (SELECT doc_id, (((((doc_id::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint) % 4294967296) * {MULTIPLIER}
  + (((((doc_id::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint) // 4294967296) * {MULTIPLIER % (1 << 32)}) % 4294967296) * 4294967296 + 1) % 18446744073709551616::hugeint) AS z FROM d) GROUP BY 1)
SELECT c.doc_id, c.size, c.text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY part, c.doc_id) - 1 AS slot, g.shard AS grown_shard
FROM c JOIN o a ON a.doc_id = c.doc_id AND a.n = 16 JOIN o g ON g.doc_id = c.doc_id AND g.n = 17 JOIN f ON f.doc_id = c.doc_id"""

SQL = {"op6_ngram_jaccard_join": JACCARD, "op8_sharding": SHARDING, "op10_topk": TOPK}
