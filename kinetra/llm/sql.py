"""DuckDB SQL of the operators whose queries need more than a few lines of it."""

from __future__ import annotations

UPPER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of a string's UTF-8 bytes, four bits at a time."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    digits = f"hex(encode({text}))"
    nibbles = f"flatten(list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: [instr('0123456789ABCDEF', {digits}[i + 1]) - 1, instr('0123456789ABCDEF', {digits}[i]) - 1]))"
    step = f"lambda a, b: xor(list_extract(CAST([{', '.join(map(str, table))}] AS BIGINT[]), CAST(xor(a & 15, b) AS INTEGER) + 1), a >> 4)"
    return f"xor(list_reduce({nibbles}, {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


OP12_SQL = """
WITH RECURSIVE own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, h FROM (SELECT DISTINCT c, CRC AS v FROM own), LATERAL (SELECT v % 4 AS h)),
heads AS (SELECT cs.c, own.p, role, text FROM cs JOIN own ON own.c = cs.c - cs.c % 20 AND own.p <= h),
k AS (SELECT cs.c, h, count(heads.p) AS k FROM cs LEFT JOIN heads USING (c) GROUP BY cs.c, h),
turns AS (SELECT c, p, role, text FROM heads UNION ALL SELECT own.c, own.p - h + k, role, text FROM own JOIN k USING (c) WHERE own.p > h),
pre AS (SELECT c, p AS d, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY p)) AS node, text FROM turns UNION ALL SELECT c, 0, 'root', '' FROM cs),
ends AS (SELECT c, max(d) AS d FROM pre GROUP BY c),
n AS (SELECT node, d AS depth, min(pre.c) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS words, coalesce(string_agg(CAST(ends.c AS VARCHAR), ',' ORDER BY ends.c) FILTER (WHERE ends.c IS NOT NULL), '') AS ids
  FROM pre LEFT JOIN ends USING (c, d) GROUP BY node, d),
up AS (SELECT n.node, par.node AS parent, p2.conv_id AS parent_conv_id FROM n JOIN pre par ON par.c = n.conv_id AND par.d = n.depth - 1 JOIN n p2 ON p2.node = par.node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
anc AS (SELECT node AS top, node FROM n UNION ALL SELECT anc.top, up.node FROM anc JOIN up ON up.parent = anc.node),
sums AS (SELECT top AS node, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (WHERE kids.node IS NULL) AS n_leaves FROM anc JOIN n USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ids) AS ends_sha256
FROM n LEFT JOIN up USING (node) LEFT JOIN kids USING (node) JOIN sums USING (node)
""".replace("CRC", crc32_sql("CAST(conv_id AS VARCHAR)").replace("conv_id", "c"))

OP13_SQL = (
    """
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS raw FROM documents),
c0 AS (SELECT d, run, count(*) AS k FROM (SELECT d, LOWERED AS run FROM runs) GROUP BY d, run),
c1 AS (SELECT run, k, CRC AS h FROM c0),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM c1) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
wild AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS key FROM places),
gone AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS key FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT g.word, v.word, v.n FROM gone g JOIN v ON v.word = g.key UNION ALL SELECT v.word, g.word, g.n FROM gone g JOIN v ON v.word = g.key),
best AS (SELECT word, n_near, other, m FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near) WHERE k = 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word JOIN f AS e ON e.word = chain.at AND e.form IS NULL
""".replace("LOWERED", UPPER_SQL.format("raw"))
    .replace("CRC", crc32_sql("d || ':' || run"))
)
