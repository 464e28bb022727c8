"""DuckDB SQL for the operators that SQL can express over whole tables."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
        FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13 AND doc_id IS NOT NULL)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
late AS (SELECT r, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE doc_id > m),
hit AS (SELECT DISTINCT r, p FROM late),
word AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.r, count(*) AS n_words, count(hit.r) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (hit.r IS NULL) AS t
         FROM word LEFT JOIN hit ON word.r = hit.r AND word.p = hit.p GROUP BY word.r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.r, k.doc_id, line, p, coalesce(k.doc_id <> last, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
item AS (SELECT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
         FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
size AS (SELECT DISTINCT n FROM item),
win AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
        FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, size WHERE len(ws) >= n)),
found AS (SELECT win.r, win.n, i, item_id FROM win JOIN item ON win.k = item.k AND win.n = item.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
name AS (SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS names
         FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM found) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CASE WHEN len(ws) = 0 THEN 0.0 ELSE coalesce(n_hit, 0)::DOUBLE / len(ws) END AS coverage
FROM d LEFT JOIN hit USING (r) LEFT JOIN name USING (r)
"""

ORACLE: dict[str, str] = {"op2_substring_dedup": SUBSTRINGS, "op4_line_dedup": LINES, "op6_decontaminate": CONTAMINATION}


def _crc_table() -> str:
    """The 256 steps of crc32 as an SQL list."""
    steps = list(range(256))
    for _ in range(8):
        steps = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in steps]
    return f"[{', '.join(map(str, steps))}]::BIGINT[]"


IMPORTANCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
size AS (SELECT unnest([1, 2, 3]) AS n),
gram AS (SELECT r, g, count(*) AS m FROM (SELECT r, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
         FROM d, size WHERE len(ws) >= n) GROUP BY r, g),
want AS (SELECT g, count(*) AS m FROM (SELECT unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
         FROM b, size WHERE len(ws) >= n) GROUP BY g),
bytes AS (SELECT g, list_transform(range(0, length(hex(encode(g))) // 2), lambda i: CAST('0x' || substr(hex(encode(g)), 2 * i + 1, 2) AS BIGINT)) AS x
          FROM (SELECT g FROM gram UNION SELECT g FROM want)),
place AS (SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), x), lambda c, k: xor(c >> 8, ({_crc_table()})[(xor(c, k) & 255) + 1])),
                        CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM bytes),
corpus AS (SELECT bucket, sum(m) AS s FROM gram JOIN place USING (g) GROUP BY bucket),
target AS (SELECT bucket, sum(m) AS t FROM want JOIN place USING (g) GROUP BY bucket),
every AS (SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS v
         FROM corpus LEFT JOIN target USING (bucket), every),
own AS (SELECT r, sum(m)::BIGINT AS n_features, sum(m * v)::BIGINT AS weight FROM gram JOIN place USING (g) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
           + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM d LEFT JOIN own USING (r)),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, 5 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank, n_words FROM scored LEFT JOIN able USING (r)
"""

ORACLE["op12_importance"] = IMPORTANCE


TRIE = rf"""
WITH t AS (SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS k
           FROM (SELECT conv_id, turn, left(sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS digest,
                        strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL)),
id AS (SELECT conv_id, list_transform(range(0, length(hex(encode(c))) // 2), lambda i: CAST('0x' || substr(hex(encode(c)), 2 * i + 1, 2) AS BIGINT)) AS x
       FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c FROM t)),
conv AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), x), lambda c, k: xor(c >> 8, ({_crc_table()})[(xor(c, k) & 255) + 1])),
                             CAST(4294967295 AS BIGINT)) % 9 AS h FROM id),
every AS (SELECT conv.conv_id, 0 AS of, k, digest, size FROM conv JOIN t ON t.conv_id = conv.conv_id - conv.conv_id % 5 AND k < h
          UNION ALL SELECT conv.conv_id, 1, k, digest, size FROM conv JOIN t ON t.conv_id = conv.conv_id AND k >= h),
turn AS (SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY of, k) AS d FROM every),
prefix AS (SELECT conv_id, 0 AS d, '' AS name, 0 AS size FROM conv
           UNION ALL SELECT conv_id, d, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d), size FROM turn),
node AS (SELECT name, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM prefix GROUP BY name, d),
kids AS (SELECT left(name, length(name) - 32) AS name, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
below AS (SELECT a.name, sum((u.n_convs - 1) * u.size) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
          FROM node u LEFT JOIN kids USING (name) JOIN prefix a ON a.conv_id = u.conv_id AND a.d <= u.d GROUP BY a.name),
size AS (SELECT conv_id, max(d) AS n FROM prefix GROUP BY conv_id),
ends AS (SELECT name, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM prefix JOIN size USING (conv_id) WHERE d = n GROUP BY name)
SELECT node.conv_id, node.d::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below ON below.name = node.name LEFT JOIN kids ON kids.name = node.name LEFT JOIN ends ON ends.name = node.name
LEFT JOIN node up ON node.d > 0 AND up.name = left(node.name, length(node.name) - 32)
"""

ORACLE["op13_prefix_trie"] = TRIE
