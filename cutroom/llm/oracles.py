"""DuckDB SQL for what SQL expresses of the operators: whole results of op2 and op4, and the columns that contracts fix of others."""

from __future__ import annotations

_ALPHABET = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

QUALITY_RULES = rf"""WITH d AS (SELECT row_number() over () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_SPACED}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) AS ls FROM d),
g AS (SELECT rid, i, count(*) over (partition by rid, win) AS times FROM (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w))),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM g WHERE times > 1) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, (case when n_words < 20 then 1 else 0 end + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end + case when 10 * n_symbols > n_words then 4 else 0 end
+ case when word_chars < 2 * n_words or word_chars > 15 * n_words then 8 else 0 end + case when n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines then 16 else 0 end
+ case when n_letters >= 20 and 2 * n_capitals > n_letters then 32 else 0 end)::bigint AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits, 2 AS policy_version FROM b"""

QUALITY_ABLATION = f"""SELECT rule, sum(case when fail_bits & bit <> 0 then 1 else 0 end)::bigint AS n_failed, sum(case when fail_bits = bit then 1 else 0 end)::bigint AS n_only
FROM ({QUALITY_RULES}), (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('word_length', 8), ('repeated_lines', 16), ('capitals', 32)) r(rule, bit) GROUP BY rule"""

DECONTAMINATE = rf"""WITH i AS (SELECT coalesce(cast(item_id as varchar), '') AS item, regexp_extract_all({_ALPHABET}, '{_ALNUM}') AS ws FROM benchmark),
p AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM (SELECT *, least(10, len(ws)) AS n FROM i WHERE len(ws) > 0))),
d AS (SELECT row_number() over () AS rid, doc_id, regexp_extract_all({_ALPHABET}, '{_ALNUM}') AS ws FROM documents),
v AS (SELECT rid, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS win FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)),
h AS (SELECT rid, item, v.n, k FROM v JOIN p ON v.win = p.win AND v.n = p.n),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS q FROM h) GROUP BY rid),
f AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN f USING (rid)"""

BASE_SOURCE_MIX = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, row_number() over (order by source nulls last) AS i FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(i - 1) % 3 + 1]::double AS weight, 2.0::double * source_size AS cap FROM s),
o AS (SELECT a.source, a.cap / a.weight AS full_at, 1.5::double * (SELECT sum(source_size) FROM w) - coalesce(sum(b.cap) filter (b.cap / b.weight < a.cap / a.weight), 0) AS rest, sum(b.weight) filter (b.cap / b.weight >= a.cap / a.weight) AS open_ FROM w a, w b GROUP BY ALL),
l AS (SELECT min_by(rest / open_, full_at) AS level FROM o WHERE full_at > rest / open_)
SELECT doc_id, size, source_size, cast(round(case when level is null or cap / weight <= level then cap else weight * level end, 3) as double) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, l"""

BASE_SHARDING = """WITH RECURSIVE d AS (SELECT row_number() over () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, ('0x' || substr(md5(coalesce('=' || cast(doc_id as varchar), '-')), 1, 16))::ubigint::hugeint AS k FROM documents),
s AS (SELECT rid, k, 0::bigint AS b, 0::bigint AS j FROM d UNION ALL
SELECT rid, x, j, floor((j + 1)::double * (2147483648.0::double / ((x >> 33) + 1)::double))::bigint FROM (SELECT rid, j, (k * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint AS x FROM s WHERE j < 17)),
f AS (SELECT rid, max(b) filter (b < 16) AS shard, max(b) AS grown FROM s GROUP BY rid)
SELECT doc_id, size::bigint AS size, 'key' AS law, shard::int AS shard, grown::int AS grown_shard FROM d JOIN f USING (rid)"""

BASE_LICENSE_SCAN = rf"""WITH d AS (SELECT row_number() over () AS rid, doc_id, regexp_extract_all({_ALPHABET}, '{_ALNUM}') AS ws FROM documents),
p AS (SELECT rid, k, label FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS k FROM d), (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) AS x(phrase, label) WHERE list_slice(ws, k, k + len(phrase) - 1) = phrase),
f AS (SELECT rid, count(*) AS n, min(k) - 1 AS a, max(k) - 1 AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM p GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN f USING (rid)"""

# crc32 of the key, bit by bit
BASE_LANGUAGE_MODEL = rf"""WITH RECURSIVE d AS (SELECT row_number() over () AS rid, doc_id, coalesce(cast(doc_id as varchar), '') AS s, list_append(list_transform(regexp_extract_all({_ALPHABET}, '{_SPACED}'), lambda x: 'w' || x), 'e') AS ts FROM documents),
c AS (SELECT rid, s, 0 AS i, 4294967295::bigint AS crc FROM d UNION ALL
SELECT rid, s, i + 1, xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end) FROM (SELECT rid, s, i, case when i % 8 = 0 then xor(crc, ascii(substr(s, i // 8 + 1, 1))::bigint) else crc end AS x FROM c WHERE i < 8 * length(s))),
h AS (SELECT rid, xor(arg_max(crc, i), 4294967295::bigint) % 5 = 1 AS held_out FROM c GROUP BY rid),
t AS (SELECT rid, held_out, doc_id, unnest(ts) AS w FROM d JOIN h USING (rid)),
n AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
a AS (SELECT coalesce(sum(c), 0)::bigint AS n, count(*) AS v FROM n)
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(a.n) AS train_tokens, cast(round(sum(log10((coalesce(c, 0) + 0.5::double) / (a.n + 0.5::double * (a.v + 1)))), 3) as double) AS base_score FROM t LEFT JOIN n USING (w), a GROUP BY rid"""

_CRC = """SELECT rid, s, 0 AS i, 4294967295::bigint AS crc FROM {of} UNION ALL
SELECT rid, s, i + 1, xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end) FROM (SELECT rid, s, i, case when i % 8 = 0 then xor(crc, ascii(substr(s, i // 8 + 1, 1))::bigint) else crc end AS x FROM c WHERE i < 8 * length(s))"""

# a node's key is the digests of its turns, one after the other, so its ancestors' keys are what its own begins with
CONVERSATION_TRIE = f"""WITH RECURSIVE t AS (SELECT conv_id, row_number() over (partition by conv_id order by turn nulls first, k) AS p, k, b FROM (SELECT conv_id, turn, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS k, octet_length(encode(coalesce(text, ''))) AS b FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id AS rid, cast(conv_id as varchar) AS s, count(*) AS n FROM t GROUP BY conv_id),
c AS ({_CRC.format(of="ids")}),
h AS (SELECT rid, xor(arg_max(crc, i), 4294967295::bigint) % 9 AS h FROM c GROUP BY rid),
q AS (SELECT i.rid, h, i.rid - i.rid % 5 AS base, least(h, coalesce(f.n, 0)) AS taken FROM ids i JOIN h USING (rid) LEFT JOIN ids f ON f.rid = i.rid - i.rid % 5),
r AS (SELECT q.rid, p AS d, k, b FROM q JOIN t ON t.conv_id = q.base AND p <= h UNION ALL SELECT q.rid, p - h + taken, k, b FROM q JOIN t ON t.conv_id = q.rid AND p > h),
l AS (SELECT ids.rid, coalesce(list(k ORDER BY d) FILTER (k IS NOT NULL), []) AS ks, list(b ORDER BY d) AS bs FROM ids LEFT JOIN r USING (rid) GROUP BY ids.rid),
x AS (SELECT rid, d, array_to_string(list_slice(ks, 1, d), '') AS k, case when d > 0 then bs[d] else 0 end AS b, d = len(ks) AS e FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM l)),
n AS (SELECT d, k, min(rid) AS conv_id, count(*) AS m, max(b) AS b, coalesce(string_agg(cast(rid as varchar), ',' ORDER BY rid) FILTER (e), '') AS ends FROM x GROUP BY d, k),
f AS (SELECT d - 1 AS d, left(k, 64 * (d - 1)::int) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (d, k)),
u AS (SELECT left(k, 64 * i::int) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((m - 1) * b) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM w) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, y.conv_id AS parent_conv_id, w.m AS n_convs, w.n_children, n_leaves, saved::bigint AS saved_tokens, sha256(w.ends) AS ends_sha256 FROM w JOIN u USING (k) LEFT JOIN w y ON w.d > 0 AND y.k = left(w.k, 64 * (w.d - 1)::int)"""

EXACT_DEDUP = """SELECT doc_id, first_value(doc_id) over (w) AS keep_id, count(*) over (partition by t) AS group_size, row_number() over (w) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t ORDER BY doc_id DESC NULLS LAST)"""

BASE_WHITENING = """WITH v AS (SELECT row_number() over () AS rid, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT rid, i, floor(64 * embedding[i]::double)::hugeint + 1000000 AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
s AS (SELECT i, count(*)::hugeint AS n, sum(x)::hugeint AS s FROM x GROUP BY i),
d AS (SELECT rid, any_value(n) AS n, count(*) AS dim, sum((n * x - s) * (n * x - s)) AS deviation FROM x JOIN s USING (i) GROUP BY rid)
SELECT vec_id, unnest(range(1, least(32, dim) + 1))::int AS component, n::bigint AS n, deviation::bigint AS deviation FROM v JOIN d USING (rid)"""
