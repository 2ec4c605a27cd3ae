"""DuckDB SQL of the training-data queries that SQL can state, each written on its own."""

from __future__ import annotations

SP = r"[\x20\x09-\x0D]"
WD = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SP}+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""

# The mix takes a source's stream from its start to the source's target, rounded to a word, repeated passes included.
MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WD}'))::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
o AS (SELECT *, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || h), 1, 15))::BIGINT AS o FROM d),
n AS (SELECT count(*) AS docs FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
-- if exactly the sources up to this one in order of cap per weight are capped, the others share the rest by weight
l AS (SELECT *, cap / weight AS ratio,
             (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM w),
f AS (SELECT min_by(rest / weights, ratio) AS level FROM l WHERE rest / weights * weight < cap),
t AS (SELECT l.*, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM l, f),
a AS (SELECT doc_id, size, source_size, target, least(floor(3.0 * source_size), round(target))::BIGINT AS stop,
             coalesce(sum(size) OVER (PARTITION BY t.rank ORDER BY (o >> 20) % (floor(sqrt(docs))::BIGINT + 1), o, doc_id, h, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source, n)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, stop) - start) + greatest(0, least(start + source_size + size, stop) - start - source_size)
        + greatest(0, least(start + 2 * source_size + size, stop) - start - 2 * source_size))::BIGINT AS taken
FROM a"""


def _md5_32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


SHARDING = f"""
WITH t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)),
             lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, {_md5_32("coalesce(doc_id::VARCHAR, '')")} % 4096 AS virtual_slot,
             xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
                 lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)])))::BIGINT AS text_crc32
      FROM documents, t),
m AS (SELECT v AS virtual_slot, list_max(list_filter(range(0, 40), lambda j: {_md5_32("v || ':' || j")} % (j + 1) = 0)) AS shard,
             list_max(list_filter(range(0, 41), lambda j: {_md5_32("v || ':' || j")} % (j + 1) = 0)) AS grown_shard
      FROM (SELECT DISTINCT virtual_slot AS v FROM d))
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard, virtual_slot,
       row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, {_md5_32("coalesce(doc_id::VARCHAR, '') || ':' || text_crc32")} % 64, doc_id, text_crc32, size) - 1 AS slot,
       sum(size) OVER (PARTITION BY virtual_slot)::BIGINT AS slot_bytes
FROM d JOIN m USING (virtual_slot)"""

PREFERENCE = """
WITH c AS (SELECT conv_id AS p, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT p, max(turn) AS answer, arg_max(text, turn) AS text FROM c WHERE role = 'assistant' GROUP BY p),
r AS (SELECT c.* FROM c LEFT JOIN last USING (p) WHERE answer IS NULL OR turn < answer
      UNION ALL
      SELECT l.p, l.answer, 'assistant', n.text FROM last l JOIN last n ON n.p = xor(l.p, 1)),
turns AS (SELECT 0 AS side, * FROM c UNION ALL SELECT 1, * FROM r),
lists AS (SELECT p, side, list({'role': role, 'text': text} ORDER BY turn, role, text) AS x FROM turns GROUP BY p, side),
pairs AS (SELECT p, coalesce(a.x, []) AS a, coalesce(b.x, []) AS b
          FROM (SELECT p, x FROM lists WHERE side = 0) a FULL JOIN (SELECT p, x FROM lists WHERE side = 1) b USING (p)),
cut AS (SELECT p, a, b, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])), greatest(len(a), len(b)) + 1) - 1 AS n FROM pairs),
parts AS (SELECT p, n, a[:n] AS pre, a[n + 1:] AS ca, b[n + 1:] AS cb FROM cut),
pieces AS (SELECT p, n, ca, cb,
  list_transform(pre, lambda t: '<|' || replace(t.role, '<|', '< |') || '|>' || chr(10) || replace(t.text, '<|', '< |') || '<|end|>' || chr(10)) AS pp,
  list_transform(ca, lambda t: '<|' || replace(t.role, '<|', '< |') || '|>' || chr(10) || replace(t.text, '<|', '< |') || '<|end|>' || chr(10)) AS pa,
  list_transform(cb, lambda t: '<|' || replace(t.role, '<|', '< |') || '|>' || chr(10) || replace(t.text, '<|', '< |') || '<|end|>' || chr(10)) AS pb FROM parts)
SELECT p AS pair_id, array_to_string(pp, '') AS prompt, array_to_string(pa, '') AS chosen, array_to_string(pb, '') AS rejected, n::BIGINT AS prompt_turns,
  array_to_string(list_transform(list_filter(range(1, len(ca) + 1), lambda i: ca[i].role = 'assistant'),
    lambda i: (length(array_to_string(pa[:i - 1], '')) + 14) || ':' || length(array_to_string(pa[:i], ''))), ',') AS chosen_mask,
  array_to_string(list_transform(list_filter(range(1, len(cb) + 1), lambda i: cb[i].role = 'assistant'),
    lambda i: (length(array_to_string(pb[:i - 1], '')) + 14) || ':' || length(array_to_string(pb[:i], ''))), ',') AS rejected_mask
FROM pieces"""


def _key(mask: str) -> str:
    return " || ' ' || ".join(f"w[q + {k + 1}]" for k, m in enumerate(mask) if m == "1")


def decontamination(masks: tuple[str, ...], span: int, window: int = 20, similarity: float = 0.8) -> str:
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"
    seeds = " UNION ALL ".join(f"SELECT id, w, q, {i} AS m, {_key(mask)} AS k FROM %s_at" for i, mask in enumerate(masks))
    return f"""
WITH d AS (SELECT doc_id AS id, {words} AS w FROM documents), b AS (SELECT item_id AS id, {words} AS w FROM benchmark),
d_at AS (SELECT id, w, unnest(range(0, len(w) - {span - 1})) AS q FROM d), b_at AS (SELECT id, w, unnest(range(0, len(w) - {span - 1})) AS q FROM b),
ds AS ({seeds % tuple(["d"] * len(masks))}), bs AS ({seeds % tuple(["b"] * len(masks))}),
hits AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.w AS w, bs.w AS x, ds.q - bs.q AS g, bs.q AS j FROM ds JOIN bs USING (m, k)),
same AS (SELECT *, list_transform(range(0, len(x)), lambda i: CASE WHEN i + g >= 0 AND i + g < len(w) AND w[i + g + 1] = x[i + 1] THEN 1 ELSE 0 END) AS s,
                least({window}, len(x)) AS n FROM hits),
best AS (SELECT *, list_max(list_transform(range(greatest(0, least(j, j + {span} - n)), greatest(greatest(0, least(j, j + {span} - n)), least(j, len(x) - n)) + 1),
                                            lambda a: list_sum(s[a + 1:a + n]))) / n AS overlap FROM same)
SELECT doc_id, item_id, max(list_sum(s))::INTEGER AS words_matched, max(len(x))::INTEGER AS item_words, max(overlap)::DOUBLE AS overlap, min(greatest(0, g))::INTEGER AS first_word
FROM best WHERE overlap >= {similarity} GROUP BY doc_id, item_id"""

# a node is the list of its turns' digests; a subtree is summed over the prefixes of its nodes
PREFIX_TRIE = """
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'d': substr(sha256(length(role) || ':' || role || text), 1, 32), 'n': length(text)}
             ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || text), 1, 32)) AS x FROM t GROUP BY c),
crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)),
             lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
h AS (SELECT c, x, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
             lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)]))) % 6 AS h FROM l, crc),
r AS (SELECT h.c, list_concat(coalesce(b.x[:h.h], []), h.x[h.h + 1:]) AS x FROM h LEFT JOIN l b ON b.c = h.c - h.c % 100),
m AS (SELECT c, list_transform(x[:d], lambda t: t.d) AS p, d, len(x) AS n, CASE WHEN d = 0 THEN 0 ELSE x[d].n END AS size
      FROM (SELECT c, x, unnest(range(0, len(x) + 1)) AS d FROM r)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS own,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM m GROUP BY p, d),
kids AS (SELECT p[:d - 1] AS p, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY 1, 2),
n AS (SELECT node.*, coalesce(k, 0) AS n_children FROM node LEFT JOIN kids USING (p, d)),
s AS (SELECT p[:a] AS p, a AS d, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens
      FROM (SELECT p, own, n_children, unnest(range(0, d + 1)) AS a FROM n) GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s USING (p, d) LEFT JOIN node q ON q.d = n.d - 1 AND q.p = n.p[:n.d - 1]"""

HARD_NEGATIVES = """
WITH r AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
             list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3"""
