"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

# The checksum's table follows from its polynomial; a text's bytes are read off its hex form.
SHARDING = r"""
WITH table256 AS (
    SELECT list_transform(range(256), lambda b: list_reduce(
        range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS entries
), sized AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
           xor(list_reduce(
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
               lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
    FROM documents, table256
), run AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto,
           sum(size) OVER () AS total
    FROM sized
), placed AS (
    SELECT *, (((2 * upto - size) * 24) // (2 * total))::INT AS shard FROM run
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, NULL::INT AS grown_shard
FROM placed
"""

TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), shingled AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) END AS s
    FROM words
), sized AS (
    SELECT doc_id, len(s) AS n, s FROM shingled
), entries AS (
    SELECT doc_id, n, md5_number(unnest(s)) AS h FROM sized
), linked AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM entries a JOIN entries b ON a.h = b.h AND a.doc_id <> b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM sized
    UNION
    SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
)
SELECT doc_id, n AS n_shingles, (SELECT min(b) FROM reached r WHERE r.a = sized.doc_id) AS component_id FROM sized
"""


# The level of the water: sources fill up one after another, the smallest for its weight first.
MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS size,
           [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM sized GROUP BY source
), filling AS (
    SELECT *, row_number() OVER filled AS nth,
           coalesce(sum(2 * size) OVER (filled ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS given,
           sum(weight) OVER (filled ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weighing,
           1.5::DOUBLE * (sum(size) OVER ())::DOUBLE AS whole
    FROM sources WINDOW filled AS (ORDER BY 2 * size / weight, source)
), level AS (
    SELECT (whole - given) / weighing AS level FROM filling
    WHERE (whole - given) / weighing * weight < 2 * size ORDER BY nth LIMIT 1
), wanted AS (
    SELECT source, size, least(coalesce((SELECT level FROM level), 0) * weight, (2 * size)::DOUBLE) AS target FROM sources
), goals AS (
    SELECT *, floor(target + 0.5)::BIGINT AS goal FROM wanted
), turns AS (
    SELECT *, CASE WHEN size > 0 THEN goal // size ELSE 0 END AS turns,
           goal - CASE WHEN size > 0 THEN goal // size ELSE 0 END * size AS rest
    FROM goals
), blocks AS (
    SELECT *, least(512, size - 512 * block) AS words, ('0x' || md5('0:' || doc_id || ':' || block)[1:15])::BIGINT AS place
    FROM (SELECT *, unnest(range(greatest(1, (size + 511) // 512))) AS block FROM sized)
), laid AS (
    SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY place, doc_id, block
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM blocks
)
SELECT doc_id, l.size, t.size AS source_size, target,
       sum(turns * words + greatest(0, least(words, rest - before)))::BIGINT AS taken
FROM laid l JOIN turns t ON l.source IS NOT DISTINCT FROM t.source
GROUP BY doc_id, l.size, t.size, target
"""

# Near words by deletion: two words give the same rest at the same place, or one is the other's rest.
VARIANTS = r"""
WITH RECURSIVE table256 AS (
    SELECT list_transform(range(256), lambda b: list_reduce(
        range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS entries
), runs AS (
    SELECT doc_id, r, count(*) AS c
    FROM (SELECT doc_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents)
    WHERE length(r) >= 6 GROUP BY ALL
), hashed AS (
    SELECT r, c, xor(list_reduce(
        list_transform(regexp_extract_all(hex(encode(doc_id || ':' || r)), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
    FROM runs, table256
), words AS MATERIALIZED (
    SELECT CASE WHEN h % 199 = 0 THEN r[1:(h % length(r))] || r[(h % length(r)) + 2:] ELSE r END AS word, sum(c)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING sum(c) >= 5 AND length(word) >= 6
), cut AS (
    SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM words, unnest(range(length(word))) AS u(i)
), near AS (
    SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), counted AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS best, max(n) AS best_n FROM near GROUP BY word
), formed AS MATERIALIZED (
    SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form,
           CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
    FROM words w LEFT JOIN counted USING (word)
), followed AS (
    SELECT word, word AS root, form AS next FROM formed
    UNION ALL
    SELECT f.word, f.next, g.form FROM followed f JOIN formed g ON f.next = g.word
)
SELECT word, form, root, n, n_near, form_n
FROM formed JOIN (SELECT word, root FROM followed WHERE next IS NULL) USING (word)
"""

# Levels of both trees by recursion; each row's run of siblings is looked up level by level.
MERKLE = r"""
WITH RECURSIVE table256 AS (
    SELECT list_transform(range(256), lambda b: list_reduce(
        range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS entries
), marked AS (
    SELECT *, xor(list_reduce(
        list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 2 = 0 AS touched
    FROM documents, table256
), headed AS (
    SELECT doc_id, source, text, touched,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           CASE WHEN touched THEN replace(text, chr(10), '') ELSE text END AS later
    FROM marked
), leaves AS (
    SELECT doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(later) || ':' || later, '-')) AS changed,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src
    FROM headed
), lower_levels AS (
    SELECT src, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY src) AS n FROM leaves
    UNION ALL
    SELECT src, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 2) // 3
    FROM lower_levels WHERE n > 1 GROUP BY src, level, pos // 3
), subroots AS (
    SELECT src, h FROM lower_levels WHERE n = 1
), upper_levels AS (
    SELECT 0 AS level, src AS pos, h, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 2) // 3
    FROM upper_levels WHERE n > 1 GROUP BY level, pos // 3
), steps AS (
    SELECT a.src, a.level, a.pos, string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS before,
           string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS after
    FROM lower_levels a JOIN lower_levels b ON a.src = b.src AND a.level = b.level AND a.pos // 3 = b.pos // 3
    WHERE a.n > 1 GROUP BY a.src, a.level, a.pos
), upper_steps AS (
    SELECT a.level, a.pos, string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS before,
           string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS after
    FROM upper_levels a JOIN upper_levels b ON a.level = b.level AND a.pos // 3 = b.pos // 3
    WHERE a.n > 1 GROUP BY a.level, a.pos
), climbed AS (
    SELECT doc_id, src, 0 AS level, pos, changed AS node, '' AS proof FROM leaves
    UNION ALL
    SELECT doc_id, src, c.level + 1, c.pos // 3, sha256(coalesce(before, '') || node || coalesce(after, '')),
           proof || coalesce(before, '') || coalesce(after, '')
    FROM climbed c JOIN steps s USING (src, level, pos)
), risen AS (
    SELECT doc_id, 0 AS level, src AS pos, node, proof
    FROM climbed c JOIN (SELECT src, max(level) AS level FROM lower_levels GROUP BY src) USING (src, level)
    UNION ALL
    SELECT doc_id, r.level + 1, r.pos // 3, sha256(coalesce(before, '') || node || coalesce(after, '')),
           proof || coalesce(before, '') || coalesce(after, '')
    FROM risen r JOIN upper_steps s USING (level, pos)
)
SELECT l.doc_id, l.leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, node AS folded_root,
       node = u.h AS verified
FROM leaves l JOIN subroots s USING (src) JOIN risen r ON r.doc_id = l.doc_id
JOIN (SELECT level, h FROM upper_levels WHERE n = 1) u ON u.level = r.level
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": EXACT_DEDUP,
        "op6_topk": TOPK,
        "op8_sharding": SHARDING,
        "op10_ngram_join": NGRAM_JOIN,
        "op11_mixing": MIXING,
        "op12_variants": VARIANTS,
        "op13_merkle": MERKLE,
    }
