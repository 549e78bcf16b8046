"""SQL (DuckDB's) of the training-data queries that SQL can express.

The others have none: tokenizers, fitted models and keyed surrogates are tested by
round trips, held-out accuracy and brute force instead.
"""

from __future__ import annotations

from . import sharding

SUBSTRING = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
 s AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
 t AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
 k AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM t),
 g AS (SELECT e.doc_id, count(*) AS n_words, count(k.p) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE k.p IS NULL), '') AS kept FROM e LEFT JOIN k ON e.doc_id = k.doc_id AND e.p = k.p GROUP BY e.doc_id)
 SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""

JACCARD = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
 r(node, seen) AS (SELECT a, a FROM l UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node),
 c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(k.n_links, 0) AS n_links FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.node LEFT JOIN k ON d.doc_id = k.a"""


NEAR_DUPLICATES = f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({JACCARD.replace('100 * k >= 90', '100 * k >= 85')})"

HARD_NEGATIVES = """WITH f AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN embedding END AS e FROM embeddings WHERE label IS NOT NULL),
 v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(e, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM f WHERE e IS NOT NULL),
 s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS r2, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5)
 SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.r2 ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
 FROM p JOIN s n ON p.r = n.r AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10"""

COLLOCATIONS = r"""WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
 q AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM t)),
 g AS (SELECT lang, z, unnest(list_transform(range(1, len(w) - z + 2), lambda i: array_to_string(list_slice(w, i, i + z - 1), ' '))) AS phrase FROM q, (VALUES (1), (2), (3)) zs(z) WHERE len(w) >= z),
 f AS (SELECT lang, z, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
 n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE z = 1 GROUP BY lang),
 c AS (SELECT lang, z, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE z >= 2 AND f >= 10),
 u AS (SELECT c.*, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM c, (VALUES (1), (2)) ks(k) WHERE k < z),
 x AS (SELECT u.lang, u.z, u.phrase, u.a, u.k, l.f AS l, r.f AS r, (1000000 * u.a * u.a) // (l.f * r.f) AS score FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.lp JOIN f r ON r.lang = u.lang AND r.phrase = u.rp),
 y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 h AS (SELECT lang, p, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p FROM c WHERE z = 3) GROUP BY ALL)
 SELECT y.lang, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, y.a DESC, phrase) AS rank, phrase, CAST(y.a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
 FROM y JOIN n ON n.lang = y.lang LEFT JOIN h ON h.lang = y.lang AND h.p = y.phrase WHERE h.a IS NULL OR 100 * h.a < 50 * y.a QUALIFY rank <= 2000"""


def _descent(shards: int, name: str) -> tuple[str, str]:
    """Common table expressions that lead each key down the tree, and the last one's name."""
    parts, above = [], "(SELECT doc_id, key, 0 AS node FROM keys)"
    for k, table in enumerate(sharding.levels(sharding.layout(shards))):
        rows = ", ".join(f"({p}, '{n}', {w}, {i})" for p, row in enumerate(table) for n, w, i in row)
        draw = "-ln((CAST('0x' || substr(md5(key || '/' || c.n), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / c.w"
        parts.append(f"{name}{k} AS (SELECT doc_id, key, arg_min(c.i, {draw}) AS node FROM {above} s JOIN (VALUES {rows}) c(p, n, w, i) ON c.p = s.node GROUP BY doc_id, key)")
        above = f"{name}{k}"
    return ", ".join(parts), above


def sharding_sql(shards: int = 40) -> str:
    """The crc32 runs over the bytes of each text; slots go by the md5 of id, checksum and size."""
    (now, a), (grown, b) = _descent(shards, "a"), _descent(shards + 1, "b")
    return rf"""WITH tbl AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
 raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 crc AS (SELECT doc_id, CAST(length(h) / 2 + 16 AS BIGINT) AS size, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM raw, tbl),
 keys AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '\N') AS key FROM documents), {now}, {grown}
 SELECT crc.doc_id, size, text_crc32, 'key' AS law, CAST(x.node AS INTEGER) AS shard, CAST(y.node AS INTEGER) AS grown_shard, row_number() OVER (PARTITION BY x.node ORDER BY md5(coalesce(CAST(crc.doc_id AS VARCHAR), '\N') || '/' || text_crc32 || '/' || size)) - 1 AS slot
 FROM crc JOIN {a} x ON crc.doc_id = x.doc_id JOIN {b} y ON crc.doc_id = y.doc_id"""


ORACLE_SQL = {
    "op2_sharding": sharding_sql(),
    "op4_substring": SUBSTRING,
    "op7_jaccard": JACCARD,
    "op11_near_duplicates": NEAR_DUPLICATES,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_collocations": COLLOCATIONS,
}
