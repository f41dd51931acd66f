"""SQL of the corpus queries that SQL can express, for an engine with MD5, lists and lambdas."""

from __future__ import annotations

from plumbline.llm.sharding import SLOT_ROWS, Tree, grown_tree


def _children(tree: Tree) -> str:
    """(level, parent, name, weight, number) of all nodes; racks are numbered through."""
    rows, rack = [], 0
    for r, racks in enumerate(tree):
        rows.append(("region", 0, f"region:{r}", sum(w for k in racks for _, w in k), r))
        for k, shards in enumerate(racks):
            rows.append(("rack", r, f"rack:{r}.{k}", sum(w for _, w in shards), rack))
            rows += [("shard", rack, f"shard:{r}.{k}.{s}", w, s) for s, w in shards]
            rack += 1
    return ", ".join(f"('{a}', {b}, '{c}', {d}, {e})" for a, b, c, d, e in rows)


def _descend(table: str, source: str, tree: str) -> str:
    draw = "-ln((CAST('0x' || substr(md5(c.name || '/' || k), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / c.weight"
    pick = lambda level, parent: f"(SELECT arg_min(c.number, {draw}) FROM {tree} c WHERE c.level = '{level}' AND c.parent = {parent})"
    return f"""{table}_r AS (SELECT *, {pick('region', 0)} AS r FROM {source}),
 {table}_k AS (SELECT *, {pick('rack', 'r')} AS q FROM {table}_r),
 {table} AS (SELECT * EXCLUDE (r, q), {pick('shard', 'q')} AS s_{table} FROM {table}_k)"""


def op2_sql(shards: int = 40) -> str:
    """Shards, slots and checksums; CRC-32 is folded over each text's bytes by its table."""
    names = "(level, parent, name, weight, number)"
    return f"""WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
 tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
 now{names} AS (VALUES {_children(grown_tree(shards, shards))}),
 later{names} AS (VALUES {_children(grown_tree(shards, shards + 1))}),
 d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
 e AS (SELECT doc_id, k, CAST(len(x) // 2 + 16 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
 {_descend('a', 'e', 'now')}, {_descend('b', 'a', 'later')},
 n AS (SELECT greatest(1, CAST(ceil(count(*) / {shards * SLOT_ROWS}) AS BIGINT)) AS buckets FROM (SELECT DISTINCT doc_id, size, text_crc32 FROM b))
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(s_a AS INT) AS shard,
 row_number() OVER (PARTITION BY s_a ORDER BY CAST('0x' || substr(md5('slot/' || k || '/' || text_crc32), 1, 8) AS BIGINT) % buckets, doc_id, text_crc32, size) - 1 AS slot,
 CAST(s_b AS INT) AS grown_shard FROM b, n"""


def op10_sql(least: float = 0.95) -> str:
    """All pairs' cosines, and what links reach."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 u AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
 e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= {least}),
 r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vec_id WHERE r.root < e.b),
 c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
 n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""


def op11_sql(least: int = 3, top: int = 200) -> str:
    """Counts of every kept term in every group and language, in whole numbers of 128 bits."""
    share = "1 + 1000000000::HUGEINT * (k + 1) // (n + v)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 w AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM d),
 kept AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT i) >= {least}),
 v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, t, count(*) AS k FROM w JOIN kept USING (lang, t) GROUP BY lang, source, t),
 full_counts AS (SELECT g.lang, g.source, kept.t, coalesce(c.k, 0) AS k FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
 p AS (SELECT lang, source, t, k, {share} AS p FROM full_counts JOIN (SELECT lang, source, sum(k) AS n FROM full_counts GROUP BY lang, source) USING (lang, source) JOIN v USING (lang)),
 l AS (SELECT lang, t, {share} AS q FROM (SELECT lang, t, sum(k) AS k FROM c GROUP BY lang, t) JOIN (SELECT lang, sum(k) AS n FROM c GROUP BY lang) USING (lang) JOIN v USING (lang)),
 f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
 terms AS (SELECT p.lang, p.source, 'term' AS part, p.t AS item, (p - q) * (p - q) // q AS value FROM p JOIN l ON l.lang = p.lang AND l.t = p.t WHERE k > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= {top}"""


def op12_sql(every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> str:
    """All scores of all anchors, ranked; rows that share an id are anchors of their own."""
    return f"""WITH d AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 e AS (SELECT *, row_number() OVER () AS r FROM d),
 s AS (SELECT a.r, a.id AS anchor, a.label AS own, b.id, b.r AS other, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON len(a.v) = len(b.v) WHERE a.id % {every} = 0),
 p AS (SELECT r, anchor, id, other, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS nth FROM s WHERE label = own AND id <> anchor),
 n AS (SELECT p.anchor AS anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.r = p.r AND s.label <> s.own AND {low} * p.score <= 100 * s.score AND 100 * s.score <= {high} * p.score WHERE p.nth <= {positives})
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""
