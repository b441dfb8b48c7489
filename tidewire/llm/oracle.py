"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from itertools import permutations


def _crc32(s: str) -> str:
    """crc32 of an ASCII string: eight shifts a byte by the reversed polynomial 0xEDB88320."""
    byte = "list_reduce([xor(c, b)] || range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({s}) + 1), lambda i: ord(substr({s}, i, 1))::BIGINT), lambda c, b: {byte}), 4294967295::BIGINT)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Trees go up level by level; a node's way up is the same places divided by 3 again and again. Tree -1 joins the subroots.
MERKLE = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, text, {_leaf("text")} AS leaf, {_leaf("CASE WHEN " + _crc32("CAST(doc_id AS VARCHAR)") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS changed FROM documents
), s AS (
    SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)
), leaves AS (
    SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, doc_id, leaf, changed FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), low(tree, level, place, digest, held) AS (
    SELECT tree, 0, place, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
    UNION ALL
    SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (held + 2) // 3 FROM low WHERE held > 1 GROUP BY tree, level, held, place // 3
), high(tree, level, place, digest, held) AS (
    SELECT -1, 0, tree, digest, count(*) OVER () FROM low WHERE held = 1
    UNION ALL
    SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (held + 2) // 3 FROM high WHERE held > 1 GROUP BY tree, level, held, place // 3
), nodes AS (
    SELECT * FROM low UNION ALL SELECT * FROM high
), steps AS (
    SELECT a.tree, a.level, a.place, a.held, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.held > 1 GROUP BY ALL
), climb(doc, of, tree, level, place, folded, proof) AS (
    SELECT (tree, place), tree, tree, 0, place, changed, '' FROM leaves
    UNION ALL
    SELECT doc, of, CASE WHEN held IS NULL THEN -1 ELSE c.tree END, CASE WHEN held IS NULL THEN 0 ELSE c.level + 1 END, CASE WHEN held IS NULL THEN of ELSE c.place // 3 END,
        CASE WHEN held IS NULL THEN folded ELSE sha256(l || folded || r) END, proof || coalesce(l || r, '')
    FROM climb c LEFT JOIN steps p ON c.tree = p.tree AND c.level = p.level AND c.place = p.place WHERE held IS NOT NULL OR c.tree >= 0
), ends AS (
    SELECT doc, folded, proof FROM climb c LEFT JOIN steps p ON c.tree = p.tree AND c.level = p.level AND c.place = p.place WHERE c.tree = -1 AND p.held IS NULL
)
SELECT doc_id, leaf, w.digest AS subroot, h.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h.digest AS verified
FROM leaves JOIN ends ON doc = (leaves.tree, leaves.place) JOIN low w ON w.tree = leaves.tree AND w.held = 1 JOIN high h ON h.held = 1
"""


_ORDERS = ["".join(p) for p in permutations("ABCDE")]

#: Filters applied in each of the 120 orders, a document's removal being the first place of a filter that it fails.
INTERACTIONS = f"""
WITH t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), f AS (
    SELECT part, (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM t
), g AS (
    SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
), o AS (
    SELECT unnest({_ORDERS!r}) AS filter_order
), s AS (
    SELECT filter_order, step, filter_order[step] AS filter FROM o, range(1, 6) r(step)
), gone_at AS (
    SELECT g.*, filter_order, list_min([5 + 1] || list_transform(string_split(fails, ''), lambda c: CASE WHEN c = '' THEN 6 ELSE instr(filter_order, c) END)) AS gone FROM g, o
), r AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(sum(CASE WHEN gone > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN contains(fails, filter) AND gone < step THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN gone = step AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM gone_at JOIN s USING (filter_order) GROUP BY ALL
)
SELECT r.* EXCLUDE (filter), CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""


#: Windows of items as strings, and those of documents of every size that an item's window has.
DECONTAMINATION = r"""
WITH d AS (
    SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM documents
), b AS (
    SELECT item_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM benchmark
), n AS (
    SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w, row_number() OVER () AS k FROM d
), i AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS body FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE w <> [''])
), z AS (
    SELECT DISTINCT size FROM i
), x AS (
    SELECT k, size, p, array_to_string(w[p:p + size - 1], ' ') AS body FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM n, z WHERE len(w) >= size)
), h AS (
    SELECT k, p, size, item_id FROM x JOIN i USING (size, body)
), c AS (
    SELECT k, count(DISTINCT p + j) AS n_hit FROM h, range(0, 10) r(j) WHERE j < size GROUP BY k
), t AS (
    SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM n LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""
