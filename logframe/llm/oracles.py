"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

#: Levels of a tree that the SQL spells out: enough for 3 ** 16 leaves of one source.
LEVELS = 16

#: The table of crc32 with its usual polynomial, from its rule.
_TABLE = """crc_table AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT range AS i FROM range(256)))
)"""


def _crc32(value: str) -> str:
    digits = f"list_transform(string_split({value}::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}),
        lambda c, b: xor(crc_table.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = f"""WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (
    SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
        lambda k: array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' '))) AS win
    FROM items WHERE len(w) > 0
),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k
    FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n
),
doc_windows AS (SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win FROM places),
found AS (SELECT DISTINCT d.r, d.n, d.k, i.item_id FROM doc_windows d JOIN item_windows i USING (win, n)),
hits AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM found) GROUP BY r
),
owners AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN owners USING (r)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs ``{name}_0`` to ``{name}_{levels}``: the nodes ``g, idx, h`` of each level, as long as one has several."""
    out = [f"{name}_0 AS ({leaves})"]
    for k in range(1, levels + 1):
        out.append(
            f"""{name}_{k} AS (SELECT g, idx // 3 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM {name}_{k - 1}
            WHERE g IN (SELECT g FROM {name}_{k - 1} GROUP BY g HAVING count(*) > 1) GROUP BY g, idx // 3)"""
        )
    return ",\n".join(out)


def _folds(name: str, start: str, tree: str, levels: int) -> str:
    """CTEs ``{name}_0`` to ``{name}_{levels}``: each row's digest, place and siblings so far, level by level."""
    out = [f"{name}_0 AS ({start})"]
    for k in range(levels):
        out.append(
            f"""{name}_{k + 1} AS (
            SELECT r.row, r.g, r.idx // 3 AS idx,
                CASE WHEN s.n > 1 THEN sha256(coalesce(array_to_string(list_transform(list_filter(n.hs,
                    lambda x: x.i < r.idx), lambda x: x.h), ''), '') || r.h || coalesce(array_to_string(
                    list_transform(list_filter(n.hs, lambda x: x.i > r.idx), lambda x: x.h), ''), '')) ELSE r.h END AS h,
                r.sib || CASE WHEN s.n > 1 THEN coalesce(array_to_string(list_transform(list_filter(n.hs,
                    lambda x: x.i <> r.idx), lambda x: x.h), ''), '') ELSE '' END AS sib
            FROM {name}_{k} r
            LEFT JOIN (SELECT g, count(*) AS n FROM {tree}_{k} GROUP BY g) s USING (g)
            LEFT JOIN (SELECT g, idx // 3 AS run, list({{'i': idx, 'h': h}} ORDER BY idx) AS hs FROM {tree}_{k} GROUP BY g, idx // 3) n
                ON n.g = r.g AND n.run = r.idx // 3)"""
        )
    return ",\n".join(out)


def _top(tree: str, levels: int) -> str:
    """The root of each tree: the node at the only level with one node, which is its last one."""
    nodes = " UNION ALL ".join(f"SELECT g, {k} AS level, h FROM {tree}_{k}" for k in range(levels + 1))
    return f"SELECT g, arg_max(h, level) AS h FROM ({nodes}) GROUP BY g"


OP12 = f"""WITH {_TABLE},
leaves AS (
    SELECT documents.*, row_number() OVER () AS row, {_leaf('text')} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_crc32('doc_id')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")}
        ELSE {_leaf('text')} END AS changed
    FROM documents, crc_table
),
placed AS (
    SELECT *, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS g,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
    FROM leaves
),
{_tree('t', 'SELECT g, idx, leaf AS h FROM placed', LEVELS)},
subroots AS ({_top('t', LEVELS)}),
{_tree('u', 'SELECT 0 AS g, g AS idx, h FROM subroots', LEVELS)},
roots AS ({_top('u', LEVELS)}),
{_folds('f', "SELECT row, g, idx, changed AS h, '' AS sib FROM placed", 't', LEVELS)},
{_folds('e', f"SELECT row, 0 AS g, g AS idx, h, sib FROM f_{LEVELS}", 'u', LEVELS)}
SELECT doc_id, leaf, s.h AS subroot, o.h AS root, sha256(e.sib) AS proof_sha256, e.h AS folded_root, e.h = o.h AS verified
FROM placed p JOIN subroots s ON s.g = p.g JOIN e_{LEVELS} e ON e.row = p.row CROSS JOIN roots o"""

OP13 = f"""WITH {_TABLE},
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank
    FROM conversations WHERE conv_id IS NOT NULL
),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS g, {_crc32('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
lent AS (SELECT h.conv_id, t.rank AS p, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.g AND t.rank <= h.h),
rebuilt AS (
    SELECT * FROM lent UNION ALL
    SELECT t.conv_id, t.rank, t.role, t.text FROM turns t JOIN heads h USING (conv_id) WHERE t.rank > h.h
),
ordered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS depth, length(text) AS size,
        list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY p) AS path
    FROM rebuilt
),
steps AS (
    SELECT conv_id, depth, size, sha256(path::JSON::VARCHAR) AS node FROM ordered
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM heads
),
paths AS (
    SELECT conv_id, depth, size, node, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS ends
    FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
),
nodes AS (
    SELECT node, depth, min(parent) AS parent, min(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
    FROM paths GROUP BY node, depth
),
children AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.parent = n.node AND c.depth = n.depth
),
totals AS (
    SELECT p.node, p.depth, sum((o.n_children = 0)::BIGINT) AS n_leaves, sum((o.n_convs - 1) * o.size) AS saved_tokens
    FROM own o JOIN paths p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY p.node, p.depth
)
SELECT o.conv_id, o.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs,
    o.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens,
    sha256(o.ends) AS ends_sha256
FROM own o JOIN totals t USING (node, depth) LEFT JOIN own u ON u.node = o.parent AND u.depth = o.depth - 1"""


def oracle_sql() -> dict[str, str]:
    return {"op11_decontamination": OP11, "op12_merkle_manifest": OP12, "op13_prefix_trie": OP13}
