"""DuckDB SQL that restates the rules of the queries that SQL can express."""

from __future__ import annotations

from . import merkle as _merkle

#: The trie's query rebuilds a conversation from up to so many first turns of the first of its five.
TAKES_FROM, TAKES_AT_MOST = 5, 8
#: Levels of digests that the SQL builds: enough for 16 ** LEVELS rows of a group.
LEVELS = 6


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, byte))"
    letters = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce({letters}, lambda crc, byte: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def prefix_trie() -> str:
    """Nodes are texts of digests; a node's subtree are the nodes whose first member's path goes through it."""
    return f"""
    WITH plain AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    digests AS (SELECT conv_id, turn, role, strlen(text) AS bytes, sha256(strlen(role) || ':' || role || text) AS content FROM plain),
    own AS (SELECT conv_id, bytes, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, content) AS pos FROM digests),
    ids AS (SELECT conv_id, conv_id - conv_id % {TAKES_FROM} AS base, {crc32("CAST(conv_id AS VARCHAR)")} % {TAKES_AT_MOST + 1} AS takes FROM (SELECT DISTINCT conv_id FROM own)),
    both_parts AS (
        SELECT ids.conv_id, 0 AS part, own.pos, own.bytes, own.content FROM ids JOIN own ON own.conv_id = ids.base AND own.pos <= ids.takes
        UNION ALL SELECT ids.conv_id, 1, own.pos, own.bytes, own.content FROM ids JOIN own ON own.conv_id = ids.conv_id AND own.pos > ids.takes
    ),
    rebuilt AS (SELECT conv_id, bytes, content, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS pos FROM both_parts),
    path AS (
        SELECT conv_id, pos, bytes, string_agg(content, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS label FROM rebuilt
        UNION ALL SELECT conv_id, 0, 0, '' FROM ids
    ),
    lengths AS (SELECT conv_id, max(pos) AS length FROM path GROUP BY conv_id),
    nodes AS (
        SELECT path.pos AS depth, path.label, min(path.conv_id) AS conv_id, count(*) AS n_convs, any_value(path.bytes) AS bytes,
            coalesce(string_agg(CAST(path.conv_id AS VARCHAR), ',' ORDER BY path.conv_id) FILTER (WHERE lengths.length = path.pos), '') AS ends
        FROM path JOIN lengths USING (conv_id) GROUP BY path.pos, path.label
    ),
    with_parent AS (SELECT n.*, p.conv_id AS parent_conv_id, p.label AS parent_label FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.label = left(n.label, 64 * (n.depth - 1))),
    kids AS (SELECT depth - 1 AS depth, parent_label AS label, count(*) AS n_children FROM with_parent WHERE depth > 0 GROUP BY ALL),
    known AS (SELECT w.*, coalesce(k.n_children, 0) AS n_children FROM with_parent w LEFT JOIN kids k ON k.depth = w.depth AND k.label = w.label),
    folded AS (
        SELECT path.pos AS depth, path.label, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, CAST(sum((u.n_convs - 1) * u.bytes) AS BIGINT) AS saved_tokens
        FROM known u JOIN path ON path.conv_id = u.conv_id AND path.pos <= u.depth GROUP BY path.pos, path.label
    )
    SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, f.n_leaves, f.saved_tokens, sha256(k.ends) AS ends_sha256
    FROM known k JOIN folded f ON f.depth = k.depth AND f.label = k.label"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def merkle() -> str:
    """Every level of digests as a table of its own; a row takes the runs that it lies in, level by level."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    other = f"CASE WHEN {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % {_merkle.TAMPER} = 0 THEN translate(text, '{upper}', '{upper.lower()}') ELSE text END"
    fan = _merkle.FANOUT

    def trie(name: str) -> str:
        """Tables name_1 to name_LEVELS from name_0 (grp, n, place, h); kids is null above the last digest."""
        out = []
        for k in range(LEVELS):
            nodes = f"ceil(n / {fan**k}::DOUBLE)"
            out.append(f"""{name}_{k + 1} AS (
                SELECT grp, n, place // {fan} AS place, CASE WHEN {nodes} > 1 THEN list(h ORDER BY place) END AS kids,
                    CASE WHEN {nodes} > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE any_value(h) END AS h
                FROM {name}_{k} GROUP BY grp, n, place // {fan})""")
        return ",\n".join(out)

    def climb(name: str, levels: str, start: str) -> str:
        """Tables name_1 to name_LEVELS from start: row, place, proof and folded, grown by the run of each level."""
        out, before = [], start
        for k in range(1, LEVELS + 1):
            i = f"d.place % {fan}"
            left, right = f"array_to_string(r.kids[1:{i}], '')", f"array_to_string(r.kids[{i} + 2:], '')"
            out.append(f"""{name}_{k} AS (
                SELECT d.row, d.grp, d.place // {fan} AS place, CASE WHEN r.kids IS NULL THEN d.proof ELSE d.proof || {left} || {right} END AS proof,
                    CASE WHEN r.kids IS NULL THEN d.folded ELSE sha256({left} || d.folded || {right}) END AS folded
                FROM {before} d JOIN {levels}_{k} r ON r.grp IS NOT DISTINCT FROM d.grp AND r.place = d.place // {fan})""")
            before = f"{name}_{k}"
        return ",\n".join(out)

    leaf = " || ".join(map(_field, columns))
    found = " || ".join(_field("other" if c == "text" else c) for c in columns)
    return f"""
    WITH tampered AS (SELECT *, {other} AS other FROM documents),
    leaves AS (SELECT doc_id, source, sha256({leaf}) AS leaf, sha256({found}) AS found FROM tampered),
    placed AS (
        SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves
    ),
    low_0 AS (SELECT source AS grp, n, place, leaf AS h FROM placed),
    {trie("low")},
    subroots AS (SELECT grp AS source, h AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low_{LEVELS}),
    high_0 AS (SELECT 0 AS grp, n, place, subroot AS h FROM subroots),
    {trie("high")},
    start AS (SELECT row, source AS grp, place, '' AS proof, found AS folded FROM placed),
    {climb("d", "low", "start")},
    middle AS (SELECT d.row, 0 AS grp, s.place, d.proof, d.folded FROM d_{LEVELS} d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.grp),
    {climb("e", "high", "middle")}
    SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.h AS verified
    FROM placed p JOIN e_{LEVELS} e USING (row) JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN high_{LEVELS} r"""
