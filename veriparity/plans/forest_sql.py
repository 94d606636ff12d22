"""Check statement for isolation forests: the draws, the growth and the walk of all rows, level by level in SQL."""

from __future__ import annotations

import numpy as np


def path_sql(n: str) -> str:
    """Mean depth of a search among ``n`` rows."""
    return f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1.0::DOUBLE) + {np.euler_gamma!r}::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} END"


def hex_sql(text: str, at: int) -> str:
    return f"('0x' || substr(md5({text}), {at}, 8))::BIGINT"


def forest_sql(cells: str, ids: str, seed: int, trees: int, sample: int, levels: int, draws: int) -> str:
    """``scored`` (id, score) of all rows of ``ids`` (id), whose features are ``cells`` (id, feature, value)."""
    ctes = [f"""
    draws AS (SELECT id, t AS tree, ({hex_sql(f"'{seed}:' || id", 1)} + t * {hex_sql(f"'{seed}:' || id", 9)}) % {draws} AS draw
        FROM {ids}, (SELECT unnest(range({trees})) AS t)),
    g0 AS MATERIALIZED (SELECT tree, id, 1::BIGINT AS node FROM (
        SELECT tree, id, row_number() OVER (PARTITION BY tree ORDER BY draw, id) AS turn FROM draws) WHERE turn <= {sample}),
    deep AS (SELECT tree, ceil(log2(greatest(count(*), 2)))::INT AS deepest FROM g0 GROUP BY tree),
    r0 AS MATERIALIZED (SELECT id, t AS tree, 1::BIGINT AS node FROM {ids}, (SELECT unnest(range({trees})) AS t))"""]
    for k in range(levels + 1):
        ctes.append(f"""
    n{k} AS (SELECT tree, node, count(*) AS n FROM g{k} GROUP BY tree, node),
    o{k} AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY feature) - 1 AS place,
            count(*) OVER (PARTITION BY tree, node) AS choices FROM (
        SELECT tree, node, feature, CASE WHEN count(*) < any_value(n) THEN least(min(value), 0) ELSE min(value) END AS low,
            CASE WHEN count(*) < any_value(n) THEN greatest(max(value), 0) ELSE max(value) END AS high
        FROM g{k} JOIN n{k} USING (tree, node) JOIN {cells} USING (id) JOIN deep USING (tree)
        WHERE n > 1 AND {k} < deepest GROUP BY tree, node, feature) WHERE high > low),
    s{k} AS MATERIALIZED (SELECT tree, node, feature,
            low + {hex_sql(f"'{seed}:' || tree || ':' || node", 9)} / 4294967296.0::DOUBLE * (high - low) AS cut
        FROM o{k} WHERE place = floor({hex_sql(f"'{seed}:' || tree || ':' || node", 1)} / 4294967296.0::DOUBLE * choices)),
    l{k} AS (SELECT id, {k} + {path_sql('n')} AS path FROM r{k} JOIN n{k} USING (tree, node) ANTI JOIN s{k} USING (tree, node)),
    g{k + 1} AS MATERIALIZED (SELECT g.tree, g.id, 2 * g.node + (coalesce(value, 0) > cut)::BIGINT AS node
        FROM g{k} g JOIN s{k} s USING (tree, node) LEFT JOIN {cells} c ON c.id = g.id AND c.feature = s.feature),
    r{k + 1} AS MATERIALIZED (SELECT g.id, g.tree, 2 * g.node + (coalesce(value, 0) > cut)::BIGINT AS node
        FROM r{k} g JOIN s{k} s USING (tree, node) LEFT JOIN {cells} c ON c.id = g.id AND c.feature = s.feature)""")
    leaves = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(levels + 1))
    ctes.append(f"""
    scored AS (SELECT id, pow(2.0::DOUBLE, -round(sum(path), 9)
            / ({trees} * (SELECT {path_sql('n')} FROM (SELECT least(count(*), {sample}) AS n FROM {ids})))) AS score
        FROM ({leaves}) GROUP BY id)""")
    return ",".join(ctes)
