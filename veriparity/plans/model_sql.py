"""Check statements for fitted models: encoders by fold and Newton steps written out in SQL."""

from __future__ import annotations

from collections.abc import Sequence

STEPS = 14


def encoded_sql(view: str, numeric: Sequence[str], categorical: Sequence[str], parts: Sequence[int], tag: str = "") -> str:
    """``xs``: every row of ``view`` (id, y, fold, features) under the encoder fitted without each of ``parts``."""
    stats = ", ".join(
        f"avg({c}) AS m{i}, stddev_pop({c}) * sqrt(count({c})::DOUBLE / count(*)) AS s{i}" for i, c in enumerate(numeric)
    )
    words = ", ".join(f"list(DISTINCT coalesce({c}::VARCHAR, '(missing)') ORDER BY coalesce({c}::VARCHAR, '(missing)')) AS v{i}" for i, c in enumerate(categorical))
    scaled = ", ".join(f"coalesce((coalesce({c}, m{i}) - m{i}) / nullif(s{i}, 0), 0)" for i, c in enumerate(numeric))
    hot = "".join(
        f" || list_transform(v{i}, lambda c: (c = coalesce({c}::VARCHAR, '(missing)'))::INT::DOUBLE)" for i, c in enumerate(categorical)
    )
    return f"""
    parts{tag} AS (SELECT unnest({list(parts)}) AS f),
    enc{tag} AS (SELECT f, {stats} FROM parts{tag} JOIN {view} ON fold <> f GROUP BY f),
    vocab{tag} AS (SELECT {words} FROM {view}),
    xs{tag} AS MATERIALIZED (SELECT f, id, y, fold, [1.0::DOUBLE, {scaled}]{hot} AS x FROM {view}, enc{tag}, vocab{tag})"""


def newton_sql(strengths: Sequence[float], tag: str = "", steps: int = STEPS) -> str:
    """``w``: weights of the model of each strength s and left-out fold f over ``xs``, by ``steps`` Newton steps.

    A step gathers the weighted Gram matrix with the gradient as its last column, and eliminates it row by row.
    """
    ctes = [
        f"""
    w{tag}0 AS (SELECT f, s::DOUBLE AS s, (SELECT list_transform(any_value(x), lambda v: 0.0::DOUBLE) FROM xs{tag}) AS w
        FROM parts{tag}, (SELECT unnest({list(strengths)}) AS s))"""
    ]
    for k in range(steps):
        ctes.append(f"""
    z{tag}{k} AS (SELECT m.f, m.s, x, w, y, 1 / (1 + exp(-list_dot_product(x, w))) AS p
        FROM w{tag}{k} m JOIN xs{tag} r ON r.f = m.f AND r.fold <> m.f),
    c{tag}{k} AS (SELECT f, s, i, j, any_value(w) AS w, sum(x[i] * q[j]) / count(*) AS h
        FROM (SELECT f, s, x, w, list_transform(x, lambda v: v * p * (1 - p)) || [p - y] AS q FROM z{tag}{k}),
            (SELECT unnest(range(1, (SELECT len(any_value(x)) FROM xs{tag}) + 1)) AS i),
            (SELECT unnest(range(1, (SELECT len(any_value(x)) FROM xs{tag}) + 2)) AS j)
        GROUP BY f, s, i, j),
    e{tag}{k} AS (SELECT f, s, any_value(w) AS w, list(h ORDER BY i) AS a FROM (
            SELECT f, s, i, any_value(w) AS w, list(h + CASE WHEN i = 1 THEN CASE WHEN j = 1 THEN 1e-12 ELSE 0 END
                WHEN j = i THEN s WHEN j = len(w) + 1 THEN s * w[i] ELSE 0 END ORDER BY j) AS h
            FROM c{tag}{k} GROUP BY f, s, i) GROUP BY f, s),
    w{tag}{k + 1} AS MATERIALIZED (SELECT f, s, list_transform(w, lambda v, i: v - list_last(solved[i])) AS w FROM (
        SELECT f, s, w, list_reduce(list_prepend(a, list_transform(a, lambda r: a)), lambda acc, x, k:
            list_transform(acc, lambda row, r: CASE WHEN r = k - 1 THEN list_transform(row, lambda v: v / row[k - 1])
                ELSE list_transform(row, lambda v, c: v - row[k - 1] * acc[k - 1][c] / acc[k - 1][k - 1]) END)) AS solved
        FROM e{tag}{k}))""")
    return ",".join([*ctes, f"\n    w{tag} AS (SELECT f, s, w FROM w{tag}{steps})"])


def evaluation_sql(view: str, test: str, numeric: Sequence[str], categorical: Sequence[str], strengths: Sequence[float], folds: int, tag: str = "") -> str:
    """``judged``: id, y, grp, p of the rows of ``test`` under the model of the best strength, trained on ``view``."""
    scaled = ", ".join(f"coalesce((coalesce({c}, m{i}) - m{i}) / nullif(s{i}, 0), 0)" for i, c in enumerate(numeric))
    hot = "".join(
        f" || list_transform(v{i}, lambda c: (c = coalesce({c}::VARCHAR, '(missing)'))::INT::DOUBLE)" for i, c in enumerate(categorical)
    )
    return f"""{encoded_sql(view, numeric, categorical, [-1, *range(folds)], tag)},{newton_sql(strengths, tag)},
    rates{tag} AS (SELECT s, fold, avg(((1 / (1 + exp(-list_dot_product(x, w))) > 0.5)::INT = y)::INT::DOUBLE) AS accuracy
        FROM w{tag} m JOIN xs{tag} r ON r.f = m.f AND r.fold = m.f GROUP BY s, fold),
    best{tag} AS (SELECT s FROM rates{tag} GROUP BY s ORDER BY round(avg(accuracy), 12) DESC, list_position({list(strengths)}, s) LIMIT 1),
    judged{tag} AS (SELECT id, y, grp, round(1 / (1 + exp(-list_dot_product([1.0::DOUBLE, {scaled}]{hot}, w))), 10) AS p
        FROM {test}, (SELECT * FROM enc{tag} WHERE f = -1), vocab{tag}, (SELECT w FROM w{tag} JOIN best{tag} USING (s) WHERE f = -1))"""


def measures_sql(tag: str = "", prefix: str = "") -> str:
    """One row over ``judged``: accuracy, AUC and the counts of ``train_and_evaluate``."""
    cells = ", ".join(
        f"count(*) FILTER (WHERE grp = '{grp}' AND y = {y} AND (p > 0.5) = {hit}) AS {prefix}{cell}_{name}"
        for grp, name in (("priv", "priv"), ("dis", "nonpriv"))
        for cell, y, hit in (("tn", 0, "FALSE"), ("fp", 0, "TRUE"), ("fn", 1, "FALSE"), ("tp", 1, "TRUE"))
    )
    return f"""(SELECT avg((y = (p > 0.5)::INT)::INT::DOUBLE) AS {prefix}accuracy,
        (sum(CASE WHEN y = 1 THEN place END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
            / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0) AS {prefix}auc, {cells}
        FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS place FROM judged{tag}))"""
