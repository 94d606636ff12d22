"""Statistics as SQL text for the check statements.

These use other formulas than the library where there is a choice (gamma
functions instead of running products), so that an error in one shows.
"""

from __future__ import annotations


def g_sql(n_priv: str, dirty_priv: str, n_dis: str, dirty_dis: str) -> str:
    """Yates-corrected G of the 2x2 table, NULL when not testable."""
    n, dirty = f"({n_priv} + {n_dis})", f"({dirty_priv} + {dirty_dis})"
    cells = [
        (dirty_dis, n_dis, dirty),
        (f"({n_dis} - {dirty_dis})", n_dis, f"({n} - {dirty})"),
        (dirty_priv, n_priv, dirty),
        (f"({n_priv} - {dirty_priv})", n_priv, f"({n} - {dirty})"),
    ]
    parts = []
    for seen, row, column in cells:
        expected = f"({row}::DOUBLE * {column} / {n})"
        moved = f"({seen} + sign({expected} - {seen}) * least(0.5, abs({expected} - {seen})))"
        parts.append(f"CASE WHEN {moved} <= 0 THEN 0 ELSE {moved} * ln({moved} / {expected}) END")
    testable = f"({dirty_priv} > 0 OR {dirty_dis} > 0) AND {n_priv} <> {dirty_priv} AND {n_dis} <> {dirty_dis}"
    return f"CASE WHEN {testable} THEN 2 * ({' + '.join(parts)}) END"


def erf_sql(x: str) -> str:
    """erf for 0 <= x <= 6, 1 beyond."""
    return (
        f"CASE WHEN {x} = 0 THEN 0 WHEN {x} > 6 THEN 1 ELSE exp(-{x} * {x}) * list_sum(list_transform("
        f"range(0, 200), lambda i: exp((2 * i + 1) * ln({x}) - lgamma(i + 1.5)))) END"
    )


def g_p_sql(g: str) -> str:
    return f"CASE WHEN {g} IS NOT NULL THEN greatest(0, 1 - ({erf_sql(f'sqrt(greatest({g}, 0) / 2)')})) END"


def t_p_sql(t: str, dof: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom >= 1."""
    theta = f"atan(abs({t}) / sqrt({dof}))"
    odd = (
        f"list_sum(list_transform(range(1, (({dof} - 1) // 2) + 1), lambda i: "
        f"exp(lgamma(i) + lgamma(1.5) - lgamma(i + 0.5)) * pow(cos({theta}), 2 * i - 1)))"
    )
    even = (
        f"list_sum(list_transform(range(1, ({dof} // 2) + 1), lambda i: "
        f"exp(lgamma(i - 0.5) - lgamma(0.5) - lgamma(i)) * pow(cos({theta}), 2 * i - 2)))"
    )
    return (
        f"greatest(0, 1 - CASE WHEN {dof} = 1 THEN 2 * {theta} / pi() "
        f"WHEN {dof} % 2 = 1 THEN 2 / pi() * ({theta} + sin({theta}) * {odd}) ELSE sin({theta}) * {even} END)"
    )


def t_sql(n: str, mean: str, sd: str) -> str:
    return (
        f"CASE WHEN {n} < 2 OR {sd} IS NULL OR ({sd} = 0 AND {mean} = 0) THEN 0 "
        f"WHEN {sd} = 0 THEN sign({mean}) * 'infinity'::DOUBLE ELSE {mean} * sqrt({n}) / {sd} END"
    )


def paired_p_sql(n: str, t: str) -> str:
    return (
        f"CASE WHEN {n} < 2 OR {t} = 0 THEN 1 WHEN isinf({t}) THEN 0 "
        f"ELSE {t_p_sql(t, f'greatest({n} - 1, 1)')} END"
    )


def _simpson_sql(steps: int, f: str) -> str:
    """Simpson's sum of ``f`` (of the node number i) over ``steps`` steps, without the width of a step."""
    return (
        f"list_sum(list_transform(range(0, {steps + 1}), lambda i: "
        f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f}))) / 3"
    )


def log_erfc_sql(x: str) -> str:
    """Logarithm of erfc(x) = 2 / sqrt(pi) exp(-x^2) times the integral of exp(-s^2 - 2 x s) over s > 0."""
    h = 0.002
    area = _simpson_sql(4000, f"exp(-({h} * i) * ({h} * i) - 2 * {x} * ({h} * i))")
    return f"(-{x} * {x} + ln(2 / sqrt(pi()) * {h} * {area}))"


def t_log_p_sql(t: str, dof: str) -> str:
    """Logarithm of the two-sided p of Student's t: the tail beyond |t| by s = |t| + w / (1 - w) over 0 < w < 1."""
    steps = 8000
    w = f"(i / {steps}.0::DOUBLE)"
    inside = (
        f"CASE WHEN i = {steps} THEN CASE WHEN {dof} = 1 THEN 1 + {t} * {t} ELSE 0 END ELSE exp(-({dof} + 1) / 2.0 * (ln(1 + "
        f"pow(abs({t}) + {w} / (1 - {w}), 2) / {dof}) - ln(1 + {t} * {t} / {dof})) - 2 * ln(1 - {w})) END"
    )
    return (
        f"least(0, ln(2 / sqrt({dof} * pi()) / {steps} * {_simpson_sql(steps, inside)}) + lgamma(({dof} + 1) / 2.0) "
        f"- lgamma({dof} / 2.0) - ({dof} + 1) / 2.0 * ln(1 + {t} * {t} / {dof}))"
    )


def audit_sql(counts: str, keys: str = "") -> str:
    """Wrap a statement returning the four counts (and ``keys``) into a judged audit."""
    lead = f"{keys}, " if keys else ""
    cells = ("n_priv", "dirty_priv", "n_dis", "dirty_dis")
    return f"""
        SELECT {lead}n_priv, dirty_priv, n_dis, dirty_dis,
            round(100.0 * dirty_priv / nullif(n_priv, 0), 1) + 0.0 AS pct_priv,
            round(100.0 * dirty_dis / nullif(n_dis, 0), 1) + 0.0 AS pct_dis,
            round(g, 6) + 0.0 AS g,
            round({g_p_sql('g')}, 6) + 0.0 AS p_value,
            coalesce(g > 3.841458820694124, FALSE) AS disparate
        FROM (SELECT *, {g_sql(*cells)} AS g FROM ({counts}))
    """


def counts_sql(grp: str, dirty: str) -> str:
    return (
        f"count(*) FILTER (WHERE {grp} = 'priv') AS n_priv, "
        f"count(*) FILTER (WHERE {grp} = 'priv' AND {dirty}) AS dirty_priv, "
        f"count(*) FILTER (WHERE {grp} = 'dis') AS n_dis, "
        f"count(*) FILTER (WHERE {grp} = 'dis' AND {dirty}) AS dirty_dis"
    )
