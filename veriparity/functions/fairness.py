"""Group fairness gaps as column expressions over confusion counts.

A count builder takes a group (``priv`` or ``dis``) and a cell (``tp`` ``tn``
``fp`` ``fn``) and returns the column that holds the count, so one metric
definition serves wide tables, maps and joined rows alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriparity.functions.values import ratio

Counts = Callable[[str, str], Column]
GROUPS = ("priv", "dis")
CELLS = ("tp", "tn", "fp", "fn")


def _share(counts: Counts, group: str, hit: tuple[str, ...], whole: tuple[str, ...]) -> Column:
    def total(cells: tuple[str, ...]) -> Column:
        out = counts(group, cells[0])
        for cell in cells[1:]:
            out = out + counts(group, cell)
        return out

    return ratio(total(hit), total(whole))


def _gap(hit: tuple[str, ...], whole: tuple[str, ...]) -> Callable[[Counts], Column]:
    return lambda counts: _share(counts, "priv", hit, whole) - _share(counts, "dis", hit, whole)


# metric -> gap, and gap when the undesired class is the one of interest
METRICS = {
    "equal_opportunity": (_gap(("tp",), ("tp", "fn")), _gap(("tn",), ("tn", "fp"))),
    "predictive_parity": (_gap(("tp",), ("tp", "fp")), _gap(("tn",), ("tn", "fn"))),
    "statistical_parity": (_gap(("tp", "fp"), CELLS), None),
}


def fairness_gap(metric: str, counts: Counts, flipped: bool | Column = False) -> Column:
    """Privileged minus disadvantaged rate; NULL when a rate has no rows."""
    if metric not in METRICS:
        raise ValueError(f"Unsupported: {metric}")
    straight, other = METRICS[metric]
    if flipped is False:
        return straight(counts)
    if other is None:
        raise ValueError(f"Unsupported: flipped {metric}")
    return other(counts) if flipped is True else F.when(flipped, other(counts)).otherwise(straight(counts))


def wide_counts(prefix: str = "", dis: str = "dis") -> Counts:
    """Counts in columns ``{prefix}{cell}_{group}``."""
    name = {"priv": "priv", "dis": dis}
    return lambda group, cell: F.col(f"{prefix}{cell}_{name[group]}")


def map_counts(metrics: Column, prefix: Column, criteria: Column) -> Counts:
    """Counts in a map under ``{prefix}__{criteria}_{group}__{cell}``."""
    return lambda group, cell: F.try_element_at(
        metrics, F.concat(prefix, F.lit("__"), criteria, F.lit(f"_{group}__{cell}"))
    )
