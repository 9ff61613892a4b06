"""Put the named relations a query needs in front of its select."""
from __future__ import annotations

from . import sql_files, sql_panel
from .present import COLUMNS, present_sql


def _rounded(relation: str, key: str) -> tuple[str, str]:
    """Every double of a relation to two decimals, half to even."""
    doubles = [item.split(":")[0] for item in COLUMNS[key].split() if item.endswith(":d")]
    shown = ", ".join(f"round_even({c} * 100.0, 0) / 100.0 AS {c}" for c in doubles)
    return relation, f"SELECT * REPLACE ({shown}) FROM {relation}"


RELATIONS = {**sql_panel.RELATIONS, **sql_files.RELATIONS,
             "rounded_units": _rounded("flat_units", "extract_units"),
             "rounded_areas": _rounded("flat_areas", "extract_areas")}
QUERIES = {**sql_panel.QUERIES, **sql_files.QUERIES}


def _needed(names: str, found: list[str]) -> list[str]:
    for name in names.split():
        if name not in found:
            _needed(RELATIONS[name][0], found)
            found.append(name)
    return found


def oracle_sql() -> dict[str, str]:
    out = {}
    for key, (names, relation) in QUERIES.items():
        parts = ", ".join(f"{n} AS MATERIALIZED ({RELATIONS[n][1]})" for n in _needed(names, []))
        out[key] = (f"WITH {parts} " if parts else "") + present_sql(relation, key)
    return out
