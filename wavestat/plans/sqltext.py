"""Helpers that write SQL text for the DuckDB oracle.

The oracle is an independent statement of each product in plain SQL; these
helpers only expand fixed lists (items, label maps) into SQL fragments.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + str(s).replace("'", "''") + "'"


def ident(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def in_list(values: Iterable) -> str:
    return "(" + ", ".join(q(v) if isinstance(v, str) else repr(v) for v in values) + ")"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    """CASE expr WHEN key THEN value ... ELSE default END."""
    whens = " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {q(v) if isinstance(v, str) else v}"
                     for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def case_in(expr: str, mapping: Sequence[tuple[object, Sequence]], default: str = "NULL") -> str:
    """CASE WHEN expr IN (...) THEN target ... ELSE default END (NULL -> default)."""
    whens = " ".join(f"WHEN {expr} IN {in_list(src)} THEN {q(t) if isinstance(t, str) else t}"
                     for t, src in mapping)
    return f"(CASE {whens} ELSE {default} END)"


def union_long(source: str, ids: Sequence[str], items: Sequence[str], name_col: str,
               value_col: str, value_cast: str | None = None) -> str:
    """Wide -> long as UNION ALL of one SELECT per item."""
    parts = []
    for it in items:
        v = ident(it) if value_cast is None else f"CAST({ident(it)} AS {value_cast})"
        id_list = "".join(f"{ident(i)}, " for i in ids)
        parts.append(f"SELECT {id_list}{q(it)} AS {name_col}, {v} AS {value_col} FROM {source}")
    return "\nUNION ALL\n".join(parts)


def r6(expr: str, alias: str) -> str:
    """Round a double result to 6 decimals, as the Spark side does (adding 0.0
    turns -0.0 into 0.0, which Spark's decimal-based rounding never yields)."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + CAST(0.0 AS DOUBLE)) AS {ident(alias)}"
