"""Helpers to write oracle SQL (DuckDB) over the adapter views."""

from __future__ import annotations

from ledgerloom.sources.adapters import ADAPTERS, oracle_text

# DuckDB spelling of the text cleaners used by the library.  They mirror
# the column functions in ``ledgerloom.functions.text`` but are written
# independently, so the oracle is not the library's own expression.
NULLW = "('', 'nan', 'none', 'null', '<na>')"


def clean_text(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR lower(trim(CAST({x} AS VARCHAR))) IN {NULLW} THEN '' "
            f"ELSE trim(regexp_replace(trim(CAST({x} AS VARCHAR)), '\\.0$', '')) END)")


def clean_id(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR lower(trim(CAST({x} AS VARCHAR))) IN {NULLW} THEN '' "
            f"ELSE regexp_replace(trim(CAST({x} AS VARCHAR)), '\\.0$', '') END)")


def digits(x: str) -> str:
    return f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '[^0-9]', '', 'g')"


def zfill(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) < {n} THEN lpad({x}, {n}, '0') ELSE {x} END)"


def with_views(names: list[str], body: str) -> str:
    """``WITH <adapter> AS (...), ... <body>``; body may start with more CTEs
    (then it must begin with ', name AS (').
    """
    ctes = ",\n".join(f"{n} AS ({oracle_text(n)})" for n in names)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"


__all__ = ["ADAPTERS", "with_views", "clean_text", "clean_id", "digits", "zfill", "NULLW"]
