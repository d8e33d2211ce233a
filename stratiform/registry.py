"""name -> query, and name -> equivalent SQL."""

from __future__ import annotations

from .plans import alignment, core, imaging, kernels, records, volumes

MODULES = [core, imaging, kernels, alignment, records, volumes]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
