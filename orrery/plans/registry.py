"""All queries of the numeric library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from orrery.operators import chirp, cluster, numeric, scalars, scan, sequence, series, spectral, stats, summary, tensor, tiles, tridiagonal
from orrery.streaming import windows

MODULES = (stats, summary, scalars, sequence, scan, cluster, tensor, tiles, series, spectral, chirp, tridiagonal, numeric, windows)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
