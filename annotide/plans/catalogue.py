"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from annotide.plans import edges, files, gates, harmony, joins, scalars, scores, search, sequences, spectra, stats, streams, tempo, windows  # noqa: F401  they register their queries
from annotide.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
