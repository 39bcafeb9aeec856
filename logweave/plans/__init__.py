"""Named queries over the driver tables (one per operator of the survey) and
their DuckDB oracles."""

from __future__ import annotations

from logweave.plans.registry import ORACLES, QUERIES, Query


def _load() -> None:
    # importing the family modules fills the registry
    from logweave.plans import web, recon, relational, scalars, jsonq, io  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
