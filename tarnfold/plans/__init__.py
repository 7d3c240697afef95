"""Named queries over the shared tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from tarnfold.plans.registry import ORACLES, QUERIES, QueryFn


def _load() -> None:
    from tarnfold.plans import clustering, graph, mining, ordered, recommend, relational, simulation, statistics, streams, texts  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
