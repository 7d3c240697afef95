"""A junction of roads: densities on cells move by a conservative scheme, lights follow the densest approach.

A scenario is one group: steps follow each other, scenarios run beside each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ROADS, CELLS, CYCLE, RUSH = 16, 10, 20, 400
DT, DX, SPEED, BEST, FULL, START = 0.1, 0.2, 0.5, 0.5, 1.0, 0.1
#: Share of road a's flow that turns into road b.
TURNS = {(12, 0): 0.2, (12, 1): 0.8, (0, 11): 1.0, (1, 9): 0.3, (1, 10): 0.7, (13, 2): 0.2, (13, 3): 0.8, (2, 8): 1.0, (3, 10): 0.3, (3, 11): 0.7, (14, 4): 0.2, (14, 5): 0.8, (4, 9): 1.0, (5, 11): 0.3, (5, 8): 0.7, (15, 6): 0.2, (15, 7): 0.8, (6, 10): 1.0, (7, 8): 0.3, (7, 9): 0.7}
ENTRIES, EXITS = (12, 13, 14, 15), (8, 9, 10, 11)
#: Approaches that are green together.
PHASES = ((0, 4), (1, 5), (2, 6), (3, 7))


def flow(density):
    """Triangular flow of a density."""
    return SPEED * np.where(density <= BEST, density, 2 * BEST - density)


def turn_matrix() -> np.ndarray:
    m = np.zeros((ROADS, ROADS))
    for (a, b), share in TURNS.items():
        m[a, b] = share
    return m


def outflow(p: np.ndarray, green: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Flow out of each road's last cell: what leaves, within what its light and each road behind it let in."""
    last, first = p[-1], p[0]
    out = np.where(last <= BEST, flow(last), SPEED * BEST) * green
    room = np.where(first <= BEST, SPEED * BEST, flow(first))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.minimum(out, np.min(np.where(turns > 0, room[None, :] / turns, np.inf), axis=1))
    out[list(EXITS)] = flow(last[list(EXITS)])
    return out


def step(p: np.ndarray, green: np.ndarray, entering: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Densities (cells x roads) one step on; ``entering``: flow into the entry roads."""
    out = outflow(p, green, turns)
    into = out @ turns
    into[list(ENTRIES)] = entering
    f = flow(p)
    c = 0.5 * DT / DX
    new = np.empty_like(p)
    new[2:-2] = (p[1:-3] + 2 * p[2:-2] + p[3:-1]) / 4 - c * (f[3:-1] - f[1:-3])
    new[0] = (3 * p[0] + p[1]) / 4 - c * (f[1] + f[0] - 2 * into)
    new[1] = (p[0] + 2 * p[1] + p[2]) / 4 - c * (f[2] - into)
    new[-2] = (p[-3] + 2 * p[-2] + p[-1]) / 4 - c * (out - f[-3])
    new[-1] = (p[-2] + 3 * p[-1]) / 4 - c * (2 * out - f[-1] - f[-2])
    return np.clip(new, 0, FULL)


def run(seed: int, steps: int = 2000) -> np.ndarray:
    """Densities (steps x cells x roads) of a scenario; one draw of inflow for each entry road and step."""
    rng, turns = np.random.default_rng(seed), turn_matrix()
    out = np.empty((steps, CELLS, ROADS))
    out[0] = START
    approaches = np.arange(8)
    green = np.ones(ROADS)
    green[approaches] = 0
    for t in range(1, steps):
        scale = np.array([2.5 if t < RUSH else 10.0, 10.0, 10.0 if t < steps - RUSH else 2.5, 10.0])
        out[t] = step(out[t - 1], green, rng.random(4) / scale, turns)
        if t % CYCLE == 0:
            seen = out[t, -3, approaches]
            pick = int(rng.choice(np.flatnonzero(seen == seen.max())))
            green[approaches] = 0
            green[list(next(g for g in PHASES if pick in g))] = 1
    return out


def simulate(scenarios: DataFrame, steps: int = 2000, every: int = 20) -> DataFrame:
    """``scenario, t, road, cell, density`` at every ``every``-th step; ``scenarios``: column scenario (the seed)."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["scenario"].iloc[0])
        p = run(s, steps)[::every]
        t, k, i = np.indices(p.shape)
        return pd.DataFrame({"scenario": s, "t": t.ravel() * every, "road": i.ravel(), "cell": k.ravel(), "density": p.ravel()})

    return scenarios.groupBy("scenario").applyInPandas(work, "scenario bigint, t bigint, road bigint, cell bigint, density double")
