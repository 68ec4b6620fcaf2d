"""Draws of the hierarchical Pitman-Yor model: tables of dishes, and the contexts' strength.

A dish's customers sit at its tables in its restaurant; each of these tables is one customer of the
dish in the parent restaurant. With discount 1/2 the number of ways to seat c customers at t tables
(summed over who sits where, with the weights of their sizes) is (2c-t-1)! / ((c-t)! (t-1)! 4^(c-t)), a
generalised Stirling number; so all customers of a dish can leave and be seated anew at once, given
all the rest, by a draw of t from its exact conditional distribution.
"""

from __future__ import annotations

import numpy as np

DISCOUNT = 0.5
#: Dishes with more customers are drawn in a window around the mode.
WHOLE = 32
#: Half a window: so many standard deviations, and places beside them.
DEVIATIONS, MORE = 12.0, 24.0
#: Numbers held by one step of a draw.
CELLS = 1 << 21


def log_ratio(t: np.ndarray, customers, others, own, total, strength: float, discount: float, parent: float) -> np.ndarray:
    """log p(t + 1) / p(t) for a dish with ``customers``, ``others`` tables of other dishes in its
    restaurant, ``own`` customers of the dish in the parent from other restaurants and ``total`` of all."""
    return (
        np.log(2.0 * (2.0 * strength + others + t) * (customers - t)) - np.log(t * (2.0 * customers - t - 1.0))
        + np.log(own + t - discount) - np.log(parent + total + t)
    )


def _inverse(first: np.ndarray, width: int, draw: np.ndarray, given: tuple, strength: float, discount: float, parent: float, last: np.ndarray) -> np.ndarray:
    """Draws from first..min(first + width - 1, last) by adding up probabilities."""
    t = first[:, None] + np.arange(width - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = log_ratio(t, *(x[:, None] for x in given), strength, discount, parent)
    steps = np.where(t < last[:, None], steps, -np.inf)
    logs = np.concatenate((np.zeros((len(first), 1)), np.cumsum(steps, axis=1)), axis=1)
    upto = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return first + (upto < (draw * upto[:, -1])[:, None]).sum(axis=1)


def table_draws(
    customers: np.ndarray, others: np.ndarray, own: np.ndarray, total: np.ndarray, draw: np.ndarray, strength: float, discount: float, parent: float
) -> np.ndarray:
    """Numbers of tables of dishes, each drawn given the rest, from uniform ``draw``s."""
    c = customers.astype(np.float64)
    given = (c, others.astype(np.float64), own.astype(np.float64), total.astype(np.float64))
    first, last = np.ones(len(c), dtype=np.int64), customers.astype(np.int64)
    wide = np.flatnonzero(customers > WHOLE)
    if len(wide):
        some = tuple(x[wide] for x in given)

        def step(at: np.ndarray) -> np.ndarray:
            return log_ratio(at.astype(np.float64), *some, strength, discount, parent)

        # the last place with a ratio of 1 or more, by halving
        low, high = np.ones(len(wide), dtype=np.int64), last[wide] - 1
        while (low < high).any():
            middle = (low + high + 1) // 2
            up = step(middle) >= 0
            low, high = np.where(up, middle, low), np.where(up, high, np.maximum(middle - 1, low))
        bend = np.maximum(step(low) - step(np.minimum(low + 1, last[wide] - 1)), 1.0 / some[0])
        half = np.minimum(DEVIATIONS / np.sqrt(bend) + MORE, some[0]).astype(np.int64)
        first[wide], last[wide] = np.maximum(low - half, 1), np.minimum(low + half, last[wide])
    out = np.ones(len(c), dtype=np.int64)
    spans = last - first + 1
    widths = 1 << np.ceil(np.log2(np.maximum(spans, 1))).astype(np.int64)
    for width in np.unique(widths[spans > 1]).tolist():
        rows = np.flatnonzero((widths == width) & (spans > 1))
        for i in range(0, len(rows), max(1, CELLS // width)):
            part = rows[i : i + max(1, CELLS // width)]
            out[part] = _inverse(first[part], width, draw[part], tuple(x[part] for x in given), strength, discount, parent, last[part])
    return out


def strength_sums(customers: np.ndarray, tables: np.ndarray, strength: float, rng: np.random.Generator) -> tuple[float, float]:
    """Sums of the auxiliary draws by which the strength of all restaurants is drawn next: of log Beta
    (strength + 1, customers - 1), and of Bernoulli (strength / (strength + i / 2)) for tables i."""
    several = customers > 1
    logs = float(np.log(rng.beta(strength + 1.0, customers[several] - 1.0)).sum())
    ones = 0.0
    number = np.maximum(tables - 1, 0)
    upto = np.cumsum(number)
    every = int(upto[-1]) if len(upto) else 0
    for a in range(0, every, CELLS):
        places = np.arange(a, min(a + CELLS, every))
        of = np.searchsorted(upto, places, "right")
        i = places - (upto[of] - number[of]) + 1
        ones += float((rng.random(len(i)) < strength / (strength + DISCOUNT * i)).sum())
    return logs, ones
