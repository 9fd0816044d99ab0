"""Order and orientation of the contigs of a cluster.  A cluster is one group: its contigs, not its reads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Share of each change of an order in the evolution, and contestants of a tournament.
SWAP, ROTATE, SHIFT, REVERSE = 0.2, 0.2, 0.3, 0.3
TOURNAMENT = 3
#: Links between contigs: two arrays of numbers of contigs and one of weights.
Links = tuple[np.ndarray, np.ndarray, np.ndarray]


def links_of(weights: np.ndarray) -> Links:
    i, j = np.nonzero(np.triu(weights, 1))
    return i, j, weights[i, j]


def links_cost(order: np.ndarray, lengths: np.ndarray, links: Links) -> float:
    """Sum of weight * ln(mid-point distance + 1) of an order."""
    l = lengths[order]
    mid = np.empty(len(order))
    mid[order] = np.cumsum(l) - l / 2
    i, j, w = links
    return float((w * np.log(np.abs(mid[i] - mid[j]) + 1)).sum())


def tour_cost(order: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> float:
    return links_cost(order, lengths, links_of(weights))


def greedy_chain(n: int, links: Links) -> np.ndarray:
    """From the contig with the least weight, each time to the strongest link that is left; without one, to the first contig left."""
    near: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    total = np.zeros(n)
    for i, j, w in zip(*(x.tolist() for x in links), strict=True):
        near[i].append((-w, j))
        near[j].append((-w, i))
        total[[i, j]] += w
    start = int(np.argmin(np.where(total > 0, total, np.inf)))
    order, seen, first = [start], {start}, 0
    while len(order) < n:
        best = min((x for x in near[order[-1]] if x[1] not in seen), default=None)
        while first in seen:
            first += 1
        order.append(best[1] if best else first)
        seen.add(order[-1])
    return np.array(order, dtype=int)


def climb(order: np.ndarray, cost, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Inversions, moves and swaps that lower the cost, until none of the last rounds did."""
    best, n, stale = cost(order), len(order), 0
    while n > 2 and stale < rounds:
        i, j = sorted(rng.choice(n + 1, 2, replace=False))
        new = order.copy()
        kind = rng.random()
        if kind < 0.5:
            new[i:j] = new[i:j][::-1]
        elif kind < 0.8:
            part = new[i:j]
            rest = np.concatenate([new[:i], new[j:]])
            at = int(rng.integers(0, len(rest) + 1))
            new = np.concatenate([rest[:at], part, rest[at:]])
        else:
            a, b = rng.integers(0, n, 2)
            new[a], new[b] = new[b], new[a]
        value = cost(new)
        if value < best - 1e-12:
            order, best, stale = new, value, 0
        else:
            stale += 1
    return order


def _changed(order: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    new = order.copy()
    i, j = rng.choice(len(order), 2, replace=False)
    low, high = min(i, j), max(i, j) + 1
    kind = rng.random()
    if kind < SWAP:
        new[[i, j]] = new[[j, i]]
    elif kind < SWAP + ROTATE:
        new = np.roll(new, int(rng.integers(1, len(order))))
    elif kind < SWAP + ROTATE + SHIFT:
        new[low:high] = np.roll(new[low:high], -1 if i < j else 1)
    else:
        new[low:high] = new[low:high][::-1]
    return new


def evolve(order: np.ndarray, cost, rng: np.random.Generator, *, rate: float, population: int, stale: int) -> np.ndarray:
    """The best of generations of orders, until stale of them bring nothing better.

    Parents win tournaments; a child is changed with probability rate; the best order
    always goes on, so the result costs no more than the given one.
    """
    if len(order) < 3:
        return order
    people, costs = [order] * population, np.full(population, cost(order))
    best, low, still = order, costs[0], 0
    while still < stale:
        contest = rng.integers(0, population, (population - 1, TOURNAMENT))
        parents = contest[np.arange(population - 1), np.argmin(costs[contest], axis=1)]
        hit = rng.random(population - 1) < rate
        children = [_changed(people[p], rng) if h else people[p] for p, h in zip(parents, hit, strict=True)]
        values = [cost(c) if h else costs[p] for c, p, h in zip(children, parents, hit, strict=True)]
        people, costs = [best, *children], np.array([low, *values])
        k = int(np.argmin(costs))
        still = 0 if costs[k] < low - 1e-12 else still + 1
        best, low = people[k], costs[k]
    return best


def improve_links(lengths: np.ndarray, links: Links, *, seed: int = 42, rounds: int = 400, population: int = 20, generations: int = 100, rate: float = 0.2) -> np.ndarray:
    """The cheaper of a greedy chain and the given order, improved by steps, then by two evolutions, the second of three times the rate of changes."""
    n = len(lengths)
    if n == 0:
        return np.zeros(0, dtype=int)
    rng = np.random.default_rng(seed)
    cost = lambda order: links_cost(order, lengths, links)
    order = climb(min(np.arange(n), greedy_chain(n, links), key=cost), cost, rng, rounds)
    for r in (rate, min(1.0, 3 * rate)):
        order = evolve(order, cost, rng, rate=r, population=population, stale=generations)
    return order


def improve_order(lengths: np.ndarray, weights: np.ndarray, **options) -> np.ndarray:
    """improve_links() of a matrix of weights."""
    return improve_links(lengths, links_of(weights), **options)


def orient(order: np.ndarray, logs: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Signs (+1, -1) by dynamic programming over neighbours: u + shows its tail, v + its head."""
    n = len(order)
    score = np.zeros((n, 2))
    back = np.zeros((n, 2), dtype=int)
    for k in range(1, n):
        cell = logs.get((order[k - 1], order[k]), np.zeros((2, 2)))
        for s in (0, 1):  # 0: +, shows its head to the left
            options = [score[k - 1, r] + cell[1 - r, s] for r in (0, 1)]
            back[k, s] = int(np.argmax(options))
            score[k, s] = max(options)
    signs = np.zeros(n, dtype=int)
    s = int(np.argmax(score[-1])) if n else 0
    for k in range(n - 1, -1, -1):
        signs[k] = 1 if s == 0 else -1
        s = back[k, s]
    return signs


def order_clusters(contigs: DataFrame, cells: DataFrame, **options) -> DataFrame:
    """cluster, place, contig, strand.  contigs: cluster, contig, size.  cells: contig1, contig2, hh, ht, th, tt.  options: those of improve_links()."""
    both = cells.where("contig1 <> contig2").join(contigs.select("cluster", F.col("contig").alias("contig1")), "contig1").join(contigs.select("cluster", F.col("contig").alias("contig2")), ["cluster", "contig2"])
    links = both.select(F.col("cluster").alias("of"), "contig1", "contig2", "hh", "ht", "th", "tt")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("contig", ignore_index=True)
        at = {c: i for i, c in enumerate(left["contig"])}
        weights: dict[tuple[int, int], float] = {}
        logs = {}
        for r in right.itertuples(index=False):
            i, j = at[r.contig1], at[r.contig2]
            m = np.array([[r.hh, r.ht], [r.th, r.tt]], dtype=float)
            weights[min(i, j), max(i, j)] = m.sum()
            logs[i, j], logs[j, i] = np.log1p(m), np.log1p(m.T)
        ends = np.array(list(weights), dtype=int).reshape(-1, 2)
        order = improve_links(left["size"].to_numpy(float), (ends[:, 0], ends[:, 1], np.array(list(weights.values()), dtype=float)), **options)
        signs = orient(order, logs)
        return pd.DataFrame({"cluster": left["cluster"].iloc[0] if len(left) else "", "place": range(len(order)), "contig": left["contig"].to_numpy()[order], "strand": np.where(signs > 0, "+", "-")})

    return contigs.groupBy("cluster").cogroup(links.groupBy("of")).applyInPandas(run, "cluster string, place long, contig string, strand string")
