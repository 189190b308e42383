"""Greedy choice of pages under a token budget."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Candidate:
    id: str
    tokens: int
    coverage: dict[str, float]
    strength: float

    def density(self) -> float:
        return sum(self.coverage.values()) / max(self.tokens, 1)


def pack(candidates: Sequence[Candidate], budget: int) -> list[str]:
    """Identifiers in the order chosen: always the fitting candidate with the largest gain in coverage per token.

    Coverage of a concept is the best weighted score so far, so gains only shrink: a candidate whose gain is stale is
    looked at again only when it comes up, and the choice is that of trying them all. Earlier candidates win ties. If
    none fits at all, the densest alone is chosen.
    """
    if budget < 1:
        raise ValueError("budget has to be at least 1")
    if not candidates:
        return []
    if all(c.tokens > budget for c in candidates):
        return [max(candidates, key=Candidate.density).id]
    best: dict[str, float] = {}

    def gain(c: Candidate) -> float:
        return sum(max(0.0, s * c.strength - best.get(name, 0.0)) for name, s in c.coverage.items()) / max(c.tokens, 1)

    queue = [(-gain(c), i) for i, c in enumerate(candidates)]
    heapq.heapify(queue)
    chosen: list[str] = []
    seen: set[str] = set()
    while queue and budget > 0:
        stale, i = heapq.heappop(queue)
        c = candidates[i]
        if c.tokens > budget or c.id in seen:
            continue
        fresh = (-gain(c), i)
        if fresh > (stale, i) and queue and fresh > queue[0]:
            heapq.heappush(queue, fresh)
            continue
        chosen.append(c.id)
        seen.add(c.id)
        budget -= c.tokens
        for name, s in c.coverage.items():
            best[name] = max(best.get(name, 0.0), s * c.strength)
    return chosen


def pack_groups(candidates: DataFrame) -> DataFrame:
    """(key, rank, id) of the chosen for each ``key``: candidates (key, ord, id, tokens, coverage map, strength, budget).

    A key's candidates are those of one query, in order ``ord``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [Candidate(r.id, int(r.tokens), dict(r.coverage), float(r.strength)) for r in pdf.sort_values("ord").itertuples()]
        ids = pack(rows, int(pdf.budget.iloc[0]))
        return pd.DataFrame({"key": [pdf.key.iloc[0]] * len(ids), "rank": range(1, len(ids) + 1), "id": ids})

    return candidates.groupBy("key").applyInPandas(run, "key string, rank int, id string")
