"""Order-dependent steps on small, bounded pools of a query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

LAMBDA = 0.7


def mmr(pool: pd.DataFrame, limit: int, balance: float = LAMBDA) -> pd.DataFrame:
    """Greedy diversification: the row of the greatest balance * score - (1 - balance) * likeness to those chosen; first on ties.

    Likeness is the Jaccard similarity of the rows' words. pool: doc, score, words, in rank order.
    """
    rows = [(d, s, set(w)) for d, s, w in zip(pool["doc"], pool["score"], pool["words"], strict=True)]
    chosen: list[tuple] = []
    worst = [0.0] * len(rows)
    left = list(range(len(rows)))
    while left and len(chosen) < limit:
        best = max(left, key=lambda i: (balance * rows[i][1] - (1 - balance) * worst[i], -i))
        left.remove(best)
        chosen.append((rows[best][0], len(chosen) + 1))
        for i in left:
            union = len(rows[i][2] | rows[best][2])
            worst[i] = max(worst[i], len(rows[i][2] & rows[best][2]) / union if union else 0.0)
    return pd.DataFrame(chosen, columns=["doc", "position"])


def diversify(pool: DataFrame, limit: int) -> DataFrame:
    """(query, doc, position) for pools (query, doc, score, rank, words) that a rank limit bounds."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = mmr(frame.sort_values("rank"), limit)
        return out.assign(query=key[0])[["query", "doc", "position"]]

    return pool.groupBy("query").applyInPandas(run, "query long, doc long, position int")
