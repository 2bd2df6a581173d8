"""Average-linkage clustering of episodes into topics, one sample a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def average_linkage(distance: np.ndarray, cut: float) -> list[list[int]]:
    """Clusters of row numbers: the closest two join while their mean distance is at most cut."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, groups = np.ones(n), {i: [i] for i in range(n)}
    while len(groups) > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        joint = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = joint, joint
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        groups[i] += groups.pop(j)
    return sorted((sorted(g) for g in groups.values()), key=lambda g: g[0])


def with_small_merged(vectors: np.ndarray, groups: list[list[int]], least: int = 2, similarity: float = 0.64) -> list[list[int]]:
    """Clusters of fewer than ``least`` join the one they are most similar to on average, if similar enough."""
    large = [list(g) for g in groups if len(g) >= least]
    if not large:
        return groups
    for g in (g for g in groups if len(g) < least):
        means = [float((vectors[g] @ vectors[h].T).mean()) for h in large]
        best = int(np.argmax(means))
        if means[best] >= similarity:
            large[best] += g
        else:
            large.append(list(g))
    return sorted((sorted(g) for g in large), key=lambda g: g[0])


def topics(episodes: DataFrame, cut: float = 0.30, similarity: float = 0.64) -> DataFrame:
    """Rows (sample_id, episode_id, topic): from rows (sample_id, episode_id, embedding)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("episode_id")
        v = np.array(rows["embedding"].tolist(), float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        groups = with_small_merged(v, average_linkage(1 - v @ v.T, cut), similarity=similarity)
        topic = {i: k for k, g in enumerate(groups) for i in g}
        return pd.DataFrame({"sample_id": rows["sample_id"], "episode_id": rows["episode_id"], "topic": [topic[i] for i in range(len(rows))]})

    return episodes.groupBy("sample_id").applyInPandas(run, "sample_id long, episode_id long, topic int")
