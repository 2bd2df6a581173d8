"""Metrics that need a pass over both word lists: ROUGE-L and BLEU of several orders."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def words(text: str | None) -> list[str]:
    return re.sub("[.,!?]", " ", (text or "").lower()).split()


def rouge_l(pred: list[str], ref: list[str]) -> float:
    """F of the longest common subsequence, unstemmed."""
    if not pred or not ref:
        return 0.0
    row = [0] * (len(ref) + 1)
    for p in pred:
        corner = 0
        for j, r in enumerate(ref, 1):
            corner, row[j] = row[j], corner + 1 if p == r else max(row[j], row[j - 1])
    n = row[-1]
    return 2 * n / (len(pred) + len(ref)) if n else 0.0


def bleu(pred: list[str], ref: list[str], weights: tuple[float, ...]) -> float:
    """Sentence BLEU; orders without a match count a tenth of one, none at all of order 1 gives 0."""
    if not pred or not ref:
        return 0.0
    logs = 0.0
    for n, w in enumerate(weights, 1):
        if not w:
            continue
        own, other = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (pred, ref))
        hits, total = sum((own & other).values()), max(1, sum(own.values()))
        if n == 1 and not hits:
            return 0.0
        logs += w * math.log((hits or 0.1) / total)
    return math.exp(logs) * (1.0 if len(pred) > len(ref) else math.exp(1 - len(ref) / len(pred)))


BLEU = ((1.0,), (0.5, 0.5), (0.33, 0.33, 0.33), (0.25, 0.25, 0.25, 0.25))


def with_metrics(pairs: DataFrame) -> DataFrame:
    """Rows (pair_id, rouge_l, bleu1 ... bleu4) from rows (pair_id, pred, ref)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [(words(p), words(r)) for p, r in zip(b["pred"], b["ref"], strict=True)]
            out = {"pair_id": b["pair_id"], "rouge_l": [rouge_l(p, r) for p, r in both]}
            yield pd.DataFrame(out | {f"bleu{i}": [bleu(p, r, w) for p, r in both] for i, w in enumerate(BLEU, 1)})

    return pairs.select("pair_id", "pred", "ref").mapInPandas(run, "pair_id long, rouge_l double, bleu1 double, bleu2 double, bleu3 double, bleu4 double")
