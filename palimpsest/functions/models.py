"""Language models and embedders behind small protocols, with offline defaults."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class LanguageModel(Protocol):
    def complete(self, prompt: str, temperature: float = 0.0, max_tokens: int = 1000) -> str: ...


class Offline:
    """Answers nothing; callers fall back to their rules."""

    def complete(self, prompt: str, temperature: float = 0.0, max_tokens: int = 1000) -> str:
        return ""


def with_retries(call, attempts: int = 4, base: float = 1.0, sleep=time.sleep):
    """call() again after base, 2 base, 4 base ... seconds; the last error is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            if i == attempts - 1:
                raise
            sleep(base * 2**i)


def hashing_embedding(text: str, width: int = 256) -> list[float]:
    """Normalized counts of tokens by the first four digits of their MD5; the same as the SQL embedder."""
    v = [0.0] * width
    for t in re.findall("[a-z0-9]+", text.lower()):
        v[int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % width] += 1
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def completed(df: DataFrame, prompt: str = "prompt", model: LanguageModel | None = None, out: str = "reply") -> DataFrame:
    """df with a reply and an error column: a failed call makes an error, not a failed job."""
    model = model or Offline()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies, errors = [], []
            for p in b[prompt]:
                try:
                    replies.append(with_retries(lambda p=p: model.complete(p)))
                    errors.append(None)
                except Exception as e:
                    replies.append(None)
                    errors.append(str(e))
            yield b.assign(**{out: replies, "error": errors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{out}` string, error string")
