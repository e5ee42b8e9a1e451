"""Models as Columns: a callable on a list of texts, called in small batches from iterator UDFs, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ATTEMPTS, FIRST_WAIT = 4, 1.0


def called(model: Callable[[list[Any]], list[Any]], batch: list[Any], attempts: int = ATTEMPTS, wait: float = FIRST_WAIT) -> list[Any]:
    """The model's answer to a batch; failures are tried again after 1, 2, 4 seconds, and the last one is raised."""
    for n in range(attempts):
        try:
            out = list(model(batch))
            if len(out) != len(batch):
                raise ValueError(f"{len(out)} answers to {len(batch)} inputs")
            return out
        except Exception:
            if n + 1 == attempts:
                raise
            time.sleep(wait * 2**n)
    return []


def model_column(load: Callable[[], Callable[[list[Any]], list[Any]]], returns: str, text: Column, batch: int = 8, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT) -> Column:
    """Column of a model's answers. ``load`` runs once per task, so clients and sessions aren't shipped; nulls stay null."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            asked = s.dropna()
            # Texts of like length go together, so a model that pads does little of it.
            order = asked.map(len).sort_values(kind="stable").index
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                for i, x in zip(part, called(model, asked.loc[part].tolist(), attempts, wait), strict=True):
                    out.at[i] = x
            yield out

    return run(text)


def checked_vectors(vectors: Column, dim: int) -> Column:
    """Embeddings of the expected length; others raise."""
    return F.when(vectors.isNull() | (F.size(vectors) == dim), vectors).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vectors).cast("string"))).cast("array<double>"))
