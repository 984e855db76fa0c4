"""K1: batch scoring with an opaque model.

``scorer_factory`` builds the model once per Python worker (workers are reused
by later tasks; ``cached_model`` holds it); the model maps a
list of texts to a (rows x outputs) array of logits. Rows arrive in Arrow
batches and are passed to the model ``batch_size`` at a time (the reference
scores 1 or 32 rows at a time). A null text is scored as the empty text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from dialogset.session import ship_package

_MODELS: dict[str, Callable] = {}


def cached_model(name: str, factory: Callable[[], Callable]) -> Callable:
    """The worker's model ``name``, built on first use; it takes the place of
    the worker's previous one. Tasks reach this function by import, so all
    tasks of a worker share one ``_MODELS``."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = factory()
    return _MODELS[name]


def score_texts(
    df: DataFrame,
    scorer_factory: Callable[[], Callable[[list[str]], np.ndarray]],
    text_col: str = "text",
    keep: list[str] | None = None,
    out_col: str = "logits",
    batch_size: int = 32,
    model_name: str | None = None,
) -> DataFrame:
    """Add ``out_col`` (``array<double>``) with the model's output per row. Calls
    that give the same ``model_name`` share a worker's model; without a name a
    model serves its own call only."""
    ship_package(df.sparkSession)
    keep = keep if keep is not None else [c for c in df.columns]
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out_col}` array<double>"
    key = model_name or uuid.uuid4().hex

    def run(batches):
        model = cached_model(key, scorer_factory)
        for b in batches:
            texts = b[text_col].fillna("").tolist()
            parts = [np.asarray(model(texts[i:i + batch_size]), dtype=float) for i in range(0, len(texts), batch_size)]
            res = b[keep].copy()
            res[out_col] = [row for part in parts for row in part]
            yield res

    cols = list(dict.fromkeys([*keep, text_col]))
    return df.select(*cols).mapInPandas(run, schema)


def char_stats_scorer() -> Callable[[list[str]], np.ndarray]:
    """A small deterministic stand-in model (two logits from text length and
    the share of vowels); any real model plugs in the same way."""

    def model(texts: list[str]) -> np.ndarray:
        s = pd.Series(texts, dtype="object")
        n = s.str.len().to_numpy(dtype=float)
        vowels = s.str.count("[aeiouAEIOU]").to_numpy(dtype=float)
        share = np.divide(vowels, n, out=np.zeros_like(n), where=n > 0)
        return np.stack([np.log1p(n) / 4.0, share * 8.0 - 2.0], axis=1)

    return model
