"""Doors to services and models that aren't installed: callables are injected, nothing is on by default."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def interpret(prompts: Iterable[str], ask: Callable[[str], str] | None = None, pause: float = 1.0) -> Iterator[str]:
    """Answers of a language model, one prompt after another with a pause; an error becomes an answer that says so."""
    if ask is None:
        raise RuntimeError("no model: give a callable that takes a prompt and returns a text")
    for i, prompt in enumerate(prompts):
        if i and pause:
            time.sleep(pause)
        try:
            yield ask(prompt)
        except Exception as e:  # noqa: BLE001
            yield f"ERROR: {e}"


def infer(df: DataFrame, model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A model over batches of rows (embeddings, tags, links): model() is called once in each task and loads it there."""

    def run(batches):
        predict = model()
        for batch in batches:
            yield predict(batch)

    return df.mapInPandas(run, schema)
