"""The embedding stage (inventory I14): batches through a model, failures pass through without a vector."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.plans.ship import ensure

#: Inputs that a model is given at once.
BATCH = 16


class Embed(Protocol):
    """A model: vectors of ``width`` for some inputs, in their order."""

    width: int

    def embed(self, inputs: Sequence[np.ndarray]) -> Sequence[np.ndarray]: ...


def embedded(rows: DataFrame, model: Embed, key: str = "id", column: str = "input", batch: int = BATCH) -> DataFrame:
    """``key, v, error`` of rows with an array in ``column``.

    A null input has neither.  A batch that the model fails on, or answers with another number or
    width of vectors, has null vectors and the error; it stops nothing.  The model is sent to the
    workers, so it has to be small or load itself there.
    """

    def run(inputs: list[np.ndarray]) -> tuple[list, str | None]:
        try:
            found = [np.asarray(v, np.float32) for v in model.embed(inputs)]
            if len(found) != len(inputs) or any(v.shape != (model.width,) for v in found):
                raise ValueError(f"not {len(inputs)} vectors of width {model.width}")
            return [v.tolist() for v in found], None
        except Exception as e:  # noqa: BLE001  whatever a model raises, its rows go on
            return [None] * len(inputs), f"{type(e).__name__}: {e}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            vectors, errors = [None] * len(part), [None] * len(part)
            wanted = [i for i, x in enumerate(part[column]) if x is not None]
            for at in range(0, len(wanted), batch):
                places = wanted[at : at + batch]
                found, error = run([np.asarray(part[column].iloc[i], np.float32) for i in places])
                for i, v in zip(places, found, strict=True):
                    vectors[i], errors[i] = v, error
            yield pd.DataFrame({key: part[key], "v": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    ensure(rows.sparkSession)
    return rows.select(key, column).mapInPandas(work, f"`{key}` {dict(rows.dtypes)[key]}, v array<float>, error string")
