"""Folds along keys that are sequential by nature, as a stream of batches with the state carried from one to the next."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def carried(x: DataFrame, keys: list[str], order: str, start: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """Rows of start(), step(state, rows) -> (state, rows or None), end(key, state) -> rows or None over each key's rows in order.

    Keys are dealt to tasks and sorted by Spark, which spills; a task holds one batch of rows and one state, however long a key is. step may get a key's rows in
    any number of pieces.
    """

    def many(batches):
        key = state = None
        for pdf in batches:
            for k, rows in pdf.groupby(keys, sort=False):
                if k != key:
                    if key is not None and (out := end(key, state)) is not None:
                        yield out
                    key, state = k, start()
                state, out = step(state, rows)
                if out is not None:
                    yield out
        if key is not None and (out := end(key, state)) is not None:
            yield out

    return x.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(many, schema)
