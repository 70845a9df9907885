"""Many small groups in one call of Python: what a grouped map does for each of them, without its cost for each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def in_groups(df: DataFrame, keys, run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of run(rows, starts) for whole groups of equal keys: rows of several groups, one after the other, and where each begins.

    A partition is sorted by keys and read in batches; the last group of a batch waits until its end is seen, so a group must fit into a task and the partition needn't.
    """
    keys = list(keys)

    def begins(rows: pd.DataFrame) -> np.ndarray:
        group = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        return np.flatnonzero(np.diff(group, prepend=-1))

    def batches(parts):
        waiting: list[pd.DataFrame] = []
        for part in parts:
            if not len(part):
                continue
            first = begins(part)
            if waiting and len(begins(pd.concat([waiting[-1].iloc[-1:], part.iloc[:1]], ignore_index=True))) == 1:
                if len(first) == 1:
                    waiting.append(part)
                    continue
                whole, first = pd.concat([*waiting, part.iloc[: first[-1]]], ignore_index=True), first[-1:]
            else:
                whole = pd.concat([*waiting, part.iloc[: first[-1]]], ignore_index=True)
            if len(whole):
                yield run(whole, begins(whole))
            waiting = [part.iloc[first[-1] :]]
        if waiting:
            whole = pd.concat(waiting, ignore_index=True)
            yield run(whole, begins(whole))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(batches, schema)


def slices(starts: np.ndarray, n: int, most: int, room: int = 0):
    """(first row, end, starts from the first row on) of runs of groups with most cells at most, or of one group: cells are rows, or room for each group where that is more."""
    ends, k = np.append(starts[1:], n), 0
    size = np.cumsum(np.maximum(ends - starts, room))
    while k < len(starts):
        end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + most, "right")))
        yield int(starts[k]), int(ends[end - 1]), starts[k:end] - starts[k]
        k = end


def group_of(starts: np.ndarray, n: int) -> np.ndarray:
    """The group's number for each of n rows."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
