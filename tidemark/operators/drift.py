"""Change detectors over ordered values: prefix sums between alarms, and an adaptive window.

Both keep a state of bounded size per key, so a key's history streams past in Arrow batches
and the same functions serve the batch query and the streaming job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

START = (0.0, 0.0, 0.0, 0.0)
# Buckets of one size that an adaptive window keeps before it joins the two oldest.
PER_SIZE = 5


def page_hinkley(values: np.ndarray, state: tuple, threshold: float, warmup: int = 30, slack: float = 0.005):
    """Alarms of a Page-Hinkley test and the state (count, sum, excess, lowest excess) after it.

    The excess over the running mean is a prefix sum of the whole stretch up to the next
    alarm, and its distance from its running minimum is compared at once; after an alarm
    the next stretch starts from nothing.
    """
    flags = np.zeros(len(values), bool)
    at = 0
    while at < len(values):
        n, total, excess, low = state
        x = values[at:]
        count = n + np.arange(1, len(x) + 1)
        ready = count >= warmup
        above = excess + np.cumsum(np.where(ready, x - (total + np.cumsum(x)) / count - slack, 0.0))
        floor = np.minimum.accumulate(np.minimum(np.where(ready, above, low), low))
        hit = np.flatnonzero(ready & (above - floor > threshold))
        if not len(hit):
            return flags, (float(count[-1]), float(total + x.sum()), float(above[-1]), float(floor[-1]))
        at += int(hit[0]) + 1
        flags[at - 1] = True
        state = START
    return flags, state


def adaptive_window(values: np.ndarray, buckets: list, delta: float = 0.002, least: int = 5):
    """Alarms of an adaptive window and its buckets (count, sum), oldest first.

    The window is a histogram of buckets whose sizes double with age, so it covers all
    values since the last change in logarithmic space. A value alarms when, at some bucket
    border with ``least`` values on both sides, the two means differ by the Hoeffding bound
    or more; the older part is then forgotten.
    """
    flags = np.zeros(len(values), bool)
    scale = math.log(4.0 / delta) / 2.0
    for i, x in enumerate(values.tolist()):
        buckets.append((1, x))
        size = 1
        while True:
            same = [k for k, b in enumerate(buckets) if b[0] == size]
            if len(same) <= PER_SIZE:
                break
            a, b = same[:2]
            buckets[a:b + 1] = [(2 * size, buckets[a][1] + buckets[b][1])]
            size *= 2
        n = np.cumsum([b[0] for b in buckets])
        s = np.cumsum([b[1] for b in buckets])
        old, new = n[:-1], n[-1] - n[:-1]
        fair = (old >= least) & (new > least)
        if fair.any():
            old, new, left = old[fair], new[fair], s[:-1][fair]
            apart = np.abs(left / old - (s[-1] - left) / new) >= np.sqrt(scale * (1.0 / old + 1.0 / new))
            if apart.any():
                flags[i] = True
                del buckets[:int(np.flatnonzero(fair)[np.flatnonzero(apart)[0]]) + 1]
    return flags, buckets


def detect_changes(df: DataFrame, key: str, t: str, order: Sequence[str], value: str, detector: Callable, start: Callable) -> DataFrame:
    """Rows with ``drift``: ``detector(values, state)`` runs over each key's values in order.

    Rows are sorted inside hash partitions and pass in batches, one stretch of a key at a
    time; ``start()`` gives the state of a new key.
    """
    slim = df.select(key, t, *order, value).repartition(key).sortWithinPartitions(key, t, *order)
    schema = ", ".join(f"{n} {ty}" for n, ty in slim.dtypes) + ", drift boolean"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            flags = np.zeros(len(pdf), bool)
            names, values = pdf[key].to_numpy(), pdf[value].to_numpy(float)
            borders = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(pdf)] if len(pdf) else [0]
            for a, b in zip(borders, borders[1:]):
                if state is None or names[a] != current:
                    current, state = names[a], start()
                flags[a:b], state = detector(values[a:b], state)
            yield pdf.assign(drift=flags)

    return slim.mapInPandas(scan, schema)
