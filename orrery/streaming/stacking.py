"""The ordered, stateful stack as a stream: one state for each key, samples integrated strictly by sequence number.

The state holds the running mean and second moment, the counts, the next sequence number and the samples that came early.
``checkpointLocation`` keeps it, so a restarted query goes on as if it had not stopped. Repeated sequence numbers are
refused before any work and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fold import FLOOR, HIGH, LOW, WARMUP

STATE = "next long, n long, mean double, m2 double, rejected long, repeated long, early_seq array<long>, early_v array<double>"
OUTPUT = "k long, next long, n long, mean double, variance double, rejected long, repeated long, waiting int, checkpoint boolean"


def integrate(state: tuple, v: float | None, low: float = LOW, high: float = HIGH, warmup: int = WARMUP, floor: float = FLOOR) -> tuple:
    """(n, mean, m2, rejected) after one sample; a rejected one moves only its count, a masked one nothing."""
    n, mean, m2, rejected = state
    if v is None or v != v:
        return state
    if n >= warmup and n > 1:
        sigma = max((m2 / (n - 1)) ** 0.5, floor)
        if v - mean < -low * sigma or v - mean > high * sigma:
            return n, mean, m2, rejected + 1
    new = mean + (v - mean) / (n + 1)
    return n + 1, new, m2 + (v - mean) * (v - new), rejected


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, n, mean, m2, rejected, repeated, seqs, values = state.get if state.exists else (1, 0, 0.0, 0.0, 0, 0, [], [])
    early = dict(zip(seqs, values))
    power = False
    for batch in batches:
        for s, v in zip(batch["seq"].tolist(), batch["v"].tolist()):
            if s < at or s in early:
                repeated += 1
            else:
                early[s] = v
    fold = (n, mean, m2, rejected)
    while at in early:
        fold = integrate(fold, early.pop(at))
        power = power or (at & (at - 1)) == 0
        at += 1
    n, mean, m2, rejected = fold
    order = sorted(early)
    state.update((at, n, mean, m2, rejected, repeated, order, [early[s] for s in order]))
    yield pd.DataFrame({"k": [key[0]], "next": [at], "n": [n], "mean": [mean if n else None], "variance": [m2 / (n - 1) if n > 1 else 0.0], "rejected": [rejected], "repeated": [repeated], "waiting": pd.Series([len(early)], dtype="int32"), "checkpoint": [power]})


def live_stack(samples: DataFrame) -> DataFrame:
    """samples (k long, seq long from 1, v double) to one row a key and batch (output mode update). ``checkpoint`` marks
    batches in which a key passed a depth that is a power of two."""
    return samples.select("k", "seq", "v").groupBy("k").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def start(samples: DataFrame, sink, checkpoint: str, once: bool = True):
    """Runs the stack into ``sink(batch, epoch)``; bounded by the source's ``maxFilesPerTrigger``. ``query.stop()`` ends it."""
    writer = live_stack(samples).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()
