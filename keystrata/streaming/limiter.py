"""The sliding-log rate limiter over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def limited_stream(ops: DataFrame, seconds: int, number: int) -> DataFrame:
    """base_key, ts, seq and accepted of a stream's operations. The state of a
    key is its last accepted times, ``number`` at most; operations are taken
    in order within a micro-batch, and batches in the order they come."""

    def step(key, frames: Iterator[pd.DataFrame], state):
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")
        out = []
        for ts in rows["ts"]:
            passed = [t for t in passed if ts - t < seconds]
            out.append(len(passed) < number)
            if out[-1]:
                passed.append(int(ts))
        state.update((passed,))
        yield pd.DataFrame({"base_key": key[0], "ts": rows["ts"], "seq": rows["seq"], "accepted": out})

    return ops.select("base_key", "ts", "seq").groupBy("base_key").applyInPandasWithState(step, "base_key string, ts long, seq long, accepted boolean", "passed array<long>", "append", "NoTimeout")
