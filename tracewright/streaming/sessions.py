"""Keyed state over streams: monotone sequences a session, and drift between count windows of a trace."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = 300  # accepted sequences that a session remembers


def accept_monotone(steps: DataFrame, session: str = "session", sequence: str = "sequence") -> DataFrame:
    """Rows (session, sequence, accepted) of a stream: a step is accepted if its sequence is above all accepted ones of its session.

    Rows of a batch are taken in the order of ``arrival``. State is the last sequence and how many were accepted, a row a session. It has
    no processing-time timeout: with one, a query over what is there now would never end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (-1, 0)
        for pdf in (pd.concat(list(batches)).sort_values("arrival"),):
            out = []
            for s in pdf[sequence]:
                ok = int(s) > last
                last, count = (int(s), count + 1) if ok else (last, count)
                out.append((key[0], int(s), ok))
            yield pd.DataFrame(out, columns=["session", "sequence", "accepted"])
        state.update((last, min(count, HISTORY)))

    return steps.groupBy(session).applyInPandasWithState(
        step, "session long, sequence long, accepted boolean", "last long, accepted long", "append", GroupStateTimeout.NoTimeout
    )


def phase_changes(keys: DataFrame, trace: str = "trace_id", size: int = 500, threshold: float = 0.2) -> DataFrame:
    """Rows (trace_id, window_idx, total_variation, boundary) of a stream (trace_id, arrival, key): each complete window of ``size`` accesses
    against the one before. State is the open window and the last one's counts, so at most two windows a trace."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, open_, last_keys, last_counts = state.get if state.exists else (0, [], [], [])
        open_, before = list(open_), dict(zip(last_keys, last_counts))
        out = []
        for k in pd.concat(list(batches)).sort_values("arrival")["key"]:
            open_.append(int(k))
            if len(open_) == size:
                now = pd.Series(open_).value_counts().to_dict()
                if index:
                    tv = sum(abs(now.get(x, 0) - before.get(x, 0)) for x in now.keys() | before.keys()) / (2 * size)
                    out.append((key[0], index, round(tv, 8), tv >= threshold))
                before, open_, index = {int(a): int(b) for a, b in now.items()}, [], index + 1
        state.update((index, open_, list(before), list(before.values())))
        yield pd.DataFrame(out, columns=["trace_id", "window_idx", "total_variation", "boundary"])

    return keys.groupBy(trace).applyInPandasWithState(
        advance, "trace_id long, window_idx long, total_variation double, boundary boolean", "idx long, open array<long>, keys array<long>, counts array<long>", "append", GroupStateTimeout.NoTimeout
    )
