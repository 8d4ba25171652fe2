"""Rate limits whose decisions depend on earlier ones, so each key is walked in order.

A key's calls come as sorted batches of bounded memory: the state is the accepted calls of one window at most.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _walk(rows: DataFrame, keys: list[str], at: str, order: str, decide) -> DataFrame:
    """Partitions by key, sorts within partitions and streams: no key has to fit in memory. decide(state, time, key) -> whether a call passes."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, order)) + ", accepted boolean"
    dealt = rows.select(*keys, at, order).repartition(*keys).sortWithinPartitions(*keys, at, order)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, deque()
        for batch in batches:
            out = []
            for *k, t in zip(*[batch[c] for c in (*keys, at)], strict=True):
                if k != now:
                    now, state = k, deque()
                out.append(decide(state, t, k))
            yield pd.DataFrame({**{c: batch[c] for c in (*keys, order)}, "accepted": out})

    return dealt.mapInPandas(walk, schema)


def _slide(state: deque, t: int, most: int, window: int) -> bool:
    while state and state[0] <= t - window:
        state.popleft()
    if len(state) >= most:
        return False
    state.append(t)
    return True


def sliding(rows: DataFrame, key: str, at: str, order: str, most: int, window: int) -> DataFrame:
    """(key, order, accepted): a call passes if fewer than `most` accepted calls lie in the `window` before it; rejected calls don't count."""
    return _walk(rows, [key], at, order, lambda state, t, _: _slide(state, t, most, window))


def by_scope(rows: DataFrame, scope: str, who: str, at: str, order: str, rates: dict[str, int], window: int) -> DataFrame:
    """(scope, who, order, accepted): as `sliding`, with a count of its own for each caller and scope, and the rate of the scope.

    Calls without a caller (no cookie yet) and scopes without a rate are exempt: they pass.
    """
    limited = F.col(who).isNotNull() & F.coalesce(F.col(scope).isin(*rates), F.lit(False))
    walked = _walk(rows.where(limited), [scope, who], at, order, lambda state, t, key: _slide(state, t, rates[key[0]], window))
    return walked.unionByName(rows.where(~limited).select(scope, who, order, F.lit(True).alias("accepted")))


def anchored(rows: DataFrame, key: str, at: str, order: str, most: int, window: int) -> DataFrame:
    """(key, order, accepted): the first call opens a window in which `most` calls pass; the next call after it opens another."""

    def decide(state: deque, t: int, _: list) -> bool:
        if not state or t - state[0] >= window:
            state.clear()
            state.extend((t, 0))
        state[1] += 1
        return state[1] <= most

    return _walk(rows, [key], at, order, decide)
