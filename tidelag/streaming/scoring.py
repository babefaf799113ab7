"""Fitted lag models on streams: lags need the last exposures of each group, which are kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.basis import Basis, with_basis
from ..operators.crossbasis import CrossBasis, with_history_basis


def score_stream(stream: DataFrame, column: str, basis: Basis, histories: CrossBasis | None = None, history: str | None = None, name: str = "b", cross: str = "cb") -> DataFrame:
    """The stream with the basis columns of each row's value and, if asked for, the cross-basis columns of its history array. Stateless."""
    out = with_basis(stream, column, basis, name)
    return out if histories is None else with_history_basis(out, history, histories, cross)


def score_lags(stream: DataFrame, group: str, time: str, x: str, cb: CrossBasis, coef, cen: float) -> DataFrame:
    """group, time, x, eta (the centred sum over lags; null until the group has a whole history) and late of each row.

    The state of a group is its last exposures and their last time. Rows of a batch are taken in order of time; a
    row that is not after the group's last time is late: it gets no eta and enters no history. Lags count rows.
    """
    low, high = cb.lag
    if low < 0:
        raise ValueError("a stream has no later rows for negative lags")
    weights = cb.weights @ np.asarray(coef, float).reshape(cb.df).T
    at_ref = cb.var(np.array([float(cen)]))[0]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, last = state.get if state.exists else ([], None)
        past = list(past)
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        eta, late = [], []
        for t, v in zip(rows[time].tolist(), rows[x].tolist(), strict=True):
            late.append(last is not None and t <= last)
            if late[-1]:
                eta.append(None)
                continue
            last = t
            past = [float("nan") if v is None else float(v), *past][: high + 1]
            value = float(((cb.var(np.array(past[low:])) - at_ref) * weights).sum()) if len(past) == high + 1 else float("nan")
            eta.append(None if np.isnan(value) else value)
        state.update((past, last))
        yield pd.DataFrame({group: key[0], time: rows[time].to_numpy(), x: rows[x].to_numpy(), "eta": pd.array(eta, "Float64").to_numpy(float, na_value=np.nan), "late": late})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    if kinds[time] not in ("bigint", "int", "double", "float"):
        raise ValueError("times are numbers: a clock in days or seconds")
    clock = "long" if kinds[time] in ("bigint", "int") else "double"
    out = f"`{group}` {kinds[group]}, `{time}` {kinds[time]}, `{x}` {kinds[x]}, eta double, late boolean"
    scored = stream.select(group, time, x).groupBy(group).applyInPandasWithState(run, out, f"past array<double>, last {clock}", "append", GroupStateTimeout.NoTimeout)
    return scored.selectExpr(f"`{group}`", f"`{time}`", f"`{x}`", "nanvl(eta, CAST(NULL AS DOUBLE)) AS eta", "late")
