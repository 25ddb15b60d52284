"""The same questions over unbounded input: binned rates, gaps as session windows, a running filter and tracks, in order of event time.

Rows may come in any order within ``late``. The stateful operators hold a session's rows until the watermark has passed them, so that no earlier one can come any more, and then take them in
order of time: what they give does not depend on how the input was cut into batches, and equals the batch operators. Rows that come later than that are dropped, as Spark
drops them for any watermark. A session that is silent for longer than ``forget`` begins anew, and its state goes. Both need Spark's RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from frostline.operators.events import match_frames


def binned(stream: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(session_id, start, n, mean) of rows (session_id, t, value) in bins of time; rows later than ``late`` are dropped with their bin's state."""
    w = stream.withWatermark("t", late).groupBy("session_id", F.window("t", f"{seconds} seconds"))
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("session_id", F.col("window.start").alias("start"), "n", "mean")


def bursts(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(session_id, start, end, n): runs of rows without a pause of ``gap``; the pauses between them are the gaps."""
    w = stream.withWatermark("t", late).groupBy("session_id", F.session_window("t", gap))
    return w.agg(F.count("*").alias("n")).select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class InOrder(StatefulProcessor):
    """Holds rows (us, ...numbers) until the watermark has passed them, and gives those that are due in order to ``step(state, rows)``, which gives the state and the results.

    held: columns of the rows, the first of them "us", microseconds of event time; ties are ordered by the columns after it, in turn. kept: columns of the state, a table of few rows.
    A row that comes more than ``forget`` microseconds after the one before it finds an empty state.
    """

    def __init__(self, held: dict[str, str], kept: dict[str, str], step: Callable[[pd.DataFrame, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]], forget: int):
        self.columns, self.kept, self.step, self.forget = held, kept, step, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        ddl = lambda columns: ", ".join(f"{k} {v}" for k, v in columns.items())
        self.handle = handle
        self.waiting = handle.getListState("waiting", ddl(self.columns))
        self.state = handle.getListState("state", ddl(self.kept))
        self.last = handle.getValueState("last", "us long")

    def _table(self, state, columns: dict[str, str]) -> pd.DataFrame:
        return pd.DataFrame(list(state.get()) if state.exists() else [], columns=list(columns))

    def _wait(self, rows: pd.DataFrame) -> None:
        self.waiting.appendList([tuple(None if x != x else x for x in r) for r in rows.astype(object).itertuples(index=False)])
        self.handle.registerTimer(int(rows["us"].min()) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._wait(pd.concat(list(rows))[list(self.columns)])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self._table(self.waiting, self.columns)
        due = rows["us"] <= mark
        ready = rows[due].sort_values(list(self.columns), kind="stable")
        self.waiting.clear()
        if not due.all():
            self._wait(rows[~due])
        last = self.last.get()[0] if self.last.exists() else None
        if len(ready):
            state, out = self._table(self.state, self.kept), []
            before = ready["us"].shift(1, fill_value=ready["us"].iloc[0] if last is None else last)
            for _, part in ready.groupby((ready["us"] - before > self.forget).cumsum()):
                state, made = self.step(state.iloc[:0] if part["us"].iloc[0] - before[part.index[0]] > self.forget else state, part.reset_index(drop=True))
                out.append(made)
            self.state.clear()
            self.state.put([tuple(r) for r in state.astype(object).itertuples(index=False)])
            last = int(ready["us"].iloc[-1])
            self.last.update((last,))
            made = pd.concat(out)
            made.insert(0, "session_id", key[0])
            made.insert(1, "t", pd.to_datetime(made.pop("us"), unit="us", utc=True).dt.tz_localize(None))
            yield made
        if last is not None and due.all():
            if last + self.forget < mark:  # whatever comes yet is later still, and begins anew
                self.state.clear()
                self.last.clear()
            else:
                self.handle.registerTimer((last + self.forget) // 1000 + 1)


def _microseconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


def running_level(stream: DataFrame, late: str = "10 minutes", forget: str = "1 day", q: float = 1.0, r: float = 1.0, x0: float = 0.0, p0: float = 1.0) -> DataFrame:
    """(session_id, t, n, level, variance), one row for each row (session_id, t, value) in order of t: a random-walk filter. Null and NaN values only widen the variance; ties in t go by value."""

    def step(state: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        n, x, p = state.iloc[0] if len(state) else (0, x0, p0)
        out = []
        for us, y in zip(rows["us"].tolist(), rows["value"].astype(float).tolist(), strict=True):
            p, n = p + q, n + 1
            if y == y:
                x, p = x + p / (p + r) * (y - x), p * r / (p + r)
            out.append((us, int(n), float(x), float(p)))
        return pd.DataFrame([(int(n), float(x), float(p))], columns=["n", "x", "p"]), pd.DataFrame(out, columns=["us", "n", "level", "variance"])

    rows = stream.withWatermark("t", late).select("session_id", "t", F.unix_micros("t").alias("us"), F.col("value").cast("double").alias("value"))
    processor = InOrder({"us": "long", "value": "double"}, {"n": "long", "x": "double", "p": "double"}, step, _microseconds(forget))
    return rows.groupBy("session_id").transformWithStateInPandas(processor, "session_id string, t timestamp, n long, level double, variance double", "append", "eventTime")


def tracks(stream: DataFrame, reach: float = 5.0, late: str = "10 minutes", forget: str = "1 day") -> DataFrame:
    """(session_id, t, frame_idx, comp, track) of components (session_id, t, frame_idx, comp, cy, cx), as link_tracks names them. t must rise with frame_idx and be one a frame.

    The state is the last frame's components. A frame is matched once the watermark has passed its time.
    """

    def step(state: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        out = []
        for frame, now in rows.groupby("frame_idx", sort=True):
            now = now.sort_values("comp", kind="stable")
            if len(state) and state["frame_idx"].iloc[0] != frame - 1:
                state = state.iloc[:0]
            to = match_frames(*(x.to_numpy(np.float64) for x in (now["cy"], now["cx"], state["cy"], state["cx"])), reach)
            before = state["track"].tolist()
            names = [before[k] if k >= 0 else f"{int(frame)}:{int(c)}" for k, c in zip(to.tolist(), now["comp"], strict=True)]
            state = now[["frame_idx", "comp", "cy", "cx"]].assign(track=names)
            out.append(now[["us", "frame_idx", "comp"]].assign(track=names))
        return state, pd.concat(out).astype({"us": "int64", "frame_idx": "int32", "comp": "int64"})

    rows = stream.withWatermark("t", late).select("session_id", "t", F.unix_micros("t").alias("us"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("comp").cast("long").alias("comp"), "cy", "cx")
    held = {"us": "long", "frame_idx": "long", "comp": "long", "cy": "double", "cx": "double"}
    kept = {"frame_idx": "long", "comp": "long", "cy": "double", "cx": "double", "track": "string"}
    return rows.groupBy("session_id").transformWithStateInPandas(InOrder(held, kept, step, _microseconds(forget)), "session_id string, t timestamp, frame_idx int, comp long, track string", "append", "eventTime")
