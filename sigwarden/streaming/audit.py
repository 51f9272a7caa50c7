"""Streams of device events: daily summaries with late data, wear sessions, timestamp jitter and online change-points.

Each function takes a streaming (or batch) DataFrame and returns one; the caller chooses sink, trigger and
checkpoint. State is bounded by the watermark, or by one fixed-size record a key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import RunLength


def with_event_time(df: DataFrame, time: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a time zone."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def daily_summary(events: DataFrame, key: str = "user_id", time: str = "ts", value: str = "value", late: str = "1 day") -> DataFrame:
    """(key, date, n, mean, least, greatest) in tumbling windows of a day; events later than ``late`` are dropped."""
    rows = with_event_time(events, time).withWatermark(time, late)
    days = rows.groupBy(F.window(time, "1 day"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return days.select(key, F.col("window.start").cast("date").alias("date"), "n", "mean", "least", "greatest")


def sliding_rate(events: DataFrame, key: str = "event_type", time: str = "ts", width: str = "6 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(key, start, end, n) in sliding windows."""
    rows = with_event_time(events, time).withWatermark(time, late)
    return rows.groupBy(F.window(time, width, slide), key).agg(F.count(F.lit(1)).alias("n")).select(key, "window.start", "window.end", "n")


def wear_sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(key, start, end, n): sessions that end when nothing comes for ``gap``."""
    rows = with_event_time(events, time).withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, "session_window.start", "session_window.end", "n")


def jitter(events: DataFrame, expected_ms: float, key: str = "user_id", time: str = "ts", jitter_ms: float = 5.0, gap_factor: float = 3.0, late_ms: int = 86_400_000) -> DataFrame:
    """(key, n_intervals, n_jitter, n_gaps) so far, after each batch that has events of the key.

    Times of the last ``late_ms`` before a key's latest one stay in its state, so an event that comes late, in whatever batch, splits the interval in
    which it belongs; older intervals are counts only, and an event that is later than that is left out.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = with_event_time(events, time).select(key, F.unix_millis(time).alias("ms"))

    def counts(ms: np.ndarray) -> np.ndarray:
        d = np.diff(ms)
        return np.array([len(d), (np.abs(d - expected_ms) > jitter_ms).sum(), (d > expected_ms * gap_factor).sum()])

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, bad, gaps, held = state.get if state.exists else (0, 0, 0, [])
        new = np.concatenate([b["ms"].to_numpy(np.int64) for b in batches])
        held = np.asarray(held, np.int64)
        # The first of the held times is settled: it ends the intervals that are counts.
        recent = np.sort(np.concatenate([held, new[new >= held[0]] if len(held) else new]))
        keep = max(int(np.searchsorted(recent, recent[-1] - late_ms)) - 1, 0)
        settled = np.array([n, bad, gaps]) + counts(recent[: keep + 1])
        state.update((*map(int, settled), recent[keep:].tolist()))
        total = settled + counts(recent[keep:])
        yield pd.DataFrame({key: [k[0]], "n_intervals": [int(total[0])], "n_jitter": [int(total[1])], "n_gaps": [int(total[2])]})

    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n_intervals long, n_jitter long, n_gaps long", "n long, bad long, gaps long, held array<long>", "update", "NoTimeout")


def change_points(events: DataFrame, key: str = "user_id", time: str = "ts", value: str = "value", hazard: float = 1 / 50, fall: int = 5, warm_up: int = 5, order: str = "event_id", late_ms: int = 86_400_000) -> DataFrame:
    """(key, index, score, value): online Bayesian change-points of each key's values in the order of (time, ``order``).

    A value waits in the state until one that is over ``late_ms`` later has come, so late and shuffled events are taken in their order and every
    batching gives the same rows; what is later still is left out. The prior mean is the mean of the first ``warm_up`` values. The state is the waiting
    values and one record of at most 200 run lengths a key.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = with_event_time(events, time).select(key, F.unix_millis(time).alias("ms"), F.col(order).cast("long").alias("id"), F.col(value).cast("double").alias("v"))

    def load(text: str | None) -> tuple[dict, RunLength | None]:
        if text is None:
            return {"n": 0, "last": 0, "first": [], "waiting": [], "done": None}, None
        s = json.loads(text)
        model = None
        if held := s.pop("model"):
            model = RunLength(held["mu0"], hazard)
            model.log_p, model.mu, model.beta = (np.array(held[k]) for k in ("log_p", "mu", "beta"))
        return s, model

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, model = load(state.get[0] if state.exists else None)
        new = pd.concat(list(batches)).dropna(subset=["v"])
        new = [(int(t), int(i), float(v)) for t, i, v in zip(new["ms"], new["id"].fillna(-1), new["v"])]
        waiting = sorted([*map(tuple, s["waiting"]), *[x for x in new if s["done"] is None or x[0] >= s["done"]]])
        done = waiting[-1][0] - late_ms if waiting else None
        due = [x for x in waiting if x[0] < done] if waiting else []
        found = []
        for _, _, v in due:
            taken = [v]
            if model is None:
                s["first"].append(v)
                if len(s["first"]) < warm_up:
                    continue
                model, taken, s["first"] = RunLength(float(np.mean(s["first"])), hazard), s["first"], []
            for x in taken:
                s["n"] += 1
                now = model.update(x)
                if s["last"] - now >= fall and s["n"] >= 5:
                    found.append((k[0], s["n"] - 1, float(s["last"] - now), x))
                s["last"] = now
        s["waiting"], s["done"] = waiting[len(due) :], done if s["done"] is None else max(done, s["done"]) if done is not None else s["done"]
        record = s | {"model": model and {"mu0": model.prior[0], "log_p": model.log_p.tolist(), "mu": model.mu.tolist(), "beta": model.beta.tolist()}}
        state.update((json.dumps(record),))
        yield pd.DataFrame(found, columns=[key, "index", "score", "value"])

    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, index long, score double, value double", "record string", "append", "NoTimeout")
