"""Stateful stream operators. Each keeps a small state for its key and gives what the batch form gives, however the rows
fall into micro-batches. Rows that come later than the watermark allows are not seen, as usual."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(frames) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order of time."""
    p = pd.concat(list(frames), ignore_index=True)
    return p.sort_values("timestamp", kind="stable").reset_index(drop=True)


def _seconds(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "none") -> DataFrame:
    """``rows`` through ``processor``, key by key. Its typed states need the RocksDB store, which the session is told to use."""
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {dict(rows.dtypes)[key]}, {schema}", "append", time)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows, with an explicit lateness."""
    e = events.withWatermark("timestamp", late)
    return e.groupBy(F.window("timestamp", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, key: str, gap: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: start, last event and count. An exact gap still belongs to the session."""
    e = events.withWatermark("timestamp", late)
    return e.groupBy(F.session_window("timestamp", gap).alias("w"), key).agg(F.count("*").alias("n"), F.max("timestamp").alias("last")).select(key, F.col("w.start").alias("start"), "last", "n")


class _Sessions(StatefulProcessor):
    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "second long, n long")

    def handleInputRows(self, key, rows, timerValues):
        p = _ordered(rows)
        s = np.floor(_seconds(p["timestamp"])).astype(np.int64)
        known = self.last.exists()
        second, n = self.last.get() if known else (0, 0)
        before = np.concatenate([[second], s[:-1]])
        new = np.abs(s - before) > self.gap
        new[0] |= not known
        session = n + np.cumsum(new)
        self.last.update((int(s[-1]), int(session[-1])))
        yield pd.DataFrame({self.key: key[0], "id": p["id"], "timestamp": p["timestamp"], "session": session})


def session_ids(events: DataFrame, key: str, gap: int = 600) -> DataFrame:
    """(key, id, timestamp, session): a number for each event's session; the state is the last time and number, and always
    moves to the latest event, in order or not. Differences count in whole seconds."""
    return _stateful(events, key, _Sessions(key, gap), "id string, timestamp timestamp, session long")


class _Runs(StatefulProcessor):
    def __init__(self, key: str, least: int):
        self.key, self.least = key, least

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", "app string, title string, start double")

    def handleInputRows(self, key, rows, timerValues):
        p = _ordered(rows)
        s, app, title = _seconds(p["timestamp"]), p["app"].to_numpy(object), p["title"].to_numpy(object)
        if self.open.exists():
            a, t, start = self.open.get()
            s, app, title = np.concatenate([[start], s]), np.concatenate([[a], app]), np.concatenate([[t], title])
        first = np.concatenate([[True], (app[1:] != app[:-1]) | (title[1:] != title[:-1])])
        at = np.flatnonzero(first)
        lasted = np.floor(s[at[1:]]).astype(np.int64) - np.floor(s[at[:-1]]).astype(np.int64)
        self.open.update((app[at[-1]], title[at[-1]], float(s[at[-1]])))
        k = at[:-1][lasted >= self.least]
        yield pd.DataFrame({self.key: key[0], "app": app[k], "title": title[k], "start": pd.to_datetime(np.round(s[k] * 1e6).astype(np.int64), unit="us"), "duration_seconds": lasted[lasted >= self.least]})


def focus_runs(log: DataFrame, key: str, least: int = 30) -> DataFrame:
    """(key, app, title, start, duration_seconds): runs of one window, emitted when the next begins. The open run is kept in
    the state, so one that spans micro-batches is not cut."""
    return _stateful(log, key, _Runs(key, least), "app string, title string, start timestamp, duration_seconds long")


class _Debounce(StatefulProcessor):
    def __init__(self, key: str, quiet: float):
        self.key, self.quiet = key, quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.waits = handle.getValueState("waits", "type string, at double")
        self.paused = handle.getValueState("paused", "since double")

    def _rows(self, key, out):
        kinds, times = zip(*out, strict=True) if out else ((), ())
        return pd.DataFrame({self.key: [key[0]] * len(out), "type": list(kinds), "timestamp": pd.to_datetime(np.round(np.array(times, float) * 1e6).astype(np.int64), unit="us")})

    def handleInputRows(self, key, rows, timerValues):
        p, out = _ordered(rows), []
        kind, at = self.waits.get() if self.waits.exists() else (None, 0.0)
        since = self.paused.get()[0] if self.paused.exists() else None
        for what, s in zip(p["type"], _seconds(p["timestamp"]), strict=True):
            if kind is not None and s - at >= self.quiet:
                out.append((kind, at))
                kind = None
            if what == "screen_lock":
                kind, since = None, s
            elif what == "screen_unlock":
                since = None
                out.append((what, s))
            elif since is None:
                kind, at = what, s
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if kind is None:
            self.waits.clear()
        else:
            self.waits.update((kind, float(at)))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, int(self.quiet * 1000)))
        self.paused.clear() if since is None else self.paused.update((float(since),))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = [self.waits.get()] if self.waits.exists() else []
        self.waits.clear()
        yield self._rows(key, out)


def debounced(triggers: DataFrame, key: str, quiet: float = 0.5) -> DataFrame:
    """(key, type, timestamp) of triggers that fire: the latest once ``quiet`` seconds of processing time pass without
    another, by a timer, or once a later row shows that they passed. screen_lock forgets what waits and pauses the key until
    screen_unlock, which fires at once."""
    return _stateful(triggers, key, _Debounce(key, quiet), "type string, timestamp timestamp", "ProcessingTime")


class _Idle(StatefulProcessor):
    def __init__(self, key: str, timeout: float):
        self.key, self.timeout = key, timeout

    def init(self, handle) -> None:
        self.idle = handle.getValueState("idle", "since boolean")

    def handleInputRows(self, key, rows, timerValues):
        p = _ordered(rows)
        now = (p["idle"] >= self.timeout).to_numpy(bool)
        was = np.concatenate([[bool(self.idle.get()[0]) if self.idle.exists() else False], now[:-1]])
        self.idle.update((bool(now[-1]),))
        k = now != was
        yield pd.DataFrame({self.key: key[0], "timestamp": p["timestamp"][k], "edge": np.where(now[k], "WentIdle", "Resumed")})


def idle_edges(samples: DataFrame, key: str, timeout: float) -> DataFrame:
    """(key, timestamp, edge): WentIdle once idle reaches ``timeout``, Resumed once it falls below again."""
    return _stateful(samples, key, _Idle(key, timeout), "timestamp timestamp, edge string")


class _Drops(StatefulProcessor):
    def __init__(self, key: str, threshold: float, ttl: float):
        self.key, self.threshold, self.ttl = key, threshold, ttl

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "app string, title string")
        self.seen = handle.getMapState("seen", "app string", "at double, vector array<double>", int(self.ttl * 1000))

    def _alike(self, app, s, v) -> bool:
        if not self.seen.containsKey((app,)):
            return False
        at, w = self.seen.getValue((app,))
        n = min(len(v), len(w))
        v, w = v[:n], np.asarray(w[:n])
        size = np.linalg.norm(v) * np.linalg.norm(w)
        return bool(s - at <= self.ttl and size > 0 and float(v @ w) / size >= self.threshold)

    def handleInputRows(self, key, rows, timerValues):
        p, out = _ordered(rows), []
        last = tuple(self.last.get()) if self.last.exists() else None
        for app, title, s, x in zip(p["app"], p["title"], _seconds(p["timestamp"]), p["embedding"], strict=True):
            v = None if x is None else np.asarray(x, float)
            same = v is not None and app is not None and last == (app, title) and self._alike(app, s, v)
            if not same and v is not None and app is not None:
                self.seen.updateValue((app,), (float(s), v.tolist()))
            last = (app, title)
            out.append(same)
        self.last.update(last)
        yield pd.DataFrame({self.key: key[0], "id": p["id"], "timestamp": p["timestamp"], "dropped": out})


def visual_drops(rows: DataFrame, key: str, threshold: float = 0.97, ttl: float = 7200) -> DataFrame:
    """(key, id, timestamp, dropped): a row of the same window as the one before is dropped if its vector resembles what is
    cached for its app, no older than ``ttl`` seconds by the rows' own times. The cache is a map of apps, whose entries the
    store itself forgets ``ttl`` seconds after they were written."""
    return _stateful(rows, key, _Drops(key, threshold, ttl), "id string, timestamp timestamp, dropped boolean", "ProcessingTime")
