"""Windows that close on event-time timers.

State per machine is a list of its open windows, as counts and extremes that
merge in any order, and the time of one timer. Rows of a micro-batch are
aggregated per window before they touch the state, so a key's batch is neither
sorted nor held, and the result does not depend on where batches are cut as
long as they come in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetstream.config import Config

WINDOW = "window_start long, frame_count long, first_seq long, last_seq long, first_us long, last_us long"
CLOSED = "machine_id string, window_start long, frame_count long, first_seq long, last_seq long, reason string"
_OUT = [f.split()[0] for f in CLOSED.split(", ")]


class WindowTimer(StatefulProcessor):
    """Closes windows when a frame passes their end and lateness, or when the machine is silent."""

    def __init__(self, window_s: int, lateness_s: int, silence_s: int):
        self.window_us, self.late_us, self.silence_us = (int(x * 1_000_000) for x in (window_s, lateness_s, silence_s))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", WINDOW)

    def _closed(self, key: tuple, windows: list[tuple], n: int) -> pd.DataFrame:
        """The first ``n`` windows as rows: the gap to the next frame says whether the machine went silent."""
        rows = []
        for i, (start, count, first, last, _, last_us) in enumerate(windows[:n]):
            going = i + 1 < len(windows) and windows[i + 1][4] - last_us < self.silence_us
            rows.append((key[0], start, count, first, last, "EVENT_TIME" if going else "INACTIVE"))
        return pd.DataFrame(rows, columns=_OUT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        spans = {w[0]: w[1:] for w in self.open.get()} if self.open.exists() else {}
        for pdf in rows:
            us = pdf["us"]
            per = pdf.assign(w=us // self.window_us * (self.window_us // 1_000_000)).groupby("w").agg(
                n=("seq", "size"), first=("seq", "min"), last=("seq", "max"), first_us=("us", "min"), last_us=("us", "max")
            )
            for w, n, a, b, c, d in per.itertuples():
                old = spans.get(w)
                spans[w] = (n, a, b, c, d) if old is None else (old[0] + n, min(old[1], a), max(old[2], b), min(old[3], c), max(old[4], d))
        windows = [tuple(int(x) for x in (w, *spans[w])) for w in sorted(spans)]
        top = max(w[5] for w in windows)
        n = sum(w[0] * 1_000_000 + self.window_us + self.late_us <= top for w in windows)
        self.open.put(windows[n:])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((top + self.silence_us) // 1000)
        if n:
            yield self._closed(key, windows, n)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            windows = sorted(tuple(w) for w in self.open.get())
            self.open.clear()
            yield self._closed(key, windows, len(windows))

    def close(self) -> None:
        pass


def closed_on_timer(frames: DataFrame, cfg: Config = Config()) -> DataFrame:
    """machine_id, window_start (epoch seconds), frame_count, first_seq, last_seq, reason (EVENT_TIME or INACTIVE).

    ``frames``: machine_id, seq, ts, in time order over micro-batches. A window
    closes on a frame past its end and the lateness, or by a timer once the
    stream's time is ``cfg.inactivity_s`` past the machine's last frame; a
    shorter inactivity than window and lateness together counts as these, so
    that no window opens twice. The reason is INACTIVE if the next frame, if
    any, came only after that silence. Rows without a machine move the time on
    and open nothing; frames without a seq or a time are left out.
    """
    silence = max(cfg.inactivity_s, cfg.window_s + cfg.lateness_s)
    d = frames.where("ts is not null and (seq is not null or machine_id is null)").withWatermark("ts", "0 seconds").select("machine_id", "seq", F.unix_micros("ts").alias("us"), "ts")
    processor = WindowTimer(cfg.window_s, cfg.lateness_s, silence)
    return d.groupBy("machine_id").transformWithStateInPandas(processor, CLOSED, "append", "eventTime")
