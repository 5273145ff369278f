"""Delivery of progress events by site, in order, as a stream with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAMES = "site string, seq long, kind string, frame string"


class SiteRelay(StatefulProcessor):
    """Frames of one site's events (seq, type, level, msg, content) in order of `seq`, from 0 on.

    Events that came before are dropped, those that came too early are held. The last result (`json`) is held until the run
    is `done`: then it is delivered as the site's entry for the history. A site that says nothing for `silent_ms`
    is closed: what is held is delivered in order, gaps or not, and then an end that says so. A later run of the site, which
    begins at 0 again, is a new one.
    """

    def __init__(self, silent_ms: int = 600_000):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long")
        self.held = handle.getMapState("held", "seq long", "event string")
        self.result = handle.getValueState("result", "content string")
        self.timer = handle.getValueState("timer", "at long")

    def _frame(self, site: str, seq: int, event: dict) -> Iterator[Row]:
        kind = event["type"]
        if kind == "log":
            event = {**event, "level": event.get("level") or "INFO"}
        said = {k: v for k, v in event.items() if v is not None}
        yield Row(site=site, seq=seq, kind=kind, frame=f"data: {json.dumps(said, ensure_ascii=False)}\n\n")
        if kind == "json":
            self.result.update((event.get("content"),))
        if kind == "done":
            last = self.result.get()
            content = event.get("content") or (last[0] if last else None)
            yield Row(site=site, seq=seq, kind="history", frame=content)
            self.result.clear()

    def _silence(self, now: int) -> None:
        old = self.timer.get()
        if old:
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(now + self.silent_ms)
        self.timer.update((now + self.silent_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        site = key[0]
        at = self.next.get()
        at = at[0] if at else 0
        for r in rows:
            event = {"type": r.type, "level": r.level, "msg": r.msg, "content": r.content}
            if r.seq is not None and r.type is not None and (r.seq >= at or r.seq == 0 and at < 0):
                if not self.held.containsKey((r.seq,)):
                    self.held.updateValue((r.seq,), (json.dumps(event),))
        at = max(at, 0)
        over = False
        while self.held.containsKey((at,)):
            event = json.loads(self.held.getValue((at,))[0])
            self.held.removeKey((at,))
            yield from self._frame(site, at, event)
            at += 1
            over = event["type"] == "done"
            if over:
                break
        if over:
            self._close()
        else:
            self.next.update((at,))
            self._silence(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        site, last = key[0], -1
        for seq in sorted(k[0] for k in self.held.keys()):
            last = seq
            yield from self._frame(site, seq, json.loads(self.held.getValue((seq,))[0]))
        yield Row(site=site, seq=last + 1, kind="timeout", frame='data: {"type": "done", "msg": "no more events"}\n\n')
        self._close(timed_out=True)

    def _close(self, timed_out: bool = False) -> None:
        old = self.timer.get()
        if old and not timed_out:
            self.handle.deleteTimer(old[0])
        for state in (self.next, self.held, self.result, self.timer):
            state.clear()

    def close(self) -> None:
        pass


def relayed(events: DataFrame, silent_ms: int = 600_000) -> DataFrame:
    """The stream of frames of a stream of events (site, seq, type, level, msg, content); see `SiteRelay`.

    State is kept by site in the state store, so a lost executor loses none of it; it needs a store that can hold several
    states (`spark.sql.streaming.stateStore.providerClass` of RocksDB). A site that is done or silent leaves nothing.
    """
    rows = events.select("site", "seq", "type", "level", "msg", "content").where("site IS NOT NULL")
    return rows.groupBy("site").transformWithState(SiteRelay(silent_ms), FRAMES, "Append", "ProcessingTime")
