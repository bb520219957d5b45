"""Custom state: burst seeds while a recording is live, and the review session."""

from __future__ import annotations

import sys
from typing import Any, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clipmine.operators import review
from clipmine.operators.review import STATE_SCHEMA, Session

# The process that sets up stateful operators does not see files added to the session, so these
# classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(review)

SEED_SCHEMA = "vod_id string, t double, react double"


class BurstSeeds(StatefulProcessor):
    """Seeds from finished reaction bins: strong against the running mean, and kept apart.

    State per recording: bins seen, their total strength, the last seed. An event-time timer clears it
    once the recording has been quiet for `idle_sec`.
    """

    def __init__(self, *, floor: float = 1.5, mult: float = 1.2, lag: float = 8.0, gap: float = 8.0, idle_sec: float = 3600.0):
        self.floor, self.mult, self.lag, self.gap, self.idle_ms = floor, mult, lag, gap, int(idle_sec * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stats = handle.getValueState("stats", "n long, total double, last double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, total, last = self.stats.get() if self.stats.exists() else (0, 0.0, None)
        for row in sorted(rows, key=lambda r: r["t"]):
            n, total = n + 1, total + row["react"]
            seed = round(max(0.0, row["t"] + 2.5 - self.lag), 1)
            strong = row["react"] >= max(self.floor, self.mult * total / n)
            if strong and (last is None or seed - last >= self.gap):
                last = seed
                yield Row(vod_id=key[0], t=seed, react=row["react"])
        self.stats.update((n, total, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(0, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.stats.clear()
        return iter([])

    def close(self) -> None:
        pass


def burst_seeds(bins: DataFrame, **options) -> DataFrame:
    """`bins`: `vod_id, ts` (watermarked), `t, react` — finished reaction bins."""
    return bins.groupBy("vod_id").transformWithState(
        statefulProcessor=BurstSeeds(**options), outputStructType=SEED_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


class ReviewSession(StatefulProcessor):
    """Clip states of one reviewer: each event emits the clips it changed, latest state last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "recent array<string>, dropped array<string>")
        self.clips = handle.getMapState("clips", "clip string", "total int, status string, submitted boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        recent, dropped = self.session.get() if self.session.exists() else ([], [])
        session = Session(map(_clip, recent), map(_clip, dropped))
        states = _LazyStates(self.clips)
        for row in sorted(rows, key=lambda r: r["seq"]):
            for job, n in session.apply(row["kind"], (row["job_id"], row["n"]), row["total"], states):
                s = states[(job, n)]
                yield Row(reviewer=key[0], job_id=job, n=n, total=s["total"], status=s["status"], submitted=s["submitted"])
        states.save()
        self.session.update(([_name(c) for c in session.recent], [_name(c) for c in session.dropped]))

    def close(self) -> None:
        pass


def _name(clip: tuple) -> str:
    return f"{clip[1]}/{clip[0]}"


def _clip(name: str) -> tuple:
    n, job = name.split("/", 1)
    return job, int(n)


class _LazyStates(dict):
    """Clip states read from the state store when first touched."""

    def __init__(self, store):
        super().__init__()
        self.store = store

    def __missing__(self, clip):
        row = self.store.getValue((_name(clip),)) if self.store.containsKey((_name(clip),)) else None
        if row is None:
            raise KeyError(clip)
        self[clip] = {"total": row[0], "status": row[1], "submitted": row[2]}
        return self[clip]

    def setdefault(self, clip, default):
        try:
            return self[clip]
        except KeyError:
            self[clip] = default
            return default

    def save(self) -> None:
        for clip, s in self.items():
            self.store.updateValue((_name(clip),), (s["total"], s["status"], s["submitted"]))


def review_states(events: DataFrame) -> DataFrame:
    """`events`: `reviewer, seq, kind, job_id, n, total`; a change log of clip states."""
    return events.groupBy("reviewer").transformWithState(
        statefulProcessor=ReviewSession(), outputStructType=STATE_SCHEMA, outputMode="Update", timeMode="None"
    )
