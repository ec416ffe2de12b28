"""The live-edge monitor as a Structured Streaming query.

State per rendition: the observations that may still be overtaken by earlier ones, and the edge as it was when the
watermark last passed: the last list, when its newest last moved, the longest gap, counts, what was published. No source
promises an order, so an observation waits until the watermark has passed it and is then taken in the order of
time; one that comes later than the watermark allows is dropped. A timer at the next waiting one takes it
up when nothing else arrives; a second one speaks of silence, and forgets a rendition that has long been silent. The
batch form in ``operators.timing.watch`` over the same series says the same.

State needs the RocksDB provider (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OBSERVATION = "rendition long, poll long, observed_us long, uris array<string>, durations_us array<long>, target_us long, failed boolean"
OUTPUT = "rendition long, looks long, advances long, stall_us long, backwards long, failures long, target_us long, last_newest string, published_us long, passed_us long, rule string, rate string, silent boolean"
#: Of these a rendition that stays silent for so many targets is forgotten.
FORGET = 100
_WAITING = "poll long, observed_us long, uris array<string>, durations_us array<long>, target_us long, failed boolean"
_EDGE = "looks long, filled long, advances long, stall long, back long, failures long, target long, shown string, uris array<string>, moved long, seen long, since long, media long, one long"


def rule_of(looks: int, filled: int, advances: int, stall: int, target: int, failures: int, tolerance: int) -> str:
    """What a series says so far; without a stated interval nothing is judged."""
    if not looks:
        return "all-failed" if failures else "empty"
    if looks == 1:
        return "one-look"
    if not filled:
        return "empty"
    if not advances:
        return "never-advanced"
    if not target:
        return "no-interval"
    return "stalled" if stall > target * tolerance else "advancing"


def rate_of(media: int, one: int, passed: int, back: int) -> str | None:
    """``behind`` or ``ahead`` of time by more than a segment and a fifth of it, over four segments at least; none if not known."""
    if media < 0 or back or not one or passed < 4 * one or abs(media - passed) <= one + passed / 5:
        return None
    return "behind" if media < passed else "ahead"


def published(before: list[str], uris: list[str], durations: list[int]) -> int | None:
    """What stands in a list after the newest of the list before; None if that has scrolled out."""
    return sum(durations[uris.index(before[-1]) + 1 :]) if before and before[-1] in uris else None


def went_back(before: list[str], uris: list[str]) -> bool:
    """Whether the newest stood in the list before already, ahead of that one's newest."""
    return bool(before and uris) and uris[-1] != before[-1] and uris[-1] in before and before.index(uris[-1]) < before.index(before[-1])


class LiveEdge(StatefulProcessor):
    def __init__(self, tolerance: int = 3):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.edge = handle.getValueState("edge", _EDGE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = lambda x: 0 if pd.isna(x) else int(x)
        for frame in rows:
            for poll, at, uris, durations, target, failed in frame[["poll", "observed_us", "uris", "durations_us", "target_us", "failed"]].itertuples(index=False):
                self.waiting.appendValue((int(poll), int(at), [] if uris is None else [str(u) for u in uris], [] if durations is None else [int(d) for d in durations], whole(target), bool(failed)))
        yield from self._take(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key, timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def _take(self, key, timers, fired: int | None = None) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        ready, later = [r for r in held if r[1] // 1000 <= now], [r for r in held if r[1] // 1000 > now]
        looks, filled, advances, stall, back, failures, target, shown, before, moved, seen, since, media, one = self.edge.get() if self.edge.exists() else (0,) * 7 + ("", [], -1, -1, -1, -1, 0)
        before = list(before)
        for _, at, uris, durations, goal, failed in ready:
            uris, durations = list(uris), list(durations)
            seen = max(seen, at)
            if failed:
                failures += 1
                continue
            if looks == 0:
                moved, since = at, at
            stall = max(stall, at - moved)
            if looks:
                back += int(went_back(before, uris))
                if (new := published(before, uris, durations)) is not None:
                    media, one = max(media, 0) + new, max(one, *durations)
                if uris and uris[-1] != shown:
                    advances, moved = advances + 1, at
            looks, filled, target, before = looks + 1, filled + int(bool(uris)), max(target, goal), uris
            shown = uris[-1] if uris else shown
        said = rule_of(looks, filled, advances, stall, target, failures, self.tolerance)
        limit = target * self.tolerance
        silent = fired is not None and not later and target and seen >= 0 and now * 1000 > seen + limit
        if ready:
            self.waiting.clear()
            for r in later:
                self.waiting.appendValue(r)
        if later:
            self.handle.registerTimer(later[0][1] // 1000 + 1)
        elif ready and target:
            self.handle.registerTimer((seen + limit) // 1000 + 1)
        if silent and now * 1000 > seen + FORGET * target:
            self.edge.clear()
        elif silent:
            self.handle.registerTimer((seen + FORGET * target) // 1000 + 1)
        if ready:
            self.edge.update((looks, filled, advances, stall, back, failures, target, shown, before, moved, seen, since, media, one))
        if ready or silent:
            passed = seen - since if looks else 0
            row = (key[0], looks, advances, stall, back, failures, target, shown or None, max(media, 0), passed, said, rate_of(media, one, passed, back), bool(silent))
            yield pd.DataFrame([row], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def watch_stream(observations: DataFrame, late: str = "10 seconds", tolerance: int = 3) -> DataFrame:
    """Per rendition the state of its live edge, whenever the watermark lets observations count. ``observations``: a streaming DataFrame."""
    timed = observations.withColumn("at", F.timestamp_micros("observed_us")).withWatermark("at", late)
    return timed.groupBy("rendition").transformWithStateInPandas(LiveEdge(tolerance), OUTPUT, "Update", "EventTime")


def windowed_polls(observations: DataFrame, window: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """Polls and failures per rendition and window of event time, with late observations up to ``late``."""
    timed = observations.withColumn("at", F.timestamp_micros("observed_us")).withWatermark("at", late)
    return timed.groupBy("rendition", F.window("at", window)).agg(F.count("*").alias("polls"), F.sum(F.col("failed").cast("int")).alias("failures"))
