"""Live playlists as a stream: each poll reads every playlist once, in the partition that owns it.

    spark.dataSource.register(PollSource)
    spark.readStream.format("live_polls").option("playlists", "1 https://h/a.m3u8\\n2 https://h/b.m3u8").load()

An offset is a number of polls. A new one is offered when the interval has passed since the last: ``interval`` seconds if stated, else the
playlists' own largest target duration, else six seconds, one at least. A poll is read by its number, so a restart from the
checkpoint goes on after the last one that was committed and neither loses nor doubles a number; what a poll that has to be read again sees is what is live then. An
address may hold ``{poll}``, which is replaced by that number: an archive of polls, which reads the same each time. ``polls`` ends the stream after so many.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urljoin, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from mediaprism.sources.fetch import get
from mediaprism.streaming.watch import OBSERVATION

_INF = re.compile(r"#EXTINF:\s*([0-9.]+)")
_TARGET = re.compile(r"^#EXT-X-TARGETDURATION:\s*([0-9.]+)", re.M)


def read_playlist(url: str, timeout: float = 15) -> tuple[list[str], list[int], int | None] | None:
    """Segment addresses and durations of a media playlist in order, and its target, in microseconds; None if it cannot be read."""
    if urlsplit(url).scheme in ("http", "https"):
        answer = get(url, {"User-Agent": "mediaprism"}, 64 << 20, timeout, False, {})
        body = None if answer["error"] else answer["body"]
    else:
        try:
            body = Path(url.removeprefix("file://")).read_bytes()
        except OSError:
            body = None
    text = body.decode("utf-8-sig", "replace") if body is not None else ""
    if not text.startswith("#EXTM3U"):
        return None
    uris, durations, pending = [], [], 0
    for line in map(str.strip, text.splitlines()):
        if m := _INF.match(line):
            pending = round(float(m[1]) * 1e6)
        elif line and not line.startswith("#"):
            uris.append(urljoin(url, line))
            durations.append(pending)
            pending = 0
    target = _TARGET.search(text)
    return uris, durations, round(float(target[1]) * 1e6) if target else None


class _Poll(InputPartition):
    def __init__(self, rendition: int, url: str, first: int, last: int):
        self.rendition, self.url, self.first, self.last = rendition, url, first, last


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.playlists = [(int(n), url) for n, url in (line.split(None, 1) for line in options.get("playlists", "").splitlines() if line.strip())]
        self.most, self.timeout = int(options.get("polls", 1 << 62)), float(options.get("timeout", 15))
        self.interval = float(options["interval"]) if "interval" in options else None
        self.offered, self.at = None, None

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def _interval(self) -> float:
        if self.interval is None:
            targets = [t for _, url in self.playlists if (x := read_playlist(url.replace("{poll}", "1"), self.timeout)) and (t := x[2])]
            self.interval = max(1.0, max(targets) / 1e6) if targets else 6.0
        return self.interval

    def latestOffset(self) -> dict:
        now = time.monotonic()
        if self.offered is None:
            self.offered, self.at = self.begun, now - self._interval()
        if self.offered < self.most and now - self.at >= self._interval():
            self.offered, self.at = self.offered + 1, now
        return {"poll": self.offered}

    begun = 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # After a restart the first batch says how far the stream had come.
        self.begun = max(self.begun, end["poll"])
        if self.offered is None or self.offered < end["poll"]:
            self.offered, self.at = end["poll"], time.monotonic()
        return [_Poll(n, url, start["poll"] + 1, end["poll"]) for n, url in self.playlists] if end["poll"] > start["poll"] else []

    def commit(self, end: dict) -> None:
        self.begun = max(self.begun, end["poll"])

    def read(self, partition: _Poll) -> Iterator[tuple]:
        for poll in range(partition.first, partition.last + 1):
            seen = read_playlist(partition.url.replace("{poll}", str(poll)), self.timeout)
            uris, durations, target = seen or ([], [], None)
            yield partition.rendition, poll, time.time_ns() // 1000, uris, durations, target, seen is None


class PollSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_polls"

    def schema(self) -> str:
        return OBSERVATION

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)
