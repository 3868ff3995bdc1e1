"""Live event-log channels as a streaming data source: `spark.readStream.format("lanternlog_channels")`.

The offset is the last record id of each channel.
"""

from __future__ import annotations

import re
import subprocess
import sys

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StringType, StructField, StructType


def ask(channel: str, where: str, most: int, newest_first: bool = False) -> list[str]:
    """Records of a channel as XML, by the system's query tool."""
    done = subprocess.run(["wevtutil", "qe", channel, f"/q:*[System[{where}]]", "/f:xml", f"/c:{most}", f"/rd:{str(newest_first).lower()}"], capture_output=True, text=True, timeout=60, check=True)
    return re.findall(r"<Event .*?</Event>", done.stdout, re.S)


def record_id(xml: str) -> int:
    found = re.search(r"<EventRecordID>(\d+)<", xml)
    return int(found[1]) if found else -1


class ChannelReader(SimpleDataSourceStreamReader):
    """An offset is the last record id of each channel, and a batch of a channel is what lies between two of its own ids."""

    def __init__(self, options: dict):
        self.channels = [c.strip() for c in options.get("channels", "Security").split(",")]
        self.backfill = int(options.get("backfill_minutes", 0))
        self.most = int(options.get("records_a_poll", 1000))
        self.ask = ask
        self.broken: dict[str, str] = {}

    def _asked(self, channel: str, where: str, most: int, newest_first: bool = False) -> list[str]:
        """What a channel answers; one that can't be read is named once and then left alone."""
        if channel in self.broken:
            return []
        try:
            return self.ask(channel, where, most, newest_first)
        except Exception as e:  # noqa: BLE001 - whatever keeps a channel from being read
            self.broken[channel] = str(e)
            print(f"channel {channel} can't be read: {e}", file=sys.stderr)
            return []

    def _start(self, channel: str) -> int:
        """The id before the first record of the last minutes asked for; without such a record, or without backfill, the newest id."""
        if self.backfill:
            first = self._asked(channel, f"TimeCreated[timediff(@SystemTime) <= {self.backfill * 60_000}]", 1)
            if first:
                return record_id(first[0]) - 1
        newest = self._asked(channel, "EventRecordID >= 0", 1, True)
        return record_id(newest[0]) if newest else -1

    def initialOffset(self) -> dict:
        return {c: self._start(c) for c in self.channels}

    def read(self, start: dict):
        rows, end = [], dict(start)
        for channel in self.channels:
            after = start.get(channel, -1)
            found = self._asked(channel, f"EventRecordID > {after}", self.most)
            rows += [(xml,) for xml in found]
            end[channel] = max([after, *map(record_id, found)])
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        """The same batch again: of each channel the records above its start up to its own end."""
        bounds = {c: (start.get(c, -1), end.get(c, -1)) for c in self.channels}
        return iter([(xml,) for c, (a, z) in bounds.items() if z > a for xml in self._asked(c, f"EventRecordID > {a} and EventRecordID <= {z}", z - a)])

    def commit(self, end: dict) -> None:
        pass


class ChannelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lanternlog_channels"

    def schema(self) -> StructType:
        return StructType([StructField("value", StringType())])

    def simpleStreamReader(self, schema: StructType) -> ChannelReader:
        return ChannelReader(self.options)
