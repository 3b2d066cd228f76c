"""A vulnerability catalogue that is read on from where the last sweep ended (S-10).

Entries are landed by the day on which they were modified: folders `modified_on=YYYY-MM-DD`
of JSON lines, each an entry of the catalogue. The stream's offset is a moment, and a batch
has the entries modified after the last offset and up to the new one, which stays `buffer`
seconds behind the clock, as entries may come late. Only the days of that window are
listed, and every page (the lines that begin in a range of `PAGE` bytes of a file) is a
partition of its own.

An entry that is modified again comes again, with its new moment. Lines that are no entry,
or whose moment can't be read, are left out. Files are reached through pyarrow's file
systems, so the folder may be in any store that it knows.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import readers

#: Bytes of a page, seconds that a window ends before now, and where the first window begins.
PAGE, BUFFER, FIRST = 4 << 20, 120, "2020-01-01T00:00:00.000000"
_FORM = "%Y-%m-%dT%H:%M:%S.%f"


def _moment(written: str) -> str:
    """A moment in the form that sorts as text; in UTC where it names no zone."""
    at = dt.datetime.fromisoformat(written.strip().replace("Z", "+00:00"))
    return (at.astimezone(dt.UTC) if at.tzinfo else at).strftime(_FORM)


@dataclass
class Page(InputPartition):
    path: str
    start: int
    after: str
    until: str


class EntriesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.where, self.path = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), options["path"])
        self.now, self.buffer, self.first = options.get("now"), int(options.get("buffer", BUFFER)), _moment(options.get("first", FIRST))

    def initialOffset(self) -> dict:
        return {"modified": self.first}

    def latestOffset(self) -> dict:
        now = dt.datetime.fromisoformat(_moment(self.now)) if self.now else dt.datetime.now(dt.UTC).replace(tzinfo=None)
        return {"modified": max(self.first, (now - dt.timedelta(seconds=self.buffer)).strftime(_FORM))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        after, until = start["modified"], end["modified"]
        out = []
        for day in self.where.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
            if day.type == fs.FileType.Directory and f"modified_on={after[:10]}" <= day.base_name <= f"modified_on={until[:10]}":
                for f in self.where.get_file_info(fs.FileSelector(day.path)):
                    if f.type == fs.FileType.File and f.base_name.startswith("part-"):
                        out += [Page(f.path, k, after, until) for k in range(0, f.size, PAGE)]
        return out or [Page("", 0, after, until)]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("modified", pa.string()), ("entry", pa.string())])
        if not page.path:
            return
        found = []
        with io.BufferedReader(self.where.open_input_file(page.path)) as lines:
            if page.start:
                lines.seek(page.start - 1)
                lines.readline()
            while lines.tell() < page.start + PAGE and (line := lines.readline()):
                try:
                    modified = _moment(json.loads(line)["lastModified"])
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
                if page.after < modified <= page.until:
                    found.append((modified, line.decode().rstrip("\n")))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(2)], schema=schema)

    def commit(self, end: dict) -> None:
        """Nothing to let go: offsets are kept by the checkpoint."""


class Entries(DataSource):
    """Options: path; now (a moment that stands for the clock), buffer (seconds), first (where the first window begins)."""

    @classmethod
    def name(cls) -> str:
        return "catalogue_entries"

    def schema(self) -> str:
        return "modified string, entry string"

    def streamReader(self, schema) -> EntriesReader:
        return EntriesReader(dict(self.options))


def land(entries: DataFrame, path: str) -> None:
    """Adds `entries` (id, lastModified and the other fields of an entry) to the landed days; an unreadable moment goes to no day."""
    day = F.to_date(F.try_to_timestamp("lastModified"))
    rows = entries.withColumn("modified_on", day).where("modified_on is not null")
    rows.repartition("modified_on", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("modified_on").json(path)


def modified(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of (cve_id, modified_at, description, cvss, vector) of the entries that were modified since the checkpoint's offset."""
    # By value, so that workers need not find this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Entries)
    rows = spark.readStream.format("catalogue_entries").options(path=path, **options).load()
    entry = F.from_json("entry", readers.ENTRY).alias("c")
    return readers.entry_columns(rows.select(entry))
