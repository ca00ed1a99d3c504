"""A Spark data source that reads log lines by byte ranges.

Partitions are packs of ranges; each range already carries the session, kind
and sidecar name of its log, so lines need no join and no shuffle to learn
whose they are. Names with a leading underscore are read like any other. `seq`
is a line's byte offset: it rises through a log and never depends on splits.

The stream reader tails logs that grow: an offset names a stored listing of
sizes, a batch holds what was appended between two listings. A line belongs to
the batch in which its line break arrives, so a partial tail is read once it is
whole.

Workers get this module by value; it uses nothing else of the package.
"""

from __future__ import annotations

import io
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, session_id string, kind string, sidecar_name string, seq bigint, line string"
OWNER = ["source", "session_id", "kind", "sidecar_name"]
BATCH_LINES, BATCH_BYTES = 20_000, 16 << 20
BLOCK = 64 << 10
OPEN_COST = 64 << 10  # what opening a log weighs, in bytes read


def open_store(path: str):
    """(file system, plain path) for a Spark path."""
    from pyarrow import fs

    uri = re.sub(r"^file:/*", "file:///", path if ":" in path else "file:" + path)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def lines_starting_in(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in [start, stop)."""
    system, plain = open_store(path)
    with system.open_input_file(plain) as raw, io.BufferedReader(raw, BLOCK) as stream:
        at = 0
        if start:
            stream.seek(start - 1)
            at = start - 1 + len(stream.readline())
        while at < stop and (line := stream.readline()):
            yield at, line
            at += len(line)


def lines_ending_in(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines whose line break lies in [start, stop)."""
    system, plain = open_store(path)
    with system.open_input_file(plain) as raw, io.BufferedReader(raw, BLOCK) as stream:
        at = start
        while at:  # back to the break before `start`
            low = max(0, at - BLOCK)
            stream.seek(low)
            found = stream.read(at - low).rfind(b"\n")
            at = low + found + 1 if found >= 0 else low
            if found >= 0:
                break
        stream.seek(at)
        while (line := stream.readline()).endswith(b"\n"):
            if at + len(line) > stop:
                break
            yield at, line
            at += len(line)


def batches_of(lines: Iterator[tuple[tuple, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (owner, offset, line), bounded in rows and bytes, over
    as many logs as fit; only lines that may be records."""

    def batch() -> pa.RecordBatch:
        whose = [pa.array(x, pa.string()) for x in zip(*owners)]
        return pa.RecordBatch.from_arrays([*whose, pa.array(at, pa.int64()), pa.array(texts, pa.string())], names=[*OWNER, "seq", "line"])

    owners, at, texts, size = [], [], [], 0
    for owner, offset, line in lines:
        if not line.startswith(b"{"):
            continue
        owners.append(owner)
        at.append(offset)
        texts.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
        size += len(line)
        if len(at) >= BATCH_LINES or size >= BATCH_BYTES:
            yield batch()
            owners, at, texts, size = [], [], [], 0
    if at:
        yield batch()


@dataclass
class Pack(InputPartition):
    group: int
    pack: int


class PackReader(DataSourceReader):
    """Reads packs of ranges listed as Parquet under `plan`/group=<n>."""

    def __init__(self, options) -> None:
        self.plan, self.packs = options["plan"], json.loads(options["packs"])

    def partitions(self) -> list[Pack]:
        return [Pack(int(group), pack) for group, n in self.packs.items() for pack in range(n)]

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, plain = open_store(f"{self.plan}/group={partition.group}")
        rows = pq.read_table(plain, filesystem=system, partitioning=None, filters=[("pack", "=", partition.pack)]).to_pylist()
        owned = ((tuple(row[c] for c in OWNER), lines_starting_in(row["path"], row["start"], row["stop"])) for row in rows)
        yield from batches_of((owner, at, line) for owner, lines in owned for at, line in lines)


@dataclass
class Growth(InputPartition):
    """A file that lists ranges (path, start, stop) of logs that grew."""

    ranges: str


class TailReader(DataSourceStreamReader):
    """Follows the logs of a folder; listings are kept in the `listings` folder."""

    def __init__(self, options) -> None:
        self.root, self.listings = options["path"], options["listings"]
        self.source, self.flat = options.get("source", "a"), options.get("flat", "false") == "true"
        self.range_bytes = int(options.get("rangeBytes", str(64 << 20)))
        self.inside = None  # where paths below the root begin

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """A listing of sizes; the number rises only if something grew."""
        last = self._last()
        now = self._sizes()
        if now == self._read(last):
            return {"listing": last}
        system, plain = open_store(self.listings)
        system.create_dir(plain, recursive=True)
        with system.open_output_stream(f"{plain}/{last + 1:012d}.json") as out:
            out.write(json.dumps(now).encode())
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Growth]:
        before, after = self._read(start["listing"]), self._read(end["listing"])
        ranges = []
        for path, size in after.items():
            seen = before.get(path, 0)
            # A log that shrank was written anew.
            ranges += [(path, at, min(at + self.range_bytes, size)) for at in range(seen if seen <= size else 0, size, self.range_bytes)]
        # Very many small logs are few tasks; 64 tasks where there is work for them.
        total = sum(stop - at + OPEN_COST for _, at, stop in ranges)
        room = max(16 * OPEN_COST, min(self.range_bytes, total // 64))
        system, plain = open_store(self.listings)
        folder = f"{plain}/ranges/{start['listing']}-{end['listing']}"
        system.create_dir(folder, recursive=True)
        packs, filled = [], room
        for item in ranges:
            if filled >= room:
                packs.append([])
                filled = 0
            packs[-1].append(item)
            filled += item[2] - item[1] + OPEN_COST
        for number, pack in enumerate(packs):
            with system.open_output_stream(f"{folder}/{number}.json") as out:
                out.write(json.dumps(pack).encode())
        name = self.listings.rstrip("/") + folder[len(plain):]
        return [Growth(f"{name}/{number}.json") for number in range(len(packs))]

    def read(self, partition: Growth) -> Iterator[pa.RecordBatch]:
        system, plain = open_store(partition.ranges)
        with system.open_input_stream(plain) as stream:
            ranges = json.loads(stream.read())
        yield from batches_of((owner, at, line) for path, start, stop in ranges for owner in (self.owner(path),) for at, line in lines_ending_in(path, start, stop))

    def commit(self, end: dict) -> None:
        """Listings before the one that is done, and its ranges, are not needed again."""
        from pyarrow import fs

        system, plain = open_store(self.listings)
        for number in self._numbers():
            if number < end["listing"]:
                system.delete_file(f"{plain}/{number:012d}.json")
        for info in system.get_file_info(fs.FileSelector(f"{plain}/ranges", allow_not_found=True)):
            if int(info.base_name.split("-")[1]) <= end["listing"]:
                system.delete_dir(info.path)

    def owner(self, path: str) -> tuple:
        """Source, session, kind and sidecar name by the place in the tree."""
        parts = self._inside(path).split("/")
        base = parts[1].removesuffix(".jsonl")
        session = base.split("_", 1)[-1]
        if len(parts) == 2:
            return self.source, session, "primary", ""
        kind = "advisor" if parts[-1] == "__advisor.jsonl" else "subagent"
        return self.source, session, kind, "/".join(parts[2:]).removesuffix(".jsonl")

    def _inside(self, path: str) -> str:
        if self.inside is None:
            self.inside = len(open_store(self.root)[1].rstrip("/")) + 1
        return path[self.inside:]

    def _sizes(self) -> dict[str, int]:
        from pyarrow import fs

        system, plain = open_store(self.root)
        found = system.get_file_info(fs.FileSelector(plain, recursive=True, allow_not_found=True))
        logs = {i.path: i.size for i in found if i.is_file and i.base_name.endswith(".jsonl")}
        depth = {p: self._inside(p).count("/") for p in logs}
        return {p: n for p, n in sorted(logs.items()) if depth[p] == 1 or depth[p] > 1 and not self.flat}

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        system, plain = open_store(self.listings)
        return sorted(int(i.base_name.split(".")[0]) for i in system.get_file_info(fs.FileSelector(plain, allow_not_found=True)) if i.base_name.endswith(".json"))

    def _last(self) -> int:
        return max(self._numbers(), default=0)

    def _read(self, number: int) -> dict[str, int]:
        if not number:
            return {}
        system, plain = open_store(self.listings)
        with system.open_input_stream(f"{plain}/{number:012d}.json") as stream:
            return json.loads(stream.read())


class LogSource(DataSource):
    """Format `worktrail_logs`."""

    @classmethod
    def name(cls) -> str:
        return "worktrail_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PackReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return TailReader(self.options)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
