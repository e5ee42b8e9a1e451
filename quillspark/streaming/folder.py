"""A folder's changes as a stream: files that arrived, changed or went, each as a row.

An offset is the number of a listing (path, time, length), kept as a file below ``state``; a batch is what differs between two listings, so
it can be replayed. Spark's own file stream neither sees that a file went nor that one changed. Names are taken as they are, brackets
and stars included. The folder has to be one that pyarrow reaches (local, HDFS or an object store); ``ingest.watch_folder`` serves
those that only Spark reaches.

    spark.dataSource.register(FolderChanges)
    spark.readStream.format("folder_changes").option("root", ...).option("state", ...).load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, change string, modified long, length long, content binary"
#: Files that one task opens.
FILES = 200

Listing = dict[str, tuple[int, int]]


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def listing(root: str) -> Listing:
    """Path below root -> (modification time in nanoseconds, length) of all its files."""
    system, base = _opened(root)
    found = system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    return {f.path[len(base) + 1 :]: (f.mtime_ns or 0, f.size) for f in found if f.type == pafs.FileType.File}


def difference(before: Listing, now: Listing) -> list[tuple[str, str, int, int]]:
    """(path, change, modified, length) of what differs, by path."""
    rows = [(p, "added" if p not in before else "changed", *now[p]) for p in now if now[p] != before.get(p)]
    return sorted(rows + [(p, "removed", *before[p]) for p in before if p not in now])


class Part(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.rows = rows


class FolderReader(DataSourceStreamReader):
    def __init__(self, root: str, state: str):
        self.root, self.state = root, state

    def _numbers(self) -> list[int]:
        system, base = _opened(self.state)
        found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def _stored(self, number: int) -> Listing:
        if not number:
            return {}
        system, base = _opened(self.state)
        with system.open_input_stream(f"{base}/{number}.json") as f:
            return {k: tuple(v) for k, v in json.loads(f.read()).items()}

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        now, last = listing(self.root), (self._numbers() or [0])[-1]
        if now == self._stored(last):
            return {"listing": last}
        system, base = _opened(self.state)
        system.create_dir(base)
        with system.open_output_stream(f"{base}/.{last + 1}") as f:
            f.write(json.dumps(now).encode())
        system.move(f"{base}/.{last + 1}", f"{base}/{last + 1}.json")  # a listing is whole or isn't there
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        rows = difference(self._stored(start["listing"]), self._stored(end["listing"]))
        return [Part(rows[at : at + FILES]) for at in range(0, len(rows), FILES)]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, base = _opened(self.root)
        for path, change, modified, length in partition.rows:
            content = None
            if change != "removed":
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue  # it went meanwhile; the next listing says so
            yield path, change, modified, length, content

    def commit(self, end: dict) -> None:
        system, base = _opened(self.state)
        for number in self._numbers():
            if number < end["listing"]:
                system.delete_file(f"{base}/{number}.json")


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options["root"], self.options["state"])
