"""Event shards as a Spark data source, batch and stream: a shard is read again only if its digest has changed.

    spark.dataSource.register(ShardSource)
    spark.readStream.format("lectern-shards").option("path", folder).load()

A shard is a file of JSON lines. Its digest is its size and time of change, from the listing alone. The stream's offset is the
digest of every shard, so Spark's checkpoint says what has been taken in; rows of a changed shard come again as a whole, with
its digest, for a sink that keeps what is new (`append_new`). Shards over MOST_BYTES, or with more than MOST_EVENTS lines, give
one row that says why they were refused and no events. Empty lines are no events; an empty folder gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Limits of a shard.
MOST_BYTES, MOST_EVENTS = 32 * 1024 * 1024, 100_000
SCHEMA = "shard string, digest string, line int, json string, refused string"


class Shard(InputPartition):
    def __init__(self, path: str, name: str, digest: str, size: int):
        super().__init__(None)
        self.path, self.name, self.digest, self.size = path, name, digest, size


def listed(folder: str, ending: str) -> dict[str, Shard]:
    """Shards of a folder, and of the folders in it, by name."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    prefix = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
    names = ((f, f.path[len(root) :].lstrip("/")) for f in found if f.type == fs.FileType.File and f.path.endswith(ending))
    return {name: Shard(prefix + f.path, name, f"{f.size}-{f.mtime_ns}", f.size) for f, name in sorted(names, key=lambda x: x[1])}


def rows(shard: Shard, most_bytes: int, most_events: int) -> Iterator[tuple]:
    """The events of a shard, or one row that says why it is refused."""
    from pyarrow import fs

    if shard.size > most_bytes:
        yield shard.name, shard.digest, None, None, "too many bytes"
        return
    system, path = fs.FileSystem.from_uri(shard.path) if "://" in shard.path or shard.path.startswith("file:") else (fs.LocalFileSystem(), shard.path)
    with system.open_input_stream(path) as file:
        lines = [x for x in file.read().decode("utf-8", "replace").splitlines() if x.strip()]
    if len(lines) > most_events:
        yield shard.name, shard.digest, None, None, "too many events"
        return
    for k, line in enumerate(lines):
        yield shard.name, shard.digest, k, line, None


class ShardSource(DataSource):
    """Options: path, ending (`.jsonl`), mostBytes, mostEvents."""

    @classmethod
    def name(cls) -> str:
        return "lectern-shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ShardStream(self.options)


class _Limits:
    def __init__(self, options: dict):
        self.folder, self.ending = options["path"], options.get("ending", ".jsonl")
        self.most_bytes, self.most_events = int(options.get("mostBytes", MOST_BYTES)), int(options.get("mostEvents", MOST_EVENTS))

    def read(self, partition: Shard) -> Iterator[tuple]:
        return rows(partition, self.most_bytes, self.most_events)


class ShardReader(_Limits, DataSourceReader):
    def partitions(self) -> list[Shard]:
        return list(listed(self.folder, self.ending).values())

    def read(self, partition: Shard) -> Iterator[tuple]:
        return rows(partition, self.most_bytes, self.most_events) if isinstance(partition, Shard) else iter(())


class ShardStream(_Limits, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: s.digest for name, s in listed(self.folder, self.ending).items()}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        """Shards whose digest is not the one taken in; one that has changed since the offset was taken comes with the next."""
        now = listed(self.folder, self.ending)
        return [now[name] for name, digest in end.items() if start.get(name) != digest and name in now]

    def commit(self, end: dict) -> None:
        pass
