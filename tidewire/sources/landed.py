"""Landed feeds and report archives as Spark data sources (SRC-01, UDF-5, SNK-09).

Files are reached through pyarrow's file systems by URI, in the tasks, so a folder may be in any store that these know.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

FEEDS = "source_id string, status string, error string, xml string, landed string"
Fetch = Callable[[str, str], Iterator[tuple[str, bytes]]]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def landed_files(folder: str, source_id: str) -> Iterator[tuple[str, bytes]]:
    """(name, content) of a source's landed documents: folder/source_id.xml or the files of folder/source_id/, by name."""
    files, root = _open(folder)
    one, many = posixpath.join(root, f"{source_id}.xml"), posixpath.join(root, source_id)
    kinds = {i.path: i.type for i in files.get_file_info([one, many])}
    paths = [one] if kinds[one] == fs.FileType.File else []
    if kinds[many] == fs.FileType.Directory:
        paths += sorted(i.path for i in files.get_file_info(fs.FileSelector(many)) if i.type == fs.FileType.File)
    if not paths:
        raise FileNotFoundError(f"nothing landed for {source_id}")
    for path in paths:
        with files.open_input_stream(path) as f:
            yield posixpath.basename(path), f.read()


@dataclass
class Source(InputPartition):
    """A registry source, and for a stream the names after which and up to which its documents are new."""

    source_id: str
    after: str = ""
    upto: str | None = None


def _rows(fetch: Fetch, folder: str, source: Source) -> Iterator[tuple]:
    """A row for each document of a source; a failure is a row too and ends that source only."""
    try:
        for name, content in fetch(folder, source.source_id):
            if name > source.after and (source.upto is None or name <= source.upto):
                yield source.source_id, "ok", None, content.decode("utf-8"), name
    except Exception as e:  # noqa: BLE001  whatever a source does, others are collected
        yield source.source_id, "error", f"{type(e).__name__}: {e}", None, None


def feed_source(fetch: Fetch = landed_files, name: str = "landed_feeds") -> type[DataSource]:
    """A data source of feed documents, one partition for each source. Options: path, and sources, a JSON list of their ids.

    fetch(folder, source_id) yields (name, content); another function may read what it likes. As a stream, names are offsets: documents whose name is
    greater than all seen of their source are new.
    """

    class Feeds(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return FEEDS

        def _ids(self) -> list[str]:
            return json.loads(self.options["sources"])

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["path"], self._ids())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(self.options["path"], self._ids())

    class Reader(DataSourceReader):
        def __init__(self, folder: str, ids: list[str]):
            self.folder, self.ids = folder, ids

        def partitions(self) -> list[InputPartition]:
            return [Source(i) for i in self.ids]

        def read(self, partition: Source) -> Iterator[tuple]:
            return _rows(fetch, self.folder, partition)

    class Stream(DataSourceStreamReader):
        def __init__(self, folder: str, ids: list[str]):
            self.folder, self.ids = folder, ids

        def initialOffset(self) -> dict:
            return {}

        def latestOffset(self) -> dict:
            files, root = _open(self.folder)
            found = files.get_file_info([posixpath.join(root, i) for i in self.ids])
            latest = {}
            for i, info in zip(self.ids, found, strict=True):
                if info.type == fs.FileType.Directory and (names := [x.base_name for x in files.get_file_info(fs.FileSelector(info.path)) if x.type == fs.FileType.File]):
                    latest[i] = max(names)
            return latest

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [Source(i, start.get(i, ""), upto) for i, upto in sorted(end.items()) if upto > start.get(i, "")]

        def read(self, partition: Source) -> Iterator[tuple]:
            return _rows(fetch, self.folder, partition)

        def commit(self, end: dict) -> None:
            pass

    return Feeds


def read_landed(spark: SparkSession, registry: DataFrame, folder: str, fetch: Fetch = landed_files, stream: bool = False) -> DataFrame:
    """FEEDS rows of the registry's active sources. The registry is a small table: its ids become the reader's partitions."""
    from ..operators.health import active

    kind = feed_source(fetch)
    spark.dataSource.register(kind)
    ids = sorted(r["id"] for r in active(registry).select("id").collect())
    return (spark.readStream if stream else spark.read).format(kind.name()).option("path", folder).option("sources", json.dumps(ids)).load()


ARCHIVE = "week string, name string, content string"
#: What a week of the archive consists of (fixed values).
WEEK_FILES = ("article.md", "script.md", "manifest.json")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Archive(DataSource):
    """A folder of weekly reports: path/week/{article.md, script.md, manifest.json}. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "report_archive"

    def schema(self) -> str:
        return ARCHIVE

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options["path"], overwrite)


class ArchiveWriter(DataSourceWriter):
    """Tasks write aside; weeks become visible on commit, each by one rename of its folder, and only if every week of the job is whole."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _aside(self, root: str) -> str:
        return posixpath.join(root, "_staged", self.job)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = _open(self.path)
        task, done = uuid.uuid4().hex, []
        for row in iterator:
            folder = posixpath.join(self._aside(root), task, row["week"])
            files.create_dir(folder)
            with files.open_output_stream(posixpath.join(folder, row["name"])) as f:
                f.write((row["content"] or "").encode())
            done.append((row["week"], posixpath.join(folder, row["name"])))
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _open(self.path)
        weeks: dict[str, dict[str, str]] = {}
        for week, path in (f for m in messages if m is not None for f in m.files):
            weeks.setdefault(week, {})[posixpath.basename(path)] = path
        try:
            partial = sorted(w for w, names in weeks.items() if set(names) != set(WEEK_FILES))
            there = [w for w in weeks if files.get_file_info(posixpath.join(root, w)).type != fs.FileType.NotFound]
            if partial or (there and not self.overwrite):
                raise ValueError(f"partial weeks: {partial}; weeks that are archived already: {sorted(there)}")
            for week, names in sorted(weeks.items()):
                whole = posixpath.join(self._aside(root), "whole", week)
                files.create_dir(whole)
                for name, path in names.items():
                    files.move(path, posixpath.join(whole, name))
                if week in there:
                    files.delete_dir(posixpath.join(root, week))
                files.move(whole, posixpath.join(root, week))
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _open(self.path)
        if files.get_file_info(self._aside(root)).type == fs.FileType.Directory:
            files.delete_dir(self._aside(root))


def write_archive(reports: DataFrame, path: str, overwrite: bool = False) -> None:
    """Archive reports (ARCHIVE rows): all their weeks appear, or none does."""
    reports.sparkSession.dataSource.register(Archive)
    reports.select("week", "name", "content").write.format("report_archive").option("path", path).mode("overwrite" if overwrite else "append").save()
