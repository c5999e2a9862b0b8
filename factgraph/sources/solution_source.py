"""Solution files as a data source: spark.read.format("solution").load(folder).

A row for each project that a solution names. Which of the two forms a file has is read from its
content, not from its name. Files are dealt to as many tasks as asked for, and filters on a file's path
are applied before it is opened. Files are reached through pyarrow's file systems (local,
object stores, HDFS), so a folder must be one that workers reach as well.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "path string, form string, ord int, project string, project_path string"

_LINE = re.compile(r'^\s*Project\("[^"]*"\)\s*=\s*"[^"]*"\s*,\s*"([^"]+\.csproj)"', re.M | re.I)
_CLASSIC_HEAD = re.compile(r"\A\s*(?:Microsoft Visual Studio Solution File|Project\()")


def projects_of(content: bytes) -> tuple[str | None, list[str | None]]:
    """(form, paths of projects in their order): `xml`, `classic`, or None and one None for what is neither."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return None, [None]
    if text.lstrip().startswith("<"):
        try:
            root = ElementTree.fromstring(text)
        except ElementTree.ParseError:
            return None, [None]
        paths = [e.get("Path") or "" for e in root.iter() if e.tag.rpartition("}")[2] == "Project"]
        return "xml", [p for p in paths if p.lower().endswith(".csproj")]
    if _CLASSIC_HEAD.match(text):
        return "classic", _LINE.findall(text)
    return None, [None]


@dataclass
class Files(InputPartition):
    paths: list[str]


class SolutionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.tasks = options.get("path"), int(options.get("tasks", 16))
        if not self.folder:
            raise ValueError("load() needs a folder")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over filters on the path; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, path: str) -> bool:
        test = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value), StringEndsWith: lambda f: path.endswith(f.value)}
        return all(test[type(f)](f) for f in self.filters)

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.is_file and f.path.lower().endswith((".sln", ".slnx")) and self.wanted(f.path))
        return [Files(paths[i :: self.tasks]) for i in range(min(self.tasks, len(paths)))] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                form, projects = projects_of(f.read())
            for i, p in enumerate(projects):
                plain = p and p.replace("\\", "/")
                yield path, form, None if p is None else i, plain and re.sub(r"(?i)\.csproj$", "", plain.rpartition("/")[2]), plain


class SolutionSource(DataSource):
    """path, form (`classic` or `xml`), ord, project, project_path. A file that is neither, or broken, gives a row with nulls but its path; one without projects gives none."""

    @classmethod
    def name(cls) -> str:
        return "solution"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SolutionReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known. Sources that take filters over need the session's leave, which is given here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SolutionSource)
