"""The board registry as files, one YAML list per system, behind Spark's data source API.

``spark.read.format("board_registry").load(path)`` gives BOARD rows; writing replaces the whole
registry. A write makes a new version folder, and only its commit names that version in the file
``CURRENT``, in one step; an aborted write leaves the version before. The folder must be mounted
at the same place on all machines, as a registry of hand-kept files is.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from jobloom.schemas import BOARD

CURRENT = "CURRENT"
FIELDS = ("ats", "board_key", "tenant", "wd", "site", "slug", "name", "ord")


def current(path: str) -> str | None:
    """Folder of the version that counts."""
    try:
        with open(os.path.join(path, CURRENT), encoding="utf-8") as file:
            return os.path.join(path, file.read().strip())
    except FileNotFoundError:
        return None


def entries(file: TextIO) -> Iterator[dict]:
    """The items of the list ``companies`` one by one, so that a file of any length takes the memory of one."""
    import yaml

    loader = yaml.SafeLoader(file)
    try:
        while loader.check_event(yaml.StreamStartEvent, yaml.DocumentStartEvent):
            loader.get_event()
        if not loader.check_event(yaml.MappingStartEvent):
            return
        loader.get_event()
        while not loader.check_event(yaml.MappingEndEvent):
            key = loader.construct_document(loader.compose_node(None, None))
            if key != "companies" or not loader.check_event(yaml.SequenceStartEvent):
                loader.compose_node(None, None)
                continue
            loader.get_event()
            while not loader.check_event(yaml.SequenceEndEvent):
                yield loader.construct_document(loader.compose_node(None, None))
            loader.get_event()
    finally:
        loader.dispose()


class RegistryFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RegistryReader(DataSourceReader):
    """One partition per file of the version that counts when the plan is made."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[RegistryFile]:
        folder = current(self.path)
        names = sorted(os.listdir(folder)) if folder else []
        return [RegistryFile(os.path.join(folder, n)) for n in names if n.endswith(".yaml")]

    def read(self, partition: RegistryFile) -> Iterator[tuple]:
        if partition is None or not getattr(partition, "path", None):
            return
        with open(partition.path, encoding="utf-8") as file:
            for entry in entries(file):
                yield tuple(entry.get(c) for c in FIELDS)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class RegistryWriter(DataSourceWriter):
    """Tasks write files of a version that nothing names yet; the commit names it."""

    def __init__(self, path: str, overwrite: bool):
        if not overwrite:
            raise ValueError("a registry is written whole: use mode('overwrite')")
        self.path, self.version = path, f"version-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        import yaml

        folder = os.path.join(self.path, self.version)
        os.makedirs(folder, exist_ok=True)
        first = next(rows := iter(rows), None)
        if first is None:
            return Written(None, 0)
        name, count = f"part-{uuid.uuid4().hex}.yaml", 0
        with open(os.path.join(folder, f".{name}"), "w", encoding="utf-8") as file:
            file.write("companies:\n")
            # Row by row: a list of all entries, and its YAML tree, would be held whole.
            for r in chain([first], rows):
                yaml.safe_dump([{c: r[c] for c in FIELDS if r[c] is not None}], file, allow_unicode=True, sort_keys=False)
                count += 1
        return Written(name, count)

    def commit(self, messages: list[Written | None]) -> None:
        """Show the files of the tasks that count, not of those that ran twice; then name the version."""
        folder = os.path.join(self.path, self.version)
        os.makedirs(folder, exist_ok=True)
        for done in messages:
            if done and done.file:
                os.replace(os.path.join(folder, f".{done.file}"), os.path.join(folder, done.file))
        aside = os.path.join(self.path, f".{CURRENT}-{uuid.uuid4().hex}")
        with open(aside, "w", encoding="utf-8") as file:
            file.write(self.version)
        os.replace(aside, os.path.join(self.path, CURRENT))

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(os.path.join(self.path, self.version), ignore_errors=True)


class BoardRegistry(DataSource):
    @classmethod
    def name(cls) -> str:
        return "board_registry"

    def schema(self) -> str:
        return BOARD

    def reader(self, schema: StructType) -> RegistryReader:
        return RegistryReader(local(self.options["path"]))

    def writer(self, schema: StructType, overwrite: bool) -> RegistryWriter:
        return RegistryWriter(local(self.options["path"]), overwrite)


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def register(spark: SparkSession) -> None:
    """Make the format known to a session; doing so again is no error."""
    spark.dataSource.register(BoardRegistry)
