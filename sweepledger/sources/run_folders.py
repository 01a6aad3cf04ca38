"""Sweep files in folders ``<root>/<platform>/<run>/…`` as a Spark data source.

The driver lists platforms and runs, never the files in them: a partition is some run folders, which its task lists and
reads, or one share of a run's folder: what lies directly in it is dealt to shares by a hash of its name, where the caller asks for them. Filters on the platform and the run are taken before that, so auditing one run opens that run's folder alone.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# Tasks get these classes whole, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "sweep_folders"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
FOLDERS = 32  # of runs in a partition
SCHEMAS = {
    # One row per label, and one without a label per file that says whether it could be read.
    "reports": "platform STRING, run_id STRING, file STRING, label STRING, success STRING, state STRING",
    "lines": "platform STRING, run_id STRING, file STRING, line_no INT, line STRING",
}


@dataclass
class RunFolders(InputPartition):
    folders: list[tuple[str, str, str]]  # platform, run and path
    others: list[tuple[str, str, str]] = field(default_factory=list)  # of which another partition has the first share
    share: int = 0
    shares: int = 1


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")


def _named(path: str) -> str:
    """The last part of a path, without the ``key=`` that Spark's writers put before a value."""
    name = path.rsplit("/", 1)[-1]
    return name.split("=", 1)[-1]


class RunFolderReader(DataSourceReader):
    def __init__(self, root: str, kind: str, suffix: str, shares: int = 1):
        self.root, self.kind, self.suffix, self.shares = root, kind, suffix, shares
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with, and lists of, platforms and runs; all others are left to Spark."""
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is None or f.attribute not in (("platform",), ("run_id",)):
                yield f
                continue
            held = self.wanted.get(f.attribute[0])
            self.wanted[f.attribute[0]] = set(values) if held is None else held & set(values)

    def _holds(self, column: str, value: str) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, top = _store(self.root)

        def below(path: str) -> list[str]:
            found = store.get_file_info(fs.FileSelector(path))
            return sorted(i.path for i in found if i.type == fs.FileType.Directory and not i.base_name.startswith(("_", ".")))

        runs = [
            (_named(platform), _named(run), run)
            for platform in below(top)
            if self._holds("platform", _named(platform))
            for run in below(platform)
            if self._holds("run_id", _named(run))
        ]
        if self.shares == 1:
            return [RunFolders(runs[i : i + FOLDERS]) for i in range(0, len(runs), FOLDERS)]
        return [RunFolders([] if n else [run], [run] if n else [], n, self.shares) for run in runs for n in range(self.shares)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = _store(self.root)
        for platform, run, folder in [*partition.folders, *partition.others] if partition is not None else ():
            own = [i for i in store.get_file_info(fs.FileSelector(folder)) if zlib.crc32(i.base_name.encode()) % partition.shares == partition.share]
            below = (store.get_file_info(fs.FileSelector(i.path, recursive=True)) for i in own if i.type == fs.FileType.Directory)
            files = [*own, *(i for infos in below for i in infos)]
            for info in sorted(files, key=lambda i: i.path):
                if info.type == fs.FileType.File and info.base_name.endswith(self.suffix) and not info.base_name.startswith((".", "_")):
                    at = (platform, run, info.path[len(folder) + 1 :])
                    with store.open_input_stream(info.path) as stream:
                        rows = _report(stream.read()) if self.kind == "reports" else _lines(stream)
                        for row in rows:
                            yield (*at, *row)


def _report(content: bytes) -> Iterator[tuple]:
    try:
        results = json.loads(content).get("results") or {}
        rows = [(label, (outcome or {}).get("success")) for label, outcome in results.items()]
    except (ValueError, AttributeError):
        yield None, None, "unreadable"
        return
    yield None, None, "read"
    for label, success in rows:
        yield label, success if isinstance(success, str) else None, None


def _lines(stream) -> Iterator[tuple]:
    """Numbered lines, a block at a time."""
    number, rest = 0, b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            number += 1
            yield number, line.removesuffix(b"\r").decode("utf-8", "replace")
    if rest:
        yield number + 1, rest.removesuffix(b"\r").decode("utf-8", "replace")


class SweepFolders(DataSource):
    """Options: ``path``, ``kind`` (``reports`` or ``lines``), ``suffix`` of the files and ``shares`` of a run."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "reports")]

    def reader(self, schema) -> DataSourceReader:
        kind = self.options.get("kind", "reports")
        return RunFolderReader(self.options["path"], kind, self.options.get("suffix", ".json" if kind == "reports" else ""), int(self.options.get("shares", 1)))


def read_run_folders(spark: SparkSession, root: str, kind: str = "reports", suffix: str | None = None, shares: int = 1) -> DataFrame:
    """Files of runs as rows of ``SCHEMAS[kind]``; ``platform`` and ``run_id`` are the folders' names.

    ``reports``: a row per label (``success`` null if it has none), and per file one without a label whose ``state`` is ``read`` or
    ``unreadable``, also for files without content, so every run has a row. ``lines``: numbered lines of lists or logs. A report is held
    whole by its task, lines are not. Filters on platform and run go to the listing; the session's setting for filters of
    Python sources is switched on. Give ``shares`` where runs have very many files: each run is read by so many tasks.
    """
    spark.dataSource.register(SweepFolders)
    spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format(FORMAT).option("path", root).option("kind", kind).option("shares", str(shares))
    return (reader if suffix is None else reader.option("suffix", suffix)).load()
