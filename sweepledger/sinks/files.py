"""Files copied or written in tasks, each under a name of its own first."""

from __future__ import annotations

import hashlib
import os
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Tasks get these functions whole, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20


def _store(path: str):
    """The file system of a path and the path on it; a plain path is a local or mounted one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def copy_members(members: DataFrame, source: str, target: str) -> DataFrame:
    """Copy ``(crate, path, content_hash)`` from one collection's folder to another's; ``(crate, path, status)``.

    A task writes a file under a name of its own beside its place and renames it when its content has the
    expected hash, so a lost or repeated task leaves no half file behind and a reader sees the old file or the new one. ``changed`` is a
    file that is no longer what was listed; it is not copied. Both folders must be on file systems that all executors see. The
    files are copied when the result is read; write it once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, top = _store(source)
        there, goal = _store(target)
        for batch in batches:
            told = []
            for crate, path, expected in zip(batch["crate"], batch["path"], batch["content_hash"]):
                final = f"{goal}/{crate}/{path}"
                folder, _, name = final.rpartition("/")
                own = f"{folder}/.{name}.{uuid.uuid4().hex}"
                there.create_dir(folder, recursive=True)
                seen = hashlib.sha256()
                with here.open_input_stream(f"{top}/{crate}/{path}") as given, there.open_output_stream(own) as made:
                    while block := given.read(CHUNK):
                        seen.update(block)
                        made.write(block)
                right = seen.hexdigest() == expected
                there.move(own, final) if right else there.delete_file(own)
                told.append((crate, path, "copied" if right else "changed"))
            yield pd.DataFrame(told, columns=["crate", "path", "status"])

    return members.select("crate", "path", "content_hash").mapInPandas(run, "crate STRING, path STRING, status STRING")


def write_line_files(lines: DataFrame, out: str) -> int:
    """Write rows ``(path, line)`` as text files below ``out``, a line each, null as an empty one; how many files there are.

    The rows of a path stand in one partition, one after the other. A task holds a batch of rows; it writes a file under a name of
    its own and renames it when it is whole, so a lost or repeated task leaves no half file behind and nothing is left to be
    committed by the driver. ``out`` is on a file system that all executors see, and is made even if there are no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _store(out)
        n, path, stream = 0, None, None
        for batch in batches:
            for given, some in batch.groupby("path", sort=False)["line"]:
                if given != path:
                    if stream:
                        stream.close()
                        store.move(own, f"{top}/{path}")
                    path, n = given, n + 1
                    folder, _, name = f"{top}/{path}".rpartition("/")
                    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    store.create_dir(folder, recursive=True)
                    stream = store.open_output_stream(own)
                stream.write("".join(f"{'' if line is None else line}\n" for line in some).encode())
        if stream:
            stream.close()
            store.move(own, f"{top}/{path}")
        yield pd.DataFrame({"n": [n]})

    store, top = _store(out)
    store.create_dir(top, recursive=True)
    return sum(r["n"] for r in lines.select("path", "line").mapInPandas(run, "n LONG").collect())  # one row per task
