"""Small helpers of the operators: tables, free column names, batches of texts."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

# Words of the word-based operators, over UTF-8 bytes: 0-9, a-z and everything beyond ASCII,
# with A-Z lower-cased; every other byte becomes a space.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
# A-Z to a-z, all else kept.
LOWER_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def ship(spark: SparkSession) -> None:
    """Give Spark's Python workers this package as a job's file, once per application.

    The operators that run Python in tasks call this, so the package need not be installed on the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_sweepledger_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = Path(SparkFiles.getRootDirectory()) / "job-code"  # Spark's own folder, from which it serves job files
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(folder / "sweepledger-package.zip", "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(folder / "sweepledger-package.zip"))
    context._sweepledger_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_places(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` that differs from row to row and stays the same however often ``df`` is read.

    Rows of a frame that is Parquet files as they are, are told apart by file and row number there, so nothing is written; files
    by a hash of their paths, which is checked to differ. Those of any other frame, where such a row may stand several times or
    come in another order when executors come or go, are written once with numbers.
    """
    if df._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            meta = df.metadataColumn("_metadata")
            path = meta["file_path"]
            files = df.select(path.alias("path")).distinct()
            n, different = files.agg(F.count("*"), F.count_distinct(F.xxhash64("path"))).first()
            if n == different:
                return df.withColumn(name, F.struct(F.xxhash64(path).alias("file"), meta["row_index"].alias("row")))
        except AnalysisException:
            pass  # no files, or not of Parquet
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "placed")


BROADCAST_BYTES = 32 << 20


def without_places(placed: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """Rows of ``placed`` whose place is not in ``dropped``, without the column ``name`` of places.

    The dropped places are written and measured: while they hold ``BROADCAST_BYTES`` at most they are broadcast, so that no text is
    shuffled; else both sides are shuffled by place.
    """
    gone = stage(dropped.select(name).distinct(), "dropped")
    size = gone.agg(F.sum(F.octet_length(F.to_json(F.struct(name))))).first()[0] or 0
    return placed.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, name, "left_anti").drop(name)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[0-9a-z]`` or beyond ASCII, as UTF-8 bytes; none for null."""
    return [] if text is None else utf8(text).translate(WORD_BYTES).split()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def slices(batches: Iterator, column: str, most: int = 4 << 20) -> Iterator:
    """Arrow record batches cut so that the texts of each hold about ``most`` bytes, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 64
        if start < batch.num_rows:
            yield batch.slice(start)
