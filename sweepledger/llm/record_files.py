"""Token ids in files of length-delimited binary records, with an offset index beside each.

A record: its data's length (8 bytes), the masked CRC-32C of these (4), the data, the masked
CRC-32C of the data (4); all little-endian. The data are a document's ids, 2 bytes each if the
vocabulary allows, else 4. The index of a file has one entry per record: where it begins, its number of ids,
the document's id and whether it has one. With it a reader can take records in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .byte_pairs import byte_pairs
from .checksums import crc32c_many, masked
from .shared import fresh, ship, slices

INDEX = np.dtype([("offset", "<u8"), ("n_ids", "<u8"), ("doc_id", "<i8"), ("has_id", "u1")])
HEAD, TAIL = 12, 4
READ_BYTES = 4 << 20
WRITTEN = "part long, width int, n_records long, n_ids long"


def frame(records: list[bytes]) -> list[bytes]:
    """Each record with its lengths and checksums."""
    lengths = [len(r).to_bytes(8, "little") for r in records]
    length_crc, data_crc = masked(crc32c_many(lengths)), masked(crc32c_many(records))
    return [
        b"".join((n, int(a).to_bytes(4, "little"), r, int(b).to_bytes(4, "little")))
        for n, a, r, b in zip(lengths, length_crc, records, data_crc)
    ]


def unframe(framed: list[bytes]) -> list[bytes]:
    """The data of each framed record; an error if a length or checksum is wrong."""
    lengths, data = [f[:8] for f in framed], [f[HEAD:-TAIL] for f in framed]
    stored = np.array([(int.from_bytes(f[8:HEAD], "little"), int.from_bytes(f[-TAIL:], "little")) for f in framed], np.uint32)
    right = (
        all(int.from_bytes(n, "little") == len(d) for n, d in zip(lengths, data))
        and (masked(crc32c_many(lengths)) == stored[:, 0]).all()
        and (masked(crc32c_many(data)) == stored[:, 1]).all()
    )
    if not right:
        raise ValueError("a record is damaged")
    return data


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> list[tuple[int, int, int]]:
    """Encode whole texts, append ``end_id`` and write them in ascending ``doc_id`` order.

    Returns each file's number, width of an id and total of ids; one entry per file. Rows are dealt into ranges of
    ``doc_id`` and their place in the input, so that one id's repeated rows can be split; rows
    without an id come first. A null text counts as empty: its record holds the end id
    only. An empty table makes no files with records. Other columns are not read.

    ``folder`` is on a file system that all executors see and pyarrow knows. A task writes
    under a name of its own and renames the finished file, so a lost or repeated task
    leaves nothing wrong behind.
    """
    ship(docs.sparkSession)
    (place,) = fresh(docs, "place")
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias(place))
    ordered = rows.repartitionByRange("doc_id", place).sortWithinPartitions("doc_id", place).drop(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = byte_pairs(tokenizer)
        dtype = np.dtype("<u2" if known.size <= 1 << 16 else "<u4")
        part = TaskContext.get().partitionId()
        store, top = pafs.FileSystem.from_uri(folder)
        own = f"{top}/_attempt-{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        offset, n_records, n_ids = 0, 0, 0
        with store.open_output_stream(f"{own}/rec") as records, store.open_output_stream(f"{own}/idx") as index:
            for batch in slices(batches, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                data = [
                    np.append(np.frombuffer(ids, "<i4"), end_id).astype(dtype).tobytes() for ids in known.encode(texts)
                ]
                entries = np.zeros(len(data), INDEX)
                sizes = np.array([len(d) for d in data], np.uint64)
                entries["n_ids"] = sizes // dtype.itemsize
                entries["offset"] = offset + np.r_[0, np.cumsum(sizes + HEAD + TAIL)[:-1]]
                doc_ids = batch.column("doc_id")
                entries["doc_id"] = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
                entries["has_id"] = doc_ids.is_valid().to_numpy(zero_copy_only=False)
                records.write(b"".join(frame(data)))
                index.write(entries.tobytes())
                offset += int(sizes.sum()) + len(data) * (HEAD + TAIL)
                n_records += len(data)
                n_ids += int(entries["n_ids"].sum())
        for kind in ("rec", "idx"):
            final = f"{top}/part-{part:06d}.{kind}"
            if store.get_file_info(final).type != pafs.FileType.NotFound:
                store.delete_file(final)
            store.move(f"{own}/{kind}", final)
        store.delete_dir(own)
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "width": dtype.itemsize, "n_records": n_records, "n_ids": n_ids}],
            schema=pa.schema([("part", pa.int64()), ("width", pa.int32()), ("n_records", pa.int64()), ("n_ids", pa.int64())]),
        )

    written = ordered.mapInArrow(run, WRITTEN).collect()  # one row per file
    return sorted((r["part"], r["width"], r["n_ids"]) for r in written if r["n_records"])


def read_records(spark: SparkSession, folder: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """All records of the files: ``doc_id``, ``start`` (ids of all records before it), ``n_tokens`` and
    ``ids``, 4 little-endian bytes each. Every length and checksum is verified."""
    ship(spark)
    before = [0, *np.cumsum([n for _, _, n in files]).tolist()]
    rows = [(part, width, int(base)) for (part, width, _), base in zip(files, before)]
    listed = spark.createDataFrame(rows, "part long, width int, base long")
    if len(rows) > 1:
        listed = listed.repartition(len(rows))
    types = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        for file in (f for batch in batches for f in batch.to_pylist()):
            path, base = f"{top}/part-{file['part']:06d}", file["base"]
            with store.open_input_file(f"{path}.rec") as records, store.open_input_stream(f"{path}.idx") as index:
                while raw := index.read(INDEX.itemsize * 4096):
                    entries = np.frombuffer(raw, INDEX)
                    sizes = entries["n_ids"].astype(np.int64) * file["width"] + HEAD + TAIL
                    group = np.cumsum(sizes) // READ_BYTES
                    for some in np.split(np.arange(len(entries)), np.flatnonzero(np.diff(group)) + 1):
                        first, last = int(entries["offset"][some[0]]), int(entries["offset"][some[-1]] + sizes[some[-1]])
                        block = records.read_at(last - first, first)
                        at = [(int(entries["offset"][i]) - first, int(sizes[i])) for i in some]
                        data = unframe([block[o : o + n] for o, n in at])
                        counts = entries["n_ids"][some].astype(np.int64)
                        starts = base + np.cumsum(counts) - counts
                        base += int(counts.sum())
                        flat = np.frombuffer(b"".join(data), f"<u{file['width']}").astype("<u4").tobytes()
                        ends = (4 * np.cumsum(counts)).tolist()
                        ids = [flat[e - 4 * n : e] for e, n in zip(ends, counts.tolist())]
                        has = entries["has_id"][some] == 1
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(entries["doc_id"][some], mask=~has), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())],
                            schema=types,
                        )

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to record files in a fresh folder of the shared checkpoint folder, and read these back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "records")
    return read_records(spark, folder, write_records(docs, folder, tokenizer, end_id))


def record_digest(records: DataFrame) -> DataFrame:
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
