"""Token files: one zstandard frame per document, then a seek table.

A file is a run of independent zstandard frames followed by one skippable frame,
so any zstandard tool can decompress it. The skippable frame holds one entry per
document (id, sizes, checksum) and a footer of fixed length at the very end of
the file. A reader takes the footer, then the table, then only the frames it wants.
The last byte is a line feed: Spark's text writer, which commits the files on any
Hadoop store, puts it there.

Nulls: a null text is an empty document; a null id is kept and sorts first.
Repeated ids are ordered by a hash of the text. A text of any length is one frame, and
texts are encoded in batches of bounded bytes. Columns but doc_id and text are not
read, whatever their names. An empty table gives no documents.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.bpe import encoder, regrouped
from lodeweave.llm.storage import materialize, new_path, partitions, release

SKIPPABLE = 0x184D2A5E
MAGIC = b"LWT1"
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("stored", "<u4"), ("raw", "<u4"), ("crc32", "<u4")])
#: part, file number in the part, documents, magic, line feed
FOOTER = struct.Struct("<IIQ4sc")
ROWS = "part int, file int, place long, doc_id long, n_tokens long, ids_crc32 long, file_start long"


def pack_file(part: int, number: int, entries: list[tuple], frames: list[bytes]) -> bytes:
    """A whole file but for its last byte."""
    table = np.array(entries, ENTRY).tobytes()
    tail = table + FOOTER.pack(part, number, len(entries), MAGIC, b"\n")
    return b"".join([*frames, struct.pack("<II", SKIPPABLE, len(tail)), tail[:-1]])


def read_table(file) -> tuple[int, int, np.ndarray]:
    """Part, number and entries of an open file; reads the tail alone."""
    end = file.seek(0, io.SEEK_END)
    file.seek(end - FOOTER.size)
    part, number, count, magic, _ = FOOTER.unpack(file.read(FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    file.seek(end - FOOTER.size - count * ENTRY.itemsize)
    return part, number, np.frombuffer(file.read(count * ENTRY.itemsize), ENTRY)


def read_documents(file, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(place, ids) of the documents at the ``wanted`` places; the other frames are not decompressed."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    _, _, table = read_table(file)
    begin = np.cumsum(table["stored"], dtype=np.int64) - table["stored"]
    for i in range(len(table)) if wanted is None else wanted:
        file.seek(int(begin[i]))
        raw = unpack(file.read(int(table["stored"][i])), max_output_size=int(table["raw"][i]))
        if len(raw) != table["raw"][i] or zlib.crc32(raw) != table["crc32"][i]:
            raise ValueError(f"document {i} fails its checksum")
        yield i, np.frombuffer(raw, "<u4")


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, spaced: bool = False, file_bytes: int = 16 << 20, level: int = 1
) -> None:
    """Encode ``docs`` (doc_id, text) and write them under ``path`` in ascending doc_id order.

    ``file_bytes`` is the size at which a file is closed; a longer document makes a longer file.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        coder, part, number, held = encoder(tokenizer_path, spaced), TaskContext.get().partitionId(), 0, 0
        entries: list[tuple] = []
        frames: list[bytes] = []
        end = np.array([end_id], "<u4").tobytes()
        for batch in regrouped(batches):
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                ids, offsets = coder.encode(rows.column(1))
                ids = ids.astype("<u4", copy=False)
                for k, doc_id in enumerate(rows.column(0).to_pylist()):
                    raw = ids[offsets[k] : offsets[k + 1]].tobytes() + end
                    frames.append(press(raw))
                    entries.append((doc_id or 0, doc_id is not None, len(frames[-1]), len(raw), zlib.crc32(raw)))
                    held += len(frames[-1])
                    if held >= file_bytes:
                        yield pa.record_batch([pa.array([pack_file(part, number, entries, frames)], pa.binary())], ["content"])
                        entries, frames, held, number = [], [], 0, number + 1
        if entries:
            yield pa.record_batch([pa.array([pack_file(part, number, entries, frames)], pa.binary())], ["content"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order[:2]).sortWithinPartitions(*order).drop("tie")
    files = ranged.mapInArrow(encode, "content binary")
    writer = files.select(F.col("content").cast("string").alias("value")).write
    writer.option("lineSep", "\n").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False, wanted: Iterable[int] | None = None) -> DataFrame:
    """One row per stored document: ROWS, and ``ids`` if asked for. Every checksum is checked.

    With ``wanted`` (doc_ids), the other documents' frames are not decompressed and have no row; sizes before them
    come from the seek table. Spark's binary source has no ranges, so the files' bytes are read either way.
    """
    asked = None if wanted is None else np.array(sorted(set(wanted)), np.int64)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = pa.BufferReader(content.as_buffer())
                part, number, table = read_table(file)
                sizes, sums, ids = [], [], []
                places = np.arange(len(table)) if asked is None else np.flatnonzero(np.isin(table["doc_id"], asked) & (table["known"] == 1))
                for _, x in read_documents(file, places.tolist()):
                    sizes.append(len(x))
                    sums.append(zlib.crc32(x))
                    if with_ids:
                        ids.append(x.astype(np.int32))
                n, before = len(places), np.cumsum(table["raw"], dtype=np.int64) - table["raw"]
                columns = [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.full(n, number, np.int32)),
                    pa.array(places),
                    pa.array(table["doc_id"][places].astype(np.int64), mask=table["known"][places] == 0),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(before[places] // 4),
                ]
                names = [x.split()[0] for x in ROWS.split(", ")]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(decode, ROWS + (", ids array<int>" if with_ids else ""))


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``: tokens of all documents before each one.

    Totals are summed per file, then per part; the one ordered pass over
    everything sees a row per part (as many as shuffle partitions).
    """
    files = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("file_tokens"))
    parts = files.groupBy("part").agg(F.sum("file_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "file", F.coalesce(F.sum("file_tokens").over(inside), F.lit(0)).alias("in_part"))
    starts = files.join(parts, "part").select("part", "file", (F.col("part_start") + F.col("in_part")).alias("begin"))
    return rows.join(starts, ["part", "file"]).withColumn("start", F.col("begin") + F.col("file_start"))


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    rows = materialize(read_token_files(spark, path), "token-rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
