"""Token ids in files of bit or byte planes.

A file holds the ids of consecutive documents. The ids are cut into blocks of a fixed count; a block is
transposed into planes - byte k, or bit k, of every id side by side - and each plane is compressed by
zstandard; planes of zeros are dropped. Layout, all integers little-endian:

    magic "LQTP", u8 version 2, u8 plane width (1 or 8 bits), u16 zero, u32 ids in a full block
    u32 part, u32 seq: files in ascending (part, seq) hold documents in order
    planes of block 0, block 1, ...
    document table: zstd of i64 ids' nulls bitmap byte, i64 doc_id, u32 count for each document
    chunk index: for each block u64 offset, u32 ids, u8 planes, u32 length of each plane
    u64 offset of document table, u64 offset of chunk index, u32 blocks, u32 documents, magic, line end

Executors write the files, one for each row, to any folder that Spark can reach: Spark's text writer puts out a
value's bytes as they are and a line end, which is the file's last byte. They are read back as binary files.

Defined results: a null or empty text is a document with no ids but the end id. Documents are in ascending
order of doc_id, nulls first; rows with the same doc_id are ordered by their text. An empty table gives no
files and an empty report. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import materialize, partitions
from .bpe import ForcedBoundaryBPE, default_vocabulary, one_thread, slices

MAGIC = b"LQTP"
#: Bytes that each of the encoder's memos may take in a worker, about.
MEMO = 192 << 20


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, without the zero planes at the top."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if bits == 8:
        planes = [np.ascontiguousarray(r) for r in rows]
    else:
        planes = [np.packbits(rows[k // 8] >> (k % 8) & 1, bitorder="little") for k in range(32)]
    while planes and not planes[-1].any():
        planes.pop()
    return [p.tobytes() for p in planes]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        row = np.frombuffer(p, np.uint8)
        if bits == 1:
            row = np.unpackbits(row, count=n, bitorder="little")
        ids |= row.astype("<u4") << np.uint32(k * bits)
    return ids


def write_file(
    docs: list[tuple[int | None, bytes]], bits: int = 8, block: int = 65536, level: int = 3, part: int = 0, seq: int = 0
) -> bytes:
    """docs: (doc_id, ids as little-endian unsigned 32-bit integers) in order."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=level)
    ids = np.frombuffer(b"".join(d[1] for d in docs), "<u4")
    out, at, index = [MAGIC, struct.pack("<BBHIII", 2, bits, 0, block, part, seq)], 20, []
    for lo in range(0, len(ids), block):
        part = ids[lo : lo + block]
        planes = [packer.compress(p) for p in to_planes(part, bits)]
        index.append(struct.pack(f"<QIB{len(planes)}I", at, len(part), len(planes), *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    table = np.array([d[0] is None for d in docs], np.uint8).tobytes()
    table += np.array([d[0] or 0 for d in docs], "<i8").tobytes()
    table += np.array([len(d[1]) // 4 for d in docs], "<u4").tobytes()
    table = packer.compress(table)
    tail = struct.pack("<QQII", at, at + len(table), len(index), len(docs)) + MAGIC + b"\n"
    return b"".join([*out, table, *index, tail])


def read_file(file: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, their counts and all ids of a file."""
    import zstandard

    opener = zstandard.ZstdDecompressor()
    if file[:4] != MAGIC or file[-5:] != MAGIC + b"\n" or file[4] != 2:
        raise ValueError("not a token file")
    bits = file[5]
    at, index, blocks, n = struct.unpack_from("<QQII", file, len(file) - 29)
    table = opener.decompress(file[at:index])
    none = np.frombuffer(table, np.uint8, n)
    doc_ids = np.frombuffer(table, "<i8", n, n)
    counts = np.frombuffer(table, "<u4", n, 9 * n)
    parts = []
    for _ in range(blocks):
        start, size, k = struct.unpack_from("<QIB", file, index)
        lengths = struct.unpack_from(f"<{k}I", file, index + 13)
        index += 13 + 4 * k
        planes = []
        for length in lengths:
            planes.append(opener.decompress(file[start : start + length]))
            start += length
        parts.append(from_planes(planes, size, bits))
    ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    return [None if x else int(d) for d, x in zip(doc_ids, none)], counts, ids


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocabulary: str | None = None,
    end_id: int | None = 2,
    bits: int = 8,
    block: int = 65536,
    file_ids: int = 2**20,
) -> DataFrame:
    """Encode `text` of docs, append end_id to each, and write files of about file_ids ids to a new folder.

    Returns token_files(folder). (part, seq) ascends with doc_id. A file ends with the document that fills it.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = b"" if end_id is None else np.uint32(end_id).tobytes()

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        one_thread()
        bpe = ForcedBoundaryBPE.load(vocabulary, MEMO)
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, size
            file = write_file(held, bits, block, part=part, seq=seq)
            row = pa.RecordBatch.from_pydict({"file": pa.array([file[:-1]], pa.binary())})
            seq, held, size = seq + 1, [], 0
            return row

        for batch in batches:
            for piece in slices(batch, batch.schema.get_field_index("text")):
                rows = piece.to_pydict()
                for doc_id, ids in zip(rows["doc_id"], bpe.encode_all(rows["text"])):
                    held.append((doc_id, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= file_ids:
                        yield flush()
        if held:
            yield flush()

    n = partitions(docs.sparkSession)
    # `same` parts rows with one doc_id, so that many of them don't meet in one task
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("same")).repartitionByRange(n, "doc_id", "same")
    ordered = ordered.sortWithinPartitions("doc_id", "same").select("doc_id", "text")
    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(folder)
    return token_files(docs.sparkSession, folder)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file) of the token files in a folder."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where("length > 0").select("path", F.col("content").alias("file"))


def read_tokens(files: DataFrame) -> DataFrame:
    """(part, seq, pos, doc_id, n_tokens, ids_crc32, before) of every document: before counts ids in its file."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for file in batch.column(0).to_pylist():
                part, seq = struct.unpack_from("<II", file, 12)
                doc_ids, counts, ids = read_file(file)
                raw, ends = ids.tobytes(), 4 * np.cumsum(counts, dtype=np.int64)
                starts = ends - 4 * counts.astype(np.int64)
                n = len(doc_ids)
                columns = {
                    "part": pa.array(np.full(n, part, np.int32)),
                    "seq": pa.array(np.full(n, seq, np.int32)),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "n_tokens": pa.array(counts.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                    "before": pa.array(starts // 4),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return files.select("file").mapInArrow(run, "part int, seq int, doc_id long, n_tokens long, ids_crc32 long, before long")


def token_index(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files.

    Totals are summed up by part first, so that the one ordered window sees a row for each part only.
    """
    docs = read_tokens(files)
    docs = materialize(docs, "token-index")
    by_file = docs.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    by_part = by_file.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = by_part.select("part", earlier(Window.orderBy("part")).alias("part_start"))
    within = by_file.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq")).alias("file_start"))
    offsets = within.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("file_start")).alias("offset"))
    return docs.join(offsets, ["part", "seq"]).select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
