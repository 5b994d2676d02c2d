"""Token files: independent zstandard frames, a trailing seek table, checksums.

A file is a sequence of zstandard frames.  A data frame holds whole documents:
``u32 count``, then ``i64 doc_id, u8 has_id, u32 n_ids`` of each, then all ids as
little-endian u32.  After the data frames come two skippable frames: the
directory (magic 0x184D2A50: for each data frame ``i64 first doc_id, u8 has_id,
u32 documents, u64 ids``) and the seek table of the public zstandard seekable
format (magic 0x184D2A5E: compressed size, content size, checksum of each frame;
then the number of frames, a descriptor byte and 0x8F92EAB1).  The checksum is
the low half of the XXH64 of a frame's content.

Readers fetch the tail, choose frames, and decompress those alone.  The public
format counts a frame's content in 32 bits, and a document lies in one frame, so a
document has 2^30 - 8 ids at most; a longer one raises an error.
"""

from __future__ import annotations

import io
import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import open_random, write_whole
from ._tokens import VOCABULARY, public_encoder, slices
from ._util import mapped, new_path

#: Magic numbers of the public formats.
SKIP_DIRECTORY, SKIP_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_IDS = 65_536
LEVEL = 1
END_ID = 2
#: Ids that one reading task takes, if that gives tasks for all cores: a second or two.
READ_IDS = 64_000_000
#: Layouts of a document and of a directory entry, and their sizes.
_DOC, _DOC_SIZE = "<qBI", 13
_DIR, _DIR_SIZE = "<qBIQ", 21


class Corrupt(ValueError):
    """A frame or table that fails its checks."""


def write_frames(documents, frame_ids: int = FRAME_IDS, level: int = LEVEL):
    """Yield a file's bytes for ``documents``: (doc_id or None, ids as u32 bytes)."""
    import xxhash
    import zstandard

    compressor = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
    seek, directory = [], []
    held: list[tuple[int | None, bytes]] = []

    def frame():
        head = b"".join(struct.pack(_DOC, d or 0, d is not None, len(b) // 4) for d, b in held)
        content = struct.pack("<I", len(held)) + head + b"".join(b for _, b in held)
        packed = compressor.compress(content)
        seek.append(struct.pack("<III", len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        first = held[0][0]
        directory.append(struct.pack(_DIR, first or 0, first is not None, len(held), sum(len(b) // 4 for _, b in held)))
        return packed

    size = 0
    for d, b in documents:
        if len(b) + _DOC_SIZE + 4 >= 1 << 32:
            raise ValueError(f"document {d} has {len(b) // 4} ids, more than a frame can count")
        if held and 4 * size + len(b) + _DOC_SIZE * (len(held) + 1) + 4 >= 1 << 32:
            yield frame()
            held, size = [], 0
        held.append((d, b))
        size += len(b) // 4
        if size >= frame_ids:
            yield frame()
            held, size = [], 0
    if held:
        yield frame()
    body = b"".join(directory)
    yield struct.pack("<II", SKIP_DIRECTORY, len(body)) + body
    body = b"".join(seek) + struct.pack("<IBI", len(seek), 0x80, SEEKABLE)
    yield struct.pack("<II", SKIP_SEEK, len(body)) + body


class TokenFile:
    """Random access to one token file (a binary file object)."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        end = file.tell()
        if end < 17:
            raise Corrupt("too short for a seek table")
        file.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or descriptor & 0x7C:
            raise Corrupt("no seek table")
        width = 12 if descriptor & 0x80 else 8
        start = end - 17 - width * n
        if start < 0:
            raise Corrupt("the seek table is longer than the file")
        file.seek(start)
        if struct.unpack("<II", file.read(8)) != (SKIP_SEEK, width * n + 9):
            raise Corrupt("the seek table's header is damaged")
        table = file.read(width * n)
        entries = [struct.unpack_from("<III" if width == 12 else "<II", table, width * k) for k in range(n)]
        self.sizes = [e[1] for e in entries]
        self.checks = [e[2] if width == 12 else None for e in entries]
        self.offsets = np.concatenate([[0], np.cumsum([e[0] for e in entries], dtype=np.int64)]).tolist()
        file.seek(self.offsets[-1])
        magic, size = struct.unpack("<II", file.read(8))
        if magic != SKIP_DIRECTORY or size != _DIR_SIZE * n or self.offsets[-1] + 8 + size != start:
            raise Corrupt("the directory is damaged")
        raw = file.read(size)
        #: (first doc_id or None, documents, ids) of each frame
        self.directory = [(a if h else None, k, m) for a, h, k, m in (struct.unpack_from(_DIR, raw, _DIR_SIZE * i) for i in range(n))]
        self.frames_read = 0

    def frame(self, k: int) -> list[tuple[int | None, bytes]]:
        """The documents of frame ``k``; its checksum is verified."""
        import xxhash
        import zstandard

        self.file.seek(self.offsets[k])
        packed = self.file.read(self.offsets[k + 1] - self.offsets[k])
        try:
            content = zstandard.ZstdDecompressor().decompress(packed, max_output_size=self.sizes[k])
        except zstandard.ZstdError as e:
            raise Corrupt(f"frame {k}: {e}") from e
        if len(content) != self.sizes[k] or self.checks[k] not in (None, xxhash.xxh64_intdigest(content) & 0xFFFFFFFF):
            raise Corrupt(f"frame {k} fails its checksum")
        self.frames_read += 1
        (n,) = struct.unpack_from("<I", content)
        out, at = [], 4 + _DOC_SIZE * n
        for i in range(n):
            d, has, size = struct.unpack_from(_DOC, content, 4 + _DOC_SIZE * i)
            out.append((d if has else None, content[at : at + 4 * size]))
            at += 4 * size
        return out

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document of that id, from the frames that can hold it."""
        firsts = [(h is not None, h or 0) for h, _, _ in self.directory]  # nulls sort first
        found = []
        for k, first in enumerate(firsts):
            last = firsts[k + 1] if k + 1 < len(firsts) else (True, 1 << 63)
            if first <= (True, doc_id) <= last:
                found += [np.frombuffer(b, "<u4") for d, b in self.frame(k) if d == doc_id]
        return found


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, partitions: int | None = None
) -> list[dict]:
    """Encode ``docs(doc_id, text)`` into token files in ascending doc_id order.

    Returns the manifest in that order: path, documents, ids.  A null text is
    empty; null doc_ids come first; rows of one doc_id are ordered by a hash of
    their text, and may span files.  Texts of any length are encoded whole; other
    columns play no part.  Each task writes one file and moves it to
    its final name, so a repeated task replaces it by the same bytes.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    end = np.array([end_id], dtype="<u4").tobytes()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "h"
    )

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, total = public_encoder(vocabulary), [0, 0]

        def encoded():
            for ids, texts in slices(batches):
                for d, b in zip(ids, encoder.encode(texts)):
                    total[0] += 1
                    total[1] += len(b) // 4 + 1
                    yield d, b + end

        path = f"{folder}/tokens-{part:06d}.zst"
        first = next(stream := encoded(), None)
        if first is None:
            return
        write_whole(path, write_frames(itertools.chain([first], stream)))
        yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "documents": total[0], "ids": total[1]}])

    rows = mapped(ordered.select("doc_id", "text"), run, "part long, path string, documents long, ids long").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["part"])]


def reading_tasks(sizes: list[int], least: int, most_ids: int = READ_IDS) -> list[int]:
    """The task of each file, by the files' ids: ``least`` tasks, or as many more as hold
    ``most_ids`` each, get even runs of consecutive files, to half a file at either end."""
    total = max(1, sum(sizes))
    n = max(least, -(-total // most_ids))
    if len(sizes) <= n:
        return list(range(len(sizes)))
    tasks, shares, before = [], [], 0
    for size in sizes:
        share = (2 * before + size) * n // (2 * total)
        if not shares or share != shares[-1]:
            shares.append(share)
        tasks.append(len(shares) - 1)
        before += size
    return tasks


def read_token_files(spark, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files.

    start counts the ids of all documents before it; documents come as they were
    written, nulls and repeats included.  A task reads whole files, frame by frame, small
    files together: every task that writes its rows has the executor start processes
    (Hadoop's local store without its native library sets modes by ``chmod``).  A frame
    that fails its checksum raises ``Corrupt``.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows, base = [], 0
    for m, task in zip(manifest, reading_tasks([m["ids"] for m in manifest], spark.sparkContext.defaultParallelism)):
        rows.append((m["path"], base, task))
        base += m["ids"]
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_random(path) as file:
                    tokens = TokenFile(file)
                    for k in range(len(tokens.directory)):
                        cols: list[list] = [[] for _ in range(4 + with_ids)]
                        for d, b in tokens.frame(k):
                            for col, v in zip(cols, (d, start, len(b) // 4, zlib.crc32(b))):
                                col.append(v)
                            if with_ids:
                                cols[4].append(np.frombuffer(b, "<u4").astype(np.int32))
                            start += len(b) // 4
                        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
                        if with_ids:
                            arrays.append(pa.array(cols[4], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(
                            arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
                        )

    files = spark.createDataFrame(rows, "path string, base long, task int").repartitionById(rows[-1][2] + 1, F.col("task"))
    return files.mapInArrow(run, schema)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Ids of every row of ``documents``, written to token files and read back; see
    ``write_token_files`` for nulls, empty and long texts, ties and repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(spark, write_token_files(docs, new_path(spark, "token-files")))
