"""WARC archives: a writer with revisit records, and a salvage reader.

The writer puts each record in a gzip member of its own.  The reader checks
every record (member checksum, version line, Content-Length, block digest).
After a failed check it searches for the next member that opens to a version
line (or, in plain archives and inside a member of several records, for the next
version line that begins a valid record), continues there, and logs the bytes in
between as a quarantined gap.  Headers and blocks may have any length; a record is
held whole, an archive or a member never.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import open_fs, open_random, write_whole  # noqa: F401
from ._util import hot_join, mapped, materialize, new_path

VERSION = b"WARC/1.1"
#: First bytes of a gzip member: magic and the deflate method.
MEMBER = b"\x1f\x8b\x08"
#: Payloads below this size are stored each time.
REVISIT_BYTES = 100
_EPOCH = "2024-01-01T00:00:00Z"
CHUNK = 1 << 16
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+")
#: Distinct repeated digests up to which a broadcast replaces the shuffle of payloads:
#: some 100 bytes each.
BROADCAST_DIGESTS = 200_000


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, headers, Content-Length, block, two line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"".join([VERSION, b"\r\n", head.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


class Broken(ValueError):
    """The bytes themselves can't be had: a member is damaged or cut off."""


class _Source:
    """A window over bytes that arrive piece by piece; ``start`` is its offset."""

    def __init__(self, pieces, total: int | None = None):
        self.pieces, self.total, self.held, self.start = pieces, total, bytearray(), 0

    def _pull(self) -> bool:
        piece = next(self.pieces, b"")
        self.held += piece
        return bool(piece)

    def have(self, n: int) -> bool:
        if self.total is not None and self.start + n > self.total:
            return False
        while len(self.held) < n:
            if not self._pull():
                return False
        return True

    def find(self, what: bytes, at: int) -> int:
        while (k := self.held.find(what, at)) < 0:
            at = max(at, len(self.held) - len(what) + 1)
            if not self._pull():
                return -1
        return k

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.start += n


def _right(digest: str, block: bytes) -> bool | None:
    """Whether a labelled digest is that of the block; None if it can't be told."""
    name, colon, value = digest.partition(":")
    if not colon or name.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return None
    own = hashlib.new(name.lower(), block)
    return value.lower() in (own.hexdigest(), base64.b32encode(own.digest()).decode().lower())


def _read_record(s: _Source) -> tuple[dict[str, str], bytes, int, bool]:
    """(headers, block, length, whether a digest was checked) of the record that ``s``
    begins with, which stays in the window; ValueError if there is none."""
    headers: dict[str, str] | None = None
    at, last = 0, ""
    while True:
        stop = s.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("the headers don't end")
        line = bytes(s.held[at:stop])
        at = stop + 2
        if headers is None:
            if not _VERSION_LINE.fullmatch(line):
                raise ValueError("no version line")
            headers = {}
        elif not line:
            break
        elif line[:1] in b" \t" and last:  # a folded header
            headers[last] += " " + line.strip().decode("utf-8", "replace")
        else:
            key, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise ValueError("a header without a colon")
            last = key.strip().lower()
            headers[last] = value.strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError("no Content-Length")
    stop = at + int(size)
    if not s.have(stop + 4):
        raise ValueError("the block is cut off")
    if s.held[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where it should")
    block = bytes(s.held[at:stop])
    right = _right(headers.get("warc-block-digest", ""), block)
    if right is False:
        raise ValueError("the block digest differs")
    return headers, block, stop + 4, right is True


@dataclass
class Salvage:
    """What a pass over one archive found: iterate ``records()``, then see ``gaps``:
    (first byte, byte after the last, why), in the archive's own bytes."""

    file: object
    gaps: list[tuple[int, int, str]] = field(default_factory=list)

    def _size(self) -> int:
        self.file.seek(0, 2)
        return self.file.tell()

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def _inflate(self, at: int, end: list[int]):
        """Content of the member at ``at``, piece by piece; then its end in ``end``.
        Where the member breaks, what can still be read comes before the error."""
        d, data = zlib.decompressobj(31), b""
        while not d.eof:
            if not data:
                data = self._at(at, CHUNK)
                at += len(data)
            before = d.copy()
            try:
                piece = d.decompress(data, 1 << 20)
            except zlib.error as e:
                for k in range(len(data)):
                    try:
                        yield from filter(None, [before.decompress(data[k : k + 1])])
                    except zlib.error:
                        break
                raise Broken(f"gzip: {e}") from e
            if not data and not piece:
                raise Broken("the member is cut off")
            data = d.unconsumed_tail
            if piece:
                yield piece
        end.append(at - len(d.unused_data))

    def _member(self, at: int):
        """Yield the records of the member at ``at``; returns its end.

        A record with a checked digest is given at once, others when the member's
        own checksum has proved right.
        """
        end: list[int] = []
        s, waiting, lost, found = _Source(self._inflate(at, end)), [], [], 0
        while s.have(1):
            try:
                headers, block, n, sure = _read_record(s)
            except Broken:
                raise
            except ValueError as e:
                begin, k = s.start, s.find(b"WARC/", 1)
                if k < 0:
                    k = len(s.held)
                s.drop(k)
                if lost and lost[-1][1] == begin:
                    begin = lost.pop()[0]
                lost.append((begin, s.start, str(e)))
                continue
            s.drop(n)
            found += 1
            record = Record(at, 0, headers, block)
            if sure and s.have(1):  # more follows: the last one waits for the member's end
                yield record
            else:
                waiting.append(record)
        for record in waiting:
            record.length = end[0] - at
            yield record
        if not found:
            raise ValueError(lost[0][2] if lost else "an empty member")
        self.gaps += [(at, end[0], f"bytes {a} to {b} of the member's content: {why}") for a, b, why in lost]
        return end[0]

    def _pieces(self, at: int):
        while piece := self._at(at, CHUNK):
            at += len(piece)
            yield piece

    def _plain(self, at: int, size: int) -> tuple[Record, int]:
        headers, block, n, _ = _read_record(_Source(self._pieces(at), size - at))
        return Record(at, n, headers, block), at + n

    def _opens(self, offset: int) -> bool:
        """Whether a member at ``offset`` opens to a version line."""
        try:
            return zlib.decompressobj(31).decompress(self._at(offset, 4096), 16).startswith(b"WARC/")
        except zlib.error:
            return False

    def _reads(self, offset: int, size: int) -> bool:
        """Whether the version line at ``offset`` begins a whole, valid record."""
        try:
            self._plain(offset, size)
        except ValueError:
            return False
        return True

    def _next(self, offset: int, size: int) -> int:
        """The next offset at which a valid member or version line begins."""
        at = offset
        while at < size:
            piece = self._at(at, CHUNK + 8)
            k = 0
            while k < min(len(piece), CHUNK):
                hits = [x for x in (piece.find(MEMBER, k), piece.find(b"WARC/", k)) if x >= 0]
                if not hits or min(hits) >= CHUNK:
                    break
                k = min(hits)
                if piece.startswith(MEMBER, k):
                    if self._opens(at + k):
                        return at + k
                elif self._reads(at + k, size):
                    return at + k
                k += 1
            at += CHUNK
        return size

    def records(self):
        size, at = self._size(), 0
        while at < size:
            start = self._at(at, 5)
            try:
                if start.startswith(MEMBER):
                    at = yield from self._member(at)
                elif start == b"WARC/":
                    record, at = self._plain(at, size)
                    yield record
                else:
                    raise ValueError("neither a member nor a version line")
            except ValueError as e:
                after = self._next(at + 1, size)
                if self.gaps and self.gaps[-1][1] == at:
                    first, _, why = self.gaps.pop()
                    self.gaps.append((first, after, why))
                else:
                    self.gaps.append((at, after, str(e)))
                at = after


def _record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """A page's record; ``first`` is the page_id it revisits, or None."""
    name = lambda p: f"<urn:page:{'' if p is None else p}>"
    block = b"" if first is not None else payload
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", _EPOCH),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if first is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", name(first)),
        ]
    return record_bytes(headers, block)


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with the digest and, for revisits, ``first``.

    Payload groups are reduced to their smallest page_id, digests alone being
    shuffled; digests of two rows or more come back to the payloads by a broadcast,
    if they are ``BROADCAST_DIGESTS`` at most, else by a join that spares hot
    digests the shuffle.  A null html is an empty payload.  A null page_id never is
    a first; where the smallest page_id is repeated, its rows are all responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = materialize(
        rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1),
        "digests",
    )
    if firsts.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(firsts.select("digest", "first")), "digest", "left")
    else:
        joined = hot_join(rows, firsts, ["digest"])
    return joined.withColumn("first", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")))


def write_archives(pages: DataFrame, folder: str) -> list[str]:
    """Write one archive per partition of ``pages``; the paths, sorted."""

    def run(batches):
        from pyspark import TaskContext

        path = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz"

        def members():
            for batch in batches:
                columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "first")]
                for row in zip(*columns):
                    yield member(_record(*(x.as_py() for x in row)))

        stream = members()
        one = next(stream, None)
        if one is None:
            return
        write_whole(path, itertools.chain([one], stream))
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return sorted(r["path"] for r in mapped(plan_records(pages), run, "path string").collect())


READ_SCHEMA = (
    "path string, offset long, length long, gap string, record_type string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long, block binary"
)


def read_archives(spark, paths: list[str], with_block: bool = True) -> DataFrame:
    """One row per record, and one per quarantined gap (``gap`` holds the reason).

    One task reads one archive, record by record.  page_id and refers_to are
    parsed from this writer's record names and null for others.  payload_bytes and
    payload_digest are those of the block that was read; a revisit has no block: its
    payload_bytes are null, its digest is the one it declares.
    """

    def page(name: str):
        digits = name.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits.lstrip("-").isdigit() else None

    def row(path, r: Record) -> dict:
        h = r.headers
        own = h.get("warc-type") != "revisit"
        return {
            "path": path, "offset": r.offset, "length": r.length, "gap": None,
            "record_type": h.get("warc-type"), "page_id": page(h.get("warc-record-id", "")),
            "url": h.get("warc-target-uri"),
            "payload_bytes": len(r.block) if own else None,
            "payload_digest": hashlib.sha256(r.block).hexdigest() if own else h.get("warc-payload-digest", "").removeprefix("sha256:"),
            "refers_to": page(h.get("warc-refers-to", "")),
            "block": r.block if with_block else None,
        }

    schema = pa.schema([
        (n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t])
        for n, t in (x.split(" ") for x in READ_SCHEMA.split(", "))
    ])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_random(path) as file:
                    pass_, held, size = Salvage(file), [], 0
                    for r in pass_.records():
                        held.append(row(path, r))
                        size += len(r.block) + 500
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    held += [{"path": path, "offset": a, "length": b - a, "gap": why} for a, b, why in pass_.gaps]
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    if not paths:
        return spark.createDataFrame([], READ_SCHEMA)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(run, READ_SCHEMA)


def followed(found: DataFrame) -> DataFrame:
    """``found`` with a revisit's payload_bytes taken from the response it refers to.

    A response counts if its page_id is the one referred to and its block has the
    digest that the revisit declares; without one payload_bytes stay null.
    """
    revisits = found.filter(F.col("refers_to").isNotNull()).groupBy("refers_to", "payload_digest").agg(F.count(F.lit(1)).alias("n"))
    own = found.filter(F.col("payload_bytes").isNotNull()).select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("size"))
    sizes = materialize(own.distinct().join(revisits, ["refers_to", "payload_digest"]), "sizes")
    return hot_join(found, sizes, ["refers_to", "payload_digest"]).withColumn("payload_bytes", F.coalesce("payload_bytes", "size")).drop("size")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them.

    A null html is an empty payload; rows of one page_id are written each; texts of
    any length are one record.  A quarantined gap in archives just written is an
    error, so no page can be missing from the result unnoticed.
    """
    folder = new_path(spark, "warc")
    paths = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = materialize(read_archives(spark, paths, with_block=False), "records")
    bad = found.filter(F.col("gap").isNotNull()).first()
    if bad:
        raise RuntimeError(f"{bad['path']}, from byte {bad['offset']}, {bad['length']} bytes: {bad['gap']}")
    return followed(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, d AS payload_digest, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to
FROM q
"""
