"""Media columns: texts stored as images in archives, read back by a custom Spark data source.

A document's payload is its UTF-8 bytes, filled with spaces (32) to a positive multiple of 192.  It is
kept losslessly as an 8-bit greyscale PNG, 192 samples a row; equal texts give equal PNGs.  PNGs are
members of ZIP archives.  ``ArchiveSource`` plans byte ranges of whole members from the directory of every
archive, whatever its size, and compares the number of members with the manifest's.  A range's task takes
the offsets, sizes and CRCs of its members from the directory and streams them through Arrow; a member that
doesn't pass its CRC, or whose read fails, is read again by its own offset, without its neighbours.  A local
header is only used to find where the data begins, and if it is damaged, the directory's names do.

Edge cases: null text is empty (one row of 192 spaces); null ``doc_id`` and repeated rows are kept, one
member each; an empty table writes no archive and gives no rows; other columns are ignored.  A member whose
data stays damaged after all attempts, or an archive that lacks members, fails the read: no row is left out.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sedimark.llm.common import cut, doc_rows, filesystem, scratch_path

ROW = 192
#: Payload bytes of one archive, about.
ARCHIVE_BYTES = 32 << 20
#: Members of one archive at most, so that its directory has the plain form.
MOST_MEMBERS = 60_000
#: Stored bytes of one read partition, about.
RANGE_BYTES = 4 << 20
#: Directories that are read at once while ranges are planned.
PLANNERS = 16
ATTEMPTS = 3
_PNG = b"\x89PNG\r\n\x1a\n"
_LOCAL = struct.Struct("<4sHHHHHIIIHH")
_ENTRY = struct.Struct("<4sHHHHHHIIIHHHHHII")
_END = struct.Struct("<4sHHHHIIH")
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEMBERS = "name string, offset long, media binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(text: bytes) -> bytes:
    """The PNG of a text: payload as samples, the unpadded length in a text chunk."""
    rows = max(1, -(-len(text) // ROW))
    grid = np.full((rows, ROW + 1), 32, np.uint8)
    grid[:, 0] = 0  # no filter
    samples = np.full(rows * ROW, 32, np.uint8)
    samples[: len(text)] = np.frombuffer(text, np.uint8)
    grid[:, 1:] = samples.reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(grid.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[int, np.ndarray]:
    """(unpadded length, samples by row); raises ValueError on damage."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, parts = 8, {}
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    width, rows = struct.unpack_from(">II", parts[b"IHDR"])
    grid = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(rows, width + 1)
    if grid[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return int(parts[b"tEXt"].partition(b"\0")[2]), grid[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Rows, mean, and a 64-bit average hash over an 8 x 8 grid of block means, as text."""
    rows, width = samples.shape
    bounds = (np.arange(8) * rows) // 8
    sums = samples.reshape(rows, 8, width // 8).sum(axis=2, dtype=np.int64)
    sizes = np.maximum(np.diff(np.append(bounds, rows)), 1) * (width // 8)
    blocks = np.add.reduceat(sums, bounds, axis=0) * 1000 // sizes[:, None]
    bits = np.packbits((blocks > int(blocks.sum()) // 64).ravel())
    return f"{rows}:{int(samples.sum(dtype=np.int64)) * 1000 // samples.size}:{bits.tobytes().hex()}"


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Store ``docs`` as ZIP archives of PNGs under ``folder``; the manifest of committed archives.

    Each attempt of a task writes files of its own; those of lost attempts are in no manifest.
    """

    def write(batches):
        files, top = filesystem(folder)
        files.create_dir(top, recursive=True)
        members: list[tuple[str, bytes]] = []
        size = 0

        def flush():
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
                for i, (name, media) in enumerate(members):
                    z.writestr(zipfile.ZipInfo(f"{i}/{name}.png"), media)
            raw = buffer.getvalue()
            path = f"{top}/media-{uuid.uuid4().hex}.zip"
            with files.open_output_stream(path) as out:
                out.write(raw)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rpartition('/')[2]}"], "members": [len(members)], "bytes": [len(raw)]})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_buffer() if text.is_valid else b""
                members.append((str(doc_id), to_png(bytes(raw))))
                size += len(raw)
                if size >= ARCHIVE_BYTES or len(members) >= MOST_MEMBERS:
                    yield flush()
                    members, size = [], 0
        if members:
            yield flush()

    return cut(doc_rows(docs).mapInArrow(write, "path string, members long, bytes long"), "media-manifest")


class ByteRange(InputPartition):
    """Whole members of one archive: those whose local headers are from ``first`` up to ``last``."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


@dataclass(frozen=True)
class Member:
    """A directory entry of a stored member."""

    name: str
    offset: int
    size: int
    crc: int


def _retried(work, attempts: int = ATTEMPTS):
    for attempt in range(attempts):
        try:
            return work()
        except (OSError, ValueError, struct.error):
            if attempt + 1 == attempts:
                raise
            time.sleep(0.1 * 2**attempt)


def directory(opened) -> tuple[list[Member], int]:
    """(members in the order of their offsets, where the directory begins) of an archive written here."""
    size = opened.size()
    end = opened.read_at(_END.size, size - _END.size)
    magic, _, _, _, count, n_bytes, start, _ = _END.unpack(end)
    if magic != b"PK\5\6" or start + n_bytes + _END.size != size:
        raise ValueError("no archive directory")
    raw, at, out = opened.read_at(n_bytes, start), 0, []
    while at < n_bytes:
        magic, _, _, _, method, _, _, crc, stored, full, n, extra, comment, _, _, _, offset = _ENTRY.unpack_from(raw, at)
        if magic != b"PK\1\2" or method != 0 or stored != full:
            raise ValueError("no stored member")
        out.append(Member(raw[at + _ENTRY.size : at + _ENTRY.size + n].decode(), offset, stored, crc))
        at += _ENTRY.size + n + extra + comment
    if len(out) != count:
        raise ValueError("the directory is cut short")
    return sorted(out, key=lambda m: m.offset), start


def member_at(read_at, member: Member) -> bytes:
    """The bytes of a member; ``read_at(size, offset)`` reads the archive or a block of it."""
    head = read_at(_LOCAL.size, member.offset)
    skip = len(member.name.encode())
    if head[:4] == b"PK\3\4":
        *_, n, extra = _LOCAL.unpack(head)
        skip = n + extra
    media = read_at(member.size, member.offset + _LOCAL.size + skip)
    if zlib.crc32(media) != member.crc:
        media = read_at(member.size, member.offset + _LOCAL.size + len(member.name.encode()))
        if zlib.crc32(media) != member.crc:
            raise ValueError(f"member {member.name} is damaged")
    return media


class ArchiveReader(DataSourceReader):
    def __init__(self, archives: str, range_bytes: int):
        self.archives, self.range_bytes = archives, range_bytes

    def _ranges(self, listed: tuple[str, int]) -> list[ByteRange]:
        path, count = listed

        def read():
            files, at = filesystem(path)
            with files.open_input_file(at) as f:
                return directory(f)

        members, end = _retried(read)
        if len(members) != count:
            raise ValueError(f"{path} has {len(members)} members, its manifest {count}")
        out, first = [], 0
        for start in [*(m.offset for m in members[1:]), end]:
            if start - first >= self.range_bytes or start == end and start > first:
                out.append(ByteRange(path, first, start))
                first = start
        return out

    def partitions(self):
        """Byte ranges from the directory of each archive in the list."""
        files, at = filesystem(self.archives)
        with files.open_input_stream(at) as f:
            listed = [tuple(json.loads(line)) for line in f.read().splitlines()]
        with ThreadPoolExecutor(PLANNERS) as pool:
            out = [r for some in pool.map(self._ranges, listed) for r in some]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        if not partition.path:
            return
        files, at = filesystem(partition.path)
        rows, size = [], 0

        def block():
            with files.open_input_file(at) as f:
                return directory(f)[0], f.read_at(partition.last - partition.first, partition.first)

        members, held = _retried(block)

        def from_block(n: int, offset: int) -> bytes:
            return held[offset - partition.first : offset - partition.first + n]

        def alone(member: Member) -> bytes:
            with files.open_input_file(at) as f:
                return member_at(lambda n, offset: f.read_at(n, offset), member)

        for member in members:
            if not partition.first <= member.offset < partition.last:
                continue
            try:
                media = member_at(from_block, member)
            except (OSError, ValueError, struct.error):
                media = _retried(lambda: alone(member))  # noqa: B023
            rows.append((member.name, member.offset, media))
            size += len(media)
            if size >= 4 << 20:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        names, offsets, media = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], names=["name", "offset", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive")``: members of the archives that the file in option ``archives`` lists.

    The list has a JSON line [path, members] for each archive; ``range_bytes`` is the size of a partition.
    """

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return MEMBERS

    def reader(self, schema):
        return ArchiveReader(self.options["archives"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members of the manifest's archives; the driver streams one line for each archive (32 MB) to a list."""
    spark.dataSource.register(ArchiveSource)
    listed = f"{scratch_path(spark, 'media-list')}/archives.jsonl"
    files, at = filesystem(listed)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    with files.open_output_stream(at) as out:
        for r in manifest.select("path", "members").toLocalIterator():
            out.write(json.dumps([r.path, r.members]).encode() + b"\n")
    return spark.read.format("media_archive").option("archives", listed).option("range_bytes", range_bytes).load()


def describe(members: DataFrame) -> DataFrame:
    """Per member, from its stored bytes: digests, sizes and the feature."""

    def work(batches):
        for batch in batches:
            rows = []
            for name, media in zip(batch.column("name").to_pylist(), batch.column("media").to_pylist()):
                n, samples = from_png(media)
                payload = samples.tobytes()
                doc_id = name.partition("/")[2].removesuffix(".png")
                rows.append({
                    "doc_id": None if doc_id == "None" else int(doc_id), "n_bytes": n, "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
                    "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(samples),
                })
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)

    return members.mapInArrow(work, RESULT)


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "media")
    return describe(read_archives(spark, write_archives(docs, folder)))
