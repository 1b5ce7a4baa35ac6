"""Content types, media kinds, statuses and probe results as columns; signatures of file formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimark.schemas import STREAM

_PROBED = "struct<format: struct<format_name: string, duration: string, bit_rate: string>, streams: array<struct<index: bigint, codec_type: string, codec_name: string, width: bigint, height: bigint, sample_rate: string, channels: bigint>>>"

# Published signatures (offset, bytes, content type); the first that fits holds.
SIGNATURES = (
    (0, b"\x89PNG\r\n\x1a\n", "image/png"),
    (0, b"\xff\xd8\xff", "image/jpeg"),
    (0, b"GIF8", "image/gif"),
    (8, b"WEBP", "image/webp"),
    (0, b"BM", "image/bmp"),
    (0, b"II*\x00", "image/tiff"),
    (0, b"MM\x00*", "image/tiff"),
    (0, b"\x00\x00\x01\x00", "image/vnd.microsoft.icon"),
    (4, b"ftypheic", "image/heif"),
    (4, b"ftypavif", "image/avif"),
    (4, b"ftypqt", "video/quicktime"),
    (4, b"ftypM4A", "audio/m4a"),
    (4, b"ftypM4V", "video/x-m4v"),
    (4, b"ftyp", "video/mp4"),
    (0, b"\x1aE\xdf\xa3", "video/x-matroska"),
    (8, b"AVI ", "video/x-msvideo"),
    (0, b"FLV\x01", "video/x-flv"),
    (0, b"\x00\x00\x01\xba", "video/mpeg"),
    (0, b"ID3", "audio/mpeg"),
    (0, b"\xff\xfb", "audio/mpeg"),
    (0, b"fLaC", "audio/x-flac"),
    (0, b"OggS", "audio/ogg"),
    (8, b"WAVE", "audio/x-wav"),
    (0, b"#!AMR", "audio/amr"),
    (0, b"%PDF", "application/pdf"),
    (0, b"PK\x03\x04", "application/zip"),
    (0, b"\x1f\x8b", "application/gzip"),
    (0, b"BZh", "application/x-bzip2"),
    (0, b"\xfd7zXZ\x00", "application/x-xz"),
    (0, b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"),
    (0, b"\x28\xb5\x2f\xfd", "application/zstd"),
    (0, b"Rar!\x1a\x07", "application/vnd.rar"),
    (257, b"ustar", "application/x-tar"),
    (0, b"\x7fELF", "application/x-executable"),
    (0, b"SQLite format 3\x00", "application/vnd.sqlite3"),
    (0, b"{\\rtf", "application/rtf"),
)
#: Bytes of a file that are looked at.
SNIFFED = 8192


def sniff(prefix: bytes) -> str | None:
    """The content type of a file's first bytes; None if no signature fits."""
    for at, mark, kind in SIGNATURES:
        if prefix[at : at + len(mark)] == mark:
            return kind
    return None


def sniffed(content: Column) -> Column:
    """As ``sniff``, for content in a binary column."""
    out = F.lit(None).cast("string")
    for at, mark, kind in reversed(SIGNATURES):
        out = F.when(F.substring(content, at + 1, len(mark)) == F.lit(mark), kind).otherwise(out)
    return out


def kind_of(content_type: str | None) -> str:
    top, slash, _ = (content_type or "").partition("/")
    return "unknown" if not slash else top if top in ("image", "video", "audio") else "other"


def media_kind(content_type: Column) -> Column:
    """image, video or audio by the part before the first slash, other, or unknown without one."""
    top = F.split_part(content_type, F.lit("/"), F.lit(1))
    return F.when(content_type.isNull() | ~content_type.contains("/"), "unknown").when(top.isin("image", "video", "audio"), top).otherwise("other")


def status(kind: Column) -> Column:
    return F.when(kind.isin("unknown", "other"), "unsupported").otherwise("analyzed")


def wants_probe(kind: Column, probing: bool, tool: bool) -> Column:
    return F.lit(probing and tool) & kind.isin("image", "video", "audio")


def probe_warning(status_column: Column, probing: bool, tool: bool) -> Column:
    return F.when(F.lit(probing and not tool) & (status_column != "unsupported"), "no ffprobe: the streams of this file stay undescribed")


def lenient_long(text: Column) -> Column:
    """Text of an unsigned whole number, else null."""
    return F.when(text.rlike(r"^\+?[0-9]+$"), text).try_cast("bigint")


def probe_descriptor(text: Column) -> Column:
    """The media struct of a probe's JSON output; numbers given as text are parsed leniently."""
    got = F.from_json(text, _PROBED)
    streams = F.transform(
        F.coalesce(got["streams"], F.array().cast("array<struct<index: bigint, codec_type: string, codec_name: string, width: bigint, height: bigint, sample_rate: string, channels: bigint>>")),
        lambda s: F.struct(
            s["index"].alias("index"), s["codec_type"].alias("codec_type"), s["codec_name"].alias("codec_name"), s["width"].alias("width"), s["height"].alias("height"), lenient_long(s["sample_rate"]).alias("sample_rate"), s["channels"].alias("channels")
        ),
    ).cast(f"array<{STREAM}>")
    return F.when(
        got.isNotNull(),
        F.struct(got["format"]["format_name"].alias("format_name"), got["format"]["duration"].try_cast("double").alias("duration_seconds"), lenient_long(got["format"]["bit_rate"]).alias("bit_rate"), streams.alias("streams")),
    )
