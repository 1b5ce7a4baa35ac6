import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimark.functions import blake3, media, paths

# Published test vectors, of bytes 0..250 repeated, by length.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    5121: "628bd2cb2004694adaab7bbd778a25df25c47b9d4155a55f8fbd79f2fe154cff",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
}


def pattern(n):
    return bytes(i % 251 for i in range(n))


def test_blake3_vectors():
    assert blake3.hash_many([pattern(n) for n in VECTORS]) == list(VECTORS.values())


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 9000), st.integers(1, 4000))
def test_blake3_in_pieces(n, step):
    whole = pattern(n)
    digest = blake3.Hasher()
    for at in range(0, n, step):
        digest.update(whole[at : at + step])
    assert digest.hexdigest() == blake3.hash_one(whole)


def test_blake3_column(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, t string")
    got = dict(rows.select("id", blake3.blake3_udf()("t")).collect())
    assert got == {1: blake3.hash_one(b"abc"), 2: None, 3: VECTORS[0]}


def test_paths_round_trip(spark):
    raws = [b"/a", b"/tmp/\xff\xfe/file.bin", b"/data/\x80\x81\x82/media.mkv", "/ü/é".encode(), bytes(range(1, 256)), b"x" * 200 + b"\xff"]
    rows = spark.createDataFrame([(bytearray(r),) for r in raws], "raw binary").select("raw", paths.native_path(F.col("raw")).alias("p"))
    for r in rows.select("raw", "p", paths.path_bytes(F.col("p")).alias("back"), paths.path_key(F.col("p")).alias("key")).collect():
        native = paths.from_bytes(bytes(r.raw))
        assert bytes(r.back) == bytes(r.raw) == paths.to_bytes(native)
        assert r.p.asDict() == native and r.key == paths.key_of(native)


def test_other_encodings_sort_first(spark):
    keys = [paths.key_of(paths.from_bytes(b)) for b in (b"/b", b"/a", b"\x7e\x8a\x2f")]
    assert sorted(keys)[1:] == ["/a", "/b"]


def test_base64(spark):
    raws = [b"", b"f", b"fo", b"foo", b"foob", b"fooba", b"foobar", bytes(range(256))]
    got = spark.createDataFrame([(bytearray(r),) for r in raws], "r binary").select("r", paths.base64_text(F.col("r")).alias("t")).collect()
    assert all(x.t == base64.b64encode(bytes(x.r)).decode() for x in got)
    lenient = spark.createDataFrame([("Zm 9v\n",)], "t string").select(paths.base64_bytes(F.col("t"))).first()[0]
    assert bytes(lenient) == b"foo"


def test_display_escapes():
    assert paths.display(paths.from_bytes(b"/tmp/line\n\x1b[31m.txt")) == "/tmp/line\\n\\u{1b}[31m.txt"
    assert paths.display(paths.from_bytes(b"/plain's")) == "/plain's"


def test_components_and_hidden(spark):
    row = spark.createDataFrame([("/r/./a//b",)], "p string").select(paths.components(F.col("p")).alias("c"), paths.is_within(F.col("p"), F.lit("/r/a")).alias("w"), paths.is_within(F.lit("/r/ab"), F.lit("/r/a")).alias("n"), paths.strip_root(F.col("p"), F.lit("/r")).alias("s")).first()
    assert (row.c, row.w, row.n, row.s) == (["", "r", "a", "b"], True, False, "a/b")


@pytest.mark.parametrize("content_type, kind", [("image/png", "image"), ("video/mp4", "video"), ("audio/flac", "audio"), ("application/pdf", "other"), ("image", "unknown"), (None, "unknown")])
def test_media_kinds(spark, content_type, kind):
    assert media.kind_of(content_type) == kind
    assert spark.createDataFrame([(content_type,)], "c string").select(media.media_kind(F.col("c"))).first()[0] == kind


def test_sniffing(spark):
    contents = [b"\x89PNG\r\n\x1a\nrest", b"RIFF\0\0\0\0WAVEfmt ", b"\0\0\0 ftypisom", b"plain", b""]
    got = spark.createDataFrame([(bytearray(c),) for c in contents], "c binary").select("c", media.sniffed(F.col("c")).alias("t")).collect()
    assert {bytes(r.c): r.t for r in got} == {c: media.sniff(c) for c in contents}
    assert media.sniff(contents[1]) == "audio/x-wav" and media.sniff(contents[3]) is None


def test_probe_results(spark):
    text = '{"format": {"format_name": "mp4", "duration": "1.5", "bit_rate": "N/A"}, "streams": [{"index": 0, "codec_type": "audio", "sample_rate": "44100"}]}'
    got = spark.createDataFrame([(text,), ("junk",), (None,)], "t string").select(media.probe_descriptor(F.col("t")).alias("m")).collect()
    assert got[0].m.duration_seconds == 1.5 and got[0].m.bit_rate is None and got[0].m.streams[0].sample_rate == 44100
    assert got[2].m is None
