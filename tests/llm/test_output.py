"""Token files, media archives, SentencePiece: exact round trips."""

import hashlib
import json
import random
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimark.llm import media, pieces
from sedimark.llm import token_binary as token_binary_module
from sedimark.llm.elias_fano import EliasFano
from sedimark.llm.registry import tokenizer_path
from sedimark.llm.token_binary import MemoEncoder, Shard, pack_shard, read_shards, token_binary, write_shards
from tests.llm.conftest import ROUGH, ordered


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=1200))
def test_elias_fano(values):
    values = sorted(values)
    coded, used = EliasFano.from_bytes(memoryview(EliasFano.encode(np.array(values, np.uint64)).to_bytes() + b"more"))
    assert coded.decode().tolist() == values and len(values) == sum(map(len, coded.blocks()))
    assert [coded.select(i) for i in range(0, len(values), 7)] == values[::7]
    if len(values) > 100:
        assert 8 * used < len(values) * (2 + max(values).bit_length()) + 400


def expected_tokens(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    at, out = 0, []
    for doc_id, text in ordered(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("which", ["rough", "documents"])
def test_token_files_equal_the_library(request, which, rows_of):
    rows = ROUGH if which == "rough" else rows_of
    got = token_binary(request.getfixturevalue(which), tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_tokens(rows)


def test_token_files_of_nothing(nothing):
    assert token_binary(nothing, tokenizer_path("byte_bpe_50k.json")).collect() == []


def test_orphan_files_are_not_read(spark, documents, tmp_path):
    manifest = write_shards(documents, tokenizer_path("byte_bpe_50k.json"), str(tmp_path))
    (tmp_path / "shard-lost-attempt.smtb").write_bytes(b"half")
    assert read_shards(manifest).count() == documents.count()


def test_full_shards_are_closed(spark, documents, rows_of, monkeypatch, tmp_path):
    """A task with more ids than a shard holds writes several; starts go on from one to the next."""
    monkeypatch.setattr(token_binary_module, "SHARD_BYTES", 5_000)
    monkeypatch.setattr(token_binary_module, "SUMMED", 2)
    rows = documents.coalesce(1).repartitionByRange(3, "doc_id")
    manifest = write_shards(rows, tokenizer_path("byte_bpe_50k.json"), str(tmp_path))
    assert manifest.count() > 3
    assert sorted(map(tuple, read_shards(manifest).collect()), key=lambda r: r[1]) == expected_tokens(rows_of)


def test_shards_hold_documents():
    shard = Shard(pack_shard([None, 3, 9], np.array([5, 0, 0, 7, 8, 0]), np.array([2, 1, 3]), 2))
    assert shard.doc_ids == [None, 3, 9] and [shard.document(i).tolist() for i in range(3)] == [[5, 0], [0], [7, 8, 0]]


def odd_texts(n, letters):
    draw = random.Random(4)
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_memo_equals_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    own, library = MemoEncoder(tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ["", "a<|endoftext|>b", "<|endoftext|>", "  <|endoftext|> <|endoftext", " ", "it's we'll don't'", "a\tb \x1c x\xa0y", "<|endoftext|> hi", "x²y ½", "\r\n \r\nfoo", *odd_texts(800, "ab' \n\t!é1²_s.\xa0\r日")]
    ids, counts = own.encode(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, part in zip(texts, parts):
        assert part.tolist() == library.encode(text, add_special_tokens=False).ids, text


def check_media(frame, rows):
    got = media.media_columns(frame).collect()
    assert len(got) == len(rows)
    expected = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        expected.append((str(doc_id), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(expected)
    shapes = {(t or "").encode(): plain_media((t or "").encode()) for _, t in rows}
    stored = {hashlib.sha256(x).hexdigest(): (len(x), seen) for x, seen in shapes.values()}
    assert sorted((str(r.doc_id), r.media_bytes, r.media_sha256, r.feature) for r in got) == sorted(
        (str(d), stored[h][0], h, stored[h][1]) for d, t in rows for h in [hashlib.sha256(shapes[(t or "").encode()][0]).hexdigest()]
    )


def plain_media(raw):
    """(PNG, feature) of a text by plain loops."""
    payload = raw + b" " * (-len(raw) % 192 if raw else 192)
    lines = [payload[i : i + 192] for i in range(0, len(payload), 192)]

    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    head = (192).to_bytes(4, "big") + len(lines).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0" + str(len(raw)).encode())
    png += chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines), 1)) + chunk(b"IEND", b"")
    bounds = [k * len(lines) // 8 for k in range(8)] + [len(lines)]
    means = []
    for k in range(8):
        # with fewer than eight lines a band may be empty; it then shows the line where it stands
        band = lines[bounds[k] : max(bounds[k + 1], bounds[k] + 1)]
        means += [sum(sum(x[24 * c : 24 * c + 24]) for x in band) * 1000 // (24 * len(band)) for c in range(8)]
    bits = "".join(str(int(m > sum(means) // 64)) for m in means)
    return png, f"{len(lines)}:{sum(payload) * 1000 // len(payload)}:{int(bits, 2):016x}"


def test_media_round_trip(rough, documents, rows_of, nothing):
    check_media(rough, ROUGH)
    check_media(documents, rows_of)
    assert media.media_columns(nothing).collect() == []


def test_ranges_cover_every_member_once(spark, documents, tmp_path):
    manifest = media.write_archives(documents, str(tmp_path))
    for size in (1, 50_000, 1 << 30):
        names = [r.name for r in media.read_archives(spark, manifest, size).select("name").collect()]
        assert len(names) == len(set(names)) == documents.count()


def archive_of(folder, n):
    path = folder / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(n):
            z.writestr(zipfile.ZipInfo(f"{i}/{i}.png"), media.to_png(b"text %d" % i))
    (folder / "list").write_text(json.dumps([str(path), n]) + "\n")
    return path, media.ArchiveReader(str(folder / "list"), 1 << 30)


def names_of(reader, part):
    return [n for b in reader.read(part) for n in b.column("name").to_pylist()]


def test_a_damaged_member_is_read_again_alone(tmp_path, monkeypatch):
    path, reader = archive_of(tmp_path, 3)
    (part,) = reader.partitions()
    whole, calls = media.member_at, []

    def flaky(read_at, member):
        calls.append(member.offset)
        if len(calls) == 2:
            raise ValueError("damaged")
        return whole(read_at, member)

    monkeypatch.setattr(media, "member_at", flaky)
    assert names_of(reader, part) == ["0/0.png", "1/1.png", "2/2.png"]
    assert len(calls) == 4 and calls[1] == calls[2]
    with path.open("r+b") as f:
        f.seek(60)
        f.write(b"\xff\xff")
    with pytest.raises(ValueError):
        names_of(reader, part)


def test_damaged_headers_hide_no_member(tmp_path):
    """The directory names every member, so one whose local header is gone, and those after it, are read."""
    path, reader = archive_of(tmp_path, 4)
    (part,) = reader.partitions()
    with path.open("r+b") as f:
        raw = f.read()
        f.seek(raw.index(b"PK\3\4", 10))
        f.write(b"\0" * 30)
    assert names_of(reader, part) == [f"{i}/{i}.png" for i in range(4)]


def test_an_archive_that_lacks_members_is_refused(tmp_path):
    path, reader = archive_of(tmp_path, 4)
    (tmp_path / "list").write_text(json.dumps([str(path), 5]) + "\n")
    with pytest.raises(ValueError):
        reader.partitions()


def test_small_archives_are_cut_by_their_directory(tmp_path):
    _, reader = archive_of(tmp_path, 20)
    reader.range_bytes = 700
    parts = reader.partitions()
    assert len(parts) > 3 and [n for p in parts for n in names_of(reader, p)] == [f"{i}/{i}.png" for i in range(20)]


def test_pieces_equal_the_library(rows_of):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Encoder(model)
    texts = [t or "" for _, t in [*ROUGH, *rows_of]] + ["  ", " \n", "▁", "a▁b", "ab" * 900, *odd_texts(1500, "abcdeinthe' \n\t!é日.T▁")]
    ids, counts = own.encode(texts)
    raw, bounds = own.decode(ids, counts)
    for text, part, a, b in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), bounds, bounds[1:]):
        assert part.tolist() == library.encode(text), text[:80]
        assert raw[a:b].tobytes().decode() == text.replace("▁", " ")


def test_long_words_equal_the_library(rows_of):
    """Text without spaces is one word a line: its merges come from a heap, in memory in proportion to it."""
    import sentencepiece
    import tracemalloc

    model = tokenizer_path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Encoder(model)
    long = "".join(t for _, t in rows_of if t).replace(" ", "").replace("\n", "")[:200_000]
    for text in (long, "ñ日" * 20_000, "a" * 50_000):
        tracemalloc.start()
        ids, _ = own.encode([text])
        assert tracemalloc.get_traced_memory()[1] < 250 * len(text)
        tracemalloc.stop()
        assert ids.tolist() == library.encode(text)


def test_viterbi_is_the_best_path():
    """Against a plain search over all paths; ids decode to the word."""
    own = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))
    own.kind = pieces.UNIGRAM
    score = {own.text[i]: s for i, s in zip(own.ids.tolist(), own.scores.tolist())}
    least = min(score.values()) - 10

    def best(word):
        found = [(0.0, ())]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - own.longest), end):
                piece = word[start:end]
                if piece in score or end - start == 1:
                    options.append((found[start][0] + score.get(piece, least), (*found[start][1], piece)))
            found.append(max(options))
        return found[-1]

    words = ["▁" + w for w in "the quick brown fox jumps Über ñandú transformation ationth zzz 日本".split()]
    ids, counts = pieces.encode_words(own, words)
    for word, part in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        total, path = best(word)
        assert sum(score[own.text[i]] if own.text[i] in score else least for i in part) == pytest.approx(total)
        assert b"".join(own.bytes[i] for i in part).decode() == word.replace("▁", " ")


def test_the_lattice_in_spark_alone(spark):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    words = "the quick transformation ationth Über ñandú 日本 zzzz x".split()
    frame = spark.createDataFrame([(f"▁{w}",) for w in words] + [(None,), ("",), ("▁the",)], "word string")
    got = {r.word: r.symbols for r in pieces.lattice_fold(frame, pieces.piece_table(spark, model)).collect()}
    assert got == {f"▁{w}": library.encode(w, out_type=str) for w in words}


def test_viterbi_in_spark_alone(spark):
    """The fold in Spark picks the same pieces as the numpy fold, ties and characters without a piece too."""
    model = tokenizer_path("piece_bpe_32k.model")
    own = pieces.Pieces(model)
    own.kind = pieces.UNIGRAM
    words = [f"▁{w}" for w in "the quick transformation ationth Über ñandú 日本 zzzz x aaaaaaaaaaaaaaaaaaaaaa".split()]
    frame = spark.createDataFrame([(w,) for w in [*words, None, "", words[0]]], "word string")
    got = {r.word: (r.symbols, r.score) for r in pieces.lattice_viterbi(frame, pieces.piece_table(spark, model)).collect()}
    lattice, bounds = pieces.edges(own, words)
    start = pieces.fold_viterbi(own, lattice, bounds)
    assert set(got) == set(words)
    score = {own.text[i]: x for i, x in zip(own.ids.tolist(), own.scores.tolist())}
    for word, a, b in zip(words, bounds, bounds[1:]):
        cuts = [*(start[(start >= a) & (start < b)] - a).tolist(), b - a]
        symbols = [word[x:y] for x, y in zip(cuts, cuts[1:])]
        assert got[word][0] == symbols and got[word][1] == pytest.approx(sum(score.get(x, min(score.values()) - 10) for x in symbols))


def test_models_that_change_texts_are_refused(tmp_path):
    """A normalizer that drops spaces, and one that puts none in front, by a message added at the model's end."""
    raw = open(tokenizer_path("piece_bpe_32k.model"), "rb").read()
    spec = dict(pieces._fields(raw))[3]
    for field in (b"\x20\x01", b"\x18\x00"):
        changed = spec + field
        path = tmp_path / "other.model"
        path.write_bytes(raw.replace(b"\x1a" + bytes([len(spec)]) + spec, b"\x1a" + bytes([len(changed)]) + changed))
        with pytest.raises(ValueError, match="normalizer"):
            pieces.Pieces(str(path))


def test_the_memo_is_bounded_in_characters(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_CHARS", 1000)
    own = pieces.Encoder(tokenizer_path("piece_bpe_32k.model"))
    for i in range(20):
        own.encode([f"{i}" * 300])
        assert own.chars < 2000


def test_encoding_frames(rough, nothing):
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode_documents(rough, model)
    back = pieces.decode_documents(encoded, model)
    assert sorted((str(r.doc_id), bytes(r.text).decode()) for r in back.collect()) == sorted((str(d), (t or "").replace("▁", " ")) for d, t in ROUGH)
    report = pieces.encoding_report(rough, model, with_ids=True).withColumn("n", F.size("ids"))
    assert report.where("n <> n_tokens").count() == 0 and report.count() == len(ROUGH)
    assert pieces.encoding_report(nothing, model).collect() == []
