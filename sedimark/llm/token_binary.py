"""Token-ID binary output: shards of concatenated ids with Elias-Fano document boundaries.

A shard file holds the documents of one ``doc_id`` range in ascending order::

    magic "SMTB", version u8, bytes per id u8, pad u16, nulls u64, least doc_id i64
    Elias-Fano doc ids (less the least one), Elias-Fano ends (ids up to each document's end)
    ids, little-endian

Each sequence carries its sampled select positions.  No table of 64-bit offsets is stored or made: a
document's span is answered by select on the coded ends, and ``read_shards`` walks the ends of a shard
one sampled block at a time.

Edge cases: null text is empty; every document ends with the end id, so an empty one has that id
alone; null ``doc_id`` sorts before all others; rows that repeat a ``doc_id`` stay separate, ordered by
text; an empty table gives no rows; other columns of the input are ignored.  A special token's string in
a text gets that token's id, as the library gives it.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm.common import cut, doc_rows, fan_out, filesystem, scratch_path
from sedimark.llm.elias_fano import EliasFano

_MAGIC = b"SMTB"
_HEAD = struct.Struct("<4sBBHQq")
#: Distinct pre-tokens that one worker remembers before it starts anew, and characters in them.
MEMO_WORDS = 1_000_000
MEMO_CHARS = 32 << 20
#: Characters below this have had the same classes in all Unicode versions since 5.0.
_SETTLED = 0x250
#: Text of one shard, about.
SHARD_BYTES = 16 << 20
#: Shards whose ids are summed together; the driver sees one sum for so many.
SUMMED = 1024
MANIFEST = "part long, path string, n_docs long, n_ids long"
_MANIFEST = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
BOUNDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _settled_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's split for texts of settled characters alone."""
    kind = {c: unicodedata.category(chr(c))[0] for c in range(_SETTLED)}
    escape = lambda codes: "".join(f"\\u{c:04x}" for c in codes)
    letters, numbers = (escape(c for c in kind if kind[c] == k) for k in "LN")
    space = escape([*range(9, 14), 32, 0x85, 0xA0])
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class MemoEncoder:
    """The library's ids for whole texts; each distinct pre-token is encoded once.

    Byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in
    order.  Texts with characters outside the settled range, or with a special token's string, go to the
    library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = _settled_pattern().findall
        self.settled = re.compile(f"[\\x00-\\u{_SETTLED - 1:04x}]*").fullmatch
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.forget()

    def forget(self) -> None:
        self.known = _Numbered()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.n = self.used = self.chars = 0

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pre-tokens.

        One call encodes many, a line feed between them: it is a pre-token of its own before any
        character but white space, so it never joins what stands beside it.
        """
        mark = self.line_feed
        ids = np.asarray(self.tokenizer.encode("\n".join(["", *words, "a"]), add_special_tokens=False).ids, np.uint32)
        at = np.flatnonzero(ids == mark)
        if len(at) == len(words) + 1:
            return ids[at[0] : at[-1]][ids[at[0] : at[-1]] != mark], np.diff(at) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _learn(self) -> None:
        """Ids of the words that were numbered since the last call."""
        words, self.known.fresh = self.known.fresh, []
        self.chars += sum(map(len, words))
        plain = [not w.lstrip(" ").isspace() and len(w.lstrip(" ")) > 0 for w in words]
        sizes, parts = np.zeros(len(words), np.int64), {}
        for wanted in (True, False):
            places = [i for i, x in enumerate(plain) if x is wanted]
            if not places:
                continue
            if wanted:
                flat, n = self._encode_words([words[i] for i in places])
            else:
                found = [self.tokenizer.encode(words[i], add_special_tokens=False).ids for i in places]
                n = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
            sizes[places] = n
            parts[wanted] = (np.asarray(places), flat, n)
        first = self.used + np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        while len(self.starts) < self.n + len(words):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while len(self.ids) < self.used + total:
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        for places, flat, n in parts.values():
            self.ids[np.repeat(first[places] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        self.sizes[self.n : self.n + len(words)] = sizes
        self.starts[self.n : self.n + len(words)] = first
        self.n += len(words)
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if self.n > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.forget()
        out, counts = [], np.zeros(len(texts), np.int64)
        easy = [i for i, x in enumerate(texts) if self.settled(x) and not any(t in x for t in self.added)]
        words = [self.split(texts[i]) for i in easy]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
        if self.known.fresh:
            self._learn()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        id_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        if len(easy) == len(texts):
            return ids, np.diff(id_ends)
        parts = dict(zip(easy, np.split(ids, id_ends[1:-1]))) if easy else {}
        hard = [i for i in range(len(texts)) if i not in parts]
        parts |= zip(hard, (e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False)))
        for i in range(len(texts)):
            part = np.asarray(parts[i], np.uint32)
            out.append(part)
            counts[i] = len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), counts


class _Numbered(dict):
    """Numbers words as they are first looked up; ``fresh`` has those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


_encoders: dict[str, MemoEncoder] = {}


def encoder(path: str) -> MemoEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = MemoEncoder(path)
    return _encoders[path]


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    nulls = sum(x is None for x in doc_ids)
    known = np.asarray(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    head = _HEAD.pack(_MAGIC, 2, width, 0, nulls, least)
    names = EliasFano.encode((known.astype(np.uint64) - np.uint64(least & (1 << 64) - 1)) if len(known) else known)
    ends = EliasFano.encode(np.cumsum(counts))
    return head + names.to_bytes() + ends.to_bytes() + ids.astype(f"<u{width}").tobytes()


class Shard:
    """One shard file in memory: ``doc_ids``, ``ends`` (Elias-Fano) and ``ids``."""

    def __init__(self, raw: bytes):
        magic, version, width, _, nulls, least = _HEAD.unpack_from(raw)
        if magic != _MAGIC or version != 2:
            raise ValueError("not a token shard")
        view = memoryview(raw)
        names, used = EliasFano.from_bytes(view[_HEAD.size :])
        at = _HEAD.size + used
        self.ends, used = EliasFano.from_bytes(view[at:])
        self.ids = np.frombuffer(view[at + used :], f"<u{width}")
        self.doc_ids: list[int | None] = [None] * nulls + (names.decode() + least).tolist()

    def span(self, i: int) -> tuple[int, int]:
        """Where document ``i`` starts and ends, by select."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        return self.ids[slice(*self.span(i))]


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` into shard files under ``folder``; the manifest, one row for each shard.

    Shards are in order of ``part``.  A task names its files anew at each attempt, and only files in the
    manifest count, so a lost executor or a speculative copy leaves at most files that nothing reads.  An
    id with very many rows is spread by the beginning of the text, and a task closes a shard when it is full.
    """
    order = ["doc_id", F.substring("text", 1, 8)]
    most = SHARD_BYTES
    ranged = doc_rows(docs).repartitionByRange(fan_out(docs, most), *order).sortWithinPartitions(*order, "text")

    def write(batches):
        own = encoder(vocabulary)
        files, top = filesystem(folder)
        task = TaskContext.get().partitionId() << 20
        names, ids, counts, held, shard = [], [], [], 0, 0

        def close():
            flat = np.concatenate(ids)
            files.create_dir(top, recursive=True)
            path = f"{top}/shard-{uuid.uuid4().hex}.smtb"
            with files.open_output_stream(path) as out:
                out.write(pack_shard(names, flat, np.concatenate(counts), own.width))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((task + shard, f"{folder}/{path.rpartition('/')[2]}", len(names), len(flat)), _MANIFEST)], schema=_MANIFEST)

        for batch in batches:
            for some in (batch.slice(first, 512) for first in range(0, batch.num_rows, 512)):
                got, n = own.encode([x or "" for x in some.column("text").to_pylist()])
                ids.append(np.insert(got.astype(f"<u{own.width}"), np.cumsum(n), end_id))
                counts.append(n + 1)
                names += some.column("doc_id").to_pylist()
                held += len(ids[-1])
                if held >= most:
                    yield close()
                    names, ids, counts, held, shard = [], [], [], 0, shard + 1
        if names:
            yield close()

    return cut(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def _placed(manifest: DataFrame) -> tuple[DataFrame, int]:
    """(path and number of ids before it for each shard, number of shards): sums of SUMMED shards, then inside them."""
    dense = manifest.withColumn("some", F.floor(F.col("part") / F.lit(SUMMED << 20)))
    sums = sorted(tuple(r) for r in dense.groupBy("some").agg(F.sum("n_ids"), F.count("*")).collect())
    bases, before = [], 0
    for some, n_ids, _ in sums:
        bases.append((some, before))
        before += n_ids
    base = manifest.sparkSession.createDataFrame(bases, "some long, base long")
    inside = Window.partitionBy("some").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = dense.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(base, "some")
    return placed.select("part", "path", (F.col("base") + F.col("inside")).alias("base")), sum(n for *_, n in sums)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    The driver sees one sum for every SUMMED parts of about 16 MB of text.
    """

    def read(batches):
        for batch in batches:
            for path, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base"))):
                files, at = filesystem(path)
                with files.open_input_stream(at) as f:
                    shard = Shard(f.read())
                done, before = 0, 0
                for ends in shard.ends.blocks():
                    starts = np.concatenate([[before], ends[:-1]])
                    crcs = [zlib.crc32(shard.ids[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist())]
                    names = shard.doc_ids[done : done + len(ends)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    done, before = done + len(ends), int(ends[-1])

    placed, shards = _placed(manifest)
    return placed.repartition(max(1, shards), "part").select("path", "base").mapInArrow(read, BOUNDS)


def token_binary(docs: DataFrame, vocabulary: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token shards and describe each document from the files read back."""
    folder = folder or scratch_path(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, vocabulary, folder, end_id))
