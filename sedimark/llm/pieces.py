"""SentencePiece encoding and decoding over a relational lattice.

The rows of the lattice are made batch by batch: a text is cut into words (a run of spaces and what
follows it, up to the next space or line feed); the distinct words not met before are exploded into
their substrings of bounded length; these are equi-joined to the piece table by fingerprint; the
matches are the edges (word, start, length, piece), and a fold over each word's edges picks its pieces.

A unigram model folds Viterbi: the best path by the sum of piece scores.  A BPE model, such as the
public 32k one, doesn't take the best path but merges the best-scored adjacent pair again and again, so
its fold is over merges, on the same edges.  Characters without a piece become their UTF-8 byte pieces.
A piece never holds a space after another character, nor a line feed (checked when a model is loaded),
so words can be encoded apart from each other, and each distinct one once for each worker.  A model whose
normalizer does more than put a space in front, or with pieces of the user's own, is refused.

``lattice_fold`` (merges) and ``lattice_viterbi`` (best paths) are the same in Spark alone: explode, broadcast
join to the piece table, group by word, fold with the higher-order function ``aggregate``.  They serve tables
of distinct words; over whole corpora their rows (tens for each word) cost more than the limits allow, see
the README.

Edge cases: null and empty texts have no ids; null ``doc_id`` and repeated rows are kept; an empty
table gives no rows; other columns are ignored.  Decoding gives back the text except that U+2581, which
stands for a space in pieces, comes back as a space, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import doc_rows, mix64

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Words that one worker remembers before it starts anew, and characters in them.
MEMO_WORDS = 600_000
MEMO_CHARS = 16 << 20
#: Words of more characters are folded alone, with a heap.
LONG = 64
#: Characters of words whose lattices are made at once.
LATTICE_CHARS = 1 << 17
_SLOTS = 1 << 22
_NO = np.iinfo(np.int32).min


def _fields(raw: bytes):
    """(field number, value) of a protocol-buffer message; lengths and varints only."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + n]
            at += n


class Pieces:
    """The piece table of a model: text, score and id of its ordinary pieces, and the byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        trainer = next((v for k, v in _fields(raw) if k == 2), b"")
        normalizer = dict(_fields(next((v for k, v in _fields(raw) if k == 3), b"")))
        # fixed values: field numbers and defaults of the model format's normalizer, trainer and pieces
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or dict(_fields(trainer)).get(24):
            raise ValueError("the model's normalizer changes texts")
        if any(dict(_fields(v)).get(3, 1) == 4 for k, v in _fields(raw) if k == 1):
            raise ValueError("the model has pieces of the user's own")
        self.kind = next((v for k, v in _fields(trainer) if k == 3), UNIGRAM)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a lattice of pieces")
        ordinary = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.ids = np.array(ordinary, np.int32)
        self.scores = np.array([sp.get_score(i) for i in ordinary], np.float64)
        self.unknown = sp.unk_id()
        self.byte = np.full(256, self.unknown, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(self.text[i][3:5], 16)] = i
        if self.byte.min() == self.unknown and self.unknown in self.byte:
            raise ValueError("the model has no byte fallback")
        names = [self.text[i] for i in ordinary]
        if any("\n" in x or SPACE in x.lstrip(SPACE) for x in names):
            raise ValueError("pieces cross words")
        self.longest = max(map(len, names))
        self.index = {x: i for i, x in enumerate(names)}
        flat = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in names])
        prints = _Sums(flat)
        self.prints = prints.of(np.concatenate([[0], ends[:-1]]), ends)
        self.slots = np.full(_SLOTS, -1, np.int32)
        low = (self.prints & np.uint64(_SLOTS - 1)).astype(np.int64)
        self.slots[low] = np.arange(len(low))
        # pieces whose slot another one took are found in a short sorted list
        lost = np.flatnonzero(self.slots[low] != np.arange(len(low)))
        self.spare = lost[np.argsort(self.prints[lost])]
        self.spare_prints = self.prints[self.spare]
        # a piece's rank: greater is better
        self.rank = np.empty(len(names), np.int32)
        _, same = np.unique(self.scores, return_inverse=True)
        self.rank[:] = same
        self.bytes = [b""] * n
        for i in ordinary:
            self.bytes[i] = self.text[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            self.bytes[i] = bytes([b])

    def find(self, prints: np.ndarray) -> np.ndarray:
        """The piece with each fingerprint, or -1."""
        at = self.slots[(prints & np.uint64(_SLOTS - 1)).astype(np.int64)]
        hit = at >= 0
        out = np.full(len(prints), -1, np.int32)
        where = np.flatnonzero(hit)
        right = self.prints[at[where]] == prints[where]
        out[where[right]] = at[where[right]]
        if len(self.spare):
            left = where[~right]
            k = np.minimum(np.searchsorted(self.spare_prints, prints[left]), len(self.spare) - 1)
            ok = self.spare_prints[k] == prints[left]
            out[left[ok]] = self.spare[k[ok]]
        return out


class _Sums:
    """Fingerprints of substrings of code points, from prefix sums modulo 2**64."""

    base = 0x9E3779B97F4A7C15

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up = np.full(n + 1, self.base, np.uint64)
        down = np.full(n + 1, pow(self.base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(0x51ED27)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def edges(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece by (character, length - 1), -1 for none; where each word starts and the last ends)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    sums = _Sums(flat)
    out = np.full((len(flat), pieces.longest), -1, np.int32)
    start = np.arange(len(flat))
    for size in range(1, pieces.longest + 1):
        start = start[start + size <= ends[start]]
        out[start, size - 1] = pieces.find(sums.of(start, start + size))
    return out, bounds


def fold_merges(pieces: Pieces, lattice: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BPE: start positions of the final symbols; in each word the best-ranked pair merges first.

    All words take one merge a round; ranks decide, then the leftmost pair, as in the library.
    """
    rank = np.concatenate([pieces.rank, [_NO]]).astype(np.int32)
    start = np.arange(len(lattice))
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = start + 1
    done_start = []
    while len(start):
        # the pair of each symbol with the next one of its word
        pair = np.full(len(start), _NO, np.int32)
        has = np.flatnonzero(word[1:] == word[:-1])
        size = end[has + 1] - start[has]
        fits = size <= pieces.longest
        has, size = has[fits], size[fits]
        pair[has] = rank[lattice[start[has], size - 1]]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.maximum.reduceat(pair, first)
        spread = np.diff(np.append(first, len(start)))
        live = best > _NO
        if not live.all():
            settled = np.repeat(~live, spread)
            done_start.append(start[settled])
            keep = ~settled
            start, end, word, pair = start[keep], end[keep], word[keep], pair[keep]
            best, spread = best[live], spread[live]
            if not len(start):
                break
            first = np.cumsum(spread) - spread
        hit = np.flatnonzero(pair == np.repeat(best, spread))
        owner = word[hit]
        hit = hit[np.concatenate([[True], owner[1:] != owner[:-1]])]
        end[hit] = end[hit + 1]
        keep = np.ones(len(start), np.bool_)
        keep[hit + 1] = False
        start, end, word = start[keep], end[keep], word[keep]
    return np.sort(np.concatenate(done_start)) if done_start else np.zeros(0, np.int64)


def fold_viterbi(pieces: Pieces, lattice: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Unigram: start positions of the pieces on the best path of each word (ties: the longer piece first).

    A character without a piece costs 10 below the least score, as in the library.
    """
    least = float(pieces.scores.min()) - 10
    scores = np.concatenate([pieces.scores, [-np.inf]])
    n, longest = lattice.shape
    length = np.diff(bounds)
    best = np.full(n + len(length), -np.inf)  # position p of word w at p + w: a slot for each word's end
    back = np.zeros(n + len(length), np.int64)
    slot = bounds[:-1] + np.arange(len(length))
    best[slot] = 0
    for at in range(int(length.max(initial=0))):
        live = np.flatnonzero(length > at)
        p = bounds[live] + at
        here = best[slot[live] + at]
        for size in range(longest, 0, -1):
            ok = at + size <= length[live]
            score = scores[lattice[p[ok], size - 1]]
            if size == 1:
                score = np.where(np.isneginf(score), least, score)
            total = here[ok] + score
            to = slot[live[ok]] + at + size
            more = total > best[to]
            best[to[more]], back[to[more]] = total[more], size
    mark = np.zeros(n, np.bool_)
    at, live = length.copy(), np.flatnonzero(length > 0)
    while len(live):
        at[live] -= back[slot[live] + at[live]]
        mark[bounds[live] + at[live]] = True
        live = live[at[live] > 0]
    return np.flatnonzero(mark)


def encode_words(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number for each), by their lattices."""
    lattice, bounds = edges(pieces, words)
    start = (fold_merges if pieces.kind == BPE else fold_viterbi)(pieces, lattice, bounds)
    word = np.searchsorted(bounds, start, "right") - 1
    end = np.append(start[1:], len(lattice))
    piece = lattice[start, end - start - 1]
    counts = np.ones(len(start), np.int64)
    lost = np.flatnonzero(piece < 0)
    text = "".join(words)
    fallback = [text[a:b].encode("utf-8", "surrogatepass") for a, b in zip(start[lost].tolist(), end[lost].tolist())]
    counts[lost] = [len(x) for x in fallback]
    ends = np.cumsum(counts)
    ids = np.repeat(np.concatenate([pieces.ids, [0]])[piece], counts)
    for x, e in zip(fallback, ends[lost].tolist()):
        ids[e - len(x) : e] = pieces.byte[np.frombuffer(x, np.uint8)]
    return ids, np.bincount(word, counts, len(words)).astype(np.int64)


def _long_word(pieces: Pieces, word: str) -> np.ndarray:
    """Ids of one long word; its BPE merges come from a heap, so the time stays near linear.

    Of its lattice only the edges of neighbouring symbols are looked up, as they come to stand side by side, so
    the memory is some tens of bytes a character.
    """
    if pieces.kind != BPE:
        return encode_words(pieces, [word])[0]
    n, longest, find, rank = len(word), pieces.longest, pieces.index.get, pieces.rank.tolist()
    end, before, alive = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), bytearray(b"\1") * n
    most, heap = max(rank), []
    for a in range(n - 1):
        if (piece := find(word[a : a + 2])) is not None:
            heap.append((most - rank[piece]) << 80 | a << 40 | a + 2)
    heapq.heapify(heap)
    low = (1 << 40) - 1
    while heap:
        top = heapq.heappop(heap)
        a, stop = top >> 40 & low, top & low
        b = end[a]
        if not alive[a] or b >= n or end[b] != stop:
            continue
        alive[b] = 0
        end[a] = stop
        if stop < n:
            before[stop] = a
        for x in (before[a], a):
            if x >= 0 and (y := end[x]) < n and end[y] - x <= longest and (piece := find(word[x : end[y]])) is not None:
                heapq.heappush(heap, (most - rank[piece]) << 80 | x << 40 | end[y])
    out, a = array("i"), 0
    ids, bytes_of = pieces.ids.tolist(), pieces.byte.tolist()
    while a < n:
        symbol = word[a : end[a]]
        piece = find(symbol) if len(symbol) <= longest else None
        out.extend([ids[piece]] if piece is not None else [bytes_of[x] for x in symbol.encode("utf-8", "surrogatepass")])
        a = end[a]
    return np.frombuffer(out, np.int32) if len(out) else np.zeros(0, np.int32)


class _Numbered(dict):
    """Numbers words as they are first looked up."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    """Ids of whole texts; each distinct word goes through its lattice once."""

    split = re.compile(r" *[^ \n]+|\n| +").findall

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        sizes = [len(x) for x in self.pieces.bytes]
        self.piece_ends = np.cumsum(sizes)
        self.piece_sizes = np.array(sizes)
        self.piece_bytes = np.frombuffer(b"".join(self.pieces.bytes), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = _Numbered()
        self.ids, self.used, self.n, self.chars = np.zeros(1 << 16, np.int32), 0, 0, 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self) -> None:
        words, self.known.fresh = self.known.fresh, []
        self.chars += sum(map(len, words))
        marked = [w.replace(" ", SPACE) for w in words]
        some, size = [], 0
        for i, w in enumerate(marked):
            if len(w) > LONG:
                if some:
                    self._add(*encode_words(self.pieces, some))
                    some, size = [], 0
                ids = _long_word(self.pieces, w)
                self._add(ids, np.array([len(ids)]))
                continue
            some.append(w)
            size += len(w)
            if size >= LATTICE_CHARS:
                self._add(*encode_words(self.pieces, some))
                some, size = [], 0
        if some:
            self._add(*encode_words(self.pieces, some))

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        m = len(counts)
        while len(self.starts) < self.n + m:
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[self.n : self.n + m] = counts
        self.starts[self.n : self.n + m] = self.used + np.cumsum(counts) - counts
        self.n += m
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if self.n > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.forget()
        words = [self.split(" " + x.replace(SPACE, " ")) if x else [] for x in texts]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
        if self.known.fresh:
            self._learn()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        id_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        return ids, np.diff(id_ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, where each starts and the last ends)."""
        sizes = self.piece_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.piece_bytes[np.repeat(self.piece_ends[ids] - ends, sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        # the space before the first word isn't part of the text
        drop = np.zeros(len(raw) + 1, np.bool_)
        drop[bounds[:-1][counts > 0]] = True
        drop = drop[:-1]
        return raw[~drop], bounds - np.concatenate([[0], np.cumsum(drop)])[bounds]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_GROUP = 256


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) of every whole text."""

    def work(batches):
        own = encoder(model)
        for batch in batches:
            for first in range(0, batch.num_rows, _GROUP):
                some = batch.slice(first, _GROUP)
                ids, counts = own.encode([x or "" for x in some.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counts), lists], names=["doc_id", "n_tokens", "ids"])

    return doc_rows(docs).mapInArrow(work, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text (binary UTF-8) from doc_id and ids."""

    def work(batches):
        own = encoder(model)
        for batch in batches:
            lists = batch.column("ids")
            counts = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            raw, bounds = own.decode(lists.flatten().to_numpy(), counts)
            pieces = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pieces], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text binary")


REPORT = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string"


def encoding_report(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, crc32 of the ids (little-endian, 32 bits), digest of the decoded text.

    ``with_ids`` adds the ids themselves.
    """

    def work(batches):
        own = encoder(model)
        for batch in batches:
            for first in range(0, batch.num_rows, _GROUP):
                some = batch.slice(first, _GROUP)
                ids, counts = own.encode([x or "" for x in some.column("text").to_pylist()])
                raw, bounds = own.decode(ids, counts)
                cuts, raw, bounds = np.concatenate([[0], np.cumsum(counts)]), memoryview(raw), bounds.tolist()
                plain = ids.astype("<u4")
                columns = {
                    "doc_id": some.column("doc_id"),
                    "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array([zlib.crc32(plain[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.int64()),
                    "decoded_sha256": pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)

    return doc_rows(docs).mapInArrow(work, REPORT + (", ids array<int>" if with_ids else ""))


def piece_table(spark, model: str) -> DataFrame:
    """The ordinary pieces as a table: piece, id, rank (greater is better), score; as many rows as pieces."""
    own = Pieces(model)
    rows = [(own.text[i], i, int(r), float(x)) for i, r, x in zip(own.ids.tolist(), own.rank.tolist(), own.scores.tolist())]
    return spark.createDataFrame(rows, "piece string, id int, rank int, score double")


def _lattice(words: DataFrame, pieces: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(distinct words, edges: word, start, length, rank, score) from the equi-join of substrings with pieces.

    The piece table is broadcast: it has a fixed number of rows, the vocabulary.
    """
    one = words.select("word").where("word is not null and word <> ''").distinct()
    size = F.length("word")
    starts = one.select("word", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    cuts = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("start") + 1))).alias("length"))
    parts = cuts.select("word", "start", "length", F.col("word").substr(F.col("start"), F.col("length")).alias("piece"))
    return one, parts.join(F.broadcast(pieces), "piece").select("word", "start", "length", "rank", "score")


_SYMBOLS = "transform(sequence(1, size(bounds) - 1), i -> substring(word, bounds[i - 1], bounds[i] - bounds[i - 1]))"


def lattice_fold(words: DataFrame, pieces: DataFrame, longest: int = 16) -> DataFrame:
    """(word, symbols) for a table of distinct words, in Spark alone: BPE merges over the lattice.

    ``symbols`` are the final strings; those without a piece are single characters.  Null and empty words are
    left out, repeated ones are one.
    """
    one, found = _lattice(words, pieces, longest)
    name = F.concat_ws(":", "start", (F.col("start") + F.col("length")).cast("string"))
    graph = found.where("length > 1").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(name, "rank"))).alias("edges"))
    merge = """
      aggregate(sequence(1, length(word)), bounds, (b, k) -> aggregate(
        array(aggregate(sequence(1, greatest(size(b) - 2, 1)), struct(-1 as at, cast(null as int) as rank),
          (best, i) -> if(i > size(b) - 2 or element_at(edges, concat_ws(':', b[i - 1], b[i + 1])) is null
                          or (best.rank is not null and element_at(edges, concat_ws(':', b[i - 1], b[i + 1])) <= best.rank),
                          best, struct(i as at, element_at(edges, concat_ws(':', b[i - 1], b[i + 1])) as rank)))),
        b, (x, top) -> if(top.at < 0, x, filter(x, (v, j) -> j <> top.at))))
    """
    folded = one.join(graph, "word", "left").withColumn("bounds", F.sequence(F.lit(1), F.length("word") + 1))
    folded = folded.withColumn("bounds", F.when(F.col("edges").isNull(), F.col("bounds")).otherwise(F.expr(merge)))
    return folded.select("word", F.expr(_SYMBOLS).alias("symbols"))


def lattice_viterbi(words: DataFrame, pieces: DataFrame, longest: int = 16) -> DataFrame:
    """(word, symbols, score) for a table of distinct words, in Spark alone: the best path through the lattice.

    The fold goes over the ends of the word; its state has the best score up to each end and the length of the
    piece that reaches it (of equally good ones the longer).  A character without a piece costs 10 below the
    least score.  Null and empty words are left out, repeated ones are one.
    """
    one, found = _lattice(words, pieces, longest)
    ends = found.groupBy("word", (F.col("start") + F.col("length") - 1).alias("end")).agg(F.collect_list(F.struct("start", "length", "score")).alias("some"))
    graph = ends.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("end", "some"))).alias("edges"))
    least = pieces.agg(F.min("score") - 10).first()[0]
    best = """
      aggregate(sequence(1, length(word)), array(struct(cast(0 as double) as score, 0 as length)), (b, p) -> concat(b, array(array_max(concat(
        transform(coalesce(edges[p], cast(array() as array<struct<start: int, length: int, score: double>>)),
                  e -> struct(b[e.start - 1].score + e.score as score, e.length as length)),
        if(exists(coalesce(edges[p], cast(array() as array<struct<start: int, length: int, score: double>>)), e -> e.length = 1),
           cast(array() as array<struct<score: double, length: int>>), array(struct(b[p - 1].score + least as score, 1 as length))))))))
    """
    back = """
      aggregate(sequence(1, length(word)), array(length(word) + 1),
        (x, k) -> if(x[0] = 1, x, concat(array(x[0] - best[x[0] - 1].length), x)))
    """
    held = one.join(graph, "word", "left").withColumn("least", F.lit(least)).withColumn("best", F.expr(best)).withColumn("bounds", F.expr(back))
    return held.select("word", F.expr(_SYMBOLS).alias("symbols"), F.expr("best[length(word)].score").alias("score"))
