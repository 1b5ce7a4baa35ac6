"""Benchmark decontamination: SimHash of item-sized windows, then exact weighted similarity.

A benchmark item of n words is looked for in every window of n consecutive words of every text (words
lower-cased, split at white space).  Window and item are multisets of five-word shingles (of all n words
for shorter items); a shingle's weight is its number of occurrences.  A match has a weighted Jaccard
similarity (sum of least weights over sum of greatest) of at least 0.8.

Candidates come from 256-bit SimHashes in eight blocks of 32 bits: two fingerprints within RADIUS bits agree
in some block up to RADIUS // 8 bits, so the items whose block is that near, in any block, are all that are
within the radius.  Of unrelated fingerprints 3 % have such a block, and next to none is within the radius.
Each candidate is verified exactly.  Where all shingles of window and item are distinct, a similarity of 0.8
differs in about 39 bits of 256, spread 6; the radius of 71 is over five spreads away.  A repeated shingle can
outvote the others, so where window or item has one, candidates come from the shingles themselves: a match
lacks at most a ninth of the window's, so it has one of any more.

Windows are fingerprinted only where they can match at all: a match needs 0.8 n of its shingles to be
shingles of some item, which one pass over the text counts.  Nothing is shuffled; items come to the
executors in blocks of a bounded size, and every block meets all texts.

Edge cases: null and empty texts match nothing; items without words, null items and null item ids are
left out; equal items each match; of equally similar windows the first is reported; null ``doc_id`` and
repeated rows are kept; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import doc_rows, mix64, slices, text_bytes
from sedimark.llm.shingles import words

SIZE = 5
SIMILARITY = 0.8
RADIUS = 71
BLOCKS = 8
#: Seeds of the 64-bit quarters of a fingerprint; the first is the shingle itself.
_QUARTERS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Items that are broadcast at once; MAX_ITEM_BYTES each at most on average.
ITEMS_AT_ONCE = 20_000
ITEM_BYTES_AT_ONCE = 32 << 20
SLICE = 1 << 19
MATCHES = "doc_id long, item_id long, start_word long, n_words long, similarity double"
_MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])


def grams(names: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` words, document bounds ignored."""
    n = max(0, len(names) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += names[k : k + n] * np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64))
    return mix64(total)


def simhash(shingle_rows: np.ndarray) -> np.ndarray:
    """SimHashes (rows x BLOCKS) of rows of shingles; each occurrence votes, so weights are counts."""
    out = []
    for seed in _QUARTERS:
        own = mix64(shingle_rows ^ seed) if seed else shingle_rows
        votes = np.unpackbits(np.ascontiguousarray(own, "<u8").view(np.uint8).reshape(*own.shape, 8), axis=2)
        out.append(np.packbits(2 * votes.sum(axis=1, dtype=np.int32) > own.shape[1], axis=1))
    return np.ascontiguousarray(np.concatenate(out, axis=1)).view("<u4")


def _repeats(shingle_rows: np.ndarray) -> np.ndarray:
    """Which rows have a shingle twice."""
    inorder = np.sort(shingle_rows, axis=1)
    return (inorder[:, 1:] == inorder[:, :-1]).any(axis=1)


def _by_shingle(shingle_rows: np.ndarray, numbers) -> dict[int, list[int]]:
    """For each shingle, those of the numbered rows that have it."""
    out = defaultdict(list)
    for i in numbers:
        for s in set(shingle_rows[i].tolist()):
            out[s].append(i)
    return dict(out)


class Items:
    """A block of items by number of words, with the blocks of their fingerprints."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.by_size: dict[int, dict] = {}
        held = defaultdict(list)
        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            names = words(raw, np.array([0, len(raw)]))[0]
            if len(names):
                held[len(names)].append((item_id, grams(names, min(SIZE, len(names)))))
        self.known: dict[int, np.ndarray] = {}
        for n, some in held.items():
            shingles = np.array([s for _, s in some])
            self.by_size[n] = {
                "ids": [i for i, _ in some],
                "weights": [Counter(s.tolist()) for _, s in some],
                "prints": simhash(shingles),
                "by_shingle": _by_shingle(shingles, range(len(some))),
                "by_shingle_repeated": _by_shingle(shingles, np.flatnonzero(_repeats(shingles)).tolist()),
            }
        for size in range(1, SIZE + 1):
            of = [s for n, some in held.items() if min(n, SIZE) == size for _, s in some]
            if of:
                self.known[size] = np.unique(np.concatenate(of))

    def candidates(self, n: int, fingerprint: np.ndarray) -> list[int]:
        """Numbers of the items of n words within RADIUS of the fingerprint, of those near in some block."""
        apart = np.bitwise_count(self.by_size[n]["prints"] ^ fingerprint)
        near = np.flatnonzero(apart.min(axis=1) <= RADIUS // BLOCKS)
        return near[apart[near].sum(axis=1, dtype=np.int64) <= RADIUS].tolist()

    def candidates_by_shingle(self, n: int, window: Counter, repeated: bool) -> set[int]:
        """Numbers of all items of n words that can match; only of those with a repeated shingle if the window has none."""
        held = self.by_size[n]["by_shingle" if repeated else "by_shingle_repeated"]
        found, weight = set(), 0
        if held:
            for s in sorted(window, key=lambda s: len(held.get(s, ()))):
                found.update(held.get(s, ()))
                weight += window[s]
                if 9 * weight > window.total():
                    break
        return found


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return both / (a.total() + b.total() - both)


def _member(names: np.ndarray, known: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which fingerprints are in the sorted ``known``; ``table`` marks their low 20 bits."""
    out = np.zeros(len(names), np.bool_)
    maybe = np.flatnonzero(table[(names & np.uint64(0xFFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, names[maybe]), len(known) - 1)
    out[maybe[known[at] == names[maybe]]] = True
    return out


def _search(items: Items):
    """(document, item id, start word, n, similarity) of the best window of each item and document."""
    tables = {}
    for size, known in items.known.items():
        tables[size] = np.zeros(1 << 20, np.bool_)
        tables[size][(known & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def search(raw: np.ndarray, offsets: np.ndarray):
        names, doc, _, _ = words(raw, offsets)
        counts = np.bincount(doc, minlength=len(offsets) - 1)
        ends = np.cumsum(counts)
        for size, known in items.known.items():
            found = grams(names, size)
            hit = _member(found, known, tables[size])
            hit &= doc[: len(found)] == doc[size - 1 :]
            for d in np.unique(doc[: len(found)][hit]).tolist():
                a, b = int(ends[d] - counts[d]), int(ends[d]) - size + 1
                own, hits = found[a:b], np.concatenate([[0], np.cumsum(hit[a:b])])
                best: dict[int, tuple[float, int, int]] = {}
                for n, block in items.by_size.items():
                    m = n - size + 1
                    if min(n, SIZE) != size or m > len(own):
                        continue
                    starts = np.flatnonzero(hits[m:] - hits[:-m] >= SIMILARITY * m)
                    for part in np.array_split(starts, max(1, len(starts) * m // 50_000)):
                        if not len(part):
                            continue
                        rows = own[part[:, None] + np.arange(m)]
                        for start, row, fingerprint, repeated in zip(part.tolist(), rows, simhash(rows), _repeats(rows).tolist()):
                            some = items.candidates(n, fingerprint)
                            if repeated or block["by_shingle_repeated"]:
                                some = sorted(items.candidates_by_shingle(n, Counter(row.tolist()), repeated).union(some))
                            for i in some:
                                near = similarity(block["weights"][i], Counter(row.tolist()))
                                if near >= SIMILARITY and near > best.get((n, i), (0.0,))[0]:
                                    best[n, i] = (near, start, n)
                for (n, i), (near, start, _) in best.items():
                    yield d, items.by_size[n]["ids"][i], start, n, near

    return search


def item_blocks(benchmark: DataFrame):
    """Lists of (item_id, text), each of a bounded number of items and bytes, that make up the table."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // ITEMS_AT_ONCE), -(-size // ITEM_BYTES_AT_ONCE))
    for k in range(blocks):
        yield sorted(tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect())


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each contaminated pair."""
    spark = docs.sparkSession
    rows = doc_rows(docs)

    def over(block):
        shared = spark.sparkContext.broadcast(block)

        def work(batches):
            search = _search(Items(shared.value))
            for batch in batches:
                raw, offsets = text_bytes(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                out = []
                for first, last in slices(offsets, SLICE):
                    found = search(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                    out += [(ids[first + d], item, start, n, near) for d, item, start, n, near in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MATCHES)], schema=_MATCHES)

        return rows.mapInArrow(work, MATCHES)

    found = None
    for block in item_blocks(benchmark):
        one = over(block)
        found = one if found is None else found.union(one)
    return spark.createDataFrame([], MATCHES) if found is None else found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that match an item; nothing is shuffled."""
    spark = docs.sparkSession

    def less(rows, block):
        shared = spark.sparkContext.broadcast(block)

        def work(batches):
            search = _search(Items(shared.value))
            for batch in batches:
                raw, offsets = text_bytes(batch.column("text"))
                keep = np.ones(batch.num_rows, np.bool_)
                for first, last in slices(offsets, SLICE):
                    for d, *_ in search(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]):
                        keep[first + d] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(work, docs.schema)

    for block in item_blocks(benchmark):
        docs = less(docs, block)
    return docs


#: The same by definition: every window that shares a shingle with an item, compared exactly.
MATCHES_SQL = """
with doc_words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
item_words as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from benchmark where item_id is not null and text is not null),
items as (select item_id, w, len(w) as n, least(5, len(w)) as k from item_words where len(w) > 0),
item_grams as (select item_id, n, k, array_to_string(w[p:p + k - 1], ' ') as g, count(*) as weight from (select *, unnest(generate_series(1, n - k + 1)) as p from items) group by all),
doc_grams as (select doc_id, len(w) as n_words, k, p, array_to_string(w[p:p + k - 1], ' ') as g from (select d.*, s.k, unnest(generate_series(1, len(d.w) - s.k + 1)) as p from doc_words d, (select distinct k from items) s where len(d.w) >= s.k)),
hits as (select doc_id, item_id, n, i.k, n_words, p from doc_grams d join item_grams i on i.g = d.g and i.k = d.k),
starts as (select distinct doc_id, item_id, n, k, s from (select *, unnest(generate_series(greatest(1, p - n + k), least(p, n_words - n + 1))) as s from hits)),
counted as (select t.doc_id, t.item_id, t.s, t.n, t.k, d.g, count(*) as weight from starts t join doc_grams d on d.doc_id = t.doc_id and d.k = t.k and d.p between t.s and t.s + t.n - t.k group by all),
near as (select c.doc_id, c.item_id, c.s, c.n, c.k, cast(sum(least(c.weight, i.weight)) as double) as shared from counted c join item_grams i on i.item_id = c.item_id and i.g = c.g group by all),
scored as (select doc_id, item_id, s - 1 as start_word, n as n_words, shared / (2 * (n - k + 1) - shared) as similarity from near)
select * from scored where similarity >= 0.8 qualify row_number() over (partition by doc_id, item_id order by similarity desc, start_word) = 1
"""
