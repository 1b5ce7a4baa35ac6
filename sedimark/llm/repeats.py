"""Repeated byte strings removed, by a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller ``doc_id``, or
the same document and an earlier start).  Strings never cross documents and are judged on the input.

Suffixes are sampled by winnowing: each window of LENGTH bytes has one anchor, the least fingerprint
among its K-byte strings, so equal windows have anchors in the same place.  The windows of one anchor
are consecutive starts; the segment that they span names them all at once.  Matches below LENGTH bytes
don't count, so a suffix is ordered in the arrays by the fingerprint of what it must match, not by its
raw bytes.

Index: a bucket of keys holds a :class:`LevelFamily`.  Each part of the documents is a batch; its sorted
entries are merge-scanned against every level, the later of two equal entries is reported as removed,
and what remains becomes a level; levels of like size merge, so there are O(log n) of them.
:class:`RepeatIndex` keeps the families and the texts in a folder: documents that come later are a new
batch of entries, scanned against the levels that are there, and lose what an earlier batch has.

Two passes: whole segments first; then, for anchors whose K-byte string has several different segments,
the single windows.  A part sends an entry once however often it holds it, and sends one mark for an
anchor string that it holds with several segments: a passage in a third of all documents makes at most
one entry a part in any bucket.  Fingerprints have 96 bits between parts.

Edge cases: null or short texts lose nothing; null ``doc_id`` counts as smaller than all others; rows
that repeat a ``doc_id`` are ordered by a hash of id and text; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm.common import cut, fan_out, filesystem, mix64, release, slices, text_bytes
from sedimark.llm.parts import ANSWER, ASK, answer_batches, ask_rows, ask_table, asked, deal, each_part, ids_of, in_order, joined, pack, payloads, runs_of, split_by, take, unpack, with_answers
from sedimark.llm.prints import span_names, window_names

LENGTH = 100
K = 32
#: Bytes whose fingerprints are computed at once.
SLICE = 1 << 19
REMOVED, WINDOWS, SEGMENT, MARK = range(4)
SPAN = {"row": "u4", "start": "u4", "length": "u4"}
ENTRY = {"key": "u8", "check": "u4", "doc": "i8", "row": "u4", "start": "u4", "more": "u1", "epoch": "u4"}
HELD = ENTRY | {"part": "i4"}
RESULT = "doc_id long, kept binary, n_bytes long, spans array<struct<start: long, end: long>>"


def segments(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The segments of a slice of documents: key, check, row, start (in the document), more.

    ``more`` is the number of windows after the first; check is the fingerprint of the anchor string.
    """
    none = {"key": np.zeros(0, np.uint64), "check": np.zeros(0, np.uint64), "row": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "more": np.zeros(0, np.int64)}
    n = len(raw)
    if n < LENGTH:
        return none
    strings = window_names(raw, K)
    low = np.uint64((1 << n.bit_length()) - 1)
    least = strings & ~low | np.arange(len(strings), dtype=np.uint64)
    width, wanted = 1, LENGTH - K + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    valid = np.ones(n, np.bool_)
    tails = (offsets[1:, None] - np.arange(1, LENGTH)).ravel()
    valid[tails[tails >= 0]] = False
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a < LENGTH:
            valid[a:b] = False
    starts = np.flatnonzero(valid[: len(least)])
    if not len(starts):
        return none
    anchors = (least[starts] & low).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    first, last = starts[fresh], starts[np.append(fresh[1:], len(starts)) - 1]
    anchor = anchors[fresh]
    row = np.searchsorted(offsets, first, "right") - 1
    shape = (anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    key = mix64(span_names(strings, K, first, last - first + LENGTH) + shape)
    return {"key": key, "check": strings[anchor], "row": row, "start": first - offsets[row], "more": last - first}


def windows(raw: np.ndarray, offsets: np.ndarray, wanted: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The single windows of the asked segments (row, start, more) of a slice."""
    sizes = wanted["more"].astype(np.int64) + 1
    ends = np.cumsum(sizes)
    row = np.repeat(wanted["row"].astype(np.int64), sizes)
    start = np.repeat(wanted["start"].astype(np.int64) - (ends - sizes), sizes) + np.arange(int(ends[-1]))
    at = start + offsets[row]
    size = np.full(len(at), LENGTH)
    key, check = (span_names(window_names(raw, K, table), K, at, size) for table in (0, 1))
    return {"key": key, "check": check, "row": row, "start": start, "more": np.zeros(len(row), np.int64)}


def first_of_each(entries: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first of equal entries, and of the others; entries come in document order."""
    order = np.lexsort((entries["check"], entries["key"]))
    key, check = entries["key"][order], entries["check"][order]
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (check[1:] == check[:-1])]) if len(order) else np.zeros(0, np.bool_)
    return np.sort(order[~again]), np.sort(order[again])


def _before(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    out = a["start"] < b["start"]
    for c in ("row", "part", "doc", "epoch"):
        out = (a[c] < b[c]) | (a[c] == b[c]) & out
    return out


class LevelFamily:
    """Levels of sorted entries; an insert finds matches in every level and merges like-sized levels.

    Levels may come from files; those are never changed, since later batches don't come before them.
    """

    def __init__(self, levels=(), files=()):
        self.levels: list[dict[str, np.ndarray]] = list(levels)
        self.files: list[str | None] = list(files)

    def insert(self, batch: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
        """Adds a batch without equal entries; the entries, old or new, that have an earlier equal."""
        lost = []
        batch = take(batch, np.argsort(batch["key"], kind="stable"))
        for k, level in enumerate(self.levels):
            if not len(batch["key"]):
                return lost
            at = np.minimum(np.searchsorted(level["key"], batch["key"]), len(level["key"]) - 1)
            same = (level["key"][at] == batch["key"]) & (level["check"][at] == batch["check"])
            if not same.any():
                continue
            mine, theirs = take(batch, same), take(level, at[same])
            sooner = _before(mine, theirs)
            lost += [take(mine, ~sooner), take(theirs, sooner)]
            if sooner.any():
                places = at[same][sooner]
                for c in level:
                    level[c][places] = mine[c][sooner]
                self.files[k] = None
            batch = take(batch, ~same)
        if len(batch["key"]):
            self.levels.append(batch)
            self.files.append(None)
        while len(self.levels) > 1 and len(self.levels[-2]["key"]) <= 2 * len(self.levels[-1]["key"]):
            self._merge()
        return lost

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        self.files[-2:] = [None]
        both = {c: np.concatenate([a[c], b[c]]) for c in a}
        self.levels.append(take(both, np.argsort(both["key"], kind="stable")))

    def all(self) -> dict[str, np.ndarray]:
        return joined(self.levels, HELD)


class _Kept:
    """The kept family of one bucket in one pass: level files, and the anchor strings whose windows are indexed.

    A bucket's list of files has the number of the batch that wrote it, so a batch that failed leaves the list
    before it as it was; levels that a batch didn't touch keep their files.
    """

    def __init__(self, folder: str | None, name: str, epoch: int, bucket: int):
        self.folder, self.epoch = f"{folder}/{name}/bucket-{bucket}", epoch
        self.on = folder is not None

    def load(self) -> tuple[LevelFamily, np.ndarray]:
        if not self.on or not self.epoch:
            return LevelFamily(), np.zeros(0, np.uint32)
        files, top = filesystem(self.folder)
        with files.open_input_stream(f"{top}/list-{self.epoch - 1}.json") as f:
            listed = json.loads(f.read())
        levels = []
        for name in listed["levels"]:
            with files.open_input_stream(f"{top}/{name}") as f:
                levels.append(unpack(pa.py_buffer(f.read()), HELD))
        with files.open_input_stream(f"{top}/{listed['marks']}") as f:
            marks = np.frombuffer(f.read(), np.uint32)
        return LevelFamily(levels, listed["levels"]), marks

    def save(self, family: LevelFamily, marks: np.ndarray) -> None:
        if not self.on:
            return
        files, top = filesystem(self.folder)
        files.create_dir(top, recursive=True)

        def write(name: str, raw: bytes) -> str:
            with files.open_output_stream(f"{top}/{name}") as f:
                f.write(raw)
            return name

        names = [old or write(f"level-{uuid.uuid4().hex}", pack(level, HELD)) for level, old in zip(family.levels, family.files)]
        listed = {"levels": names, "marks": write(f"marks-{uuid.uuid4().hex}", marks.astype(np.uint32).tobytes())}
        fresh = write(f"list-{uuid.uuid4().hex}", json.dumps(listed).encode())
        files.move(f"{top}/{fresh}", f"{top}/list-{self.epoch}.json")  # a task that runs twice names its own files


def _spans(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    row, start, length = runs_of(columns["row"].astype(np.int64), columns["start"].astype(np.int64), columns["more"].astype(np.int64) + LENGTH)
    return {"row": row, "start": start, "length": length}


ASKED = {"row": "u4", "start": "u4", "more": "u1"}
FOUND = {"key": "u8", "check": "u8"} | ASKED
OLD = ASKED | {"part": "i4"}


def _entry_rows(part: int, kind: int, entries: dict[str, np.ndarray], ids: np.ndarray, by: str, n: int, epoch: int) -> list[tuple]:
    """Entries to their buckets; the half of the check that chose no bucket travels along."""
    bucket = (entries[by] % np.uint64(n)).astype(np.int64)
    sent = {"check": entries["check"] >> np.uint64(32), "doc": ids[entries["row"]], "epoch": np.full(len(bucket), epoch)}
    return ask_rows(part, kind, entries | sent, bucket, ENTRY)


def _entries(docs: pa.Table, work) -> dict[str, np.ndarray]:
    """``work(first, last, bytes, offsets)`` over slices of the part's documents, put together."""
    raw, offsets = text_bytes(docs.column("text"))
    found = []
    for first, last in slices(offsets, SLICE):
        got = work(first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        if got is not None:
            got["row"] = got["row"] + first
            found.append({c: got[c].astype(t, copy=False) for c, t in FOUND.items()})
    return {c: np.concatenate([x.pop(c) for x in found]) if found else np.zeros(0, t) for c, t in FOUND.items()}


def _to_buckets(n: int, epoch: int = 0):
    def ask(docs: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return ask_table([])
        part, docs = docs.column("part")[0].as_py(), in_order(docs)
        ids, found = ids_of(docs), _entries(docs, lambda first, last, raw, offsets: segments(raw, offsets))
        first, again = first_of_each(found)
        rows = [(part, part, REMOVED, pack(_spans(take(found, again)), SPAN))] if len(again) else []
        found = take(found, first)
        # anchor strings with several segments here: their windows are asked for, one mark tells others
        _, where, back, times = np.unique(found["check"], return_index=True, return_inverse=True, return_counts=True)
        several = times[back] > 1
        if several.any():
            rows.append((part, part, WINDOWS, pack(take(found, several), ASKED)))
            rows += _entry_rows(part, MARK, take(found, where[times > 1]), ids, "check", n, epoch)
        rows += _entry_rows(part, SEGMENT, take(found, ~several), ids, "check", n, epoch)
        return ask_table(rows)

    return ask


def _held(raw, part: int) -> dict[str, np.ndarray]:
    got = unpack(raw, ENTRY)
    return got | {"part": np.full(len(got["key"]), part, np.int32)}


def _match(last: bool, folder: str | None = None, epoch: int = 0):
    """The work of a bucket: what is removed goes back as spans, segments to look into as WINDOWS.

    Segments of an earlier batch are asked for under the negative number of their epoch, their part beside it.
    """

    def match(batches):
        kept = _Kept(folder, "windows" if last else "segments", epoch, TaskContext.get().partitionId() if folder else 0)
        family, opened = kept.load()
        lost, marks = [], [opened]
        for batch in batches:
            through = []
            for part, kind, raw in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("payload")):
                if kind == SEGMENT:
                    lost += family.insert(_held(raw.as_buffer(), part))
                elif kind == MARK:
                    marks.append(np.unique(unpack(raw.as_buffer(), ENTRY)["check"]))
                else:
                    through.append((part, kind, raw.as_py()))
            yield from answer_batches(through)
        out = joined(lost, HELD)
        rows = [(p, REMOVED, pack(_spans(x), SPAN)) for p, x in split_by(out, out["part"])] if len(out["key"]) else []
        if not last and family.levels:
            held = family.all()
            _, back, times = np.unique(held["check"], return_inverse=True, return_counts=True)
            look = times[back] > 1
            look |= np.isin(held["check"], np.concatenate(marks))
            marks.append(np.unique(held["check"][look]))
            now = held["epoch"] == epoch
            again = take(held, look & now)
            rows += [(p, WINDOWS, pack(x, ASKED)) for p, x in split_by(again, again["part"])]
            # those of earlier batches, unless an earlier one has looked into them already
            again = take(held, look & ~now & ~np.isin(held["check"], opened))
            for e, some in split_by(again, again["epoch"].astype(np.int64)):
                rows += [(-1 - e, WINDOWS, pack(x, OLD)) for _, x in split_by(some, some["part"])]
            # a mark alone is a string that two parts or more hold with several segments: both ask already
        kept.save(family, np.unique(np.concatenate(marks)))
        yield from answer_batches(rows)

    return match


def _windows_of(docs: pa.Table, wanted: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The single windows of the wanted segments of a part's documents, which are in order."""
    wanted = take(wanted, np.lexsort((wanted["start"], wanted["row"])))

    def work(first, last, raw, offsets):
        a, b = np.searchsorted(wanted["row"], [first, last])
        return windows(raw, offsets, {"row": wanted["row"][a:b].astype(np.int64) - first, "start": wanted["start"][a:b], "more": wanted["more"][a:b]}) if b > a else None

    return _entries(docs, work)


def _window_rows(part: int, docs: pa.Table, wanted: dict[str, np.ndarray], n: int, epoch: int) -> tuple[list[tuple], dict[str, np.ndarray]]:
    """The wanted windows to their buckets, each once, and where the others are; sorted bucket by bucket, as windows may be as many as bytes."""
    ids, found = ids_of(docs), _windows_of(docs, wanted)
    rows, others = [], []
    for _, some in split_by(found, (found["key"] % np.uint64(n)).astype(np.int32)):
        first, again = first_of_each(some)
        others.append({c: some[c][again] for c in ASKED})
        rows += _entry_rows(part, SEGMENT, take(some, first), ids, "key", n, epoch)
    return rows, joined(others, ASKED)


def _ask_windows(n: int, epoch: int = 0):
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return ask_table([])
        part = docs.column("part")[0].as_py()
        removed = payloads(answers, REMOVED, SPAN)
        asks, again = _window_rows(part, in_order(docs), payloads(answers, WINDOWS, ASKED), n, epoch)
        spans = _spans(again)
        all_spans = dict(zip(SPAN, runs_of(*(np.concatenate([removed[c].astype(np.int64), spans[c].astype(np.int64)]) for c in SPAN))))
        rows = [(part, part, REMOVED, pack(all_spans, SPAN))] if len(all_spans["row"]) else []
        return ask_table(rows + asks)

    return ask


def _ask_old_windows(n: int, epoch: int):
    """As _ask_windows for a part of an earlier batch: its windows go to the index, nothing of it is removed."""

    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return ask_table([])
        part = docs.column("part")[0].as_py()
        return ask_table(_window_rows(part, in_order(docs), payloads(answers, WINDOWS, OLD), n, epoch)[0])

    return ask


def _finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
    docs = in_order(docs)
    raw, offsets = text_bytes(docs.column("text"))
    spans = payloads(answers, REMOVED, SPAN)
    row, start, length = runs_of(*(spans[c].astype(np.int64) for c in SPAN))
    at = start + offsets[row]
    # one byte of memory a byte of text: spans of a document don't touch, so no two begin or end at one place
    lost = np.zeros(len(raw) + 1, np.int8)
    lost[at] = 1
    lost[at + length] -= 1
    np.cumsum(lost, dtype=np.int8, out=lost)
    kept = raw[lost[:-1] == 0]
    per_row = np.searchsorted(row, np.arange(docs.num_rows + 1)).astype(np.int32)
    ends = offsets - np.concatenate([[0], np.cumsum(length)])[per_row]
    pieces = pa.Array.from_buffers(pa.binary(), docs.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept)])
    both = pa.StructArray.from_arrays([pa.array(start), pa.array(start + length)], ["start", "end"])
    return pa.table({"doc_id": docs.column("doc_id"), "kept": pieces, "n_bytes": pa.array(np.diff(offsets)), "spans": pa.ListArray.from_arrays(per_row, both)})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: the bytes that stay, and the removed spans (byte offsets, maximal)."""
    n = fan_out(docs)
    parts = deal(docs, n)
    by_segment = cut(asked(each_part(parts, _to_buckets(n)), n, _match(False)), "repeats-segments")  # its asks need not stay beside the next ones
    by_segment = by_segment.repartitionById(n, F.col("part"))
    by_window = asked(with_answers(parts, by_segment, _ask_windows(n), ASK), n, _match(True))
    return with_answers(parts, by_window, _finish, RESULT)


class RepeatIndex:
    """A family of levels and the texts behind it, kept in a folder that all executors share.

    ``add`` takes a batch of documents as later than all before it: what one of its documents shares with an
    earlier batch, or with an earlier document of its own, is removed from it.  Buckets are as many as the first
    batch makes them, or as ``buckets`` says.  A batch that fails changes nothing and can be added again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _state(self) -> dict:
        files, top = filesystem(self.folder)
        found = [x.base_name for x in files.get_file_info(FileSelector(top, allow_not_found=True)) if x.base_name.startswith("added-")]
        if not found:
            return {"epoch": 0, "n": self.buckets}
        with files.open_input_stream(f"{top}/{max(found)}") as f:
            return json.loads(f.read())

    def _texts(self, epoch: int) -> str:
        return f"{self.folder}/texts/epoch-{epoch}"

    def add(self, docs: DataFrame) -> DataFrame:
        """Per document of the batch: as from ``remove_repeats``."""
        state = self._state()
        epoch, n = state["epoch"], state["n"] or fan_out(docs)
        deal(docs, n).write.mode("overwrite").parquet(self._texts(epoch))
        by_part = F.col("part")

        def stored(e: int) -> DataFrame:
            return self.spark.read.schema("part int, doc_id long, turn long, print long, text string").parquet(self._texts(e)).repartitionById(n, by_part)

        parts = stored(epoch)
        asks = each_part(parts, _to_buckets(n, epoch))
        answers = cut(asks.repartitionById(n, F.col("bucket")).mapInArrow(_match(False, self.folder, epoch), ANSWER), "repeats-segments")
        asks = with_answers(parts, answers.where("part >= 0").repartitionById(n, by_part), _ask_windows(n, epoch), ASK)
        for e in sorted(-1 - r.part for r in answers.where("part < 0").select("part").distinct().collect()):
            # the part that an old ask is for stands in its payload's own column
            old = answers.where(F.col("part") == -1 - e).mapInArrow(_old_parts, ANSWER).repartitionById(n, by_part)
            asks = asks.unionAll(with_answers(stored(e), old, _ask_old_windows(n, e), ASK))
        found = cut(asks.repartitionById(n, F.col("bucket")).mapInArrow(_match(True, self.folder, epoch), ANSWER), "repeats-windows")
        out = cut(with_answers(parts, found.repartitionById(n, by_part), _finish, RESULT), "repeats-kept")
        release(answers, found)
        files, top = filesystem(self.folder)
        with files.open_output_stream(f"{top}/added-{epoch + 1:09d}.json") as f:
            f.write(json.dumps({"epoch": epoch + 1, "n": n}).encode())
        return out


def _old_parts(batches):
    for batch in batches:
        rows = [(int(unpack(raw.as_buffer(), OLD)["part"][0]), kind, raw.as_py()) for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("payload"))]
        yield from answer_batches(rows)


def repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the digest of what stays."""
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: The same by definition: every window of every text, cut from blocks of its bytes in hexadecimal.
REPEATS_SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
blocks as (
  select doc_id, k * 500 as base, substr(h, k * 1000 + 1, 1000 + {2 * LENGTH}) as piece, least(500, n - {LENGTH - 1} - k * 500) as windows
  from (select *, unnest(range(0, cast(ceil((n - {LENGTH - 1}) / 500.0) as bigint))) as k from d where n >= {LENGTH})),
w as (select doc_id, base + i as p, md5(substr(piece, 2 * i + 1, {2 * LENGTH})) as m from (select *, unnest(range(0, windows)) as i from blocks)),
firsts as (select m, min((doc_id, p)) as f from w group by m having count(*) > 1),
later as (select doc_id, p from w join firsts using (m) where (doc_id, p) <> f),
marked as (select *, case when p > lag(p) over (partition by doc_id order by p) + {LENGTH} then 1 else 0 end as fresh from later),
islands as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as k from marked),
spans as (select doc_id, min(p) as a, max(p) + {LENGTH} as b from islands group by doc_id, k),
gaps as (
  select doc_id, lag(b, 1, 0) over (partition by doc_id order by a) as s, a as e from spans
  union all select doc_id, max(b), 1000000000000 from spans group by doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * s + 1, 2 * (least(e, n) - s)), '' order by s) as rest from gaps join d using (doc_id) group by doc_id),
lost as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from spans group by doc_id)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256
from d left join lost using (doc_id) left join kept using (doc_id)
"""
