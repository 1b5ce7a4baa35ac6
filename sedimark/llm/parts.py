"""Ask and answer between parts of a table and buckets of keys.

Documents are dealt into parts by a hash of ``doc_id`` and text; inside a part they are sorted, so a row
number names the same document in every pass.  A pass sends asks, packed numpy arrays, to buckets by key;
a bucket answers to parts.  Part and bucket numbers are the partitions themselves: a task has one of them.

Edge cases: null ids sort before all others and are spread by their texts; rows that repeat an id are
spread too, and ordered by that hash in all parts together, since parts are ranges of it; rows equal in both
are in one part; an empty table makes empty parts; columns other than id and text don't travel.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import doc_rows

#: What travels to a bucket, and what comes back to a part.
ASK = "bucket int, part int, kind int, payload binary"
ANSWER = "part int, kind int, payload binary"
_ASK = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_ANSWER = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
NO_ID = np.iinfo(np.int64).min


def deal(docs: DataFrame, n: int) -> DataFrame:
    """(part, doc_id, turn, print, text) in ``n`` parts, which are ranges of ``turn``, a hash of the row.

    ``print`` is a hash of the text alone, to find a row again where ids repeat.
    """
    rows = doc_rows(docs).withColumns({"turn": F.xxhash64(F.lit(7), "doc_id", "text"), "print": F.xxhash64("text")})
    part = F.shiftright((F.shiftright("turn", 32) + F.lit(1 << 31)) * F.lit(n), 32).cast("int")
    return rows.select(part.alias("part"), "doc_id", "turn", "print", "text").repartitionById(n, F.col("part"))


def asked(parts: DataFrame, n: int, work) -> DataFrame:
    """The answers (part, kind, payload) of ``work``, a map over the batches of a bucket, by part."""
    return parts.repartitionById(n, F.col("bucket")).mapInArrow(work, ANSWER).repartitionById(n, F.col("part"))


def with_answers(parts: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows of a part, answers to it)`` for every part."""

    def apply(rows: pa.Table, answered: pa.Table) -> pa.Table:
        return work(rows, answered)

    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(apply, schema)


def each_part(parts: DataFrame, work, schema: str = ASK) -> DataFrame:
    def apply(rows: pa.Table) -> pa.Table:
        return work(rows)

    return parts.groupBy("part").applyInArrow(apply, schema)


def in_order(part: pa.Table) -> pa.Table:
    """The rows of a part by (doc_id, turn), nulls first: the same in every pass."""
    return part.take(pc.sort_indices(part, [("doc_id", "ascending"), ("turn", "ascending")], null_placement="at_start")) if part.num_rows else part


def ids_of(part: pa.Table) -> np.ndarray:
    return part.column("doc_id").fill_null(NO_ID).to_numpy()


def pack(columns: dict[str, np.ndarray], dtypes: dict[str, str]) -> bytes:
    """The columns with as few bytes a value as their range needs: count, then base, width, values."""
    n = len(next(iter(columns[c] for c in dtypes)))
    out = [struct.pack("<I", n)]
    for c, t in dtypes.items():
        values = np.ascontiguousarray(columns[c]).astype(t, copy=False)
        base = int(values.min()) if n else 0
        reach = int(values.max()) - base if n else 0
        width = 0 if reach == 0 else 1 if reach < 1 << 8 else 2 if reach < 1 << 16 else 4 if reach < 1 << 32 else 8
        out.append(struct.pack("<QB", base & (1 << 64) - 1, width))
        if width:
            out.append((values.astype("u8") - np.uint64(base & (1 << 64) - 1)).astype(f"<u{width}").tobytes())
    return b"".join(out)


def unpack(raw, dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    """The columns; ``raw`` is an Arrow buffer or bytes."""
    n, at, out = int(np.frombuffer(raw, "<u4", 1)[0]), 4, {}
    for c, t in dtypes.items():
        base, width = int(np.frombuffer(raw, "<u8", 1, at)[0]), int(np.frombuffer(raw, "u1", 1, at + 8)[0])
        at += 9
        values = np.frombuffer(raw, f"<u{width}", n, at).astype("u8") if width else np.zeros(n, "u8")
        at += n * width
        out[c] = (values + np.uint64(base)).astype(t, copy=False)
    return out


def take(columns: dict[str, np.ndarray], rows) -> dict[str, np.ndarray]:
    return {c: v[rows] for c, v in columns.items()}


def joined(several: list[dict[str, np.ndarray]], dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([x[c] for x in several]).astype(t, copy=False) if several else np.zeros(0, t) for c, t in dtypes.items()}


def split_by(columns: dict[str, np.ndarray], owner: np.ndarray):
    """(owner, columns of its rows) for each owner; rows keep their order."""
    order = np.argsort(owner, kind="stable")
    owners, first = np.unique(owner[order], return_index=True)
    for k, rows in zip(owners.tolist(), np.split(order, first[1:])):
        yield k, take(columns, rows)


def ask_rows(part: int, kind: int, columns: dict[str, np.ndarray], bucket: np.ndarray, dtypes: dict[str, str]) -> list[tuple]:
    return [(b, part, kind, pack(x, dtypes)) for b, x in split_by(columns, bucket)] if len(bucket) else []


def ask_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else ([],) * 4, _ASK)], schema=_ASK)


def answer_batches(rows: list[tuple], most: int = 4 << 20):
    """Record batches of (part, kind, payload), each of a few MB."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[2])
        if size >= most:
            yield _answer(some)
            some, size = [], 0
    if some:
        yield _answer(some)


def _answer(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ANSWER)], schema=_ANSWER)


def payloads(answers: pa.Table, kind: int, dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    """All answers of a kind, as one set of columns."""
    wanted = answers.filter(pc.equal(answers.column("kind"), kind)).column("payload")
    return joined([unpack(x.as_buffer(), dtypes) for x in wanted], dtypes)


def runs_of(row: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a row merged; sorted by row and start."""
    if not len(row):
        return row, start, length
    order = np.lexsort((start, row))
    row, start = row[order].astype(np.int64), start[order].astype(np.int64)
    end = start + length[order]
    # ends that only grow inside a row: a row's own range is kept apart by its number
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(row * wide + end)
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (row[1:] * wide + start[1:] > reach[:-1])])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], reach[last] - row[last] * wide - start[first]
