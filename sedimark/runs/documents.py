"""JSON documents of any length: long lists are written from tables and read item by item.

A document is an object whose long lists stay in the file.  Reading it gives an ordinary dictionary in which
each list that takes more than ``SHORT`` characters is :class:`Items`, a sequence that parses the file again
whenever it is iterated; memory holds one item.  Any layout of JSON can be read.

A list is written from a table of lines (``LINES``): executors make the lines, Spark sorts and stores them, and the
driver copies them with the commas between.  ``step`` says what a line is: 0 starts an item, an odd step is an
element of a list inside the item, any other step goes between such lists or ends the item.  So no item, however long, is ever
one row.
"""

from __future__ import annotations

import codecs
import itertools
import json
import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sorted by the first four columns.
LINES = "first bigint, second string, step int, third string, line string"
#: Characters of a list that is kept in memory; read at once from a file.
SHORT, READ = 1 << 16, 1 << 20

_DECODER = json.JSONDecoder()
_SPACE = " \t\n\r"


class _Text:
    """A window of a file's text: ``buffer`` from byte ``base`` on, ``at`` the next character."""

    def __init__(self, file, base: int = 0):
        self.file, self.base, self.buffer, self.at, self.ended = file, base, "", 0, False
        self.decode = codecs.getincrementaldecoder("utf-8")().decode
        file.seek(base)

    def more(self) -> bool:
        """Read on, more the longer the window has become; what was read before ``at`` is dropped."""
        if self.ended:
            return False
        raw = self.file.read(max(READ, 2 * (len(self.buffer) - self.at)))
        self.ended = not raw
        self.base += len(self.buffer[: self.at].encode())
        self.buffer, self.at = self.buffer[self.at :] + self.decode(raw, not raw), 0
        return True

    def peek(self) -> str:
        """The next character that isn't space; empty at the end."""
        while True:
            while self.at < len(self.buffer) and self.buffer[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.buffer):
                return self.buffer[self.at]
            if not self.more():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"expected {wanted} near byte {self.place()}")
        self.at += 1

    def place(self) -> int:
        return self.base + len(self.buffer[: self.at].encode())

    def value(self):
        """The next value, whole."""
        self.peek()
        while True:
            try:
                found, end = _DECODER.raw_decode(self.buffer, self.at)
            except json.JSONDecodeError:
                if not self.more():
                    raise
                continue
            if end == len(self.buffer) and self.more():  # a number could go on
                continue
            self.at = end
            return found

    def elements(self) -> Iterator:
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            if self.peek() == "]":
                self.at += 1
                return
            self.take(",")


class Items(Sequence):
    """A list in a file, from the byte of its opening bracket on; ``each`` is applied to every item, ``opened`` opens the file."""

    def __init__(self, path: str, start: int, count: int, each: Callable = lambda item: item, opened: Callable = open):
        self.path, self.start, self.count, self.each, self.opened = path, start, count, each, opened

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator:
        with self.opened(self.path, "rb") as f:
            yield from map(self.each, _Text(f, self.start).elements())

    def __getitem__(self, at):
        if isinstance(at, slice):
            return list(itertools.islice(self, *at.indices(self.count))) if (at.step or 1) > 0 else list(self)[at]
        at = at + self.count if at < 0 else at
        if not 0 <= at < self.count:
            raise IndexError(at)
        return next(itertools.islice(self, at, None))

    def __eq__(self, other) -> bool:
        return isinstance(other, (list, Items)) and len(self) == len(other) and all(a == b for a, b in zip(self, other))

    __hash__ = None


def _skimmed(text: _Text, path: str, enough: Callable[[dict], bool] | None = None, opened: Callable = open):
    kind = text.peek()
    if kind == "{":
        out: dict = {}
        text.take("{")
        if text.peek() == "}":
            text.at += 1
            return out
        while True:
            name = text.value()
            if not isinstance(name, str):
                raise ValueError(f"expected a name near byte {text.place()}")
            text.take(":")
            out[name] = _skimmed(text, path, opened=opened)
            if enough and enough(out):
                return out
            if text.peek() == "}":
                text.at += 1
                return out
            text.take(",")
    if kind == "[":
        start, count, held, size = text.place(), 0, [], 0
        for count, item in enumerate(text.elements(), 1):
            if held is not None:
                held.append(item)
                size = text.place() - start if count % 64 == 0 else size
                held = held if size <= SHORT else None
        return held if held is not None and text.place() - start <= SHORT else Items(path, start, count, opened=opened)
    return text.value()


def load(path: str, opened: Callable = open):
    """The document of a file, with its long lists as :class:`Items`; ValueError if it isn't JSON.

    ``opened`` opens the file for reading bytes, as ``gzip.open`` does a compressed one.
    """
    with opened(path, "rb") as f:
        text = _Text(f)
        found = _skimmed(text, path, opened=opened)
        if text.peek():
            raise ValueError(f"more than one value, near byte {text.place()}")
    return found


def members(path: str, *names: str) -> dict:
    """As much of an object as shows these members, or all of it if one isn't there."""
    with open(path, "rb") as f:
        found = _skimmed(_Text(f), path, lambda out: all(n in out for n in names))
    return found if isinstance(found, dict) else {}


def pieces(value) -> Iterator[str]:
    """The JSON text of a value that may hold :class:`Items`, piece by piece."""
    if isinstance(value, Items):
        for i, item in enumerate(value):
            yield ("," if i else "[") + json.dumps(item, ensure_ascii=False)
        yield "]" if value.count else "[]"
    elif isinstance(value, dict):
        yield "{"
        for i, (k, x) in enumerate(value.items()):
            yield (", " if i else "") + json.dumps(k, ensure_ascii=False) + ": "
            yield from pieces(x)
        yield "}"
    else:
        yield json.dumps(value, ensure_ascii=False)


def lines(rows: DataFrame, first, second, step: int, third, make: Callable[[dict], str]) -> DataFrame:
    """Lines of a table: ``make`` gives a row's text; the other arguments are columns, and the step."""
    keyed = rows.select(first.cast("bigint").alias("first"), second.alias("second"), F.lit(step).alias("step"), third.alias("third"), F.struct(*rows.columns).alias("row"))

    def work(batches):
        for batch in batches:
            made = pa.array([make(row) for row in batch.column("row").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("first", "second", "step", "third")), made], names=["first", "second", "step", "third", "line"])

    return keyed.mapInArrow(work, LINES)


def marks(rows: DataFrame, first, second, step: int, text: str) -> DataFrame:
    """The same line for every row."""
    return rows.select(first.cast("bigint").alias("first"), second.alias("second"), F.lit(step).alias("step"), F.lit("").alias("third"), F.lit(text).alias("line"))


def write(path: str, head: dict, lists: dict[str, DataFrame], spool: str) -> dict:
    """Write ``head`` and the lists to a new file; the document as :func:`load` would give it, all lists as :class:`Items`.

    ``spool`` is a folder that the executors share, for the sorted lines; each of its files goes once it is copied,
    so the disk never holds a list twice.
    """
    out = dict(head)
    with open(path, "xb") as f:
        f.write(b"{\n")
        for i, (name, value) in enumerate(head.items()):
            f.write((",\n" if i else "").encode() + json.dumps({name: value}, ensure_ascii=False)[1:-1].encode())
        for name, rows in lists.items():
            stored = os.path.join(spool, name)
            rows.orderBy("first", "second", "step", "third").select(F.concat(F.col("step").cast("string"), "line").alias("value")).write.option("lineSep", "\n").text(stored)
            f.write((",\n" if len(out) else "").encode() + json.dumps(name).encode() + b": ")
            start, count, before = f.tell(), 0, None
            f.write(b"[")
            for part in sorted(x for x in os.listdir(stored) if x.startswith("part-")):
                with open(own := os.path.join(stored, part), "rb") as g:
                    for line in g:
                        step = line[0] - 48
                        if step == 0:
                            f.write(b",\n" if count else b"\n")
                            count += 1
                        else:
                            f.write(b",\n" if step % 2 and step == before else b"\n")
                        f.write(line[1:].rstrip(b"\n"))
                        before = step
                os.unlink(own)
            f.write(b"\n]")
            out[name] = Items(path, start, count)
        f.write(b"\n}\n")
        f.flush()
        os.fsync(f.fileno())
    return out
