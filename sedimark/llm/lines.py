"""Line dedup: repeated runs of lines, from suffix ranks by distributed prefix doubling.

A run of consecutive lines of a document counts if it holds one line that isn't blank (ASCII white space
alone), or, where ``least_bytes`` is given, so many bytes of text in its lines.  A line is deleted if it
lies in a run that counts and that also starts earlier: in a document with a smaller ``doc_id``, or in the
same document at an earlier line.  So all later copies of the maximal repeated runs go, the first stays.

1. A line's ID is 128 bits, two hashes of it.  Only lines with a second occurrence can lie in a repeated
   run; the distinct ones are sorted, and a line's rank is its ID's place in that order.
2. Prefix doubling: the rank of the first 2**(k+1) lines of a suffix is the place of the pair (rank of its
   first 2**k lines, rank of the 2**k lines after them) among all pairs in order.  Pairs come from a join
   of the ranks with themselves, places from one range sort.  Suffixes in order of rank are the suffix
   array to that depth, and those of one rank are an interval with that common prefix; an interval of one
   suffix can't grow and goes no further.
3. A maximal repeated run is the union of the least runs that count inside it: for each line the shortest
   from it and the shortest up to it.  A run of n lines, 2**k <= n < 2**(k+1), is named by n and the ranks
   of its first and its last 2**k lines.  Runs of one name are an interval of common prefix n; its least
   position is the first copy, and the others are later ones.

Doubling goes on while a least run is that long: once where each line counts by itself.  Ranks and first
copies are sums by key, made before they are joined, and are tables of their own; so a line that a third of
all documents hold is added up in parts, and its joins can be split.

Edge cases: a null text stays null and has no lines; an empty text has one empty line; equal lines of
one document count like those of two; null ``doc_id`` is smaller than all others; rows with one
``doc_id`` are ordered by a hash of their text, and rows equal in both are one document (both keep
their lines); an empty table gives no rows.  Other columns pass through unchanged, whatever their names, but
for those named n_lines and n_deleted, which are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import cut, release

#: A line that isn't blank, for Java and RE2 alike.
_NON_BLANK = r"[^ \t\r\f\x0B]"
RUNS = "doc long, print long, first int, last int"
_RUNS = pa.schema([("doc", pa.int64()), ("print", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_FIRST_OF_ALL = -(1 << 63)
_KEY = ["doc", "print"]


def _least_runs(place: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) indexes of the least runs from and to each line, within consecutive places."""
    n = len(place)
    total = np.concatenate([[0], np.cumsum(size)])
    island = np.cumsum(np.concatenate([[0], np.diff(place) != 1]))
    starts = np.searchsorted(island, island, "left")
    ends = np.searchsorted(island, island, "right")
    here = np.arange(n)
    last = np.searchsorted(total, total[:-1] + least, "left") - 1
    forward = last < ends
    first = np.searchsorted(total, total[1:] - least, "right") - 1
    backward = (first >= starts) & (total[1:] >= least)
    a = np.concatenate([here[forward], first[backward]])
    b = np.concatenate([last[forward], here[backward]])
    both = np.unique(a * (n + 1) + b)
    return both // (n + 1), both % (n + 1)


def _runs(least: int):
    """The least runs of each document (doc, print, lines: its repeated lines in order)."""

    def work(batches):
        for batch in batches:
            out = []
            lists = batch.column("lines")
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = lists.flatten()
            place, size = (flat.field(c).to_numpy().astype(np.int64) for c in ("place", "size"))
            docs, prints = batch.column("doc").to_numpy(), batch.column("print").to_numpy()
            for d, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                first, last = _least_runs(place[a:b], size[a:b], least)
                if len(first):
                    out.append((np.full(len(first), docs[d]), np.full(len(first), prints[d]), place[a:b][first], place[a:b][last]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type, safe=False) for x, f in zip(zip(*out), _RUNS)], schema=_RUNS)

    return work


def _masks(batches):
    """Ranges of lines as one byte a line, 1 for those that go; the lines after the last stay."""
    for batch in batches:
        masks = []
        lists = batch.column("ranges")
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64).tolist()
        flat = lists.flatten()
        first, last = (flat.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
        for a, b in zip(cuts, cuts[1:]):
            n = int(last[a:b].max()) + 1
            steps = np.bincount(first[a:b], minlength=n + 1) - np.bincount(last[a:b] + 1, minlength=n + 1)
            masks.append((np.cumsum(steps[:n]) > 0).astype(np.uint8))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("print"), pa.array([m.tobytes() for m in masks], pa.binary()), pa.array([int(m.sum()) for m in masks], pa.int64())], names=["doc", "print", "gone", "n_gone"]
        )


def _keyed(docs: DataFrame) -> list:
    """doc and print: the id with the least long for null, and the hash of the text."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(_FIRST_OF_ALL)).alias("doc"), F.xxhash64(docs["text"].cast("string")).alias("print")]


def _in_order(keys: DataFrame, by: list[str]) -> DataFrame:
    """``keys`` with ``rank``: numbers in the order of ``by``, from one range sort."""
    return keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def line_ranks(lines: DataFrame) -> DataFrame:
    """(doc, print, place, size, rank) of the lines (doc, print, place, id_a, id_b, size) that occur twice or more."""
    by = ["id_a", "id_b"]
    twice = lines.groupBy(*by).agg(F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return lines.join(cut(_in_order(twice, by), "lines-ids"), by).select(*_KEY, "place", "size", "rank")


def doubled(ranks: DataFrame, depth: int) -> DataFrame:
    """Ranks (doc, print, place, rank) to twice the depth, of the suffixes that share so much with another."""
    after = ranks.select(*_KEY, (F.col("place") - depth).alias("place"), F.col("rank").alias("next"))
    pairs = cut(ranks.select(*_KEY, "place", "rank").join(after, [*_KEY, "place"]), f"lines-pairs-{depth}")
    intervals = pairs.groupBy("rank", "next").agg(F.count("*").alias("copies")).where("copies > 1").drop("copies")
    intervals = cut(_in_order(intervals.withColumnsRenamed({"rank": "own"}), ["own", "next"]), f"lines-intervals-{depth}")
    deeper = cut(pairs.withColumnRenamed("rank", "own").join(intervals, ["own", "next"]).select(*_KEY, "place", "rank"), f"lines-ranks-{2 * depth}")
    release(pairs, intervals)
    return deeper


def _later(runs: DataFrame, ranks: DataFrame, depth: int) -> DataFrame:
    """The runs of ``depth`` to 2 * ``depth`` - 1 lines that have an earlier copy."""
    size = F.col("last") - F.col("first") + 1
    some = runs.withColumn("size", size).where((F.col("size") >= depth) & (F.col("size") < 2 * depth))
    head = ranks.select(*_KEY, F.col("place").alias("first"), F.col("rank").alias("head"))
    named = some.join(head, [*_KEY, "first"])
    if depth > 1:
        tail = ranks.select(*_KEY, (F.col("place") + (depth - 1)).cast("int").alias("last"), F.col("rank").alias("tail"))
        named = cut(named.join(tail, [*_KEY, "last"]), f"lines-named-{depth}")
    else:
        named = named.withColumn("tail", F.col("head"))
    at = F.struct("doc", "print", "first")
    firsts = cut(named.groupBy("size", "head", "tail").agg(F.min(at).alias("at"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), f"lines-firsts-{depth}")
    return named.join(firsts, ["size", "head", "tail"]).where(at > F.col("at")).select(*_KEY, "first", "last")


def later_lines(docs: DataFrame, least_bytes: int | None = None) -> DataFrame:
    """(doc, print, gone, n_gone): a byte for each line, 1 where it goes, for documents that lose any.

    ``doc`` is the id with the least long for null, ``print`` the hash of the text.
    """
    text = F.col("text").cast("string")
    keyed = docs.select(*_keyed(docs), text.alias("text")).where("text is not null")
    size, least = (F.col("t").rlike(_NON_BLANK).cast("int"), 1) if least_bytes is None else (F.octet_length("t"), max(least_bytes, 1))
    split = keyed.select(*_KEY, F.posexplode(F.split("text", "\n", -1)).alias("place", "t"))
    lines = split.select(*_KEY, "place", F.xxhash64("t").alias("id_a"), F.xxhash64(F.lit(0x51ED27), "t").alias("id_b"), size.alias("size"))
    ranks = cut(line_ranks(lines), "lines-ranks-1")
    by_doc = ranks.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct("place", "size"))).alias("lines"))
    runs = cut(by_doc.mapInArrow(_runs(least), RUNS), "lines-runs")
    longest = runs.agg(F.max(F.col("last") - F.col("first") + 1)).first()[0] or 0
    found, depth = [], 1
    while depth == 1 or depth <= longest:
        found.append(cut(_later(runs, ranks, depth), f"lines-later-{depth}"))
        deeper = doubled(ranks, depth) if 2 * depth <= longest else None
        release(ranks)
        ranks, depth = deeper, 2 * depth
    release(runs)
    ranges = functools.reduce(DataFrame.union, found).groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return ranges.mapInArrow(_masks, "doc long, print long, gone binary, n_gone long")


def dedup_lines(docs: DataFrame, least_bytes: int | None = None) -> DataFrame:
    """``docs`` with the later copies deleted from ``text``, and n_lines and n_deleted beside it."""
    gone = later_lines(docs, least_bytes)
    held = docs.select(*_keyed(docs), F.struct(*docs.columns).alias("row")).join(gone, _KEY, "left")
    split = F.split(F.col("row.text").cast("string"), "\n", -1)
    kept = F.filter(split, lambda _, i: (i >= F.octet_length("gone")) | (F.substring(F.col("gone"), i + 1, F.lit(1)) == F.lit(b"\0")))
    rest = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    own = [rest.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return held.select(*own, F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_deleted"))


def line_report(docs: DataFrame, least_bytes: int | None = None) -> DataFrame:
    """Per document: doc_id, n_lines, n_deleted and the digest of the text that stays."""
    return dedup_lines(docs.select("doc_id", "text"), least_bytes).select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same by definition, over the least runs as strings.
_RUNS_SQL = """
with lines as (
  select doc_id, cast(unnest(generate_series(1, len(string_split(text, chr(10))))) as bigint) as i, unnest(string_split(text, chr(10))) as t
  from documents where text is not null),
sized as (
  select *, WEIGHT as size, sum(WEIGHT) over (partition by doc_id order by i) as total from lines),
runs as (
  select a.doc_id, a.i as first, min(b.i) as last from sized a join sized b on a.doc_id = b.doc_id and b.i >= a.i and b.total - a.total + a.size >= LEAST group by all
  union
  select b.doc_id, max(a.i) as first, b.i as last from sized a join sized b on a.doc_id = b.doc_id and b.i >= a.i and b.total - a.total + a.size >= LEAST group by b.doc_id, b.i),
named as (
  select r.doc_id, r.first, r.last, string_agg(l.t, chr(10) order by l.i) as run
  from runs r join lines l on l.doc_id = r.doc_id and l.i between r.first and r.last group by all),
later as (
  select *, row_number() over (partition by run order by doc_id, first) as copy,
         min(doc_id) over (partition by run) as d0, first_value(first) over (partition by run order by doc_id, first) as f0 from named),
gone as (
  select distinct l.doc_id, l.i from lines l join later r on l.doc_id = r.doc_id and l.i between r.first and r.last and (r.doc_id, r.first) <> (r.d0, r.f0)),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.i) as n_deleted,
         coalesce(string_agg(l.t, chr(10) order by l.i) filter (where g.i is null), '') as rest
  from lines l left join gone g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted, sha256(coalesce(rest, '')) as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id
"""


def line_sql(least_bytes: int | None = None) -> str:
    weight = f"cast(regexp_matches(t, '{_NON_BLANK}') as int)" if least_bytes is None else "strlen(t)"
    return _RUNS_SQL.replace("WEIGHT", weight).replace("LEAST", str(least_bytes or 1))
