"""N-gram Jaccard join with vertical partitioning, and the components of its links.

The global order of n-grams is the order of their 64-bit fingerprints, cut into fragments.

1. Parts of the documents send their distinct n-grams to fragments (ranges of the order); a fragment
   answers how many of each document's n-grams another document has too.  A document with fewer than
   80 % of them shared has no link and goes no further.  Inside a part, documents with equal sets are
   one node, and an n-gram is sent once however many documents hold it.
2. The rest count document frequencies by fragment.  A document's prefix is its ``n - ceil(0.8 n) + 1``
   rarest n-grams: two linked documents share one of them.
3. Candidate pairs: first every node with one leader, the node that has fewest rarer n-grams in the
   prefix lists they share, so the least altered of a group of copies; components of the links found.
   Then only pairs of different components that share a prefix n-gram at places that still allow a link:
   with i and j rarer n-grams before the first shared one, the overlap is at most min(n_a - i, n_b - j).
   So a group of copies never becomes all its pairs: the copies of a leader are one component, and those
   too far from it have too many n-grams of their own.
4. Verification is vertical: for each pair and fragment of the order a row carries only that fragment's
   n-grams; its partial overlap is counted apart from the others, and the counts are summed per pair.
   ``100 * overlap >= 80 * union`` is a link.

Step 1 compares the place in the fragment and 40 bits (an accident only keeps a document longer), the
others all 64.

Edge cases: a text without words, empty or null, has no shingle and is linked with nothing; one with
fewer than five words has one shingle, all its words; rows that repeat a ``doc_id`` are separate nodes,
each row is returned; a null ``doc_id`` is ignored as a component's least id (null if all are); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import cut, fan_out, release, slices, text_bytes
from sedimark.llm.graph import components
from sedimark.llm.parts import answer_batches, ask_table, asked, deal, each_part, in_order, pack, unpack, with_answers
from sedimark.llm.shingles import shingle_sets

SIZE = 5
PERCENT = 80
#: Fragments of the global order in which overlaps are counted.
FRAGMENTS = 8
SLICE = 1 << 19
SIZES, GRAMS, SHARED = range(3)
_SIZE_OF = {"row": "u4", "n": "u4", "same": "u4", "shared": "u4"}
_SHARED_OF = {"row": "u4", "shared": "u4"}
_GRAMS_OF = {"row": "u4", "times": "u4"}
#: Bits of an n-gram, beyond its fragment, that step 1 compares.
_BITS = 40
NODES = "part int, node long, doc_id long, print long, n long, same long, grams array<array<long>>"
_NODES = pa.schema([("part", pa.int32()), ("node", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("same", pa.int64()), ("grams", pa.list_(pa.list_(pa.int64())))])
PREFIX = "gram long, node long, n long, place long"


def _fragment(grams: np.ndarray, n: int) -> np.ndarray:
    """The fragment of n equal ranges of the order that each n-gram is in."""
    return ((grams >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _sets(docs: pa.Table, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, number by row) of the part's documents, or of the given rows."""
    column = docs.column("text") if rows is None else docs.column("text").take(pa.array(rows))
    raw, offsets = text_bytes(column)
    grams, counts = [], []
    for first, last in slices(offsets, SLICE):
        g, c = shingle_sets(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], SIZE)
        grams.append(g)
        counts.append(c)
    return (np.concatenate(grams), np.concatenate(counts)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _same_sets(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row the first row with the same set; rows without n-grams are their own."""
    ends = np.cumsum(counts)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(grams * (grams >> np.uint64(31) | np.uint64(1)), dtype=np.uint64)])
    more = np.concatenate([[np.uint64(0)], np.cumsum(grams, dtype=np.uint64)])
    names = np.stack([sums[ends] - sums[ends - counts], more[ends] - more[ends - counts], counts.astype(np.uint64)], axis=1)
    _, first, back = np.unique(names, axis=0, return_index=True, return_inverse=True)
    same = first[back.ravel()]
    return np.where(counts > 0, same, np.arange(len(counts)))


def _ask_shared(n: int):
    """Payload to a fragment: packed rows with their numbers of n-grams, then the n-grams (4 and 1 bytes).

    An n-gram is its distance from the fragment's start, cut to ``_BITS`` bits.  Row 2**32 - 1 stands
    for n-grams that several documents of the part have.
    """
    shift = np.uint64(max(0, 64 - (n.bit_length() - 1) - _BITS))

    def ask(docs: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return ask_table([])
        part = docs.column("part")[0].as_py()
        grams, counts = _sets(in_order(docs))
        same = _same_sets(grams, counts)
        row = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
        mine = (same == np.arange(len(counts)))[row]
        grams, row = grams[mine], row[mine]
        order = np.argsort(grams, kind="stable").astype(np.uint32)
        g = grams[order]
        again = np.zeros(len(g) + 1, np.bool_)
        again[1:-1] = g[1:] == g[:-1]
        several = again[:-1] | again[1:]
        shared = np.bincount(row[order[several]], minlength=len(counts))
        rows = [(part, part, SIZES, pack({"row": np.arange(len(counts)), "n": counts, "same": same, "shared": shared}, _SIZE_OF))]
        marks = g[several & ~again[:-1]]
        single = np.sort(order[~several])
        grams, row = np.concatenate([grams[single], marks]), np.concatenate([row[single], np.full(len(marks), 0xFFFFFFFF, np.uint32)])
        where = _fragment(grams, n)
        order = np.argsort(where, kind="stable")
        grams, row, where = grams[order], row[order], where[order]
        cuts = np.searchsorted(where, np.arange(n + 1))
        for b in range(n):
            x, r = grams[cuts[b] : cuts[b + 1]], row[cuts[b] : cuts[b + 1]]
            if len(x):
                x = (x - np.uint64(-(-(b << 32) // n) << 32)) >> shift
                names, times = np.unique(r, return_counts=True)
                head = pack({"row": names, "times": times}, _GRAMS_OF)
                tail = (x & np.uint64(0xFFFFFFFF)).astype("u4").tobytes() + (x >> np.uint64(32)).astype("u1").tobytes()
                rows.append((b, part, GRAMS, len(head).to_bytes(4, "little") + head + tail))
        return ask_table(rows)

    return ask


def _count_shared(batches):
    """In a fragment: for each document, how many of its n-grams other parts have too."""
    parts, rows, grams = [], [], []
    for batch in batches:
        through = []
        for part, kind, raw in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("payload")):
            raw = raw.as_buffer()
            if kind != GRAMS:
                through.append((part, kind, raw.to_pybytes()))
                continue
            k = int(np.frombuffer(raw, "u4", 1)[0])
            head = unpack(raw.slice(4, k), _GRAMS_OF)
            names, times = head["row"], head["times"]
            m = int(times.sum())
            low, high = np.frombuffer(raw, "u4", m, 4 + k), np.frombuffer(raw, "u1", m, 4 + k + 4 * m)
            grams.append(high.astype(np.uint64) << np.uint64(32) | low)
            rows.append(np.repeat(names, times))
            parts.append(np.full(m, part, np.int32))
        yield from answer_batches(through)
    if not grams:
        return
    grams, rows, parts = map(np.concatenate, (grams, rows, parts))
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    again = np.zeros(len(g) + 1, np.bool_)
    again[1:-1] = g[1:] == g[:-1]
    found = order[again[:-1] | again[1:]]
    found = found[rows[found] != 0xFFFFFFFF]
    both = parts[found].astype(np.int64) << 32 | rows[found]
    names, times = np.unique(both, return_counts=True)
    owner = names >> 32
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
    answers = [(int(owner[a]), SHARED, pack({"row": names[a:b] & 0xFFFFFFFF, "shared": times[a:b]}, _SHARED_OF)) for a, b in zip(cuts, [*cuts[1:], len(owner)])]
    yield from answer_batches(answers)


def _nodes(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A row for each document; for those that may have links also their n-grams by fragment."""
    if not docs.num_rows:
        return _NODES.empty_table()
    docs = in_order(docs)
    part = docs.column("part")[0].as_py()
    of = {"n": np.zeros(docs.num_rows, np.int64), "same": np.zeros(docs.num_rows, np.int64), "shared": np.zeros(docs.num_rows, np.int64)}
    for kind, raw in zip(answers.column("kind").to_pylist(), answers.column("payload")):
        if kind == SIZES:
            got = unpack(raw.as_buffer(), _SIZE_OF)
            of["n"][got["row"]], of["same"][got["row"]] = got["n"], got["same"]
            of["shared"][got["row"]] += got["shared"]
        else:
            got = unpack(raw.as_buffer(), _SHARED_OF)
            of["shared"][got["row"]] += got["shared"]
    first = part << 32
    node = first + np.arange(docs.num_rows)
    info = pa.table([pa.array(np.full(docs.num_rows, part), pa.int32()), pa.array(node), docs.column("doc_id"), docs.column("print"), pa.array(of["n"]), pa.array(first + of["same"]), pa.nulls(docs.num_rows, _NODES.field("grams").type)], schema=_NODES)
    may = np.flatnonzero((of["same"] == np.arange(docs.num_rows)) & (of["n"] > 0) & (100 * of["shared"] >= PERCENT * of["n"]))
    if not len(may):
        return info
    grams, counts = _sets(docs, may)
    row = np.repeat(np.arange(len(may)), counts)
    group = row * FRAGMENTS + _fragment(grams, FRAGMENTS)  # ascending: grams ascend in each row
    sizes = np.bincount(group, minlength=len(may) * FRAGMENTS)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(grams.view(np.int64)))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(may) + 1, dtype=np.int32) * FRAGMENTS), lists)
    spread = np.full(docs.num_rows, -1)
    spread[may] = np.arange(len(may))
    column = lists.take(pa.array(spread, pa.int64(), mask=spread < 0))
    return info.set_column(info.schema.get_field_index("grams"), "grams", column)


def _held_grams(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, node, n) of a part's rows sorted by n-gram then node, and where n-grams begin."""
    lists = rows.column("grams").combine_chunks()
    grams = lists.flatten().flatten().to_numpy().view(np.uint64)
    inner = lists.flatten().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = inner.reshape(-1, FRAGMENTS).sum(axis=1)
    node = np.repeat(rows.column("node").to_numpy(), sizes)
    n = np.repeat(rows.column("n").to_numpy(), sizes)
    order = np.lexsort((node, grams))
    grams = grams[order]
    fresh = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams, node[order], n[order], fresh


def _ask_frequency(n: int):
    def ask(rows: pa.Table) -> pa.Table:
        grams, _, _, fresh = _held_grams(rows)
        part = rows.column("part")[0].as_py()
        times = np.diff(np.append(fresh, len(grams)))
        names = grams[fresh]
        cuts = np.searchsorted(_fragment(names, n), np.arange(n + 1))
        return ask_table([(b, part, b, pack({"gram": names[c:d], "times": times[c:d]}, {"gram": "u8", "times": "u4"})) for b, (c, d) in enumerate(zip(cuts, cuts[1:])) if d > c])

    return ask


def _count_frequency(batches):
    """In a fragment: the document frequency of each n-gram asked for, in the order of the ask."""
    found = [(p, k, unpack(x.as_buffer(), {"gram": "u8", "times": "u4"})) for batch in batches for p, k, x in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("payload"))]
    if not found:
        return
    grams = np.concatenate([x["gram"] for _, _, x in found])
    names, back = np.unique(grams, return_inverse=True)
    total = np.bincount(back, np.concatenate([x["times"] for _, _, x in found]), len(names)).astype("u4")
    at = np.cumsum([0, *(len(x["gram"]) for _, _, x in found)])
    yield from answer_batches([(p, k, total[back[a:b]].tobytes()) for (p, k, _), a, b in zip(found, at, at[1:])])


def _prefixes(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The prefix n-grams of each node that another node has too."""
    schema = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])
    if not rows.num_rows:
        return schema.empty_table()
    grams, node, n, fresh = _held_grams(rows)
    by = sorted(zip(answers.column("kind").to_pylist(), answers.column("payload")), key=lambda x: x[0])
    frequency = np.repeat(np.concatenate([np.frombuffer(x.as_buffer(), "u4") for _, x in by]), np.diff(np.append(fresh, len(grams))))
    order = np.lexsort((grams, frequency, node))
    grams, node, n, frequency = grams[order], node[order], n[order], frequency[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    least = -(-PERCENT * n // 100)
    wanted = (place <= n - least) & (frequency > 1)
    return pa.table([pa.array(grams[wanted].view(np.int64)), pa.array(node[wanted]), pa.array(n[wanted]), pa.array(place[wanted])], schema=schema)


def _links(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that are links.

    Vertical partitions: a row for each pair and fragment holds b's n-grams of that fragment alone and goes
    to where a's n-grams of the same fragment are; each fragment's partial overlap is counted there, and the
    partial overlaps of a pair are summed.  A node's n-grams travel once for each pair whose ``b`` it is, and
    once as an ``a`` however many pairs it leads; a leader with very many pairs can be split.
    """
    slices = held.select("node", F.posexplode("grams").alias("fragment", "some"))
    leaders = slices.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    left = leaders.select(F.col("node").alias("a"), "fragment", F.col("some").alias("left"))
    right = pairs.join(slices.select(F.col("node").alias("b"), "fragment", F.col("some").alias("right")), "b")
    partial = right.join(left, ["a", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("left", "right")).alias("both"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    return summed.where(F.lit(100) * F.col("both") >= F.lit(PERCENT) * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _near_sizes(a: str, b: str):
    """Sizes that allow a link at all."""
    return (F.lit(100) * F.col(a) >= F.lit(PERCENT) * F.col(b)) & (F.lit(100) * F.col(b) >= F.lit(PERCENT) * F.col(a))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, print (hash of the text), n_shingles, component_id, stays.

    ``stays`` marks one row of each component: the least id, the first of rows that repeat it.
    """
    n = fan_out(docs)
    parts = deal(docs, n)
    shared = asked(each_part(parts, _ask_shared(n)), n, _count_shared)
    rows = cut(with_answers(parts, shared, _nodes, NODES), "jaccard-nodes")
    info, held = rows.drop("grams"), rows.where("grams is not null")

    dealt = held.select("part", "node", "n", "grams").repartitionById(n, F.col("part"))
    counted = asked(each_part(dealt, _ask_frequency(n)), n, _count_frequency)
    prefix = cut(with_answers(dealt, counted, _prefixes, PREFIX), "jaccard-prefixes")

    # each node with the leader that it meets in most of its lists
    # (sums are tables of their own before they are joined: then a hot key of the other side can be split)
    lead = cut(prefix.groupBy("gram").agg(F.min(F.struct("place", F.col("node").alias("a"), F.col("n").alias("n_a"))).alias("lead")), "jaccard-leads")
    met = prefix.join(lead, "gram").where("lead.a <> node").groupBy(F.col("node").alias("b"), F.col("n").alias("n_b"), "lead.a", "lead.n_a").agg(F.count("*").alias("times"))
    met = met.where(_near_sizes("n_a", "n_b"))
    star = met.groupBy("b", "n_b").agg(F.max_by(F.struct("a", "n_a"), F.struct("times", -F.col("a"))).alias("lead")).select("lead.a", "b", "lead.n_a", "n_b")
    found = cut(_links(star, held), "jaccard-star")
    release(lead)
    roots = components(found, "jaccard-first")

    # what is left: pairs of different components that share a prefix n-gram
    placed = prefix.join(roots, "node", "left").select("gram", "node", "n", "place", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gram")
    mixed = cut(mixed, "jaccard-mixed-grams")
    rest = cut(placed.join(mixed, "gram"), "jaccard-mixed")
    release(prefix, mixed)
    one, other = (rest.select("gram", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "place", "root"))) for x in "ab")
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    enough = F.lit(100 + PERCENT) * room >= F.lit(PERCENT) * (F.col("n_a") + F.col("n_b"))
    pairs = one.join(other, (one["gram"] == other["gram"]) & (F.col("root_a") != F.col("root_b")) & (F.col("a") < F.col("b")) & _near_sizes("n_a", "n_b") & enough)
    pairs = cut(pairs.select("a", "b", "n_a", "n_b").distinct(), "jaccard-pairs")
    release(rest)
    late = cut(_links(pairs, held), "jaccard-rest")
    release(pairs)

    # links between components join them
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    between = late.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = components(between, "jaccard-second").select(F.col("node").alias("root"), F.col("root").alias("top"))

    named = info.select("doc_id", "print", "n", F.col("node").alias("own"), F.col("same").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(tops, "root", "left").withColumn("top", F.coalesce("top", "root"))
    named = cut(named, "jaccard-named")
    least = named.groupBy("top").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("stays"))
    least = cut(least, "jaccard-least")
    return named.join(least, "top").select("doc_id", "print", F.col("n").alias("n_shingles"), "component_id", (F.col("own") == F.col("stays.own")).alias("stays"))


def jaccard_report(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one with the least id."""
    stays = jaccard_components(docs).where("stays").select("doc_id", "print")
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.struct(*docs.columns).alias("row"))
    # an id that is null stays null in the join; rows equal in id and text are one
    same = keyed["doc_id"].eqNullSafe(stays["doc_id"]) & (keyed["print"] == stays["print"])
    held = keyed.join(stays, same, "left_semi").dropDuplicates(["doc_id", "print"])
    return held.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


#: The same by definition: all pairs that share a shingle, then reachability.
JACCARD_SQL = """
with recursive split as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from split),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select p.a, p.b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * shared >= 80 * (x.n + y.n - shared)),
sides as (select a, b from links union select b, a from links),
reach as (
  select doc_id as d, doc_id as r from documents
  union
  select s.b, reach.r from reach join sides s on s.a = reach.d)
select d.doc_id, coalesce(n, 0) as n_shingles, least_id as component_id
from documents d join (select d, min(r) as least_id from reach group by d) c on c.d = d.doc_id left join sizes z on z.doc_id = d.doc_id
"""
