"""Document graphs as node and edge tables: integrity, ranks, cycles, neighbourhoods, statistics."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.storage import cut


def unresolved(references: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """References to what isn't there."""
    return references.join(targets.select(F.col(target_key).alias(key)).distinct(), key, "left_anti")


def coverage_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys that only one of two tables has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("missing").alias("side"), key).union(b.join(a, key, "left_anti").select(F.lit("unexpected").alias("side"), key))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")


class CycleError(ValueError):
    """The dependencies have a cycle."""


def dag_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rank): 0 without dependencies, else one more than the greatest rank among them.

    ``edges`` has (id, depends_on).  Each round settles the nodes whose dependencies are all settled, so
    there are as many rounds as ranks; a round that settles nothing has met a cycle.
    """
    left = edges.select("id", "depends_on").distinct()
    total, rank = nodes.count(), 0
    settled = cut(nodes.join(left, "id", "left_anti").select("id", F.lit(0).alias("rank")), "rank-0")
    done = settled.count()
    while done < total:
        rank += 1
        known = settled.select(F.col("id").alias("depends_on"), F.lit(1).alias("known"))
        ready = left.join(known, "depends_on", "left").groupBy("id").agg(F.min(F.coalesce("known", F.lit(0))).alias("all_known")).where("all_known = 1").select("id")
        fresh = ready.join(settled.select("id"), "id", "left_anti").select("id", F.lit(rank).alias("rank"))
        settled = cut(settled.union(fresh), f"rank-{rank}")
        before, done = done, settled.count()
        if done == before:
            raise CycleError(f"{total - done} nodes depend on each other")
    return settled


def neighbourhood(edges: DataFrame, focus: str) -> DataFrame:
    """Edges from or to ``focus``, and the node at the other end: two equality filters, not one "or"."""
    out = edges.where(F.col("source") == focus).select("source", "target", F.col("target").alias("neighbour"))
    into = edges.where((F.col("target") == focus) & (F.col("source") != focus)).select("source", "target", F.col("source").alias("neighbour"))
    return out.unionAll(into)


def rank_histogram(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("rank").agg(F.count("*").alias("nodes"))


def fingerprint(rows: DataFrame, key: str, content: str) -> DataFrame:
    """One digest of a table of documents, whatever their order.

    A tree over the hexadecimal digits of the row digests: a leaf's digest is that of the sorted row digests that
    begin with its eight digits, an inner node's that of its children's in order, two digits at a time.  So a node
    has at most 256 children and, of 2**32 leaves, a leaf few rows; equal rows count.
    """
    digest = F.sha2(F.concat_ws("\x00", F.col(key).cast("string"), content), 256)
    level = rows.select(digest.alias("name"), digest.alias("d"))
    for digits in (8, 6, 4, 2, 0):
        own = F.substring("name", 1, digits).alias("name") if digits else F.lit("").alias("name")
        children = level.select(own, F.struct(F.col("name").alias("child"), "d").alias("c"))
        level = children.groupBy("name").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["d"]), ""), 256).alias("d"))
    return level.select(F.col("d").alias("fingerprint"))


def ordered_digest(rows: DataFrame, key: str, content: str, first: bytes = b"") -> str:
    """SHA-256 of ``first``, then key and content of every row in the order of keys, one after the other.

    Such a digest has one order, so its rows stream through the driver, one partition at a time; for a corpus
    of any size there is ``fingerprint``.
    """
    digest = hashlib.sha256(first)
    for r in rows.select(F.col(key).cast("string").alias("k"), F.col(content).cast("string").alias("c")).orderBy("k").toLocalIterator():
        digest.update((r.k or "").encode() + (r.c or "").encode())
    return digest.hexdigest()


def layout(ranked: DataFrame, edges: DataFrame, width: float = 200.0, height: float = 90.0) -> tuple[DataFrame, DataFrame]:
    """((id, rank, place, x, y), (source, target, x1, y1, x2, y2)) of a drawing: a column for each rank.

    ``ranked`` has id, rank and title; nodes of a column stand in the order of their titles, columns are centred.
    """
    placed = ranked.select("id", "rank", (F.row_number().over(Window.partitionBy("rank").orderBy("title", "id")) - 1).alias("place"))
    rows = placed.groupBy("rank").agg(F.count("*").alias("rows"))
    most = rows.agg(F.max("rows")).first()[0] or 0
    nodes = placed.join(rows, "rank").select(
        "id", "rank", "place", (F.col("rank") * F.lit(width)).alias("x"), ((F.lit(float(most)) - F.col("rows")) * F.lit(height) / 2 + F.col("place") * F.lit(height)).alias("y")
    )
    one, other = (nodes.select(F.col("id").alias(end), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for end, k in (("source", 1), ("target", 2)))
    return nodes, edges.select("source", "target").join(one, "source").join(other, "target")
