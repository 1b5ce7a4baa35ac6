"""A portal over documents with front matter: read, check, rank, and publish as one dataset.

Documents and configuration become tables; every check is a query that returns what is wrong, so a
corpus with many faults reports them all at once.
"""

from __future__ import annotations

import html
import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import graph
from sedimark.sources import pages

DOCUMENT_SCHEMA, PORTAL_SCHEMA = "sedimark.document/v1", "sedimark.portal.v1"
# The fields of a document's front matter.
LISTS = ("owners", "governed_by", "depends_on", "related", "supersedes")
SCALARS = ("schema", "id", "title", "kind", "version", "status", "created", "updated")
_HEADER = r"(?s)^---\n(.*?)\n---(?:\n|$)"
_LIST = r"(?m)^{}:[ ]*(?:\[\][ ]*)?\n?((?:  - .+\n?)*)"
# The fields of the portal's configuration.
_CONFIG = (
    "schema string, repository struct<sourceUrl: string, revision: string>, product map<string,string>, categories array<struct<id: string, title: string, documentIds: array<string>>>, "
    "runtimeLayers array<struct<id: string, title: string>>, platformBoundaries array<struct<id: string, title: string>>"
)


class PortalError(ValueError):
    """The documents or the configuration break a rule; the message lists how."""


def _scalar(header: Column, key: str) -> Column:
    found = F.regexp_extract(header, rf"(?m)^{key}: (.+)$", 1)
    return F.when(found != "", F.trim(found))


def _items(header: Column, key: str) -> Column:
    block = F.regexp_extract(header, _LIST.format(key), 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"  - (.+)"), 1), lambda item: F.trim(item))


def documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """One row for each file: path, content, header, its fields, and the keys found in it."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    raw = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("path"), F.col("value").alias("content"), F.regexp_extract("value", _HEADER, 1).alias("header"))
    keys = F.regexp_extract_all("header", F.lit(r"(?m)^([a-z_]+):"), 1)
    return raw.select("path", "content", "header", keys.alias("keys"), *(_scalar(F.col("header"), k).alias(k) for k in SCALARS), *(_items(F.col("header"), k).alias(k) for k in LISTS))


def header_problems(found: DataFrame) -> DataFrame:
    """(path, problem) of every document whose front matter breaks a rule."""
    expected = F.array(*map(F.lit, (*SCALARS, *LISTS)))
    odd = F.filter(F.split("header", "\n"), lambda line: ~line.rlike(r"^([a-z_]+:( .*)?|  - .+)$"))
    tests = (
        (F.col("header") == "", F.lit("no front matter")),
        (F.size(F.array_except(expected, "keys")) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(F.array_except(expected, "keys")), ", "))),
        (F.size(F.array_except("keys", expected)) > 0, F.concat(F.lit("unexpected: "), F.array_join(F.array_sort(F.array_except("keys", expected)), ", "))),
        (F.size("keys") != F.size(F.array_distinct("keys")), F.lit("a key is repeated")),
        (F.size(odd) > 0, F.concat(F.lit("unreadable line: "), F.element_at(odd, 1))),
        (F.exists(F.array(*(F.col(k) for k in SCALARS)), lambda v: v.isNull()), F.lit("a field has no value")),
        ((F.col("schema") != DOCUMENT_SCHEMA) | (F.col("kind") != "document"), F.lit("unsupported schema or kind")),
    )
    return found.select("path", F.explode(F.array_compact(F.array(*(F.when(test, text) for test, text in tests)))).alias("problem"))


def edges(found: DataFrame, relation: str = "depends_on") -> DataFrame:
    """(id, depends_on) for one relation."""
    return found.select("id", F.explode(relation).alias("depends_on"))


def reference_problems(found: DataFrame) -> DataFrame:
    """References to documents that don't exist, by relation."""
    out = None
    for relation in ("governed_by", "depends_on", "related"):
        lost = graph.unresolved(edges(found, relation), "depends_on", found, "id").select(F.lit(relation).alias("relation"), "id", "depends_on")
        out = lost if out is None else out.unionAll(lost)
    return out


def configuration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_CONFIG).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def categories(config: DataFrame) -> DataFrame:
    """(category, id) of every assignment."""
    return config.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category"), F.explode("c.documentIds").alias("id"))


def coverage_problems(found: DataFrame, config: DataFrame) -> DataFrame:
    """Documents in no category, assignments of unknown documents, and documents in several."""
    assigned = categories(config)
    twice = graph.duplicate_ids(assigned, "id").select(F.lit("assigned twice").alias("side"), "id")
    return graph.coverage_gaps(found, assigned, "id").unionAll(twice)


@dataclass
class Portal:
    documents: DataFrame
    edges: DataFrame
    config: DataFrame
    config_text: str = ""

    def stats(self) -> DataFrame:
        counts = self.config.select(F.size("categories").alias("categories"), F.size("runtimeLayers").alias("layers"))
        return counts.crossJoin(self.documents.agg(F.count("*").alias("documents"))).crossJoin(self.edges.agg(F.count("*").alias("dependencies")))  # of single rows

    def cards(self) -> DataFrame:
        """Every document with its category, rank and address at the source."""
        ranked = graph.dag_rank(self.documents.select("id"), self.edges)
        address = self.config.select(F.concat(F.col("repository.sourceUrl"), F.lit("/blob/"), F.url_encode(F.col("repository.revision")), F.lit("/")).alias("base"))
        joined = self.documents.join(categories(self.config), "id").join(ranked, "id").crossJoin(address)  # one address
        shown = ("id", "title", "path", "category", "version", "status", *LISTS, "rank")
        return joined.select(*shown, F.concat("base", F.replace(F.url_encode("path"), F.lit("+"), F.lit("%20"))).alias("source_url")).orderBy("rank", "title")

    def in_category(self, category: str) -> DataFrame:
        return self.cards().where(F.col("category") == category)

    def layout(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the dependency graph with their places in a drawing."""
        ranked = graph.dag_rank(self.documents.select("id"), self.edges).join(self.documents.select("id", "title"), "id")
        return graph.layout(ranked, self.edges.select(F.col("depends_on").alias("source"), F.col("id").alias("target")))

    def drawing(self, box: tuple[int, int] = (160, 60)) -> str:
        """The dependency graph as SVG; a node links to its document's card."""
        nodes, lines = ([r.asDict() for r in rows.collect()] for rows in self.layout())
        titles = {r.id: r.title for r in self.documents.select("id", "title").collect()}
        wide, high = box
        width, height = (max((n[c] for n in nodes), default=0) + size for c, size in (("x", wide), ("y", high)))
        parts = [f'<svg viewBox="0 0 {width:g} {height:g}" role="img">']
        for e in sorted(lines, key=lambda e: (e["source"], e["target"])):
            parts.append(f'<line x1="{e["x1"] + wide:g}" y1="{e["y1"] + high / 2:g}" x2="{e["x2"]:g}" y2="{e["y2"] + high / 2:g}" stroke="currentColor"/>')
        for n in sorted(nodes, key=lambda n: n["id"]):
            name = html.escape(n["id"])
            parts.append(f'<a href="#{name}"><rect x="{n["x"]:g}" y="{n["y"]:g}" width="{wide}" height="{high}" fill="none" stroke="currentColor"/>')
            parts.append(f'<text x="{n["x"] + 8:g}" y="{n["y"] + high / 2:g}">{html.escape(titles[n["id"]])}</text></a>')
        return "\n".join([*parts, "</svg>"])

    def page(self) -> str:
        """The portal as one HTML page: the drawing, then a section of cards for each category."""
        data = self.dataset()
        cards = {d["id"]: d for d in data["documents"]}
        parts = ["<!doctype html>", '<meta charset="utf-8">', f"<title>{html.escape(str(data['product'].get('name', 'Documents')))}</title>", self.drawing()]
        for category in data["categories"]:
            parts.append(f"<section id=\"category-{html.escape(category['id'])}\"><h2>{html.escape(category['title'])}</h2>")
            for name in category["documentIds"]:
                card = cards[name]
                needs = "".join(f'<li><a href="#{html.escape(x)}">{html.escape(cards[x]["title"])}</a></li>' for x in card["depends_on"])
                parts.append(f'<article id="{html.escape(name)}"><h3><a href="{html.escape(card["source_url"])}">{html.escape(card["title"])}</a></h3><p>{html.escape(card["version"])}, {html.escape(card["status"])}</p><ul>{needs}</ul></article>')
            parts.append("</section>")
        return "\n".join(parts) + "\n"

    def dataset(self) -> dict:
        """The published document; a corpus of documents written by people fits one."""
        config = json.loads(self.config.select(F.to_json(F.struct("*"))).first()[0])
        config.pop("schema")
        fingerprint = graph.ordered_digest(self.documents, "path", "content", self.config_text.encode())
        out = {"schema": PORTAL_SCHEMA, "sourceFingerprint": fingerprint, "stats": self.stats().first().asDict(), **config}
        out["documents"] = [r.asDict() for r in self.cards().collect()]
        out["edges"] = [{"from": r.depends_on, "to": r.id} for r in self.edges.orderBy("id", "depends_on").collect()]
        return out


def load(spark: SparkSession, folder: str, config_path: str) -> Portal:
    """The checked portal; raises :class:`PortalError` with all problems found."""
    found, config = documents(spark, folder), configuration(spark, config_path)
    problems = [f"{r.path}: {r.problem}" for r in header_problems(found).orderBy("path").collect()]
    problems += [f"repeated id {r.id}" for r in graph.duplicate_ids(found, "id").collect()]
    if not problems:
        problems += [f"{r.id}: {r.relation} {r.depends_on} is unknown" for r in reference_problems(found).collect()]
        problems += [f"{r.side}: {r.id}" for r in coverage_problems(found, config).collect()]
    if problems:
        raise PortalError("; ".join(problems))
    out = Portal(found, edges(found), config, spark.read.text(config_path, wholetext=True).first().value)
    graph.dag_rank(found.select("id"), out.edges)  # refuses a cycle
    return out


def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, path, html) of the HTML files under a folder."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.html", recursiveFileLookup=True)
    whole = F.try_url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^file:/*", "/"), F.lit("+"), F.lit("%2B")))
    path = F.substring(whole, len(os.path.abspath(folder)) + 1, 1 << 20)
    return found.select(F.xxhash64(path).alias("page_id"), path.alias("path"), F.col("value").alias("html"))


def site_problems(spark: SparkSession, folder: str) -> list[str]:
    """Local references of a site's pages to files or anchors that it lacks."""
    found = site_pages(spark, folder)
    top = os.path.abspath(folder)
    files = [(os.path.join(d, n)[len(top) :],) for d, _, names in os.walk(top) for n in names]
    targets = spark.createDataFrame(files, "path string") if files else spark.createDataFrame([], "path string")
    own = found.select("page_id", F.col("path").alias("page"))
    links = pages.links(found).where("is_local and path <> ''").join(own, "page_id").withColumn("path", pages.resolved(F.col("page"), F.col("path")))
    lost = pages.broken(links, targets).select("page", "link")
    anchors = pages.broken_anchors(found).join(own, "page_id").select("page", "link")
    return sorted(f"{r.page}: {r.link}" for r in lost.union(anchors).distinct().collect())


def compose_site(spark: SparkSession, folder: str, mounts: dict[str, str]) -> None:
    """Put the folders of ``mounts`` (place in the site, source) together as ``folder``, whole or not at all.

    The site is copied aside and checked there; two sources may not bring the same file.  One rename then
    shows it in place of the one before.  Raises :class:`PortalError` and leaves everything as it was.
    """
    target = os.path.abspath(folder)
    staged, before = (f"{target}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "before"))
    try:
        for place, source in mounts.items():
            for above, _, names in os.walk(source):
                at = os.path.normpath(os.path.join(staged, place.strip("/"), os.path.relpath(above, source)))
                os.makedirs(at, exist_ok=True)
                for name in names:
                    if os.path.lexists(os.path.join(at, name)):
                        raise PortalError(f"two sources bring {os.path.join(at, name)[len(staged):]}")
                    shutil.copy2(os.path.join(above, name), os.path.join(at, name), follow_symlinks=False)
        if problems := site_problems(spark, staged):
            raise PortalError("; ".join(problems))
        if os.path.lexists(target):
            os.rename(target, before)
        try:
            os.rename(staged, target)
        except OSError:
            if os.path.lexists(before):
                os.rename(before, target)
            raise
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    shutil.rmtree(before, ignore_errors=True)
