"""Links and anchors of HTML pages held in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINK = r"""<(?:a|link|script|img)\b[^>]*?\b(?:href|src)\s*=\s*"([^"]*)\""""
_ID = r"""<[a-zA-Z][^>]*?\bid\s*=\s*"([^"]*)\""""


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link, path, is_local): each distinct reference of each page.

    Local references have no scheme and no host; their path is decoded, without query and fragment, and
    a folder stands for its index page.
    """
    raw = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("link"))
    path = F.regexp_replace("link", "[?#].*$", "")
    local = ~F.col("link").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~F.col("link").startswith("//")
    path = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    path = F.when(path.endswith("/"), F.concat(path, F.lit("index.html"))).otherwise(path)
    return raw.select("page_id", "link", F.when(local, path).alias("path"), local.alias("is_local"))


def anchors(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_ID), 1)).alias("anchor")).distinct()


def broken(links_table: DataFrame, targets: DataFrame) -> DataFrame:
    """Local references whose path isn't among ``targets`` (path)."""
    return links_table.where("is_local and path <> ''").join(targets.select("path").distinct(), "path", "left_anti")


def resolved(own: Column, path: Column) -> Column:
    """A reference's path from the root, as the page ``own`` means it: its folder before relative ones, steps taken."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(own, "[^/]*$", ""), path))
    steps = F.aggregate(
        F.split(whole, "/"), F.array().cast("array<string>"),
        lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s.isin("", "."), a).otherwise(F.concat(a, F.array(s))),
    )
    return F.when(path == "", own).otherwise(F.concat(F.lit("/"), F.array_join(steps, "/")))


def broken_anchors(pages: DataFrame) -> DataFrame:
    """(page_id, link, path, anchor): local references to an anchor that its page doesn't have.

    ``pages`` has page_id, path (from the root) and html.  An empty path is the page itself, one without a
    leading slash starts at the page's folder.  Paths that no page has are for ``broken``.
    """
    found = links(pages.select(F.struct("page_id", F.col("path").alias("own")).alias("page_id"), "html")).where("is_local")
    raw = F.regexp_extract("link", "(?s)#(.*)$", 1)
    own, path = F.col("page_id.own"), F.col("path")
    target = resolved(own, path)
    asked = found.select("page_id", "link", target.alias("path"), F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw).alias("anchor"), own.alias("own"))
    # the site generator's 404 page keeps a skip link without its target
    asked = asked.where("anchor <> '' and not (own like '%/404.html' and anchor = '__skip')").join(pages.select("path").distinct(), "path", "left_semi")
    held = anchors(pages.select(F.col("path").alias("page_id"), "html")).withColumnRenamed("page_id", "path")
    return asked.join(held, ["path", "anchor"], "left_anti").select("page_id.page_id", "link", "path", "anchor")


def missing_copy(pages: DataFrame, required: DataFrame) -> DataFrame:
    """The rows of ``required`` (path, copy) whose page is absent or doesn't hold the copy as its text stands."""
    held = required.join(pages.select("path", "html"), "path").where(F.contains("html", "copy")).select("path", "copy")
    return required.select("path", "copy").join(held, ["path", "copy"], "left_anti")
