import hashlib
import json

import pytest

from sedimark.operators.graph import CycleError
from sedimark.sources import pages, portal


def write(folder, name, depends=(), **changes):
    fields = {"schema": portal.DOCUMENT_SCHEMA, "id": name, "title": f"About {name}", "kind": "document", "version": "1", "status": "current", "created": "2024-01-01", "updated": "2024-01-02"} | changes
    lists = {k: () for k in portal.LISTS} | {"owners": ("ada", "bo"), "depends_on": depends}
    header = "".join(f"{k}: {v}\n" for k, v in fields.items() if v is not None) + "".join(f"{k}: []\n" if not v else f"{k}:\n" + "".join(f"  - {x}\n" for x in v) for k, v in lists.items())
    (folder / f"{name}.md").write_text(f"---\n{header}---\n# {name}\n")


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "base")
    write(tmp_path, "middle", ("base",))
    write(tmp_path, "top", ("middle", "base"))
    config = {
        "schema": "c", "repository": {"sourceUrl": "https://example.org/r", "revision": "a b"}, "product": {"name": "x"}, "runtimeLayers": [{"id": "l", "title": "L"}], "platformBoundaries": [],
        "categories": [{"id": "one", "title": "One", "documentIds": ["base", "top"]}, {"id": "two", "title": "Two", "documentIds": ["middle"]}],
    }
    (tmp_path / "portal.json").write_text(json.dumps(config))
    return tmp_path


def test_dataset(spark, folder):
    data = portal.load(spark, str(folder), str(folder / "portal.json")).dataset()
    assert data["stats"] == {"categories": 2, "layers": 1, "documents": 3, "dependencies": 3}
    assert [(d["id"], d["rank"], d["category"]) for d in data["documents"]] == [("base", 0, "one"), ("middle", 1, "two"), ("top", 2, "one")]
    assert data["documents"][0]["source_url"] == "https://example.org/r/blob/a+b/base.md" and data["documents"][0]["owners"] == ["ada", "bo"]
    again = portal.load(spark, str(folder), str(folder / "portal.json")).dataset()
    assert again == data
    files = [(folder / f"{n}.md") for n in ("base", "middle", "top")]
    plain = hashlib.sha256((folder / "portal.json").read_bytes() + b"".join(f.name.encode() + f.read_bytes() for f in files))
    assert data["sourceFingerprint"] == plain.hexdigest()
    drawing = portal.load(spark, str(folder), str(folder / "portal.json")).drawing()
    assert drawing.count("<rect") == 3 and drawing.count("<line") == 3
    (folder / "base.md").write_text((folder / "base.md").read_text() + "more\n")
    assert portal.load(spark, str(folder), str(folder / "portal.json")).dataset()["sourceFingerprint"] != data["sourceFingerprint"]


def test_problems_are_listed_together(spark, folder):
    write(folder, "top", ("middle", "nowhere"))
    write(folder, "extra")
    with pytest.raises(portal.PortalError) as error:
        portal.load(spark, str(folder), str(folder / "portal.json"))
    assert "top: depends_on nowhere is unknown" in str(error.value) and "missing: extra" in str(error.value)
    write(folder, "top", title=None)
    (folder / "extra.md").write_text("no header")
    with pytest.raises(portal.PortalError) as error:
        portal.load(spark, str(folder), str(folder / "portal.json"))
    assert "top.md: missing: title" in str(error.value) and "extra.md: no front matter" in str(error.value)


def test_a_cycle_is_refused(spark, folder):
    write(folder, "base", ("top",))
    with pytest.raises(CycleError):
        portal.load(spark, str(folder), str(folder / "portal.json"))


def test_page_links(spark):
    html = '<a href="/a%20b/">x</a><img src="https://e.org/i.png"><a href="//h/p"></a><a class="k" href="#top"></a><h1 id="top"></h1><a href="/a%20b/">again</a>'
    rows = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    found = {r.link: (r.path, r.is_local) for r in pages.links(rows).collect()}
    assert found == {"/a%20b/": ("/a b/index.html", True), "https://e.org/i.png": (None, False), "//h/p": (None, False), "#top": ("", True)}
    assert [r.anchor for r in pages.anchors(rows).collect()] == ["top"]
    targets = spark.createDataFrame([("/other",)], "path string")
    assert [r.path for r in pages.broken(pages.links(rows), targets).collect()] == ["/a b/index.html"]


def test_broken_anchors(spark):
    one = '<h1 id="top"><h2 id="a b"><a href="#top"><a href="#x"><a href="/d/q.html?v#a%20b"><a href="d/q.html#in"><a href="/none.html#x"><a href="https://e.org/#x"><a href="#">'
    two = '<h1 id="in"><a href="../p.html#a%20b"><a href="../p.html#y"><a href="./#z"><a href="/d/#in">'
    rows = [(1, "/p.html", one), (2, "/d/q.html", two), (3, "/d/index.html", "<p>"), (4, "/404.html", '<a href="#__skip">'), (5, "/e.html", None)]
    found = pages.broken_anchors(spark.createDataFrame(rows, "page_id long, path string, html string")).collect()
    assert sorted(map(tuple, found)) == [
        (1, "#x", "/p.html", "x"), (1, "/d/q.html?v#a%20b", "/d/q.html", "a b"), (2, "../p.html#y", "/p.html", "y"),
        (2, "./#z", "/d/index.html", "z"), (2, "/d/#in", "/d/index.html", "in"),
    ]
