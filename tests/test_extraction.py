import gc
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.operators import bundles, collisions, extraction
from docloom.operators import page_markdown as pm
from docloom.plans.corpus import build, convert
from docloom.sources.collection import Collection
from docloom.sources.pages import read_html_tree

STAMP = datetime(2024, 5, 1, 12, 0, tzinfo=timezone.utc)


def markdown(html: str) -> str:
    return pm.to_markdown(pm.content_container(pm.parse(html)))


def title(html: str):
    return pm.page_title(pm.parse(html))[0]


def test_title_fallbacks():
    assert title("<title> T </title><h1>H</h1>") == "T"
    assert title("<title></title><h1> H <i>x</i></h1>") == "H x"
    assert title("<title>  </title><h1>H</h1>") == ""
    assert title("<p>x</p>") == C.DEFAULT_TITLE
    assert title("<div class=nav><h1>In nav</h1></div>") == "In nav"
    assert pm.page_title(pm.parse("<title></title>"))[1] is not None


@pytest.mark.parametrize("html,text", [
    ("<article>A</article><main>M</main>", "M"),
    ("<article>1</article><article>2</article>", "1"),
    ("<body><div class='a content b'>C</div>B</body>", "C"),
    ("<body>B</body>", "B"),
    ("<body><main></main>B</body>", ""),
])
def test_container_choice(html, text):
    assert markdown(html) == text


def test_no_container():
    assert pm.content_container(pm.parse("<html><p>x</p></html>")) is None


@pytest.mark.parametrize("tag", C.NOISE_TAGS)
def test_noise_tags(tag):
    inner = f"<{tag}>" if tag in pm.VOID_TAGS else f"<{tag}>x</p></{tag}>" if tag in ("script", "style") else f"<{tag}>x</{tag}>"
    assert markdown(f"<main>a{inner}b</main>") == "ab"


@pytest.mark.parametrize("selector", C.NOISE_SELECTORS)
def test_noise_selectors(selector):
    if selector[0] == ".":
        inner = f"<div class='z {selector[1:]}'>x</div>"
    elif selector[0] == "#":
        inner = f"<div id='{selector[1:]}'>x</div>"
    else:
        inner = f"<{selector}>x</{selector}>"
    assert markdown(f"<main><p>a</p>{inner}<p>b</p></main>") == "a\n\nb"
    # The container itself is never noise.
    assert markdown(f"<main class='{selector[1:]}'><p>a</p></main>") == "a"


def test_nav_and_aside_tags_stay():
    assert markdown("<main><nav>n</nav><aside>s</aside></main>") == "n\n\ns"


@pytest.mark.parametrize("html,text", [
    ("<h1>A <b>b</b></h1><h3>C</h3>", "# A **b**\n\n### C"),
    ("<p>a <em>b</em> <code>c_d</code><br>e</p>", "a *b* `c_d`  \ne"),
    ("<p>5 * 3 a_b &amp; &lt;x&gt;</p>", "5 \\* 3 a\\_b & <x>"),
    ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "* a\n  + b\n* c"),
    ("<ol start='3'><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"),
    ("<pre><code>x  *y*\n z</code></pre>", "```\nx  *y*\n z\n```"),
    ("<a href='/x'>t</a> <a href='http://k'>http://k</a> <a href='y' title='T'>z</a>", "[t](/x) <http://k> [z](y \"T\")"),
    ("<img src='s.png' alt='a b'>", "![a b](s.png)"),
    ("<p>a<!-- no -->b</p>", "ab"),
    ("<p><b>T<br><p>one</p><p>two</p>", "**T  \n\none\n\ntwo**"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
    ("<table><tr><td>1</td></tr></table>", "|  |\n| --- |\n| 1 |"),
    ("<p>a</p>\n\n   <p>b\n   c</p>", "a\n\nb\nc"),
])
def test_dialect(html, text):
    assert markdown(f"<main>{html}</main>") == text


def test_very_deep_nesting():
    assert markdown("<main>" + "<div><b>" * 3000 + "x" + "</main>").strip("*") == "x"


SITE = [
    "index", "install/index", "install/linux", "install/linux/index", "rest/index", "rest/tokens",
    "rest/v2/index", "rest/v2/orders", "faq", "about/team/index",
]


def test_saved_site_becomes_a_bundle(spark, tmp_path):
    root = tmp_path / "crawl" / "kb.example.net"
    for name in SITE:
        file = root / f"{name}.html"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(
            f"<head><title>Page {name}</title></head><body><nav>skip</nav><main><h1>{name.upper()}</h1>"
            f"<p>Go <a href='next.html'>on</a>.</p></main>"
        )
    (root / "style.css").write_text("x")
    pages = read_html_tree(spark, str(tmp_path / "crawl"))
    assert pages.count() == 10
    store = Collection(spark, str(tmp_path / "store"))
    report, rejects = build(pages, store, STAMP, export_path=str(tmp_path / "out"))
    docs = {r.doc_path: r for r in store.read().collect()}
    assert set(docs) == {f"kb.example.net/{name}.md" for name in SITE}
    orders = docs["kb.example.net/rest/v2/orders.md"]
    assert orders.source_url == "https://kb.example.net/rest/v2/orders"
    assert orders.title == "Page rest/v2/orders"
    assert orders.body == "# REST/V2/ORDERS\n\nGo [on](https://kb.example.net/rest/v2/next.html)."
    [row] = report.collect()
    assert (row.bundle, row.n_md, row.valid, row.errors, row.warnings) == ("kb.example.net", 10, True, [], [])
    assert bundles.index_pages(store.read()).first().n_index == 6
    assert rejects.count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).where("bundle = 'kb.example.net'").count() == 10
    exported = spark.read.json(str(tmp_path / "out-descriptors")).collect()
    assert [r.bundle for r in exported] == ["kb.example.net"] and exported[0].descriptor.startswith("---\nname: kb")
    # A second delivery overwrites its path and keeps the others.
    newer = spark.createDataFrame(
        [(1, "https://kb.example.net/index.html", "<main>New</main>")], "page_id long, url string, html string"
    )
    build(newer, store, STAMP)
    assert store.version() == 2
    again = {r.doc_path: r.body for r in store.read().collect()}
    assert len(again) == 10 and again["kb.example.net/index.md"] == "New"


def test_whole_tree_is_read(spark, tmp_path):
    """Names with an underscore, signs that need care in URLs, and a host in mixed case."""
    names = ["_modules/core", "guide/_intro", "guide/a#b", "guide/a", "guide/b c", "_static/_x/_y"]
    for name in names:
        file = tmp_path / "crawl" / "Docs.Example.org" / f"{name}.html"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"<title>{name}</title><main>{name}</main>")
    (tmp_path / "crawl" / "Docs.Example.org" / ".hidden.html").write_text("<main>no</main>")
    pages = read_html_tree(spark, str(tmp_path / "crawl"))
    docs, rejects = convert(pages, STAMP)
    assert {r.doc_path: r.title for r in docs.collect()} == {
        f"Docs.Example.org/{name.replace('#', '_').replace(' ', '_')}.md": name for name in names
    }
    assert {r.bundle for r in docs.collect()} == {"docs.example.org"} and rejects.count() == 0


def test_missing_folder_is_empty(spark, tmp_path):
    assert read_html_tree(spark, str(tmp_path / "nothing")).count() == 0


def test_collisions_and_rejects(spark):
    good, bad = "<main>x</main>", "<p>no container</p>"
    pages = spark.createDataFrame(
        [
            (1, "https://h/a@b.html", good), (2, "https://h/a=b.html", good),
            (3, "https://h/c@d.html", good), (4, "https://h/c=d.html", bad),
            (5, "ftp://h/x", good), (6, "https://h/t", "<title></title><main>t</main>"),
            (7, "https://h/n", None), (8, "https://h/../up", good),
        ],
        "page_id long, url string, html string",
    )
    docs, rejects = convert(pages, STAMP)
    assert {r.doc_path: r.page_id for r in docs.collect()} == {"h/a_b.md": 2, "h/c_d.md": 3, "h/t.md": 6}
    found = {(r.stage, r.page_id): r.reason for r in rejects.collect()}
    assert set(found) == {
        ("collision", 1), ("extract", 4), ("url", 5), ("title", 6), ("extract", 7), ("path", 8),
    }
    assert found[("collision", 1)] == "path taken by page 2"


def test_one_path_shared_by_most_pages(spark):
    docs = spark.range(1000).select(
        F.lit("h").alias("bundle"),
        F.when(F.col("id") < 700, "h/hot.md").otherwise(F.concat(F.lit("h/"), F.col("id").cast("string"))).alias("doc_path"),
        F.col("id").alias("page_id"),
    )
    kept = collisions.keep_winners(docs)
    assert kept.count() == 301
    assert kept.where("doc_path = 'h/hot.md'").first().page_id == 699


def test_fetch_time_column(spark):
    pages = spark.createDataFrame([(1, "https://h/a", "<main>x</main>")], "page_id long, url string, html string")
    parsed = extraction.parse_pages(pages)
    row = extraction.with_document_fields(parsed, STAMP).first()
    rendered = (
        '---\ntitle: "Untitled"\nsource_url: "https://h/a"\nfetched_at: "2024-05-01T12:00:00.000000+00:00"\n---\n\nx'
    )
    assert row.md_bytes == len(rendered)


def test_own_fetch_time_is_kept(spark):
    own = datetime(2020, 2, 2, tzinfo=timezone.utc)
    pages = spark.createDataFrame(
        [(1, "https://h/a", "<main>x</main>", own), (2, "https://h/b", "<main>x</main>", None)],
        "page_id long, url string, html string, fetched_at timestamp",
    )
    docs, _ = convert(pages, STAMP)
    at = {r.page_id: r.t for r in docs.select("page_id", F.unix_timestamp("fetched_at").alias("t")).collect()}
    assert at == {1: int(own.timestamp()), 2: int(STAMP.timestamp())}


def test_parsed_pages_leave_in_small_parts_and_trees_go_at_once(monkeypatch):
    pages = [f"<title>t{i}</title><body><p>{'x' * 100 * i}<b>{i}</b></p></body>" for i in range(30)] + [None, "<p>no"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(32)), pa.array(pages)], ["page_id", "html"])
    whole = pa.Table.from_batches(extraction._parse_batches(extraction.PARSED)(iter([batch])))
    monkeypatch.setattr(extraction, "PAGES_AT_ONCE", 4)
    monkeypatch.setattr(extraction, "BYTES_AT_ONCE", 5_000)
    gc.collect()
    gc.disable()
    try:
        parts = list(extraction._parse_batches(extraction.PARSED)(iter([batch])))
        left = sum(isinstance(x, pm.Element) for x in gc.get_objects())
    finally:
        gc.enable()
    assert left <= 1 and max(p.num_rows for p in parts) <= 4 and len(parts) > 8
    assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
    assert [r["markdown"] for r in whole.to_pylist()][:2] == ["**0**", f"{'x' * 100}**1**"]
