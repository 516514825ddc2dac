import re
from urllib.parse import urljoin

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import frontmatter, links, text
from docloom.operators import frontmatter as ingest
from docloom.operators import links as link_tables


def V():
    return F.col("v")


ODD_SPACES = [chr(c) for c in (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x2003, 0x2028, 0x2029, 0x3000)]


def cleaned(value: str) -> str:
    """The rule in plain Python."""
    value = re.sub("\n{3,}", "\n\n", value)
    return "\n".join(line.rstrip() for line in value.splitlines())


def test_cleanup_goldens(apply):
    cases = {
        "a  \n\n\n\nb\n \n \n \nc\n": "a\n\nb\n\n\n\nc",
        "a\r\nb\x85c": "a\nb\nc",
        "a\u00a0\nb": "a\nb",
        "": "",
        "\n": "",
        "a\n  ": "a\n",
    }
    assert apply(list(cases), text.clean_markdown(V())) == list(cases.values())


@settings(max_examples=4, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.lists(st.sampled_from(["a", "b c", " ", "\t", "\n", "\n\n", "\r", "\r\n", *ODD_SPACES]), max_size=12).map("".join),
        min_size=150, max_size=150,
    )
)
def test_cleanup_matches_the_rule(apply, values):
    assert apply(values, text.clean_markdown(V())) == [cleaned(v) for v in values]


def test_link_pattern(apply):
    body = "[![alt](img.png)](page) ![i](s.png) [x]() [a](b_(c)) <http://auto>"
    [found] = apply([body], links.extract(V()))
    assert [(r["text"], r["href"]) for r in found] == [("![alt", "img.png"), ("i", "s.png"), ("a", "b_(c")]


def test_rewrite(apply):
    base = "https://h.com/a/index"
    cases = {
        "[x](b)": "[x](https://h.com/a/b)",
        "p [x](/r) q [y](#z) [m](mailto:x@y) [h](https://k/l) end": "p [x](https://h.com/r) q [y](#z) [m](mailto:x@y) [h](https://k/l) end",
        "[![alt](img.png)](page)": "[![alt](https://h.com/a/img.png)](page)",
        "```\n[in code](c)\n```": "```\n[in code](https://h.com/a/c)\n```",
        "no links": "no links",
        "[H](HTTPS://h.com/x)": "[H](https://h.com/x)",
    }
    once = apply(list(cases), links.rewrite(V(), F.lit(base)))
    assert once == list(cases.values())
    assert apply(once, links.rewrite(V(), F.lit(base))) == once
    assert apply(["[x](b)"], links.rewrite(V(), F.lit(None).cast("string"))) == ["[x](b)"]


pieces = st.sampled_from(
    ["[", "]", "(", ")", "!", "[a](b)", "[t](../c?d#e)", "](", "text ", "\n", "[x](#y)", "[m](mailto:q)", "$1", "\\"]
)


@settings(max_examples=3, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(pieces, max_size=10).map("".join), min_size=120, max_size=120))
def test_rewrite_matches_a_regex_callback(apply, bodies):
    base = "https://h.com/a/index"

    def swap(match):
        href = match.group(2)
        if re.match("http:|https:|mailto:|#", href):
            return match.group(0)
        return f"[{match.group(1)}]({urljoin(base, href)})"

    expected = [re.sub(r"\[([^\]]*)\]\(([^)]+)\)", swap, b) for b in bodies]
    assert apply(bodies, links.rewrite(V(), F.lit(base))) == expected


def test_link_table(spark):
    docs = spark.createDataFrame(
        [("d", "https://h/a/b", "[x](c) [y](#z) [w](https://k)"), ("e", None, "[x](c)")],
        "doc_path string, source_url string, body string",
    )
    rows = {(r.doc_path, r.ord): (r.kind, r.resolved) for r in link_tables.body_links(docs, "doc_path").collect()}
    assert rows == {
        ("d", 0): ("resolved", "https://h/a/c"),
        ("d", 1): ("anchor", "#z"),
        ("d", 2): ("absolute", "https://k"),
        ("e", 0): ("resolved", "c"),
    }


def test_plain_frontmatter(spark):
    contents = [
        '---\ntitle: "T"\nsource_url: "https://x/y"\n---\n\n\n  body\nz',
        "no header",
        "---\na: 1\nb\na : 2: 3\n---\nrest",
        "--- \n\nk: v\n---\t\n\u00a0\nB",
        "---\nopen: 1\n",
    ]
    rows = ingest.parse_plain(
        spark.createDataFrame(list(enumerate(contents)), "i int, content string")
    ).orderBy("i").collect()
    assert [r.fields for r in rows] == [
        {"title": '"T"', "source_url": '"https://x/y"'}, {}, {"a": "2: 3"}, {"k": "v"}, {},
    ]
    assert [r.body for r in rows] == ["  body\nz", "no header", "rest", "B", "---\nopen: 1\n"]


def test_yaml_frontmatter(spark):
    contents = [
        '---\ntitle: "a \\d b"\n---\nx',
        '---\ntitle: "C:\\new"\n---\nx',
        "---\njust text\n---\nx",
        "plain",
        "---\nsource_url: https://h/a\nn: 3\n---\nx",
    ]
    rows = ingest.parse_yaml(
        spark.createDataFrame(list(enumerate(contents)), "i int, content string")
    ).orderBy("i").collect()
    assert [r.fields for r in rows] == [
        None, {"title": "C:\new"}, None, None, {"source_url": "https://h/a", "n": "3"},
    ]
    assert [r.error is not None for r in rows] == [False, False, True, False, False]


def test_header_round_trip(apply):
    import yaml

    titles = ['plain', 'say "x"', r"back\slash \d", "a: b"]
    headers = apply(titles, frontmatter.render(V(), F.lit("https://h/a"), F.lit(None).cast("string")))
    for title, header in zip(titles, headers):
        assert header.startswith("---\n") and header.endswith("---\n\n")
        assert yaml.safe_load(header.strip().strip("-")) == {"title": title, "source_url": "https://h/a"}
