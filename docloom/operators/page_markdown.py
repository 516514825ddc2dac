"""One page of HTML to title, content container and Markdown text.

A small helper that runs inside the Arrow batches of ``extraction``. Markup is
often broken, so the tree rules are few: an end tag closes the nearest open
element of its name, and an element left open ends with its parent.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from docloom import constants as C

VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
EMPHASIS = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}
BULLETS = "*+-"

_NOISE_NAMES = frozenset(
    C.NOISE_TAGS + [s for s in C.NOISE_SELECTORS if s[0] not in ".#"]
)
_NOISE_CLASSES = frozenset(s[1:] for s in C.NOISE_SELECTORS if s[0] == ".")
_NOISE_IDS = frozenset(s[1:] for s in C.NOISE_SELECTORS if s[0] == "#")


class Element:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name, attrs, parent):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def classes(self):
        return (self.attrs.get("class") or "").split()

    def is_noise(self):
        return (
            self.name in _NOISE_NAMES
            or self.attrs.get("id") in _NOISE_IDS
            or not _NOISE_CLASSES.isdisjoint(self.classes())
        )


class TreeBuilder(HTMLParser):
    """Builds the tree and remembers the first element of each name of interest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.current = Element("", {}, None)
        self.open_names = {}
        self.first = {}

    def handle_starttag(self, tag, attrs):
        named = {}
        for key, value in attrs:
            named[key] = value or ""
        element = Element(tag, named, self.current)
        self.current.children.append(element)
        self.first.setdefault(tag, element)
        if tag == "div" and "content" in element.classes():
            self.first.setdefault("div.content", element)
        if tag not in VOID_TAGS:
            self.current = element
            self.open_names[tag] = self.open_names.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open_names.get(tag):
            return
        closed = None
        while closed != tag:
            closed = self.current.name
            self.open_names[closed] -= 1
            self.current = self.current.parent

    def handle_data(self, data):
        siblings = self.current.children
        if siblings and isinstance(siblings[-1], str):
            siblings[-1] += data
        else:
            siblings.append(data)

    def handle_comment(self, data):
        # A comment keeps the texts around it apart, and shows nothing itself.
        self.current.children.append(Element("!comment", {}, self.current))

    def dismantle(self):
        """Take the tree apart, so that it goes at once; elements and parents hold each other."""
        pending = [self.root]
        self.first.clear()
        self.current = self.root
        while pending:
            element = pending.pop()
            pending.extend(c for c in element.children if isinstance(c, Element))
            element.children, element.parent = [], None


def parse(html: str) -> TreeBuilder:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder


def text_of(element: Element) -> str:
    pieces, pending = [], [element]
    while pending:
        node = pending.pop()
        if isinstance(node, str):
            pieces.append(node)
        elif node is element or node.name not in ("script", "style", "!comment"):
            pending.extend(reversed(node.children))
    return "".join(pieces)


def page_title(tree: TreeBuilder) -> tuple[str, str | None]:
    """Title and a warning when the title element holds no single text."""
    warning = None
    node = tree.first.get("title")
    if node is not None:
        while isinstance(node, Element) and len(node.children) == 1:
            node = node.children[0]
        if isinstance(node, str):
            return node.strip(), None
        warning = "title element without a single text"
    heading = tree.first.get("h1")
    if heading is not None:
        return text_of(heading).strip(), warning
    return C.DEFAULT_TITLE, warning


def content_container(tree: TreeBuilder) -> Element | None:
    for name in ("main", "article", "div.content", "body"):
        if name in tree.first:
            return tree.first[name]
    return None


class _Frame:
    """An element being rendered, with what its surroundings mean for its text."""

    __slots__ = ("element", "position", "parts", "verbatim", "preformatted", "one_line", "depth")

    def __init__(self, element, outer=None):
        self.element, self.position, self.parts = element, 0, []
        name = element.name
        self.preformatted = name == "pre" or (outer is not None and outer.preformatted)
        self.verbatim = self.preformatted or name in ("code", "kbd", "samp") or (
            outer is not None and outer.verbatim
        )
        self.one_line = name in HEADINGS or name in ("td", "th") or (
            outer is not None and outer.one_line
        )
        self.depth = (outer.depth if outer is not None else 0) + (name == "ul")


def to_markdown(container: Element) -> str:
    """Depth-first without recursion: unclosed elements may nest very deep."""
    stack = [_Frame(container)]
    while True:
        frame = stack[-1]
        children = frame.element.children
        if frame.position == len(children):
            stack.pop()
            rendered = _render(frame, _join(frame.parts))
            if not stack:
                return rendered.strip("\n")
            stack[-1].parts.append(rendered)
            continue
        child = children[frame.position]
        frame.position += 1
        if isinstance(child, str):
            frame.parts.append(_render_text(child, frame))
        elif child.name != "!comment" and not child.is_noise():
            stack.append(_Frame(child, frame))


def _join(parts: list[str]) -> str:
    """Concatenate; newlines that meet at a seam merge, two at most remain."""
    out: list[str] = []
    for part in parts:
        if not part:
            continue
        body = part.lstrip("\n")
        lead = len(part) - len(body)
        if lead and out:
            before = out[-1].rstrip("\n")
            trail = len(out[-1]) - len(before)
            if trail:
                out[-1] = before
                part = "\n" * min(2, max(lead, trail)) + body
        out.append(part)
    return "".join(out)


def _is_block(node) -> bool:
    return isinstance(node, Element) and node.name in BLOCK_TAGS


def _render_text(text: str, frame: _Frame) -> str:
    if frame.preformatted:
        return text
    text = re.sub(r"[\t \r\n]*[\r\n][\t \r\n]*", "\n", text)
    text = re.sub(r"[\t ]+", " ", text)
    if not frame.verbatim:
        text = text.replace("*", r"\*").replace("_", r"\_")
    siblings, i = frame.element.children, frame.position - 1
    at_start = i == 0 and _is_block(frame.element)
    at_end = i == len(siblings) - 1 and _is_block(frame.element)
    if at_start or (i > 0 and _is_block(siblings[i - 1])):
        text = text.lstrip(" \n")
    if at_end or (i + 1 < len(siblings) and _is_block(siblings[i + 1])):
        text = text.rstrip(" \n")
    return text


def _around(mark: str, text: str) -> str:
    """Put a mark around the text and leave outer blanks outside."""
    inner = text.strip()
    if not inner:
        return ""
    lead = " " if text[0] == " " else ""
    trail = " " if text[-1] == " " else ""
    return f"{lead}{mark}{inner}{mark}{trail}"


def _block(text: str) -> str:
    inner = text.strip()
    return f"\n\n{inner}\n\n" if inner else ""


def _indent(text: str, first: str, rest: str) -> str:
    lines = text.split("\n")
    return "\n".join(
        [first + lines[0]] + [(rest + line if line else "") for line in lines[1:]]
    )


def _title_suffix(element: Element) -> str:
    title = element.attrs.get("title")
    return ' "' + title.replace('"', r"\"") + '"' if title else ""


def _render(frame: _Frame, text: str) -> str:
    element, name = frame.element, frame.element.name
    inside = element.parent
    if name in HEADINGS:
        line = " ".join(text.split())
        return f"\n\n{'#' * int(name[1])} {line}\n\n" if line else ""
    if name in EMPHASIS:
        return text if frame.verbatim else _around(EMPHASIS[name], text)
    if name in ("code", "kbd", "samp"):
        if frame.preformatted:
            return text
        ticks = "`" * (1 + max((len(run) for run in re.findall("`+", text)), default=0))
        return _around(ticks, text)
    if name == "pre":
        return f"\n\n```\n{text.strip(chr(10))}\n```\n\n" if text.strip() else ""
    if name == "a":
        return _render_link(frame, text)
    if name == "img":
        alt = " ".join((element.attrs.get("alt") or "").split())
        return f"![{alt}]({element.attrs.get('src') or ''}{_title_suffix(element)})"
    if name == "br":
        return " " if frame.one_line else "  \n"
    if name == "hr":
        return "\n\n---\n\n"
    if name == "blockquote":
        inner = text.strip()
        if not inner or frame.one_line:
            return f" {inner} " if inner else ""
        return "\n\n" + "\n".join(f"> {line}" if line else ">" for line in inner.split("\n")) + "\n\n"
    if name == "li":
        return _render_item(frame, text)
    if name in ("ul", "ol"):
        inner = text.strip("\n")
        if not inner:
            return ""
        return f"\n{inner}\n" if inside is not None and inside.name == "li" else f"\n\n{inner}\n\n"
    if name in ("td", "th"):
        cell = " ".join(text.split()).replace("|", r"\|")
        span = element.attrs.get("colspan", "")
        return f" {cell} |" + " |" * (min(int(span), C.MAX_COLSPAN) - 1 if span.isdigit() else 0)
    if name == "tr":
        return _render_row(frame, text)
    if name == "table":
        inner = text.strip("\n")
        return f"\n\n{inner}\n\n" if inner else ""
    if name in ("tbody", "thead", "tfoot"):
        return text
    if name in BLOCK_TAGS:
        inner = text.strip()
        if frame.one_line:
            return f" {inner} " if inner else ""
        return _block(text)
    return text


def _render_link(frame: _Frame, text: str) -> str:
    element = frame.element
    inner = text.strip()
    if not inner or frame.verbatim:
        return text if frame.verbatim else ""
    href = element.attrs.get("href")
    if not href:
        return text
    lead = " " if text[0] == " " else ""
    trail = " " if text[-1] == " " else ""
    if inner.replace(r"\_", "_") == href and "title" not in element.attrs:
        return f"{lead}<{href}>{trail}"
    return f"{lead}[{inner}]({href}{_title_suffix(element)}){trail}"


def _render_item(frame: _Frame, text: str) -> str:
    element, parent = frame.element, frame.element.parent
    inner = text.strip()
    if not inner:
        return "\n"
    if parent is not None and parent.name == "ol":
        start = parent.attrs.get("start", "")
        place = 0
        for sibling in parent.children:
            if sibling is element:
                break
            place += isinstance(sibling, Element) and sibling.name == "li"
        mark = f"{(int(start) if start.isdigit() else 1) + place}. "
    else:
        mark = BULLETS[max(frame.depth - 1, 0) % len(BULLETS)] + " "
    return _indent(inner, mark, " " * len(mark)) + "\n"


def _render_row(frame: _Frame, text: str) -> str:
    """A table line; the first row is the header, or an empty header precedes it."""
    element, parent = frame.element, frame.element.parent
    cells = [c for c in element.children if isinstance(c, Element) and c.name in ("td", "th")]
    if not cells:
        return ""
    row = "|" + text.replace("\n", "") + "\n"
    width = row.replace(r"\|", "").count("|") - 1
    rule = "|" + " --- |" * width + "\n"

    def leads(node):
        for sibling in node.parent.children:
            if isinstance(sibling, Element) and sibling.name != "!comment":
                return sibling is node
        return False

    group = parent if parent is not None and parent.name in ("thead", "tbody", "tfoot") else None
    is_first = leads(element) and (group is None or leads(group))
    is_header = is_first and (
        all(c.name == "th" for c in cells) or (group is not None and group.name == "thead")
    )
    if is_header:
        return row + rule
    if is_first:
        return "|" + "  |" * width + "\n" + rule + row
    return row
