"""XHTML documents as trees with byte offsets: small helpers for tasks that read or rewrite one document.

A document is never written anew from its tree. Translations and language marks
are spliced into the original bytes at the places the tree names, so all else,
the document type included, stays as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import name2codepoint
from xml.parsers import expat
from xml.sax.saxutils import escape

# Elements that are blocks of text, and those whose content isn't text.
BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre div section article aside header footer figure ul ol dl table tr tbody thead tfoot nav hr body".split()
)
OPAQUE = frozenset("svg math img image object video audio iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Meanings of elements that are reference matter, aren't read aloud, or are notes.
REFERENCE_TYPES = frozenset("bibliography index".split())
SKIP_TYPES = frozenset("cover titlepage toc copyright-page index".split())
NOTE_TYPES = frozenset("footnote endnote rearnote".split())
# References that XML itself knows, and namespaces.
XML_NAMES = frozenset("amp lt gt quot apos".split())
OPS, XML_NS, DC = "http://www.idpf.org/2007/ops", "http://www.w3.org/XML/1998/namespace", "http://purl.org/dc/elements/1.1/"

_NAMED = re.compile(rb"&[A-Za-z][A-Za-z0-9]*;")
_START_TAG = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")
_LETTER = re.compile(r"[^\W\d_]")


class MarkupError(ValueError):
    """A document or an answer that is not well-formed."""


#: HTML's named references, but for those that XML has too, as numeric ones.
_NUMERIC = {f"&{name};".encode(): f"&#{point};".encode() for name, point in name2codepoint.items() if name not in XML_NAMES}


def numeric_references(data: bytes) -> bytes:
    """HTML's named references become numeric ones; XML's own and unknown names stay."""
    return _NAMED.sub(lambda found: _NUMERIC.get(found[0], found[0]), data) if b"&" in data else data


_NO_MEANINGS: frozenset[str] = frozenset()


def _meanings(attributes: dict[str, str]) -> frozenset[str]:
    """What an element is, by its type and its role: each name, and what follows a leading ``doc-``."""
    named = f"{attributes.get(OPS + ' type', '')} {attributes.get('role', '')}".split()
    return frozenset(x for name in named for x in (name, name[4:] if name.startswith("doc-") else name)) if named else _NO_MEANINGS


@dataclass(eq=False)
class Node:
    tag: str  # without namespace
    namespace: str
    attributes: dict[str, str]  # "namespace name" or "name"
    parent: Node | None
    start: int  # of the start tag
    inner: int = 0  # its end
    close: int = 0  # of the end tag; for one without content, as inner
    end: int = 0
    content: list[Node | str] = field(default_factory=list)
    meanings: frozenset[str] = frozenset()
    outer: bool = False  # a block with a block inside

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.content) if isinstance(x, Node))

    def up(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def text(self, opaque: bool = True) -> str:
        """Its text; without what is inside opaque elements unless ``opaque``."""
        if len(self.content) == 1 and isinstance(self.content[0], str):
            return self.content[0]
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif opaque or x.tag not in OPAQUE:
                stack.extend(reversed(x.content))
        return "".join(out)


@dataclass
class Document:
    data: bytes
    root: Node

    def raw(self, a: int, b: int) -> bytes:
        return self.data[a:b]


def parse(data: bytes) -> Document:
    """Parses a document; comments and instructions are left out, text around them joined. No entity is expanded and nothing is loaded."""
    data = numeric_references(data)
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = False
    open_nodes: list[Node] = []
    roots: list[Node] = []

    def put(text: str) -> None:
        if open_nodes:
            content = open_nodes[-1].content
            if content and isinstance(content[-1], str):
                content[-1] += text
            else:
                content.append(text)

    def start(name: str, attributes: dict[str, str]) -> None:
        namespace, _, tag = name.rpartition(" ")
        node = Node(tag, namespace, attributes, open_nodes[-1] if open_nodes else None, parser.CurrentByteIndex)
        node.meanings = _meanings(attributes) if attributes else _NO_MEANINGS
        if tag in BLOCKS:
            up = node.parent
            while up is not None and not up.outer:  # all above a marked one are marked
                up.outer, up = True, up.parent
        node.inner = _START_TAG.match(data, node.start).end()
        (open_nodes[-1].content if open_nodes else roots).append(node)
        open_nodes.append(node)

    def end(name: str) -> None:
        node = open_nodes.pop()
        if data[node.inner - 2 : node.inner] == b"/>":
            node.close = node.end = node.inner
        else:
            node.close = parser.CurrentByteIndex
            node.end = data.index(b">", node.close) + 1

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, put
    parser.DefaultHandler = lambda text: None  # an internal entity is passed here, unexpanded
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise MarkupError(str(e)) from None
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise MarkupError("documents in UTF-16 aren't taken")
    return Document(data, roots[0])


def segments(document: Document) -> list[Node]:
    """Blocks of the first body that hold a letter, outside opaque elements, and no other block."""
    body = next((n for n in document.root.walk() if n.tag == "body"), None)
    if body is None:
        return []
    return [n for n in body.walk() if n.tag in BLOCKS and not n.outer and n.tag not in ("body", "hr") and _LETTER.search(n.text(opaque=False))]


def inline_nodes(segment: Node) -> list[Node]:
    """Elements inside a segment in document order, without what is inside an opaque one. The first is number 1."""
    out: list[Node] = []
    stack = [x for x in reversed(segment.content) if isinstance(x, Node)]
    while stack:
        node = stack.pop()
        out.append(node)
        if node.tag not in OPAQUE:
            stack.extend(x for x in reversed(node.content) if isinstance(x, Node))
    return out


def numbered(segment: Node) -> str:
    """A segment's content with its elements as numbered tags without attributes."""
    if not any(isinstance(x, Node) for x in segment.content):
        return escape("".join(segment.content))
    number = {id(n): i for i, n in enumerate(inline_nodes(segment), 1)}

    def inside(node: Node) -> str:
        out = []
        for x in node.content:
            if isinstance(x, str):
                out.append(escape(x))
            else:
                own = "" if x.tag in OPAQUE else inside(x)
                head = f'{x.tag} n="{number[id(x)]}"'
                out.append(f"<{head}>{own}</{x.tag}>" if own else f"<{head}/>")
        return "".join(out)

    return inside(segment)


def spliced(document: Document, segment: Node, translated: str) -> bytes:
    """The bytes of a segment's content for a translation in numbered markup.

    Each numbered tag becomes the element of that number with its own start
    tag, and an opaque one whole, in whatever order they come.
    """
    originals = inline_nodes(segment)

    def inside(node: Node) -> bytes:
        out = []
        for x in node.content:
            if isinstance(x, str):
                out.append(escape(x).encode())
                continue
            own = originals[int(x.attributes["n"]) - 1]
            if own.tag in OPAQUE:
                out.append(document.raw(own.start, own.end))
                continue
            head, content = document.raw(own.start, own.inner), inside(x)
            if head.endswith(b"/>"):
                name = re.match(rb"<([^\s/>]+)", head)[1]
                out.append(head if not content else head[:-2].rstrip() + b">" + content + b"</" + name + b">")
            else:
                out.append(head + content + document.raw(own.close, own.end))
        return b"".join(out)

    return inside(parse(b"<seg>" + translated.encode() + b"</seg>").root)


def rewrite(document: Document, edits: list[tuple[int, int, bytes]]) -> bytes:
    """The document's bytes with ranges replaced; the ranges don't overlap."""
    out, at = [], 0
    for a, b, data in sorted(edits):
        out += [document.data[at:a], data]
        at = b
    return b"".join([*out, document.data[at:]])


def language_edits(document: Document, language: str) -> list[tuple[int, int, bytes]]:
    """Edits that state the language: in each attribute that names one, and in both on the root of a page."""
    edits = []
    for node in document.root.walk():
        head = document.raw(node.start, node.inner)
        new = re.sub(rb"""(\s(?:xml:)?lang\s*=\s*)(?:"[^"]*"|'[^']*')""", lambda m: m[1] + b'"' + language.encode() + b'"', head)
        if node is document.root:
            wanted = [b"xml:lang"] + [b"lang"] * (node.tag == "html")
            for name in wanted:
                if not re.search(rb"\s" + re.escape(name) + rb"\s*=", new):
                    cut = len(new) - (2 if new.endswith(b"/>") else 1)
                    new = new[:cut].rstrip() + b" " + name + b'="' + language.encode() + b'"' + new[cut:]
        if new != head:
            edits.append((node.start, node.inner, new))
    return edits


def signature(markup: str) -> list[str]:
    """The numbered tags of a segment, as number and name, in order of their text."""
    return sorted(f"{n.attributes.get('n', '')} {n.tag}" for n in parse(f"<seg>{markup}</seg>".encode()).root.walk() if n.parent is not None)
