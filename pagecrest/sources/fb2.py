"""FB2 books as flat events."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from xml.parsers import expat

from pagecrest.functions.text import OTHER_MEDIA, PY_WS
from pagecrest.sources.encoding import UnsupportedEncoding, decode_fb2
from pagecrest.sources.events import Event, Failure
from pagecrest.sources.markup import Node, XmlTree, normalize, parse_xml, run_expat

#: Elements that are one paragraph, and those that only hold others.
PARAGRAPHS = {"p", "v", "text-author", "code"}
HOLDERS = {"epigraph", "cite", "annotation"}


def decode_base64(text: str) -> bytes | None:
    packed = re.sub(f"[{PY_WS}]+", "", text)
    if not packed:
        return None
    try:
        return base64.b64decode(packed.replace("-", "+").replace("_", "/"), validate=True)
    except (binascii.Error, ValueError):
        return None


def title_text(title: Node) -> str:
    lines = " ".join(filter(None, (normalize(p.text()) for p in title.elements("p"))))
    return lines or normalize(title.text())


class Binaries:
    """Binaries by id; the first of an id counts."""

    def __init__(self, root: Node):
        self.by_id: dict[str, Node] = {}
        for node in root.elements("binary"):
            if "id" in node.attrs:
                self.by_id.setdefault(node.attrs["id"], node)
        self.decoded: dict[str, bytes | None] = {}

    def resolve(self, image: Node) -> str | None:
        """Id of an image's binary, if it can be read."""
        href = image.attribute("href")
        if not href or not href.startswith("#") or href[1:] not in self.by_id:
            return None
        name = href[1:]
        if name not in self.decoded:
            self.decoded[name] = decode_base64(self.by_id[name].text())
        return name if self.decoded[name] is not None else None

    def event(self, name: str) -> Event:
        return Event("image", name=name, media=self.by_id[name].attrs.get("content-type", OTHER_MEDIA), data=self.decoded[name])


def description_events(info: Node | None) -> tuple[Event, Node | None]:
    """Metadata of a title-info, and the image of its cover page."""
    if info is None:
        return Event("meta", authors=[]), None
    part = lambda node, name: normalize(x.text()) if (x := node.first(name)) else ""
    authors = []
    for author in info.elements("author"):
        names = [part(author, f"{k}-name") for k in ("first", "middle", "last")]
        authors.append(" ".join(filter(None, names)) or part(author, "nickname"))
    page = info.first("coverpage")
    meta = Event("meta", text=part(info, "book-title") or None, authors=list(filter(None, authors)), name=part(info, "lang") or None)
    return meta, page.first("image") if page else None


def element_blocks(top: Node, level: int, binaries: Binaries) -> Iterator[Event]:
    """Blocks of one construct. Whatever is not known keeps its text as a paragraph."""
    todo = [(top, False)]
    while todo:
        node, in_poem = todo.pop()
        kind, block = node.local, None
        if kind == "title":
            block = Event("block", sub="h", text=title_text(node), level=level + (2 if in_poem else 1))
        elif kind == "subtitle":
            block = Event("block", sub="h", text=normalize(node.text()), level=level + 2)
        elif kind == "empty-line":
            continue
        elif kind == "stanza":
            block = Event("block", sub="p", text="\n".join(filter(None, (normalize(v.text()) for v in node.elements("v")))))
        elif kind == "poem" or kind in HOLDERS:
            todo += [(c, kind == "poem") for c in reversed(list(node.elements()))]
            continue
        elif kind == "table":
            for row in node.walk():
                if row.local == "tr" and enclosing_table(row) is node:
                    if cells := " ".join(filter(None, (normalize(c.text()) for c in row.elements("td", "th")))):
                        yield Event("block", sub="p", text=cells)
            continue
        elif kind == "image":
            if (name := binaries.resolve(node)) is not None:
                yield Event("block", sub="img", name=name)
            continue
        else:
            block = Event("block", sub="p", text=normalize(node.text()))
        if block.text:
            yield block


def enclosing_table(node: Node) -> Node | None:
    node = node.parent
    while node is not None and node.local != "table":
        node = node.parent
    return node


def chapters(root: Node, binaries: Binaries) -> Iterator[list[Event]]:
    """For each body its preamble, then its sections from the outermost in, as a chapter event and
    its block events; only those with blocks."""
    for body in root.elements("body"):
        todo = [(body, 0)]
        while todo:
            part, level = todo.pop()
            title, blocks = None, []
            for child in part.elements():
                if child.local == "section":
                    continue
                if child.local == "title" and not title:
                    title = title_text(child) or None
                blocks += element_blocks(child, level, binaries)
            if blocks:
                yield [Event("chapter", text=title, level=level), *blocks]
            below = level if part is body else level + 1
            todo += [(s, below) for s in reversed(list(part.elements("section")))]


def _decoded(data: bytes) -> str:
    try:
        return decode_fb2(data)
    except UnsupportedEncoding as e:
        raise Failure("encoding", f"no codec reads the declared encoding {e}", str(e)) from e


def parse(data: bytes) -> Iterator[Event]:
    """All events of a book; raises Failure."""
    text = _decoded(data)
    try:
        root = parse_xml(text)
    except expat.ExpatError as e:
        raise Failure("corrupt", "the book is no XML", str(e)) from e
    if root.local != "FictionBook":
        raise Failure("unsupportedFormat", f"the XML is a {root.local}, not a FictionBook")
    binaries = Binaries(root)
    description = root.first("description")
    meta, cover = description_events(description.first("title-info") if description else None)
    used = {}
    if cover is not None and (name := binaries.resolve(cover)) is not None:
        meta.cover = name
        used[name] = None
    found = list(chapters(root, binaries))
    if not found:
        raise Failure("emptyDocument", "no section has any text or image")
    yield meta
    for at, (chapter, *blocks) in enumerate(found):
        chapter.pos = at
        yield chapter
        for k, block in enumerate(blocks):
            block.pos, block.idx = at, k
            if block.sub == "img":
                used[block.name] = None
            yield block
    for name in used:
        yield binaries.event(name)


class _Enough(Exception):
    """All metadata has been read."""


class MetadataReader:
    """Reads a book only as far as its metadata needs: the first title-info of the first description
    as a small tree, then the binary of the cover."""

    def __init__(self, wanted: str | None = None):
        self.wanted, self.path = wanted, []
        self.tree: XmlTree | None = None
        self.info: Node | None = None
        self.info_seen = self.description_done = False
        self.meta: Event | None = None
        self.early: set[str] = set()
        self.binary: list[str] | None = None
        self.media = OTHER_MEDIA
        self.cover: bytes | None = None

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        name, depth = tag.rpartition(":")[2], len(self.path)
        if depth == 0 and name != "FictionBook":
            raise Failure("unsupportedFormat", "the XML is not a FictionBook")
        if self.tree is not None:
            self.tree.start(tag, attrs)
        elif depth == 2 and self.path[1] == "description" and name == "title-info" and not self.info_seen and not self.description_done:
            self.info_seen, self.tree = True, XmlTree()
            self.tree.start(tag, attrs)
        elif depth == 1 and name == "binary" and "id" in attrs and self.binary is None:
            if self.description_done or self.wanted:
                if attrs["id"] == self.wanted and self.cover is None:
                    self.binary, self.media = [], attrs.get("content-type", OTHER_MEDIA)
            else:
                self.early.add(attrs["id"])
        self.path.append(name)

    def data(self, text: str) -> None:
        if self.tree is not None:
            self.tree.data(text)
        elif self.binary is not None:
            self.binary.append(text)

    def end(self, tag: str) -> None:
        name = self.path.pop()
        depth = len(self.path)
        if self.tree is not None:
            root = self.tree.root
            self.tree.end(tag)
            if self.tree.at is None:
                self.info, self.tree = root, None
        elif depth == 1 and name == "binary" and self.binary is not None:
            self.cover = decode_base64("".join(self.binary))
            raise _Enough
        elif depth == 1 and name == "description" and not self.description_done:
            self.description_done = True
            self.meta, image = description_events(self.info)
            href = image.attribute("href") if image is not None else None
            if not self.wanted:
                self.wanted = href[1:] if href and href.startswith("#") else None
            if not self.wanted or self.wanted in self.early:
                raise _Enough


def parse_metadata(data: bytes) -> Iterator[Event]:
    """Metadata and cover; what comes after them is never read, so it may be damaged."""
    text = _decoded(data)
    reader = MetadataReader()
    try:
        try:
            run_expat(text, reader.start, reader.end, reader.data)
        except _Enough:
            pass
        meta = reader.meta or description_events(reader.info)[0]
        if reader.wanted in reader.early:  # the cover's binary came before the description
            again = MetadataReader(reader.wanted)
            try:
                run_expat(text, again.start, again.end, again.data)
            except _Enough:
                pass
            reader.cover, reader.media = again.cover, again.media
    except expat.ExpatError as e:
        raise Failure("corrupt", "the description is no XML", str(e)) from e
    if reader.cover is not None:
        meta.cover = reader.wanted
        yield meta
        yield Event("image", name=reader.wanted, media=reader.media, data=reader.cover)
    else:
        yield meta
