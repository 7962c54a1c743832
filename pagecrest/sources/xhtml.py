"""Blocks and anchors of an XHTML body."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pagecrest.sources.markup import _RUN, Node, normalize, parse_html

#: Tags that never contribute text.
SKIPPED = set("script style template noscript iframe object embed audio video source track math head title link meta base rt rp select option textarea button".split())
#: Tags that are boxes of their own; all others flow.
FLOW = set("p h1 h2 h3 h4 h5 h6 div section article aside blockquote ul ol li dl dt dd table figure figcaption header footer main nav hr pre address details summary form fieldset".split())
TABLE_PARTS = set("tr td th caption thead tbody tfoot".split())
PICTURES = {"img", "image"}
FLUSH = object()


@dataclass
class Block:
    kind: str  # p, h or img
    text: str | None = None
    level: int | None = None
    image: str | None = None


@dataclass
class Blocks:
    """Walker over a body. `resolve` gives the name of an image's entry, or None to leave it out."""

    resolve: Callable[[str], str | None] | None = None
    blocks: list[Block] = field(default_factory=list)
    anchors: dict[str, int] = field(default_factory=dict)
    run: list[str] = field(default_factory=list)

    def anchor(self, node: Node) -> None:
        names = [node.attrs.get("id")] + ([node.attrs.get("name")] if node.tag == "a" else [])
        for name in names:
            if name:
                self.anchors.setdefault(name, len(self.blocks))

    def say(self, text: str) -> None:
        text = _RUN.sub(" ", text)
        if text and (self.run or text != " "):
            self.run.append(text)

    def flush(self) -> None:
        lines = [normalize(x) for x in "".join(self.run).split("\n")]
        self.run.clear()
        if text := "\n".join(filter(None, lines)):
            self.blocks.append(Block("p", text))

    def picture(self, node: Node) -> None:
        href = node.attrs.get("src")
        if href is None:
            href = next((v for k, v in node.attrs.items() if k == "href" or k.endswith(":href")), None)
        name = self.resolve(href) if href and self.resolve else None
        if name is not None:
            self.blocks.append(Block("img", image=name))

    def flat(self, node: Node) -> str:
        """All text below as one line, boxes apart by a space."""
        out: list[str] = []
        todo: list = list(reversed(node.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            self.anchor(x)
            if x.tag in SKIPPED:
                continue
            if x.tag == "br":
                out.append(" ")
                continue
            apart = [" "] if x.tag in FLOW or x.tag in TABLE_PARTS else []
            todo += [*apart, *reversed(x.children), *apart]
        return normalize("".join(out))

    def add(self, kind: str, text: str, level: int | None = None) -> None:
        if text:
            self.blocks.append(Block(kind, text, level))

    def row(self, row: Node) -> None:
        for x in row.walk():
            if x.attrs.get("id"):
                self.anchor(x)
        self.anchor(row)
        self.add("p", " ".join(filter(None, [self.flat(c) for c in row.elements("td", "th")])))

    def table(self, table: Node) -> None:
        for part in table.elements():
            if part.tag == "tr":
                self.row(part)
                continue
            self.anchor(part)
            if part.tag == "caption":
                self.add("p", self.flat(part))
            elif part.tag in ("thead", "tbody", "tfoot"):
                for row in part.elements("tr"):
                    self.row(row)
            elif part.tag == "colgroup":
                for col in part.elements():
                    self.anchor(col)

    def body(self, body: Node) -> Blocks:
        """Walks in document order with a stack of steps; a step is a child still to be visited or a
        flush at the end of a box. Boxes directly in a box are told apart from those inside flowing
        text, where an svg is ordinary text."""
        todo: list[tuple[object, bool]] = [(c, False) for c in reversed(body.children)]
        while todo:
            x, flowing = todo.pop()
            if x is FLUSH:
                self.flush()
            elif isinstance(x, str):
                self.say(x)
            elif x.tag in SKIPPED:
                self.anchor(x)
            elif x.tag in FLOW or (not flowing and (x.tag in PICTURES or x.tag == "svg")):
                self.flush()
                self.anchor(x)
                if re.fullmatch("h[1-6]", x.tag):
                    self.add("h", self.flat(x), int(x.tag[1]))
                elif x.tag == "table":
                    self.table(x)
                elif x.tag in PICTURES:
                    self.picture(x)
                elif x.tag == "svg":
                    for image in x.walk():
                        if image.tag == "image":
                            self.picture(image)
                elif x.tag != "hr":
                    todo.append((FLUSH, False))
                    todo += [(c, False) for c in reversed(x.children)]
            else:
                self.anchor(x)
                if x.tag == "br":
                    self.run.append("\n")
                elif x.tag in PICTURES:
                    self.flush()
                    self.picture(x)
                else:
                    todo += [(c, True) for c in reversed(x.children)]
        self.flush()
        return self


def blocks_of(html: str, resolve: Callable[[str], str | None] | None = None, known: Collection[str] | None = None) -> Blocks:
    return Blocks(resolve).body(parse_html(html, known))


def html_blocks(pages: DataFrame, key: str, html: str = "html", known: Collection[str] | None = None) -> DataFrame:
    """(key, block_index, kind, text, heading_level) of every page; a null page has none. With `known`,
    a reference of another name, or that no semicolon ends, as in a text that was cut, stays as it is, and
    what stands in angle brackets without a name is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, b.kind, b.text, b.level) for k, h in zip(*(c.to_pylist() for c in batch.columns)) for i, b in enumerate(blocks_of(h or "", known=known).blocks)]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "block_index", "kind", "text", "heading_level"])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(key, html).mapInArrow(run, f"key {kind}, block_index int, kind string, text string, heading_level int")
    return found.withColumnRenamed("key", key)
