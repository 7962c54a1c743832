"""EPUB books as flat events: container, package, navigation, spine documents and images."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

from pagecrest.functions.text import MEDIA_TYPES, OTHER_MEDIA
from pagecrest.sources.events import Event, Failure
from pagecrest.sources.markup import _RUN, Node, normalize, parse_html, parse_xml
from pagecrest.sources.xhtml import blocks_of

#: Algorithms and extensions of fonts, whose obfuscation locks no text.
FONT_ALGORITHMS = {"http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC"}
FONT_EXTENSIONS = {".ttf", ".otf", ".woff", ".woff2", ".ttc", ".eot"}
NCX = "application/x-dtbncx+xml"
#: Fixed value: characters whose escapes stay when a whole reference is decoded.
RESERVED = set(";/?:@&=+$,#")
_ESCAPES = re.compile("(?:%[0-9A-Fa-f]{2})+")


def decode_full(href: str) -> str:
    """Percent-decoding of a whole reference: escapes of reserved characters stay; a reference with a
    bad escape stays as written."""
    if re.search("%(?![0-9A-Fa-f]{2})", href):
        return href

    def plain(m: re.Match) -> str:
        raw = bytes.fromhex(m[0].replace("%", ""))
        return "".join(f"%{ord(c):02X}" if c in RESERVED else c for c in raw.decode("utf-8"))

    try:
        return _ESCAPES.sub(plain, href)
    except UnicodeDecodeError:
        return href


def tidy_path(path: str) -> str:
    """Without empty and dot segments and a leading slash."""
    path = posixpath.normpath(path) if path else "."
    return path.lstrip("/") if path.startswith("/") else path


def resolve(base: str, href: str) -> str:
    href = decode_full(href)
    return tidy_path(posixpath.join(base, href) if base else href)


def split_fragment(href: str) -> tuple[str, str | None]:
    path, mark, fragment = href.partition("#")
    return path, fragment if mark else None


def extension(path: str) -> str:
    return posixpath.splitext(path)[1].lower()


def guess_media(path: str) -> str:
    return MEDIA_TYPES.get(extension(path)[1:], OTHER_MEDIA)


def tokens(value: str | None) -> set[str]:
    return set(filter(None, _RUN.split(value or "")))


class Container:
    """Entries of a zip by tidy name; the last of a name counts; bytes are inflated when asked for."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError) as e:
            raise Failure("corrupt", "the zip directory of the book cannot be read", str(e)) from e
        self.entries = {tidy_path(i.filename): i for i in self.zip.infolist() if not i.is_dir()}
        self.read_names: list[str] = []

    def has(self, path: str) -> bool:
        return tidy_path(path) in self.entries

    def read(self, path: str) -> bytes | None:
        entry = self.entries.get(tidy_path(path))
        if entry is None:
            return None
        self.read_names.append(tidy_path(path))
        return self.zip.read(entry)

    def text(self, path: str) -> str | None:
        data = self.read(path)
        return None if data is None else data.decode("utf-8", "replace").removeprefix("﻿")


def is_locked(container: Container) -> bool:
    """Whether the container declares encryption of anything but fonts."""
    if container.has("META-INF/rights.xml"):
        return True
    xml = container.text("META-INF/encryption.xml")
    if xml is None:
        return False
    try:
        root = parse_xml(xml)
    except expat.ExpatError:
        return False
    for node in (n for n in (root, *root.walk()) if n.local == "EncryptedData"):
        method = next((n for n in node.walk() if n.local == "EncryptionMethod"), None)
        if method is not None and method.attrs.get("Algorithm") in FONT_ALGORITHMS:
            continue
        target = next((n for n in node.walk() if n.local == "CipherReference"), None)
        if target is not None and extension(target.attrs.get("URI", "")) in FONT_EXTENSIONS:
            continue
        return True
    return False


@dataclass
class Item:
    id: str
    href: str
    media: str
    properties: set[str]


@dataclass
class Package:
    base: str
    title: str | None = None
    language: str | None = None
    cover_id: str | None = None
    toc_id: str | None = None
    authors: list[str] = field(default_factory=list)
    items: dict[str, Item] = field(default_factory=dict)
    spine: list[str] = field(default_factory=list)
    guide: list[tuple[str, str]] = field(default_factory=list)

    def path(self, item: Item) -> str:
        return resolve(self.base, item.href)

    def with_property(self, name: str) -> Iterator[Item]:
        return (i for i in self.items.values() if name in i.properties)


def read_package(xml: str, path: str) -> Package:
    root = parse_xml(xml)
    out = Package(posixpath.dirname(path))
    for node in (m.elements() for m in [root.first("metadata")] if m):
        for child in node:
            text = normalize(child.text())
            if child.local == "title":
                out.title = out.title or text or None
            elif child.local == "creator" and text:
                out.authors.append(text)
            elif child.local == "language":
                out.language = out.language or text or None
            elif child.local == "meta" and child.attrs.get("name") == "cover":
                out.cover_id = child.attrs.get("content") or out.cover_id
    if manifest := root.first("manifest"):
        for item in manifest.elements("item"):
            a = item.attrs
            if "id" in a and "href" in a:
                out.items[a["id"]] = Item(a["id"], a["href"], a.get("media-type", ""), tokens(a.get("properties")))
    if spine := root.first("spine"):
        out.toc_id = spine.attrs.get("toc")
        out.spine = [r.attrs["idref"] for r in spine.elements("itemref") if "idref" in r.attrs]
    if guide := root.first("guide"):
        out.guide = [(r.attrs["type"], r.attrs["href"]) for r in guide.elements("reference") if "type" in r.attrs and "href" in r.attrs]
    return out


def opened(data: bytes) -> tuple[Container, Package]:
    container = Container(data)
    try:
        if is_locked(container):
            raise Failure("drmProtected", "the book is locked: more than its fonts is encrypted, or it has a rights file")
        xml, path = container.text("META-INF/container.xml"), None
        if xml is not None:
            try:
                root = parse_xml(xml)
                path = next((n.attrs["full-path"] for n in (root, *root.walk()) if n.local == "rootfile" and n.attrs.get("full-path")), None)
            except expat.ExpatError:
                path = None
        if path is None:
            raise Failure("corrupt", "no package path: META-INF/container.xml is absent or unreadable")
        path = resolve("", path)
        package = container.text(path)
        if package is None:
            raise Failure("corrupt", f"the package {path} is missing from the zip")
        return container, read_package(package, path)
    except Failure:
        raise
    except expat.ExpatError as e:
        raise Failure("corrupt", "the package is no XML", str(e)) from e
    except Exception as e:  # damage inside the archive
        raise Failure("corrupt", "the container is damaged", str(e)) from e


def metadata(container: Container, package: Package) -> Iterator[Event]:
    """Metadata and, if there is one, the cover image."""
    meta = Event("meta", text=package.title, name=package.language, authors=package.authors)
    as_image = lambda i: i if i and i.media.startswith("image/") else None
    cover = next(package.with_property("cover-image"), None) or as_image(package.items.get(package.cover_id)) or as_image(package.items.get("cover"))
    data = container.read(package.path(cover)) if cover else None
    if data is not None:
        meta.cover = package.path(cover)
        yield meta
        # The cover's media type is its own item's; blocks take the first item of the path.
        yield Event("image", sub="cover", name=meta.cover, media=cover.media or guess_media(cover.href), data=data)
    else:
        yield meta


def ncx_entries(xml: str, base: str) -> Iterator[Event]:
    root = parse_xml(xml)
    top = next((n for n in (root, *root.walk()) if n.local == "navMap"), None)
    todo = [(p, 0) for p in reversed(list(top.elements("navPoint")))] if top else []
    while todo:
        point, depth = todo.pop()
        label = src = None
        for child in point.elements("navLabel", "content"):
            if child.local == "content":
                src = child.attrs.get("src")
            elif text := child.first("text"):
                label = normalize(text.text())
        if src:
            path, fragment = split_fragment(src)
            yield Event("nav", text=label or "", name=resolve(base, path), fragment=fragment, level=depth)
        todo += [(p, depth + 1) for p in reversed(list(point.elements("navPoint")))]


def nav_entries(html: str, base: str) -> Iterator[Event]:
    """Entries of the contents list, and paths that the landmarks declare to be contents."""
    navs = [n for n in parse_html(html).walk() if n.tag == "nav"]
    of_type = lambda n, kind: kind in tokens(n.attrs.get("epub:type"))
    toc = next((n for n in navs if of_type(n, "toc") or "doc-toc" in tokens(n.attrs.get("role"))), navs[0] if navs else None)
    todo: list[tuple[Node, int]] = [(o, 0) for o in reversed(list(toc.elements("ol")))] if toc else []
    while todo:
        node, depth = todo.pop()
        if node.tag == "a":
            if href := node.attrs.get("href"):
                path, fragment = split_fragment(href)
                yield Event("nav", text=normalize(node.text()), name=resolve(base, path), fragment=fragment, level=depth)
        else:
            below = [(c, depth if c.tag == "a" else depth + 1) for item in node.elements("li") for c in item.elements("a", "ol")]
            todo += reversed(below)
    marks = next((n for n in navs if of_type(n, "landmarks")), None)
    for a in (n for n in marks.walk() if n.tag == "a") if marks else ():
        if of_type(a, "toc") and a.attrs.get("href"):
            yield Event("toc", name=resolve(base, split_fragment(a.attrs["href"])[0]))


def navigation(container: Container, package: Package) -> list[Event]:
    for item in package.with_property("nav"):
        path = package.path(item)
        if (html := container.text(path)) is not None:
            return list(nav_entries(html, posixpath.dirname(path)))
    item = package.items.get(package.toc_id) or next((i for i in package.items.values() if i.media == NCX), None)
    xml = container.text(package.path(item)) if item else None
    try:
        return list(ncx_entries(xml, posixpath.dirname(package.path(item)))) if xml is not None else []
    except expat.ExpatError:
        return []


def parse(data: bytes) -> Iterator[Event]:
    """All events of a book; raises Failure."""
    container, package = opened(data)
    try:
        yield from metadata(container, package)
        events = navigation(container, package)
        for seq, e in enumerate(x for x in events if x.kind == "nav"):
            e.seq, e.decoded = seq, decode_full(e.fragment) if e.fragment is not None else None
        yield from events
        for kind, href in package.guide:
            if kind.lower() == "toc":
                yield Event("toc", name=resolve(package.base, split_fragment(href)[0]))
        for item in package.with_property("nav"):
            yield Event("toc", name=package.path(item))
        media: dict[str, str] = {}
        for item in package.items.values():
            if item.media:
                media.setdefault(package.path(item), item.media)
        used: dict[str, None] = {}
        paths = [package.path(package.items[r]) for r in package.spine if r in package.items]
        for pos, path in enumerate(paths):
            html = container.text(path)
            if html is None:
                yield Event("spine", pos=pos, name=path, flag=False, n=0)
                continue
            base = posixpath.dirname(path)

            def found(href: str, base: str = base) -> str | None:
                name = resolve(base, split_fragment(href)[0])
                return name if container.has(name) else None

            walked = blocks_of(html, found)
            yield Event("spine", pos=pos, name=path, flag=True, n=len(walked.blocks))
            for idx, b in enumerate(walked.blocks):
                if b.image is not None:
                    used[b.image] = None
                yield Event("block", sub=b.kind, pos=pos, idx=idx, text=b.text, level=b.level, name=b.image)
            for name, idx in walked.anchors.items():
                yield Event("anchor", pos=pos, name=name, idx=idx)
        for name in used:
            yield Event("image", name=name, media=media.get(name) or guess_media(name), data=container.read(name))
        yield Event("full")
    except Exception as e:  # damage inside an entry
        raise Failure("corrupt", "an entry of the book is damaged", str(e)) from e


def parse_metadata(data: bytes) -> Iterator[Event]:
    """Metadata and cover; reads the container, the package and the cover alone."""
    container, package = opened(data)
    try:
        yield from metadata(container, package)
        for name in container.read_names:
            yield Event("entry", name=name)
    except Exception as e:  # damage inside the cover's entry
        raise Failure("corrupt", "the entry of the cover is damaged", str(e)) from e
