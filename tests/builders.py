"""Small books for tests, put together from parts."""

from __future__ import annotations

import base64
import io
import zipfile
from itertools import count

#: Bytes that stand for pictures; no test looks into them.
PICTURE, OTHER_PICTURE = b"\x89PNG picture", bytes(range(200, 256)) * 2
LOCATOR = '<container><rootfiles><rootfile full-path="pkg.opf"/></rootfiles></container>'


def zipped(files: dict[str, bytes | str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in files.items():
            archive.writestr(name, data)
    return held.getvalue()


def tree(entries, branch, leaf) -> str:
    """Entries (label, target, depth) as nested XML: leaf makes an entry around what is below it."""
    stack: list[list] = [[-1, None, []]]
    for label, target, depth in [*entries, (None, None, -1)]:
        while stack[-1][0] >= max(depth, 0):
            _, entry, below = stack.pop()
            stack[-1][2].append(leaf(*entry, branch("".join(below)) if below else ""))
        stack.append([depth, (label, target), []])
    return branch("".join(stack[0][2]))


def epub(pages, contents=(), *, head="<title>Walks</title><creator>Ida Field</creator><language>en</language>", modern=False, files=None, guide=None, picture=None) -> bytes:
    """pages: (path, body or None) in reading order; contents: (label, target, depth), as a navigation page
    if modern, else as NCX; picture: (path, bytes, item's attributes, metadata) of a cover."""
    ids = (f"i{n}" for n in count(1))
    items, refs, packed = [], [], {"META-INF/container.xml": LOCATOR}
    for path, body in pages:
        name = next(ids)
        items.append(f'<item id="{name}" href="{path}"/>')
        refs.append(f'<itemref idref="{name}"/>')
        if body is not None:
            packed[path] = f"<html><body>{body}</body></html>"
    if picture:
        path, data, attributes, more = picture
        items.append(f'<item href="{path}" {attributes}/>')
        head, packed[path] = head + more, data
    if modern:
        listed = tree(contents, lambda x: f"<ol>{x}</ol>", lambda label, target, below: f'<li><a href="{target}">{label}</a>{below}</li>')
        items.append('<item id="go" href="go.xhtml" properties="nav"/>')
        packed["go.xhtml"] = f'<html><body><nav epub:type="toc">{listed}</nav></body></html>'
    elif contents:
        points = tree(contents, lambda x: x, lambda label, target, below: f'<navPoint><navLabel><text>{label}</text></navLabel><content src="{target}"/>{below}</navPoint>')
        items.append('<item id="map" href="map.ncx" media-type="application/x-dtbncx+xml"/>')
        packed["map.ncx"] = f"<ncx><navMap>{points}</navMap></ncx>"
    listed = f'<guide><reference type="toc" href="{guide}"/></guide>' if guide else ""
    packed["pkg.opf"] = f'<package><metadata>{head}</metadata><manifest>{"".join(items)}</manifest><spine>{"".join(refs)}</spine>{listed}</package>'
    return zipped(packed | (files or {}))


ONE_SECTION = "<body><section><title><p>Dawn</p></title><p>A short line.</p></section></body>"


def fb2(bodies=ONE_SECTION, *, writer="<author><first-name>Ida</first-name><last-name>Field</last-name></author>", lang="en", cover=None, binaries="", declared="utf-8", codec=None) -> bytes:
    """declared is the encoding that the prolog names, codec the one that the bytes are in."""
    info = [writer, "<book-title>Hills</book-title>"]
    if cover:
        info.append(f'<coverpage><image l:href="{cover}"/></coverpage>')
    if lang:
        info.append(f"<lang>{lang}</lang>")
    book = f'<FictionBook xmlns:l="http://www.w3.org/1999/xlink"><description><title-info>{"".join(info)}</title-info></description>{bodies}{binaries}</FictionBook>'
    return f'<?xml version="1.0" encoding="{declared}"?>{book}'.encode(codec or declared)


def binary(name: str, data: bytes, kind: str) -> str:
    return f'<binary content-type="{kind}" id="{name}">{base64.encodebytes(data).decode()}</binary>'
