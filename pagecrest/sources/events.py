"""The flat rows that parsers emit; everything after them is DataFrame work."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

#: Columns of an event beside its book: which of them are set depends on kind.
SCHEMA = (
    "kind string, sub string, pos int, idx int, seq int, text string, name string, fragment string, decoded string, "
    "level int, flag boolean, n int, authors array<string>, cover string, media string, data binary, message string, cause string"
)


@dataclass
class Event:
    """meta: text title, name language, authors, cover. chapter: pos, text title, level. block: pos, idx,
    sub p/h/img, text, level, name of image. image: name, media, data. spine: pos, name path, flag if
    its bytes exist, n blocks. nav: seq, text label, name path, fragment, decoded, level depth. toc: name
    path. anchor: pos, name id, idx. failure: sub kind, message, cause. entry: name of an entry read."""

    kind: str
    sub: str | None = None
    pos: int | None = None
    idx: int | None = None
    seq: int | None = None
    text: str | None = None
    name: str | None = None
    fragment: str | None = None
    decoded: str | None = None
    level: int | None = None
    flag: bool | None = None
    n: int | None = None
    authors: list[str] | None = field(default=None)
    cover: str | None = None
    media: str | None = None
    data: bytes | None = None
    message: str | None = None
    cause: str | None = None


NAMES = [f.name for f in fields(Event)]


class Failure(Exception):
    """A book that cannot be read: corrupt, unsupportedFormat, encoding, emptyDocument, drmProtected."""

    def __init__(self, kind: str, message: str, cause: str | None = None):
        super().__init__(message)
        self.kind, self.message, self.cause = kind, message, cause

    def event(self) -> Event:
        return Event("failure", sub=self.kind, message=self.message, cause=self.cause)
