"""Text out of FB2 bytes: byte order marks, declared encodings, and recovery of mislabelled UTF-8."""

from __future__ import annotations

import re

#: Declared names and the codecs that read them.
CODECS = {
    "utf-8": "utf-8", "utf8": "utf-8", "us-ascii": "utf-8", "ascii": "utf-8",
    "windows-1251": "cp1251", "cp1251": "cp1251", "windows1251": "cp1251", "x-cp1251": "cp1251",
    "windows-1250": "cp1250", "cp1250": "cp1250", "windows-1252": "cp1252", "cp1252": "cp1252",
    "koi8-r": "koi8-r", "koi8r": "koi8-r", "koi8-u": "koi8-u", "koi8u": "koi8-u",
    "iso-8859-1": "latin-1", "latin1": "latin-1", "l1": "latin-1",
}
#: Fixed value: share of replacement characters up to which a text passes for UTF-8.
DAMAGE = 0.02
PROLOG = re.compile(r"\A(?:\xef\xbb\xbf)?\s*<\?xml\s([^>]*?)\?>", re.S)
DECLARED = re.compile(r"""encoding\s*=\s*["']([\w-]+)["']""", re.I)
LOWER, CYRILLIC = re.compile("[а-яё]"), re.compile("[Ѐ-ӿ]")


class UnsupportedEncoding(Exception):
    """The prolog declares an encoding that has no codec here."""


def declared_encoding(data: bytes) -> str | None:
    """Name in the XML prolog within the first 1,024 bytes, in lower case."""
    prolog = PROLOG.match(data[:1024].decode("latin-1"))
    name = DECLARED.search(prolog[1]) if prolog else None
    return name[1].lower() if name else None


def _damage(text: str) -> int:
    return text.count("�")


def lowercase_share(text: str) -> float:
    """Share of lower-case letters among the Cyrillic ones; real prose is mostly lower case."""
    n = len(CYRILLIC.findall(text))
    return len(LOWER.findall(text)) / n if n else 0.0


def recover(data: bytes) -> str:
    """UTF-8 if the text holds up as that, else the legacy Cyrillic reading that looks most like prose."""
    text = data.decode("utf-8", "replace")
    bad = _damage(text)
    if bad <= DAMAGE * len(text):
        return text
    best, share = text, -1.0
    for codec in ("cp1251", "koi8-r"):
        other = data.decode(codec, "replace")
        if _damage(other) < bad and lowercase_share(other) > share:
            best, share = other, lowercase_share(other)
    return best


def decode_fb2(data: bytes) -> str:
    for mark, codec in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[2 : len(data) // 2 * 2].decode(codec, "replace")
    name = declared_encoding(data)
    codec = CODECS.get(name or "utf-8")
    if codec is None:
        raise UnsupportedEncoding(name)
    if codec == "utf-8":
        return recover(data.removeprefix(b"\xef\xbb\xbf"))
    return data.decode(codec, "replace")
