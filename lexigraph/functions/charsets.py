"""One-byte charsets by table: decoding never fails, and what has no byte becomes F7."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigraph.config import Charset
from lexigraph.errors import InvalidArgument

_CODECS = {Charset.ISO8859_2: "iso8859_2", Charset.CP1250: "cp1250", Charset.CP852: "cp852"}
UNMAPPABLE = 0xF7


def table(charset: Charset) -> list[str]:
    """The character of every byte; undefined bytes have private code points."""
    if charset not in _CODECS:
        raise InvalidArgument("this charset has no byte table")
    out = []
    for b in range(256):
        try:
            out.append(codecs.decode(bytes([b]), _CODECS[charset]))
        except UnicodeDecodeError:
            out.append(chr(0xE000 + b))
    return out


def decode(raw: Column, charset: Charset) -> Column:
    """Text of bytes: read as Latin-1, whose code points are the bytes, then translated."""
    if charset == Charset.UTF8:
        return F.make_valid_utf8(raw.cast("string"))
    chars = table(charset)
    moved = [b for b in range(256) if chars[b] != chr(b)]
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, moved)), "".join(chars[b] for b in moved))


def encode(text: Column, charset: Charset) -> Column:
    """Bytes of a text; a character without a byte becomes F7, of several bytes the last is used."""
    if charset == Charset.UTF8:
        return F.encode(text, "UTF-8")
    chars = table(charset)
    of = {c: b for b, c in enumerate(chars)}
    # bytes as Latin-1 characters; what is not in the table is replaced first
    known = "".join(f"\\x{{{ord(c):X}}}" for c in of)
    safe = F.regexp_replace(text, f"[^{known}]", chars[UNMAPPABLE] if of.get(chars[UNMAPPABLE]) == UNMAPPABLE else chr(UNMAPPABLE))
    moved = [c for c, b in of.items() if ord(c) != b]
    return F.encode(F.translate(safe, "".join(moved), "".join(chr(of[c]) for c in moved)), "ISO-8859-1")
